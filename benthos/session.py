"""Session, durable intermediates and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", app: str = "benthos", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what spark.checkpoint.dir names. Only where that is unset (tests on one machine) is a
    temporary folder made, and then set for the session's checkpoints too."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
            named = "file://" + tempfile.mkdtemp(prefix="benthos-checkpoint-")
        sc.setCheckpointDir(named)
    return named or current.get()


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, if they don't already find it on PYTHONPATH."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_benthos_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="benthos-code-")) / "benthos_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "benthos").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._benthos_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are task slots. Inputs of more splits than slots are left alone, so a large
    scan never pays a shuffle; a file too small to be split gets its costly per-row work distributed."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
