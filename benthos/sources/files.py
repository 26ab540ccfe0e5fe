"""JSON, JSON lines and TSV files, read with a schema; results written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "array<struct<`from`:string,value:string,role:string,content:string>>"
SAMPLE = f"id string, image string, images array<string>, video string, conversations {TURN}, num_tokens int"


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file by its ending: .jsonl by line, .json as a whole; others are refused. Absent keys are null."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError(f"neither .json nor .jsonl: {path}")
    reader = spark.read.option("multiLine", path.endswith(".json"))
    return (reader.schema(schema) if schema else reader).json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples with image as a list (one path, or a JSON list of them) and turns as (speaker, value), whichever names they have."""
    raw = read_json(spark, path, SAMPLE)
    one = F.when(F.col("image").startswith("["), F.from_json("image", "array<string>")).when(F.col("image").isNotNull(), F.array("image"))
    turns = F.transform("conversations", lambda t: F.struct(F.coalesce(t["from"], t["role"]).alias("speaker"), F.coalesce(t["value"], t["content"]).alias("value")))
    return raw.select("id", F.coalesce(one, "images").alias("image"), "video", turns.alias("conversations"), "num_tokens")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; null-like cells are null."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(*(F.when(~F.lower(F.trim(c)).isin("nan", "none", ""), F.col(c)).alias(c) for c in df.columns))


def read_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files of a folder, their contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_problems(spark: SparkSession, problems: str, splits: str, split: str) -> DataFrame:
    """(pid, choices, answer) of a map of problems, those that the split lists."""
    whole = spark.read.option("wholetext", True).text(problems).select(F.explode(F.from_json("value", "map<string,struct<choices:array<string>,answer:int>>")).alias("pid", "p")).select("pid", "p.*")
    listed = spark.read.option("wholetext", True).text(splits).select(F.explode(F.from_json("value", "map<string,array<string>>")[split]).alias("pid"))
    return whole.join(listed, "pid", "left_semi")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_write(df: DataFrame, good: str, path: str) -> None:
    """Rows by a boolean column to <path>_valid and <path>_problems; rows where it is null have a problem."""
    df = df.persist()
    write_json(df.where(F.coalesce(good, F.lit(False))), f"{path}_valid")
    write_json(df.where(~F.coalesce(good, F.lit(False))), f"{path}_problems")
    df.unpersist()


def metric_document(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(key columns, metrics): each row's other columns as one JSON object."""
    return metrics.select(*keys, F.to_json(F.struct(*(c for c in metrics.columns if c not in keys)), {"ignoreNullFields": "false"}).alias("metrics"))


def unseen(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't done yet."""
    return new.join(done.select(key).distinct(), key, "left_anti")
