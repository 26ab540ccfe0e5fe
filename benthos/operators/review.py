"""Reviews and answers beside their questions: joins with a guard or a default, documents, requeries, registries, selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.functions import text as T

Metric = Callable[[DataFrame], DataFrame]


class MissingKeys(ValueError):
    """A key that the other side must have isn't there."""


def guarded(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join; it fails if a row of left has no partner (null keys among them), with the number of such rows."""
    n = left.join(right, keys, "left_anti").count()
    if n:
        raise MissingKeys(f"{n} rows without a partner by {keys}")
    return left.join(right, keys)


def with_default(left: DataFrame, dimension: DataFrame, key: str, default: str) -> DataFrame:
    """Each row with its row of the dimension (key, ...), or else the one of `default`. The dimension is a small table of names."""
    known = dimension.select(F.col(key).alias("_k"))
    found = left.join(F.broadcast(known), F.col(key) == F.col("_k"), "left").withColumn("_use", F.coalesce("_k", F.lit(default))).drop("_k")
    return found.join(F.broadcast(dimension.withColumnRenamed(key, "_use")), "_use").drop("_use")


def context_text(captions: Column, labels: Column | None = None) -> Column:
    """Captions a line each, then `label: box` lines of what the picture holds."""
    lines = F.array_join(captions, "\n")
    return lines if labels is None else F.concat_ws("\n", F.when(lines != "", lines), F.when(F.size(labels) > 0, F.array_join(labels, "\n")))


def marked_names(c: Column, first: str = "Assistant 1", second: str = "Assistant 2") -> Column:
    """A review without its first line, if that begins with two numbers, and with the two names in bold."""
    body = F.regexp_replace(F.trim(c), r"^\d+[, ]+\d+[^\n]*(?:\n|\z)", "")
    return F.replace(F.replace(body, F.lit(first), F.lit(f"**{first}**")), F.lit(second), F.lit(f"**{second}**"))


def renumbered(n: Column) -> Column:
    """Question numbers in the order of the page: three passes, each over what the last one gave."""
    one = F.when(n <= 20, n + 60).otherwise(n - 20)
    two = F.when(one <= 50, one + 10).when(one <= 60, one - 50).otherwise(one)
    return F.when(two == 7, 1).when(two < 7, two + 1).otherwise(two)


def without_first_lines(c: Column, n: int) -> Column:
    lines = F.split(c, "\n")
    return F.array_join(F.slice(lines, F.lit(n + 1), F.greatest(F.size(lines) - n, F.lit(0))), "\n")


def framed(c: Column) -> Column:
    """The JSON chunks of a NUL-parted stream, empty ones aside."""
    return F.filter(F.split(c, "\\x00"), lambda x: x != "")


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """All rows in a seeded order, told by shuffle_key: a sort over ranges of hashes, never in one task."""
    return df.withColumn("shuffle_key", F.xxhash64(F.lit(seed), key)).orderBy("shuffle_key", key)


def sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct rows of both, of a alone, and of either."""
    return a.intersect(b), a.exceptAll(b).distinct().join(b.distinct(), a.columns, "left_anti"), a.union(b).distinct()


class Metrics:
    """A registry of metrics by task: name -> function of the answers. run gives one long table (keys, task, metric, value)."""

    def __init__(self) -> None:
        self.of: dict[str, Metric] = {}

    def register(self, task: str, f: Metric) -> None:
        if task in self.of:
            raise ValueError(f"{task} has a metric already")
        self.of[task] = f

    def run(self, tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
        """Each task's metrics as rows; a task without a function fails, one without answers has an error record in place of numbers."""
        out = None
        for task, df in tables.items():
            if task not in self.of:
                raise KeyError(f"no metric for {task}")
            m = self.of[task](df)
            names = [c for c in m.columns if c not in keys]
            long = m.select(*keys, F.lit(task).alias("task"), F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))))
            out = long if out is None else out.unionByName(long)
        return out


def first_rule(name: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """What the first rule gives whose parts all stand in the name, letter case aside: as a model's name calls for a template."""
    out = F.lit(default)
    for parts, value in reversed(rules):
        fits = F.lit(True)
        for x in parts:
            fits = fits & F.lower(name).contains(x)
        out = F.when(fits, value).otherwise(out)
    return out


def frame_indices(n_frames: Column, fps: Column, interval: float, least: int, most: int) -> Column:
    """The frames of a video to look at: as many as it has intervals, at least and at most so many, spread evenly, each once."""
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(n_frames / fps / interval).cast("int")))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.floor(F.when(n > 1, k * (n_frames - 1).cast("double") / (n - 1)).otherwise(0.0)).cast("int"))
    return F.array_distinct(at)
