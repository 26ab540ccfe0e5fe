"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot if it has more than 1/HOT_PARTS of the rows. Fewer than HOT_PARTS keys can, so their table may be broadcast at any size of the data.
HOT_PARTS = 1000


def hot_split_join(left: DataFrame, keyed: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """left joined (inner) with keyed, one row per key, whose column count_col has the number of left rows of the key.

    Keys with more than total/HOT_PARTS rows are joined by broadcast (there are fewer than HOT_PARTS of them), all others by
    shuffle, where now no key has more than a thousandth of the rows. Null keys join nothing. The columns of keyed other than
    the keys must not occur in left."""
    limit = max(total // HOT_PARTS, 10_000)
    hot = keyed.where(F.col(count_col) > limit)
    rest = keyed.where(F.col(count_col) <= limit)
    if total <= limit:  # no key can be hot
        return left.join(rest, keys)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, salts: int, name: str = "rank") -> DataFrame:
    """df with a 0-based rank within keys. The ranks of a key are dealt out by salt first, then by order, so that a key's rows
    are sorted in `salts` independent parts: a key may have a third of all rows. salt must be a deterministic integer column
    in [0, salts). Only keys x salts counts are gathered to offset the parts.

    The rank is a fixed bijection onto 0..n-1, not the order over the whole key."""
    df = df.withColumn("_salt", salt)
    counts = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - 1)
    joined = ranked.join(offsets.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_salt": "_osalt"}), [*(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_salt") == F.col("_osalt")])
    return joined.withColumn(name, F.col("_rn") + F.col("_offset")).drop("_rn", "_offset", "_salt", "_osalt", *(f"_k_{k}" for k in keys))


def counted_join(left: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """hot_split_join for a left that has no counts yet: its rows are counted by key first, so left should be cheap to read again."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    total, most = counts.agg(F.sum("_count"), F.max("_count")).first()
    if not total or most <= max(total // HOT_PARTS, 10_000):
        return left.join(keyed, keys)
    return hot_split_join(left, keyed.join(counts, keys), keys, "_count", total).drop("_count")


def celled(df: DataFrame, own: Column, others: Column, salt: Column, first: bool, cell: int = 2000) -> DataFrame:
    """df ready for a join of two many-rowed sides on a hot key: own and others are the numbers of rows that the key has on this
    and on the other side. Each side is dealt by salt (a hash) to groups of about `cell` rows, and repeated for every group of the
    other side, so that a task meets cell x cell rows at most. Join on the key, _c1 and _c2; first tells the sides apart."""
    mine = F.pmod(salt, F.greatest(F.lit(1), F.ceil(own / cell))).cast("int")
    every = F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(others / cell)) - 1).cast("int")))
    return df.withColumn("_c1" if first else "_c2", mine).withColumn("_c2" if first else "_c1", every)
