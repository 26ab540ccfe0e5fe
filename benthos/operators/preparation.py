"""Records made ready: registry, exact samples, oversampling, lengths, length-grouped batches, validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benthos.functions import text as T
from benthos.session import ship_code


def rate(name: Column) -> Column:
    """The share that a name's `%NN` asks for; 1.0 without one."""
    digits = F.regexp_extract(name, r"%(\d+)$", 1)
    return F.when(digits == "", 1.0).otherwise(digits.cast("double") / 100)


def union_of(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def named(registry: DataFrame, names: list[str]) -> DataFrame:
    """The rows of the registry (dataset, ...) for the names, `%NN` aside; fails on a name that isn't there. Both are small."""
    wanted = {n.split("%")[0].strip().lower() for n in names if n.strip()}
    found = registry.where(F.lower(F.trim("dataset")).isin(*wanted))
    missing = wanted - {r[0] for r in found.select(F.lower(F.trim("dataset"))).distinct().collect()}
    if missing:
        raise ValueError(f"not in the registry: {sorted(missing)}")
    return found


def oversample(df: DataFrame, extra: dict[str, int]) -> DataFrame:
    """df with n more copies of the rows of each tag, numbered from 0."""
    n = F.lit(0)
    for k, more in extra.items():
        n = F.when(T.tag(F.col("id")) == k, more).otherwise(n)
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), n)))


def exact_sample(df: DataFrame, by: str, key: str, share: str, seed: int = 1) -> DataFrame:
    """floor(n * share) rows of each group of n, by the least seeded hashes. Only the rows up to the group's cut are ranked: the
    cut is found in a histogram of the hashes, so that a hot group isn't sorted in one task."""
    bins = 4096
    h = df.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_bin", F.pmod(F.shiftrightunsigned("_h", 1), F.lit(bins)).cast("int"))
    counts = h.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.first(share).alias("_share"))
    w = Window.partitionBy(by)
    cum = counts.withColumns({"_all": F.sum("_n").over(w), "_upto": F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))})
    plan = cum.select(F.col(by).alias("_by"), F.col("_bin").alias("_b"), (F.floor(F.col("_all") * F.col("_share")) - F.coalesce("_upto", F.lit(0))).alias("_left")).where("_left > 0")
    joined = h.join(plan, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bin") == F.col("_b")))
    ranked = joined.withColumn("_rn", F.row_number().over(Window.partitionBy("_by", "_b").orderBy("_h", key)))
    return ranked.where("_rn <= _left").drop("_h", "_bin", "_by", "_b", "_left", "_rn")


def lengths(samples: DataFrame) -> DataFrame:
    """(row_no, n_words, length, modality_length, known_length): words of all turns; 128 more with pictures; negative without; the
    given number of tokens, else 1."""
    n = F.aggregate(F.transform(F.coalesce("conversations", F.array().cast("array<struct<speaker:string,value:string>>")), lambda t: T.word_count(t["value"])), F.lit(0), lambda s, x: s + x)
    has = F.coalesce(F.size("image") > 0, F.lit(False))
    return samples.select("row_no", n.alias("n_words"), has.alias("has_image"), F.coalesce("num_tokens", F.lit(1)).alias("known_length")).select(
        "row_no", "n_words", (F.col("n_words") + F.when(F.col("has_image"), 128).otherwise(0)).alias("length"), F.when(F.col("has_image"), F.col("n_words")).otherwise(-F.col("n_words")).alias("modality_length"), "known_length"
    )


def length_grouped(df: DataFrame, key: str, length: str, batch: int, world: int, seed: int = 1) -> DataFrame:
    """(key, length, megabatch, chunk, place): a seeded permutation cut into megabatches of batch x world rows, each sorted by
    length (longest first) and dealt out to `world` chunks of near-equal length. A megabatch is one group."""
    ship_code(df.sparkSession)
    slots = 1 << 16
    size = batch * world
    h = df.select(F.col(key).alias("key"), F.col(length).cast("long").alias("length")).withColumn("h", F.xxhash64("key", F.lit(seed))).withColumn("slot", F.pmod("h", F.lit(slots)))
    counts = h.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = h.join(counts, "slot").withColumn("at", F.row_number().over(Window.partitionBy("slot").orderBy("h", "key")) - 1 + F.col("before"))
    mega = placed.withColumn("megabatch", F.floor(F.col("at") / size)).select("key", "length", "megabatch")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True]).reset_index(drop=True)
        n, room = len(pdf), len(pdf) // world
        if len(pdf) % world:
            chunk = [i % world for i in range(n)]
        else:
            sums, counts, chunk = [0.0] * world, [0] * world, []
            for x in pdf["length"]:
                k = min(range(world), key=lambda j: (sums[j], j))
                chunk.append(k)
                counts[k] += 1
                sums[k] = float("inf") if counts[k] == room else sums[k] + x
        pdf["chunk"] = chunk
        pdf["place"] = pdf.groupby("chunk").cumcount()
        return pdf

    return mega.groupBy("megabatch").applyInPandas(deal, "key long, length long, megabatch long, chunk int, place long")


def validate(samples: DataFrame, images: DataFrame) -> DataFrame:
    """(row_no, n_images, n_tokens, n_missing, problems): a record's pictures against the listing, its image tokens against its
    pictures, and image tokens in answers."""
    said = lambda who: F.aggregate(F.transform(F.filter(F.coalesce("conversations", F.array().cast("array<struct<speaker:string,value:string>>")), lambda t: F.coalesce(F.lower(t["speaker"]), F.lit("")).isin(*who)), lambda t: T.media_tokens(t["value"])), F.lit(0), lambda s, x: s + x)
    rows = samples.select("row_no", F.coalesce(F.size("image"), F.lit(0)).alias("n"), F.coalesce("image", F.array().cast("array<string>")).alias("image"), said(["human", "user"]).alias("n_tokens"), said(["gpt", "assistant"]).alias("told"))
    rows = rows.withColumn("n_images", F.when(F.col("n") < 0, 0).otherwise(F.col("n")))
    missing = rows.select("row_no", F.explode("image").alias("image")).join(images.where("image is not null").select("image").distinct(), "image", "left_anti").groupBy("row_no").agg(F.count(F.lit(1)).alias("n_missing"))
    joined = rows.join(missing, "row_no", "left").fillna(0, ["n_missing"])
    problems = F.array_compact(F.array(F.when(F.col("n_missing") > 0, "missing"), F.when(F.col("n_tokens") != F.col("n_images"), "mismatch"), F.when(F.col("told") > 0, "answer_token")))
    return joined.select("row_no", "n_images", "n_tokens", "n_missing", F.array_join(problems, ",").alias("problems"))


def validation_summary(checked: DataFrame) -> DataFrame:
    has = lambda k: F.count_if(F.col("problems").contains(k))
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("problems") == "").alias("n_valid"), has("missing").alias("n_missing"), has("mismatch").alias("n_mismatch"), has("answer_token").alias("n_answer_token"), F.count_if(F.col("n_images") == 0).alias("n_text_only"), F.count_if(F.col("n_images") > 1).alias("n_many"))
