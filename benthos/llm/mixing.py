"""Problem 3: sources mixed to target weights.

The total size of a run (in records) is given by Sainte-Laguë's highest quotients (weight / 1, / 3, / 5, ...) to the sources, and
then again to each source's shards by their numbers of records. The seats are found by bisecting the divisor, so the work
follows the number of sources and shards, not of records. A shard is cut into blocks of BLOCK records and of equal tokens: its
records, by falling num_tokens, are dealt to the blocks to and fro. A run takes the blocks of its quota in a row, from a seeded
one on, going round as often as needed, and of the last block only what is left of the quota."""

from __future__ import annotations

import heapq
import zlib
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Records of a shard at most, about: so a source with a third of all rows is ordered in many tasks.
SHARD_ROWS = 250_000
#: Records of a block, about.
BLOCK = 16


def sainte_lague(weights: dict, seats: int) -> dict:
    """The seats of each key by the highest quotients weight / (2k + 1); ties go to the key that comes first in order.

    A divisor d gives each key round(weight / d) seats, and the highest-quotient result is that of the d at which they sum up
    to the seats; the last few are given by the quotients themselves."""
    keys = [k for k in sorted(weights) if weights[k] > 0]
    if not keys or seats <= 0:
        return dict.fromkeys(weights, 0)
    share = {k: Fraction(weights[k]) for k in keys}
    total = sum(share.values())
    # rounding adds at most half a seat a key, so at this divisor no more than all seats are given (if there are as many as keys),
    # and a greater divisor never gives a key more: the few that remain go by quotients
    d = total / seats * Fraction(seats + len(keys), seats)
    given = {k: int(share[k] / d + Fraction(1, 2)) if seats >= len(keys) else 0 for k in keys}
    heap = [(-share[k] / (2 * given[k] + 1), i, k) for i, k in enumerate(keys)]
    heapq.heapify(heap)
    for _ in range(seats - sum(given.values())):
        _, i, k = heap[0]
        given[k] += 1
        heapq.heapreplace(heap, (-share[k] / (2 * given[k] + 1), i, k))
    return {k: given.get(k, 0) for k in weights}


def blocks_of(n: int) -> int:
    return max(1, -(-n // BLOCK))


def before_block(block: int, n: int) -> int:
    """The records in the blocks before a block of a shard of n: the last, partial round of dealing goes to or fro."""
    m = blocks_of(n)
    rounds, rest = divmod(n, m)
    return block * rounds + (min(block, rest) if rounds % 2 == 0 else max(0, block - (m - rest)))


def run_sources(arguments: DataFrame) -> DataFrame:
    """(run_no, source, weight, max_repeat, size_ratio) of each source that a run's dataset_use names.

    Names stand between commas or semicolons, white space and letter case aside; `%NN` after a name is its weight, 100 if there
    is none. Weights of a name that stands there twice add up. Empty names are dropped. A null max_repeat is 1, a null
    size_ratio 1.0; a null or blank dataset_use gives no rows."""
    pieces = F.split(F.lower(F.regexp_replace(F.coalesce("dataset_use", F.lit("")), r"(?U)\s+", "")), "[,;]")
    parts = arguments.select("run_no", F.coalesce("max_repeat", F.lit(1)).alias("max_repeat"), F.coalesce("size_ratio", F.lit(1.0)).alias("size_ratio"), F.explode(pieces).alias("p"))
    named = parts.select("run_no", "max_repeat", "size_ratio", F.regexp_replace("p", r"%\d*$", "").alias("source"), F.regexp_extract("p", r"%(\d+)$", 1).alias("w"))
    weight = F.when(F.col("w") == "", F.lit(100)).otherwise(F.expr("try_cast(w as bigint)"))
    return named.where("source <> ''").groupBy("run_no", "source").agg(F.sum(weight).alias("weight"), F.first("max_repeat").alias("max_repeat"), F.first("size_ratio").alias("size_ratio"))


def plan(samples: DataFrame, arguments: DataFrame, registry: DataFrame, shard_rows: int = SHARD_ROWS):
    """The quotas of all runs: one row (run_no, source, shard, n, quota, offset) for each shard used, one report row for each
    source named, and the records with source and shard. Only counts by source and shard are gathered."""
    spark = samples.sparkSession
    records = samples.where("split_name = 'train' and dataset is not null").select("row_no", "id", F.col("num_tokens") if "num_tokens" in samples.columns else F.lit(None).cast("int").alias("num_tokens"), F.lower(F.trim("dataset")).alias("source"))
    sizes = {r["source"]: r["n"] for r in records.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = {k: -(-n // shard_rows) for k, n in sizes.items()}
    registered = {r[0] for r in registry.select(F.lower(F.trim("dataset"))).distinct().collect()}
    number = F.create_map(*(F.lit(x) for k, n in shards.items() for x in (k, n))) if shards else None
    sharded = records.withColumn("shard", F.pmod(F.xxhash64("row_no", F.lit(11)), number[F.col("source")]).cast("int") if shards else F.lit(0))
    counts: dict[str, dict[int, int]] = {}
    for source, shard, n in sharded.groupBy("source", "shard").count().collect():
        counts.setdefault(source, {})[shard] = n
    runs: dict[int, list] = {}
    for r in run_sources(arguments).collect():
        runs.setdefault(r["run_no"], []).append(r)
    quotas, report = [], []
    for run_no, named in sorted(runs.items()):
        usable = {r["source"]: r["weight"] for r in named if r["source"] in registered and sizes.get(r["source"])}
        size = round(named[0]["size_ratio"] * sum(sizes[s] for s in usable))
        seats = sainte_lague(usable, size)
        capped = {s: min(seats[s], named[0]["max_repeat"] * sizes[s]) for s in usable}
        total_weight, reached = sum(usable.values()), sum(capped.values())
        for r in sorted(named, key=lambda r: r["source"]):
            s = r["source"]
            report.append((run_no, s, r["weight"], s in registered, sizes.get(s, 0), usable[s] / total_weight if s in usable and total_weight else None, size, seats.get(s, 0), capped.get(s, 0), capped[s] / reached if s in usable and reached else None, capped[s] / size if s in usable and size else None))
        for s, quota in capped.items():
            for shard, n in sainte_lague(counts[s], quota).items():
                if n:
                    # each run starts at another block
                    size_of = counts[s][shard]
                    quotas.append((run_no, s, shard, size_of, n, before_block(zlib.crc32(f"{run_no} {s} {shard}".encode()) % blocks_of(size_of), size_of)))
    return (
        spark.createDataFrame(quotas, "run_no int, source string, shard int, n long, quota long, offset long"),
        spark.createDataFrame(report, "run_no int, dataset string, weight long, registered boolean, n_records long, target_share double, total_size long, target_records long, used_records long, actual_share double, share_of_total double"),
        sharded,
    )


def mix(samples: DataFrame, arguments: DataFrame, registry: DataFrame, seed: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(run_no, dataset, row_no, id, use_no): the train records of each run, one row per use, use_no from 1.

    The total size is size_ratio times the train records of the run's usable sources: those registered that have train records.
    Weights are relative to the usable sources' sum; names that aren't usable, and weights of 0, give nothing. Every source gets
    its blocks of the total by Sainte-Laguë's quotients, but at most max_repeat times its records: what a small source can't
    give isn't made up by others, so that these keep their share of the total. Repeated rows are records each; a null id is
    kept; a null dataset belongs to no source.

    One shuffle of the records' keys by (source, shard) orders them for all runs; the table of quotas (runs x sources x shards)
    is broadcast: it is one row per SHARD_ROWS records and run."""
    quotas, _, sharded = plan(samples, arguments, registry, shard_rows)
    order = Window.partitionBy("source", "shard").orderBy(F.desc(F.coalesce("num_tokens", F.lit(0))), F.xxhash64("row_no", F.lit(seed)), "row_no")
    dealt = sharded.withColumn("_k", (F.row_number().over(order) - 1).cast("long")).join(F.broadcast(quotas), ["source", "shard"])
    blocks = dealt.withColumns({"_m": F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))}).withColumns({"_j": F.expr("_k div _m"), "_i": F.expr("_k % _m"), "_r": F.expr("n div _m"), "_rest": F.expr("n % _m")})
    block = F.when(F.col("_j") % 2 == 0, F.col("_i")).otherwise(F.col("_m") - 1 - F.col("_i"))
    more = F.when(F.col("_r") % 2 == 0, F.least("_block", "_rest")).otherwise(F.greatest(F.lit(0), F.col("_block") - (F.col("_m") - F.col("_rest"))))
    used = blocks.withColumn("_block", block).withColumn("rank", F.col("_block") * F.col("_r") + more + F.col("_j"))
    copies = F.expr("quota div n + if(pmod(rank - offset, n) < quota % n, 1, 0)")
    return used.withColumn("use_no", F.explode(F.sequence(F.lit(1), copies.cast("int"), F.lit(1)))).where(copies > 0).select("run_no", F.col("source").alias("dataset"), "row_no", "id", "use_no")


def shares(samples: DataFrame, arguments: DataFrame, registry: DataFrame) -> DataFrame:
    """The share that each source named by a run was to reach and has reached; sources that aren't usable have null shares."""
    return plan(samples, arguments, registry)[1]
