"""Problem 7: items of varying size into containers of fixed capacity, with little space left over.

Sizes are integers of at most the capacity, so all items together are a histogram of at most `capacity` numbers, whatever their
count. The histogram is packed by minimum bin slack: the largest size left opens a container, and a bitset subset-sum dynamic
program over the multiset of sizes left finds the filling closest to the capacity, whose counts are read off by going back
through the bitsets. The filling found is used as many times as the counts left allow, so the number of programs solved depends
on the number of different sizes, not of items. Items then take their places by their rank among the items of their size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benthos.llm.encoding import TOKENIZERS, token_counts
from benthos.operators.skew import salted_rank
from benthos.session import durable, ship_code

SALTS = 64


def fill_window(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """The multiset of the given sizes (descending, with the counts left) whose sum is the largest not above room.

    Bit s of the bitset is set if the sum s can be reached. A size with n copies enters as bundles of 1, 2, 4, ... copies; the
    bitset before each bundle is kept for going back. Stops as soon as room itself is reached."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size, count in zip(sizes, counts):
        if size > room:
            continue
        count, bundle = min(count, room // size), 1
        while count > 0:
            take = min(bundle, count)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            count -= take
            bundle *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:  # not reachable without this bundle
            used[size] = used.get(size, 0) + take
            total -= size * take
    return used


def fillings(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: count}) of each filling; together they use the histogram up exactly."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    out = []
    while left:
        sizes = sorted(left, reverse=True)
        first = sizes[0]
        left[first] -= 1
        used = fill_window(sizes, [left[s] for s in sizes], capacity - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        out.append((times, used))
        for s, n in used.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
    return out


def pack(items: DataFrame, key: str, size: str, capacities: list[tuple[int, int]]) -> DataFrame:
    """(limit_no, capacity, container_no, <key>, piece_no, from_token, n_tokens) for each (limit_no, capacity).

    An item goes whole into one container unless it alone exceeds the capacity; then it is cut into pieces of full capacity,
    each its own container, and a rest that is packed like an item. Null, zero and negative sizes are no items. Repeated keys
    are items each. A null or non-positive capacity gives no container. Container numbers are unique within a limit_no; those
    of full pieces are negative (numbered by item), all others count from 1.

    Shuffles: the histogram (at most capacity rows a limit) and one rank per item within (limit_no, size), salted, since a third
    of the items may have one size. The table of fillings is bounded by the capacities alone (it is what is broadcast)."""
    spark = items.sparkSession
    ship_code(spark)
    limits = [(int(n), int(c)) for n, c in capacities if c is not None and c > 0]
    if not limits:
        return items.select(F.lit(0).alias("limit_no"), F.lit(0).alias("capacity"), F.lit(0).cast("long").alias("container_no"), key, F.lit(0).alias("piece_no"), F.lit(0).alias("from_token"), F.lit(0).alias("n_tokens")).limit(0)
    cells = F.array(*(F.struct(F.lit(n).alias("limit_no"), F.lit(c).alias("capacity")) for n, c in limits))
    each = durable(
        items.where(F.col(size) > 0)
        .select(F.col(key).alias("key"), F.col(size).cast("int").alias("size"), F.inline(cells))
        .withColumn("full", F.expr("if(size > capacity, size div capacity, 0)").cast("int"))
        .withColumn("rest", F.expr("if(size > capacity, size % capacity, size)").cast("int"))
    )
    packed = each.where("rest > 0").groupBy("limit_no", "capacity", "rest").agg(F.count(F.lit(1)).alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        limit_no, capacity = int(pdf["limit_no"].iloc[0]), int(pdf["capacity"].iloc[0])
        rows, rank, first = [], {}, 1
        for times, used in fillings(dict(zip(pdf["rest"].tolist(), pdf["n"].tolist())), capacity):
            for s, n in used.items():
                rows.append((limit_no, s, rank.get(s, 0), n, first))
                rank[s] = rank.get(s, 0) + times * n
            first += times
        return pd.DataFrame(rows, columns=["limit_no", "rest", "from_rank", "per", "first"])

    places = packed.groupBy("limit_no").applyInPandas(solve, "limit_no int, rest int, from_rank long, per int, first long")
    # bounded by the capacities: at most `capacity` fillings of at most sqrt(2 * capacity) different sizes each
    found = places.toPandas().sort_values(["limit_no", "rest", "from_rank"])
    table = {k: (g["from_rank"].to_numpy(), g["per"].to_numpy(), g["first"].to_numpy()) for k, g in found.groupby(["limit_no", "rest"])}
    shared = spark.sparkContext.broadcast(table)

    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    ranked = salted_rank(each.where("rest > 0"), ["limit_no", "rest"], [F.col("key")], salt, SALTS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit_no, rest, rank = (batch.column(k).to_numpy() for k in (0, 1, 2))
            out = np.empty(len(rank), np.int64)
            code = limit_no.astype(np.int64) << 32 | rest
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
                starts, per, first = shared.value[int(limit_no[part[0]]), int(rest[part[0]])]
                k = np.searchsorted(starts, rank[part], side="right") - 1
                out[part] = first[k] + (rank[part] - starts[k]) // per[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out), *batch.columns[3:]], names=["limit_no", "rest", "container_no", "key", "capacity", "full"])

    kind = items.schema[key].dataType.simpleString()
    whole = (
        ranked.select("limit_no", "rest", F.col("rank").cast("long").alias("rank"), "key", "capacity", "full")
        .mapInArrow(place, f"limit_no int, rest int, container_no long, key {kind}, capacity int, full int")
        .select("limit_no", "capacity", "container_no", F.col("key").alias(key), F.col("full").alias("piece_no"), (F.col("full") * F.col("capacity")).cast("int").alias("from_token"), F.col("rest").alias("n_tokens"))
    )
    over = salted_rank(each.where("full > 0"), ["limit_no"], [F.col("key")], salt, SALTS)
    # full pieces: a run of -1, -2, ... for each item; items of a limit are spaced by the longest one's number of pieces
    longest = each.groupBy("limit_no").agg(F.max("full").alias("longest"))
    pieces = (
        over.join(F.broadcast(longest.withColumnRenamed("limit_no", "_l")), F.col("limit_no") == F.col("_l"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
        .select("limit_no", "capacity", (-(F.col("rank") * F.col("longest") + F.col("piece_no") + 1)).cast("long").alias("container_no"), F.col("key").alias(key), "piece_no", (F.col("piece_no") * F.col("capacity")).cast("int").alias("from_token"), F.col("capacity").alias("n_tokens"))
    )
    return whole.unionByName(pieces)


def pack_documents(documents: DataFrame, pack_limits: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Each document in a container of each limit; pack_limits names the tokenizer of each limit. The number of limits doesn't
    grow with the data. Limits with a null tokenizer or capacity give no container."""
    limits = [tuple(r) for r in pack_limits.select("limit_no", "capacity", "tokenizer").dropDuplicates().where("capacity is not null and tokenizer is not null").collect()]
    parts = []
    for name in sorted({t for _, _, t in limits}):
        sizes = token_counts(documents, "doc_id", "text", name, folder)
        parts.append(pack(sizes, "doc_id", "n_tokens", sorted((n, c) for n, c, t in limits if t == name)))
    if not parts:
        return pack(documents.select("doc_id", F.lit(0).alias("n_tokens")), "doc_id", "n_tokens", [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_report(containers: DataFrame) -> DataFrame:
    """One row per limit: containers, items' pieces, tokens, and the least number of containers that any packing needs."""
    bins = containers.groupBy("limit_no", "capacity", "container_no").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return bins.groupBy("limit_no", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_pieces"),
        F.sum("t").alias("n_tokens"),
        F.max("t").alias("fullest"),
        F.ceil(F.sum("t") / F.first("capacity")).alias("least_containers"),
        (F.sum("t") / (F.count(F.lit(1)) * F.first("capacity"))).alias("fill"),
    )
