"""Problem 5: splits that never part related records.

Records are related if they show a common picture or name the same dive, or through other records. Each picture and dive stands
for the smallest row_no that has it (its anchor), so the graph has anchors as nodes and an edge wherever a record has two
anchors; its components are found by Borůvka's contraction: every component takes its minimum edge to another one (edges are
ordered by a hash, so that chains of choices stay short), the chosen edges join the spanning forest, which is written to the
shared folder, and components are contracted to roots by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benthos.operators.skew import counted_join, hot_split_join, salted_rank
from benthos.session import durable, written

SALTS = 64


def picture(path: Column) -> Column:
    """What tells a picture: the stem of its file name, without folder and ending, in lower case; null if nothing is left."""
    name = F.regexp_replace(path, r"(?U)^\s+|\s+$", "")
    name = F.regexp_replace(name, r"^.*[/\\]", "")
    name = F.lower(F.regexp_replace(name, r"(?U)\s*\.[^.\s]*$", ""))
    return F.when(name != "", name)


def dive(id_: Column) -> Column:
    """The number of the dive that a record's id names, without leading zeros; null for `web` and a null or odd id."""
    digits = F.regexp_extract(id_, r"(?i)^[^-_/]*[-_/]\s*D0*(\d+)\s*(?:[-_/]|$)", 1)
    return F.when(digits != "", digits)


def record_keys(samples: DataFrame) -> DataFrame:
    """(row_no, key): each picture and dive of each record, once."""
    pictures = F.transform(F.coalesce(F.col("image"), F.array().cast("array<string>")), lambda p: F.concat(F.lit("p:"), picture(p)))
    keys = F.array_distinct(F.array_compact(F.concat(pictures, F.array(F.concat(F.lit("d:"), dive(F.col("id")))))))
    return samples.where("row_no is not null").select("row_no", F.explode(keys).alias("key"))


def components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of every node of edges (u, v), and the spanning forest (u, v, round).

    root is any one node of the component. Loops and parallel edges are dropped. Rounds follow the logarithm of the number of
    nodes. Every round's tables are kept in the shared folder, so a lost executor costs no more than the round."""
    spark = edges.sparkSession
    # tables, not checkpoints: a checkpoint keeps its plan's partitionings, which multiply where a loop joins a table with itself
    durable = lambda df: written(df, "step")
    ordered = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    # live edges: cu and cv are the components of the original edge u, v
    live = durable(ordered.select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.struct(F.xxhash64("u", "v").alias("w"), "u", "v").alias("e")))
    labels = live.select(F.explode(F.array("cu", "cv")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    done: list[DataFrame] = []
    forest = spark.createDataFrame([], "u long, v long, round int")
    number = 0
    # one component may hold most nodes: joins on a component count their keys first and broadcast the few hot ones
    while not live.isEmpty():
        number += 1
        both = live.select(F.col("cu").alias("c"), F.col("cv").alias("to"), "e").unionByName(live.select(F.col("cv").alias("c"), F.col("cu").alias("to"), "e"))
        chosen = durable(both.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", F.col("m.to").alias("p"), F.col("m.e").alias("e")))
        forest = forest.unionByName(written(chosen.select("e.u", "e.v").distinct().withColumn("round", F.lit(number)), f"forest-{number}"))
        # two components that chose the same edge: the smaller becomes a root
        back = chosen.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = durable(counted_join(chosen.select("c", "p"), back, ["p"]).select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        while True:
            further = durable(counted_join(up, up.select(F.col("c").alias("p"), F.col("p").alias("pp")), ["p"]).select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            up = further.select("c", "p")
            if further.where("moved").isEmpty():
                break
        half = durable(counted_join(live, up.select(F.col("c").alias("cu"), F.col("p").alias("pu")), ["cu"]))
        ends = counted_join(half, up.select(F.col("c").alias("cv"), F.col("p").alias("pv")), ["cv"]).where("pu <> pv")
        # of parallel edges only the least can be chosen later
        live = durable(ends.groupBy(F.least("pu", "pv").alias("cu"), F.greatest("pu", "pv").alias("cv")).agg(F.min("e").alias("e")))
        # components without a live edge are finished, and their nodes moved no more
        alive = live.select(F.explode(F.array("cu", "cv")).alias("p")).distinct().withColumn("alive", F.lit(True))
        moved = durable(counted_join(labels, up.join(alive, "p", "left").select(F.col("c").alias("root"), "p", F.coalesce("alive", F.lit(False)).alias("alive")), ["root"]).select("node", F.col("p").alias("root"), "alive"))
        done.append(moved.where("not alive").drop("alive"))
        labels = moved.where("alive").drop("alive")
    for part in done:
        labels = labels.unionByName(part)
    return durable(labels), forest


def groups(samples: DataFrame) -> DataFrame:
    """(row_no, group_no) of each row with a row_no; group_no is the smallest row_no of the row's group.

    A null id, `web`, an id of another shape and a null or empty image (or path) link nothing: such a row is its own group.
    Repeated row_nos give one row each and are one record. Extra columns don't matter; an empty table gives no rows."""
    keys = durable(record_keys(samples))
    seen = durable(keys.groupBy("key").agg(F.min("row_no").alias("anchor"), F.count(F.lit(1)).alias("_n")))
    linked = durable(hot_split_join(keys, seen, ["key"], "_n", keys.count()).select("row_no", "anchor").distinct())
    firsts = linked.groupBy("row_no").agg(F.min("anchor").alias("first"), F.collect_set("anchor").alias("all"))  # bounded by the record's own pictures
    edges = firsts.where(F.size("all") > 1).select(F.col("first").alias("u"), F.explode("all").alias("v")).where("u <> v")
    labels, _ = components(edges)
    least = labels.groupBy("root").agg(F.min("node").alias("group_no"))
    named = durable(counted_join(labels, least, ["root"]).select(F.col("node").alias("first"), "group_no"))
    # anchors in no edge are their own smallest row; many rows may have one anchor, so the join splits hot ones
    rows = firsts.select("row_no", "first")
    sizes = rows.groupBy("first").agg(F.count(F.lit(1)).alias("_n")).join(named, "first", "left").select("first", F.coalesce("group_no", "first").alias("group_no"), "_n")
    placed = hot_split_join(rows, sizes, ["first"], "_n", linked.count()).select("row_no", "group_no")
    # a row without keys is alone
    return samples.where("row_no is not null").select("row_no").join(placed, "row_no", "left").select("row_no", F.coalesce("group_no", "row_no").alias("group_no"))


def deal(grouped: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(row_no, group_no, split_name): every group whole in one split, the splits' shares of rows near the targets.

    Groups are stratified by size band (the power of two below their number of rows). From the largest band down, each band
    owes every split its share of all rows up to and including the band, less what the split has; the band's groups are counted
    out to the splits by what is owed and dealt in a fixed stride through their seeded order. Null or negative target shares
    count as 0; if all are 0, everything falls to the first split by name. Only bands (at most 64) are gathered."""
    spark, grouped = grouped.sparkSession, grouped.select("row_no", "group_no")
    sizes = durable(grouped.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).withColumn("band", F.floor(F.log2("n")).cast("int")))
    wanted = {r["split_name"]: max(r["target_share"] or 0.0, 0.0) for r in targets.where("split_name is not null").collect()}
    names = sorted(wanted, key=lambda k: (-wanted[k], k))
    total = sum(wanted.values())
    have, all_rows, plan = dict.fromkeys(names, 0.0), 0, []
    for band, n_groups, n_rows in sizes.groupBy("band").agg(F.count(F.lit(1)), F.sum("n")).orderBy(F.desc("band")).collect():
        all_rows += n_rows
        owed = {k: max(all_rows * (wanted[k] / total if total else float(k == names[0])) - have[k], 0.0) for k in names}
        scale = n_groups / sum(owed.values()) if sum(owed.values()) else 0
        exact = {k: owed[k] * scale for k in names}
        quota = {k: int(exact[k]) for k in names}
        for k in sorted(names, key=lambda k: (quota[k] - exact[k], names.index(k)))[: n_groups - sum(quota.values())]:
            quota[k] += 1
        stride = next(s for s in range(max(1, int(n_groups * 0.618)), n_groups + 2) if _coprime(s, n_groups))
        at = 0
        for k in names:
            plan.append((band, k, at, at + quota[k], n_groups, stride))
            at += quota[k]
            have[k] += quota[k] * n_rows / n_groups
    if not plan or not names:
        return grouped.select("row_no", "group_no", F.lit(None).cast("string").alias("split_name")).limit(0)
    table = spark.createDataFrame(plan, "band int, split_name string, a long, b long, m long, stride long")
    salt = F.pmod(F.xxhash64("group_no", F.lit(seed + 1)), F.lit(SALTS)).cast("int")
    ranked = salted_rank(sizes, ["band"], [F.xxhash64("group_no", F.lit(seed)), F.col("group_no")], salt, SALTS)
    dealt = ranked.join(F.broadcast(table), "band").where((F.col("rank") * F.col("stride") % F.col("m") >= F.col("a")) & (F.col("rank") * F.col("stride") % F.col("m") < F.col("b")))
    counts = dealt.select("group_no", "split_name", F.col("n").alias("_n"))
    return hot_split_join(grouped, counts, ["group_no"], "_n", grouped.count()).select("row_no", "group_no", "split_name")


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def split_report(dealt: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, target_share, n_groups, n_rows, share) of each split with a target."""
    counts = dealt.groupBy("split_name").agg(F.countDistinct("group_no").alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))
    joined = targets.select("split_name", "target_share").join(F.broadcast(counts), "split_name", "left").fillna(0, ["n_groups", "n_rows"])
    return joined.withColumn("share", F.try_divide(F.col("n_rows"), F.sum("n_rows").over(Window.partitionBy(F.lit(1)))))
