"""Boxes: parsed from text, scaled, measured and matched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benthos.session import ship_code, written

BOX = "struct<category:string,x1:double,y1:double,x2:double,y2:double>"


def without_tokens(c: Column) -> Column:
    return F.regexp_replace(c, r"</?(?:ref|box)>", "")


def parse_plain(c: Column) -> Column:
    """Boxes of lines `label N: [x1,y1,x2,y2]` or `<ref>label</ref><box>[[x1,y1,x2,y2]]</box>`: label trimmed, in lower case, without
    digits; numbers above 1 taken as thousandths. A line of another shape (no `[[` and not one colon) is skipped, as is one
    with other than four numbers; a line whose brackets hold no or other than numbers makes the whole text null."""
    lines = F.transform(F.split(c, "\n"), without_tokens)
    double = lambda s: (F.length(s) - F.length(F.replace(s, F.lit("[["), F.lit("")))) / 2
    shaped = F.filter(lines, lambda s: F.when(s.contains("[["), double(s) == 1).otherwise(F.size(F.split(s, ":")) == 2))
    parted = F.transform(shaped, lambda s: F.when(s.contains("[["), F.split(s, r"\[\[")).otherwise(F.split(s, ":")))
    numbers = lambda x: F.filter(F.transform(F.split(F.regexp_replace(F.trim(x), r"^[\[\]]+|[\[\]]+$", ""), ","), lambda x: F.trim(x)), lambda v: v != "")
    label = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\d:]", "")))
    rows = F.transform(parted, lambda r: F.struct(label(r[0]).alias("category"), F.transform(numbers(r[1]), lambda x: x.try_cast("double")).alias("v")))
    broken = F.exists(rows, lambda r: (F.size(r["v"]) == 0) | F.exists(r["v"], lambda x: x.isNull()))
    scaled = F.transform(F.filter(rows, lambda r: F.size(r["v"]) == 4), lambda r: F.struct(r["category"].alias("category"), F.when(F.array_max(r["v"]) > 1, F.transform(r["v"], lambda x: x / 1000)).otherwise(r["v"]).alias("v")))
    boxes = F.transform(scaled, lambda r: F.struct(r["category"].alias("category"), r["v"][0].alias("x1"), r["v"][1].alias("y1"), r["v"][2].alias("x2"), r["v"][3].alias("y2")))
    return F.when(~broken, boxes)


def one_plain(c: Column) -> Column:
    """The box of a grounding answer, `[x1,y1,x2,y2]` or `<ref>label</ref><box>[[…]]</box>`: null for several boxes, several lines,
    another shape or other than numbers; numbers above 1 taken as thousandths. Their count isn't looked at here."""
    last = F.element_at(F.split(without_tokens(c), r"\[\["), -1)
    inner = F.regexp_replace(F.trim(F.when(c.contains("[["), last).otherwise(c)), r"^[\[\]]+|[\[\]]+$", "")
    v = F.transform(F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.try_cast("double"))
    fits = ~c.contains("],[") & ~c.contains("], [") & ~c.contains("\n") & ~inner.contains(":") & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())
    return F.when(fits, F.when(F.array_max(v) > 1, F.transform(v, lambda x: x / 1000)).otherwise(v))


def one_json(c: Column) -> Column:
    """The box of a grounding answer in JSON, the first of a list: null (left out) if the text names Fish or several boxes, and
    [0, 0, 0, 0] if it can't be read."""
    whole = F.try_parse_json(c)
    one = F.coalesce(F.try_variant_get(whole, "$[0].bbox_2d", "array<double>"), F.try_variant_get(whole, "$.bbox_2d", "array<double>"))
    zero = F.array(*(F.lit(0.0) for _ in range(4)))
    many = c.contains("Fish") | c.contains("],[") | c.contains("], [")
    return F.when(one.isNull(), zero).when(~many, one)


def to_pixels(box: Column, w: Column, h: Column) -> Column:
    """A box of shares of the sides in pixels, as (x, y, width, height, area)."""
    x1, y1, x2, y2 = box["x1"] * w, box["y1"] * h, box["x2"] * w, box["y2"] * h
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"), ((x2 - x1) * (y2 - y1)).alias("area"))


def between_sizes(x: Column, scale: Column, last: Column | None = None) -> Column:
    """A coordinate scaled, halves to the even number, and kept between 0 and last if that is given."""
    moved = F.bround(x * scale).cast("bigint")
    return moved if last is None else F.greatest(F.lit(0).cast("bigint"), F.least(moved, last))


def parse_json(c: Column) -> Column:
    """Boxes of `{"bbox_2d": [...], "label": ...}` objects parted by commas; a text that isn't wholly JSON is null."""
    parsed = F.from_json(F.concat(F.lit("["), without_tokens(c), F.lit("]")), "array<struct<bbox_2d:array<double>,label:string>>")
    ok = F.filter(parsed, lambda r: F.size(r["bbox_2d"]) == 4)
    return F.transform(ok, lambda r: F.struct(F.lower(r["label"]).alias("category"), r["bbox_2d"][0].alias("x1"), r["bbox_2d"][1].alias("y1"), r["bbox_2d"][2].alias("x2"), r["bbox_2d"][3].alias("y2")))


def parse_any(df: DataFrame, c: str) -> DataFrame:
    """df with <c>_kind and <c>_boxes, the boxes of a text in the dialect it is written in: json (from a brace on), plain, none (no
    box, or no text), unreadable (JSON that is cut off or holds no whole box, or a plain line without numbers)."""
    text = without_tokens(F.col(c))
    is_json = F.col(c).rlike(r"^\s*\{")
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    parsed = df.withColumns({"_json": F.when(is_json & whole, parse_json(F.col(c))), "_plain": F.when(~is_json, parse_plain(F.col(c)))})
    numbers = F.forall("_json", lambda b: b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull())
    kind = (
        F.when(F.col(c).isNull(), "none")
        .when(is_json, F.when(numbers & (F.size("_json") > 0), "json").otherwise("unreadable"))
        .when(F.col("_plain").isNull(), "unreadable")
        .when(F.size("_plain") > 0, "plain")
        .otherwise("none")
    )
    return parsed.withColumn(f"{c}_kind", kind).withColumn(f"{c}_boxes", F.when(F.col(f"{c}_kind") == "json", F.col("_json")).when(F.col(f"{c}_kind") == "plain", F.col("_plain"))).drop("_json", "_plain")


def extract_json(c: Column) -> Column:
    """The box objects that stand anywhere in a text; broken ones are skipped."""
    found = F.regexp_extract_all(c, F.lit(r'\{[^{}]*"bbox_2d"[^{}]*\}'), 0)
    parsed = F.transform(found, lambda s: F.from_json(s, "struct<bbox_2d:array<double>,label:string>"))
    return F.filter(parsed, lambda r: r.isNotNull() & (F.size(r["bbox_2d"]) == 4))


def rescale_text(c: Column, wide: Column, high: Column) -> Column:
    """Every `[x, y, x, y]` of whole numbers in the text scaled, halves to the even number; all else as it is."""
    pattern = r"\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]"
    rest = F.split(c, pattern)
    boxes = F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"\d+"), 0), lambda x, i: F.bround(x.cast("double") * F.when(i % 2 == 0, wide).otherwise(high)).cast("bigint")))
    texts = F.transform(boxes, lambda v: F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ", "), F.lit("]")))
    return F.when(wide.isNull() | high.isNull(), c).otherwise(F.array_join(F.flatten(F.zip_with(rest, texts, lambda r, t: F.array(r, F.coalesce(t, F.lit(""))))), ""))


def smart_resize(h: Column, w: Column, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> Column:
    """(height, width) as multiples of factor within the pixel budget; null if a side is too small or the sides differ more than
    200 times."""
    hb, wb = (F.greatest(F.lit(factor), (F.bround(x / factor) * factor).cast("bigint")) for x in (h, w))
    area = h.cast("double") * w
    down, up = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)
    low = lambda x: F.greatest(F.lit(factor), F.floor(x / down / factor) * factor)
    high = lambda x: F.ceil(x * up / factor) * factor
    pick = lambda x, b: F.when(hb * wb > most, low(x)).when(hb * wb < least, high(x)).otherwise(b).cast("bigint")
    fits = (F.least(h, w) >= factor) & (F.greatest(h, w) / F.least(h, w) <= 200)
    return F.when(fits, F.struct(pick(h, hb).alias("height"), pick(w, wb).alias("width")))


def best_resolution(w: Column, h: Column, candidates: list[tuple[int, int]]) -> Column:
    """The candidate (width, height) that keeps most of the picture, then wastes least; the first of equals."""
    def score(i, cw, ch):
        scale = F.least(F.lit(float(cw)) / w, F.lit(float(ch)) / h)
        kept = F.least(F.floor(w * scale) * F.floor(h * scale), w.cast("bigint") * h)
        return F.struct(kept.alias("kept"), (kept - cw * ch).alias("waste"), F.lit(-i).alias("i"), F.lit(cw).alias("width"), F.lit(ch).alias("height"))

    best = F.array_max(F.array(*(score(i, cw, ch) for i, (cw, ch) in enumerate(candidates))))
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(best["width"].alias("width"), best["height"].alias("height")))


def patches(w: Column, h: Column, size: int) -> Column:
    """The upper left corners of the grid of patches, row by row."""
    ys, xs = (F.sequence(F.lit(0), x - 1, F.lit(size)) for x in (h, w))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def iou(a: str, b: str) -> Column:
    """Overlap of the boxes with the columns <a>x1.. and <b>x1..; 0 for boxes without area."""
    wide = F.greatest(F.lit(0.0), F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1"))
    high = F.greatest(F.lit(0.0), F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1"))
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    return F.coalesce(F.try_divide(wide * high, area(a) + area(b) - wide * high), F.lit(0.0))


def best_overlaps(truth: DataFrame, found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each true box with its best overlap (0 if nothing was found), and each found box with its. All pairs within a picture are
    compared: their number is bounded by the boxes of one answer."""
    g = truth.select(*keys, F.col("box_no").alias("g_no"), *(F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")))
    p = found.select(*keys, F.col("box_no").alias("p_no"), *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))
    by_truth = g.join(p, keys, "left").withColumn("iou", F.when(F.col("p_no").isNull(), 0.0).otherwise(iou("g_", "p_"))).groupBy(*keys, "g_no").agg(F.max("iou").alias("iou"))
    by_found = p.join(g, keys).withColumn("iou", iou("g_", "p_")).groupBy(*keys, "p_no").agg(F.max("iou").alias("iou"))
    return by_truth, by_found


def grounding(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, n_pictures, n_boxes, n_found, miou, precision and recall at 0.5 and 0.75): mean of the pictures' mean best overlap;
    found boxes with a best overlap of at least t, over all found and over all true ones."""
    by_truth, by_found = best_overlaps(truth, found, keys)
    pictures = by_truth.groupBy(*keys).agg(F.avg("iou").alias("m"), F.count(F.lit(1)).alias("n"))
    left = pictures.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pictures"), F.sum("n").alias("n_boxes"), F.avg("m").alias("miou"))
    right = by_found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_found"), F.count_if(F.col("iou") >= 0.5).alias("hit50"), F.count_if(F.col("iou") >= 0.75).alias("hit75"))
    both = left.join(right, by, "left").fillna(0, ["n_found", "hit50", "hit75"])
    share = lambda k, n, name: F.coalesce(F.try_divide(k, n), F.lit(0.0)).alias(name)
    return both.select(*by, "n_pictures", "n_boxes", "n_found", "miou", share("hit50", "n_found", "precision50"), share("hit75", "n_found", "precision75"), share("hit50", "n_boxes", "recall50"), share("hit75", "n_boxes", "recall75"))


THRESHOLDS = [0.5 + 0.05 * k for k in range(10)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


def greedy(over: np.ndarray, beyond: np.ndarray, least: float) -> list[int]:
    """For each found box in order the true box that it takes, or -1: the free one it overlaps most, by at least `least`, one within
    the area range before one beyond it, the last of equals."""
    taken, free = [], np.ones(len(beyond), bool)
    for row in over:
        hit = -1
        for inside in (~beyond, beyond):
            can = np.flatnonzero(free & inside & (row >= least))
            if len(can):
                hit = int(can[row[can] == row[can].max()][-1])
                free[hit] = False
                break
        taken.append(hit)
    return taken


def matches(truth: DataFrame, found: DataFrame, most: int = 100) -> DataFrame:
    """(run, category, image, pred_no, rank, score, hit, ignored, n): found boxes matched to true ones of the same picture and
    category, in order of score; bit 10 * area + threshold of hit and ignored tells what became of a box in that area range at
    that threshold. Each group has a row with pred_no -1 and in n its numbers of true boxes in the area ranges.

    Greedy: each found box takes the free true box it overlaps most, by at least t, one within the area range before one beyond
    it; a match beyond the range, or an unmatched box beyond it, is ignored. At most `most` found boxes a picture and category.
    A group is one picture's boxes of one category."""
    ship_code(truth.sparkSession)
    cols = ["run", "image", "category", "box_no", "x1", "y1", "x2", "y2", "score"]
    both = truth.withColumn("score", F.lit(None).cast("double")).select(*cols).unionByName(found.select(*cols))
    true = F.when(F.col("score").isNull(), F.struct("box_no", "x1", "y1", "x2", "y2"))
    hit_first = F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("minus"), "box_no", "x1", "y1", "x2", "y2"))
    grouped = both.groupBy("run", "image", "category").agg(F.sort_array(F.collect_list(true)).alias("g"), F.slice(F.sort_array(F.collect_list(hit_first)), 1, most).alias("p"))
    least = [min(t, 1 - 1e-10) for t in THRESHOLDS]
    corners = lambda boxes: np.array([[b["x1"], b["y1"], b["x2"], b["y2"]] for b in boxes], float).reshape(-1, 4)

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for run, image, category, g, p in zip(f["run"], f["image"], f["category"], f["g"], f["p"]):
                gb, pb = corners(g), corners(p)
                ga, fa = ((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) for b in (gb, pb))
                wide = np.clip(np.minimum(pb[:, None, 2], gb[None, :, 2]) - np.maximum(pb[:, None, 0], gb[None, :, 0]), 0, None)
                high = np.clip(np.minimum(pb[:, None, 3], gb[None, :, 3]) - np.maximum(pb[:, None, 1], gb[None, :, 1]), 0, None)
                union = fa[:, None] + ga[None] - wide * high
                over = np.where(union > 0, wide * high / np.where(union > 0, union, 1), 0)
                # what meets what at a threshold is told by how many overlaps reach it: few thresholds differ
                reach = [int(x) for x in (over.reshape(-1, 1) >= least).sum(0)]
                hits, ignored, n, known = [0] * len(fa), [0] * len(fa), [], {}
                for a, (low, top) in enumerate(AREAS.values()):
                    beyond = (ga < low) | (ga > top)
                    n.append(int((~beyond).sum()))
                    outside, kind = ((fa < low) | (fa > top)).tolist(), beyond.tobytes()
                    for k, t in enumerate(least):
                        bit = 1 << (a * len(THRESHOLDS) + k)
                        if (kind, reach[k]) not in known:
                            known[kind, reach[k]] = greedy(over, beyond, t) if reach[k] else [-1] * len(fa)
                        for rank, hit in enumerate(known[kind, reach[k]]):
                            if hit >= 0:
                                hits[rank] |= bit
                            if beyond[hit] if hit >= 0 else outside[rank]:
                                ignored[rank] |= bit
                rows.append((run, category, image, -1, -1, 0.0, 0, 0, n))
                rows += [(run, category, image, int(b["box_no"]), rank, -float(b["minus"]), hits[rank], ignored[rank], None) for rank, b in enumerate(p)]
            yield pd.DataFrame(rows, columns=["run", "category", "image", "pred_no", "rank", "score", "hit", "ignored", "n"])

    return grouped.mapInPandas(match, "run string, category string, image string, pred_no long, rank int, score double, hit long, ignored long, n array<long>")


#: Found boxes whose running counts are held at one time.
AT_ONCE = 1024


def counted(hit: np.ndarray, ignored: np.ndarray, rank: np.ndarray, most: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each box counts, and is a hit, in each cell: two arrays of boxes x (len(most) * 40)."""
    bits = np.arange(len(AREAS) * len(THRESHOLDS))
    seen = (ignored[:, None] >> bits & 1) == 0
    taken = (hit[:, None] >> bits & 1) == 1
    rows = np.concatenate([seen & (rank < m)[:, None] for m in most], 1)
    return rows, rows & np.tile(taken, len(most))


def chunks(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of rows with equal keys of a batch, in slices of at most AT_ONCE rows."""
    values = list(zip(*(batch.column(c).to_pylist() for c in keys)))
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start] or i - start == AT_ONCE:
            yield values[start], batch.slice(start, i - start)
            start = i


def average_precision(matched: DataFrame, most: tuple[int, ...] = (100,)) -> DataFrame:
    """(run, category, area, t, most, n_truth, ap, recall): the mean of the precision envelope at 101 recalls, and the recall
    reached, with no more than `most` found boxes a picture; categories without a true box in the area range are left out. Found
    boxes of a category go by score, picture and number.

    A category may have most of the boxes: its boxes, one row each for all cells, are dealt to ranges of this order and only the
    ranges' sums are carried over, so that no task ranks a whole category. Tables that grow with the boxes or the categories are
    joined by shuffle only: what their files say of their size is far too little."""
    n_cells, n_areas, n_t = len(most) * len(AREAS) * len(THRESHOLDS), len(AREAS), len(THRESHOLDS)
    matched = written(matched, "matched")
    whole, part = ["run", "category"], ["run", "category", "_p"]
    truths = matched.where("pred_no < 0").groupBy(*whole).agg(*(F.sum(F.col("n")[a]).alias(f"n{a}") for a in range(n_areas)))
    numbers = F.array(*(F.col(f"n{a}") for a in range(n_areas)))
    ranged = matched.where("pred_no >= 0").select(*whole, (-F.col("score")).alias("_s"), "image", "pred_no", "rank", "hit", "ignored").repartitionByRange(*whole, "_s", "image", "pred_no")
    dealt = written(ranged.withColumn("_p", F.spark_partition_id()), "ranged")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, few in chunks(batch, part):
                rows, hits = counted(*(few.column(c).to_numpy() for c in ("hit", "ignored", "rank")), most)
                out.append((*key, rows.sum(0), hits.sum(0)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), *(pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in columns[3:])], names=[*part, "rows", "hits"])

    each = dealt.select(*part, "hit", "ignored", "rank").mapInArrow(sums_of, "run string, category string, _p int, rows array<long>, hits array<long>")
    sums = each.select(*part, F.posexplode(F.arrays_zip("rows", "hits")).alias("cell", "s")).groupBy(*part, "cell").agg(F.sum("s.rows").alias("rows"), F.sum("s.hits").alias("hits"))
    before = Window.partitionBy(*whole, "cell").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*part, F.struct("cell", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("rows", "hits"))).alias("s"))
    heads = offsets.groupBy(*part).agg(F.sort_array(F.collect_list("s")).alias("s")).select(*part, F.col("s.rows").alias("n0"), F.col("s.hits").alias("tp0"))
    starts = heads.hint("merge").join(truths.select(*whole, numbers.alias("n")), whole)
    none = F.lit(None).cast("array<long>")
    rows = dealt.select(*part, F.lit(1).alias("_o"), "_s", "image", "pred_no", "rank", "hit", "ignored", *(none.alias(c) for c in ("n0", "tp0", "n")))
    firsts = starts.select(*part, F.lit(0).alias("_o"), *(F.lit(None).cast(k).alias(c) for c, k in (("_s", "double"), ("image", "string"), ("pred_no", "long"), ("rank", "int"), ("hit", "long"), ("ignored", "long"))), "n0", "tp0", "n")
    ordered = rows.unionByName(firsts).repartition(*part).sortWithinPartitions(*part, "_o", "_s", "image", "pred_no")

    def steps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(run, category, cell, k, p, r): of the points with one recall step the best. Only points at a hit can raise the envelope.
        Each part begins with its row of sums, which a part of a category without a true box lacks."""

        def told() -> pa.RecordBatch:
            at = np.flatnonzero(best[0]) if key else []
            columns = [pa.array([key[0]] * len(at) if key else [], pa.string()), pa.array([key[1]] * len(at) if key else [], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.array(at, np.int32) // 101, pa.int32()), pa.array(np.array(at, np.int32) % 101, pa.int32()), *(pa.array(b[at] if key else [], pa.float64()) for b in best)], names=[*whole, "cell", "k", "p", "r"])

        key, best = None, []
        for batch in batches:
            for now, few in chunks(batch, part):
                if now != key:
                    if key:
                        yield told()
                    key, n_truth, best = now, None, [np.zeros(n_cells * 101) for _ in range(2)]
                if few.column("_o")[0].as_py() == 0:
                    n, tp = (np.array(few.column(c)[0].as_py()) for c in ("n0", "tp0"))
                    n_truth = np.tile(np.repeat(np.array(few.column("n")[0].as_py()), n_t), len(most))
                    few = few.slice(1)
                if n_truth is None or not few.num_rows:
                    continue
                rows, hits = counted(*(few.column(c).to_numpy() for c in ("hit", "ignored", "rank")), most)
                every, reached = rows.cumsum(0) + n, hits.cumsum(0) + tp
                n, tp = every[-1], reached[-1]
                i, cell = np.nonzero(hits & (n_truth > 0))
                r, p = reached[i, cell] / n_truth[cell], reached[i, cell] / every[i, cell]
                at = cell * 101 + np.floor(r * 100 + 1e-9).astype(int)
                np.maximum.at(best[0], at, p)
                np.maximum.at(best[1], at, r)
        if key:
            yield told()

    points = ordered.select(*part, "_o", "rank", "hit", "ignored", "n0", "tp0", "n").mapInArrow(steps_of, "run string, category string, cell int, k int, p double, r double")
    of = [*whole, "cell"]
    steps = points.groupBy(*of, "k").agg(F.max("p").alias("p"), F.max("r").alias("r"))
    behind = Window.partitionBy(*of).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lower = Window.partitionBy(*of).orderBy("k")
    envelope = steps.withColumns({"env": F.max("p").over(behind), "from": F.coalesce(F.lag("k").over(lower), F.lit(-1))})
    # the precision at recall j / 100 is the envelope of the first step k >= j
    reached = envelope.groupBy(*of).agg((F.sum((F.col("k") - F.col("from")) * F.col("env")) / 101).alias("ap"), F.max("r").alias("recall"))
    cells = F.array(*(F.struct(F.lit(i).alias("cell"), F.lit(list(AREAS)[i // n_t % n_areas]).alias("area"), F.lit(i % n_t).alias("t"), F.lit(most[i // n_t // n_areas]).alias("most")) for i in range(n_cells)))
    counts = truths.select(*whole, numbers.alias("n"), F.inline(cells)).withColumn("n_truth", F.get("n", (F.col("cell") / n_t).cast("int") % n_areas)).where("n_truth > 0").drop("n")
    joined = counts.hint("merge").join(reached, of, "left").fillna(0.0, ["ap", "recall"])
    return joined.select(*whole, "area", "t", "most", "n_truth", "ap", "recall")
