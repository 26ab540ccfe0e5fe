"""Problem 8: long spans that stand word for word in another document, by difference-cover anchors.

A difference cover D of the period v has, for any two positions i and j, a shift k < v with (i + k) mod v and (j + k) mod v both
in D. So any match of at least LENGTH characters holds, in every v of them, such an aligned place, and there a window of
LENGTH - v + 1 characters that is hashed in both documents: hashing windows only at the positions of D finds every match. Anchors
that two documents have are sent, with the v - 1 characters at each side, to their hash; in a group of up to GROUP anchors each
is extended to both sides against the others, and what is LENGTH or more together is shared: with the next anchor v characters
on, nothing of a match is missed. In a larger group the windows of full LENGTH around its anchors are compared by a 128-bit hash
instead, so that a group of copies costs its size, not its square. The union over a document, cut into longest runs, is the
result; no pair of documents ever leaves a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benthos.operators.skew import hot_split_join
from benthos.session import durable, ship_code, spread, written

LENGTH = 200
#: Anchors of one hash that are extended against each other; windows of larger groups are compared by hash.
GROUP = 32
#: The perfect difference set of 91.
COVER_91 = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
#: Characters hashed at once in a Python worker; a longer document is one part.
PART = 400_000


@lru_cache(maxsize=8)
def difference_cover(v: int) -> tuple[int, ...]:
    """A small difference cover of v: for 91 the perfect one, else greedily, each step adding the residue that covers most
    differences."""
    if v == 91:
        return COVER_91
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max(range(v), key=lambda x: (len({(x - c) % v for c in cover} & missing | {(c - x) % v for c in cover} & missing), -x))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return tuple(sorted(cover))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 constants)."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of any windows of equal width over a sequence of code points: a polynomial over Z/2^64 in the mixed code points,
    by prefix sums. Powers of the odd base and of its inverse make every window's hash independent of its place."""

    def __init__(self, codes: np.ndarray, seed: int):
        base = (seed * 2 | 5) % (1 << 64)
        n = len(codes)
        inverse = pow(base, -1, 1 << 64)
        powers = np.ones(n + 1, np.uint64)
        self.inverse = np.ones(n + 1, np.uint64)
        powers[1:] = np.uint64(base)
        self.inverse[1:] = np.uint64(inverse)
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        values = _mix(codes.astype(np.uint64), seed) * powers[:-1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])
        self.seed = seed

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return _mix((self.sums[starts + width] - self.sums[starts]) * self.inverse[starts], self.seed).view(np.int64)


SEEDS = (0x9E3779B97F4A7C15, 0x6A09E667F3BCC909)


def _parts(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about PART characters."""
    at, total = 0, 0
    for k, n in enumerate(lengths):
        if total and total + n > PART:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each starts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _emit(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=names)


def anchors(docs: DataFrame, period: int, length: int) -> DataFrame:
    """(h, doc_id, part, pos): the hash of the window at each position of the cover, of each document (doc_id, text, part)."""
    width, cover = length - period + 1, np.array(difference_cover(period))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, parts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for a, b in _parts([len(t) for t in texts]):
                codes, starts = _codes(texts[a:b])
                windows = Windows(codes, SEEDS[0])
                sizes = np.diff(starts)
                # all cover positions of each document, by the longest one's grid
                for k in range(b - a):
                    grid = (np.arange(0, sizes[k] - width + 1, period)[:, None] + cover).ravel() if sizes[k] >= width else np.empty(0, np.int64)
                    grid = grid[grid + width <= sizes[k]]
                    if len(grid):
                        yield from _emit([windows.at(starts[k] + grid, width), np.full(len(grid), ids[a + k]), np.full(len(grid), parts[a + k]), grid.astype(np.int32)], ["h", "doc_id", "part", "pos"])

    return docs.mapInArrow(_gathered(run), "h long, doc_id long, part long, pos int")


def _gathered(run):
    """run, with its small batches put together to large ones."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def grams(candidates: DataFrame, period: int, length: int) -> DataFrame:
    """(g1, g2, doc_id, pos): two hashes of each window of full length that holds one of the document's shared anchors."""
    width = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hits = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            for a, b in _parts([len(t) for t in texts]):
                codes, starts = _codes(texts[a:b])
                first, second = (Windows(codes, s) for s in SEEDS)
                for k in range(b - a):
                    size = int(starts[k + 1] - starts[k])
                    if size < length:
                        continue
                    edges = np.zeros(size - length + 2, np.int32)  # +1 where a run of candidate windows begins, -1 after its end
                    pos = hits[a + k].values.to_numpy()
                    np.add.at(edges, np.clip(pos - (length - width), 0, size - length + 1), 1)
                    np.add.at(edges, np.minimum(pos, size - length) + 1, -1)
                    here = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
                    if len(here):
                        at = starts[k] + here
                        yield from _emit([first.at(at, length), second.at(at, length), np.full(len(here), ids[a + k]), here.astype(np.int32)], ["g1", "g2", "doc_id", "pos"])

    return candidates.mapInArrow(_gathered(run), "g1 long, g2 long, doc_id long, pos int")


def contexts(candidates: DataFrame, period: int, length: int) -> DataFrame:
    """(h, h2, doc_id, pos, before, after): each of the document's shared anchors of small groups, with a second hash of it and the
    period - 1 characters at each side, fewer at the document's ends."""
    width = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hits, hashes = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for a, b in _parts([len(t) for t in texts]):
                codes, starts = _codes(texts[a:b])
                second = Windows(codes, SEEDS[1])
                for k in range(a, b):
                    pos = hits[k].values.to_numpy()
                    if len(pos):
                        t = texts[k]
                        around = [pa.array([t[max(0, p - period + 1) : p] for p in pos]), pa.array([t[p + width : p + length] for p in pos])]
                        own = [pa.array(x) for x in (hashes[k].values.to_numpy(), second.at(starts[k - a] + pos, width), np.full(len(pos), ids[k]), pos.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([*own, *around], names=["h", "h2", "doc_id", "pos", "before", "after"])

    return candidates.mapInArrow(_gathered(run), "h long, h2 long, doc_id long, pos int, before string, after string")


def _sides(texts: list[str], n: int, backwards: bool) -> np.ndarray:
    """The code points of each text from the anchor on, as rows of n; what a text lacks equals nothing."""
    out = np.repeat(-1 - np.arange(len(texts), dtype=np.int64)[:, None], n, 1)
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, np.repeat(sizes, sizes) - 1 - at if backwards else at] = codes
    return out


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their leading columns each row of a and of b have in common."""
    other = a != b
    return np.where(other.any(1), other.argmax(1), a.shape[1])


def extended(t: pa.Table, period: int, length: int) -> pa.RecordBatch:
    """(doc_id, from_char, to_char) of the anchors of t, sorted by h, that are part of a match of `length` or more."""
    width = length - period + 1
    h, h2, doc, pos = (t.column(c).to_numpy() for c in ("h", "h2", "doc_id", "pos"))
    before, after = _sides(t.column("before").to_pylist(), period - 1, True), _sides(t.column("after").to_pylist(), period - 1, False)
    left, right = np.full(len(h), -1), np.full(len(h), -1)
    edges = np.flatnonzero(np.diff(h)) + 1
    size = np.diff(np.concatenate([[0], edges, [len(h)]]))
    last = np.repeat(np.cumsum(size), size)  # where each row's group ends
    for step in range(1, int(size.max()) if len(size) else 0):
        i = np.flatnonzero(np.arange(len(h)) + step < last)
        j = i + step
        ok = (doc[i] != doc[j]) & (h2[i] == h2[j])
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            x, y = _reach(before[a], before[b]), _reach(after[a], after[b])
            ok = x + width + y >= length
            for e in (a[ok], b[ok]):
                np.maximum.at(left, e, x[ok])
                np.maximum.at(right, e, y[ok])
    on = left >= 0
    return pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array((pos[on] - left[on]).astype(np.int32)), pa.array((pos[on] + width + right[on]).astype(np.int32))], names=["doc_id", "from_char", "to_char"])


def extend(around: DataFrame, period: int, length: int) -> DataFrame:
    """(doc_id, from_char, to_char) of every match of the anchors of one hash, which stand in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:  # but for the last group, which may go on
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1])) if h[0] != h[-1] else 0
                if cut:
                    yield extended(t.slice(0, cut), period, length)
                held = t.slice(cut).combine_chunks().to_batches()
                rows = len(h) - cut
        if rows:
            yield extended(pa.Table.from_batches(held), period, length)

    return around.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc_id long, from_char int, to_char int")


def shared_spans(docs: DataFrame, length: int = LENGTH, period: int = 0, group: int = GROUP) -> DataFrame:
    """(doc_id, from_char, to_char): the longest runs of characters that lie in `length` or more successive characters standing
    identically in a document with another doc_id. Offsets count code points from 0, to_char is exclusive.

    Null, empty and shorter texts, and null ids, share nothing; rows with an equal doc_id are one document's and don't share
    with each other; repetition inside one document alone doesn't count; other columns don't matter. Whole texts are used.

    period: of the cover, 91 for a length of 200, in proportion for others. A smaller one makes more anchors of longer windows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    period = period or max(2, length * 91 // 200)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    # a document of several rows is one, but its texts have positions of their own
    texts = texts.withColumn("part", F.xxhash64("text"))
    found = written(anchors(spread(texts), period, length), "anchors")
    return _spans(texts, found, length, period, group)


def _twice(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that two or more documents have, with the number of rows; combined before the shuffle."""
    seen = df.groupBy(*keys).agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count(F.lit(1)).alias("_n"))
    return seen.where("_a <> _b").drop("_a", "_b")


def _spans(texts: DataFrame, found: DataFrame, length: int, period: int, group: int) -> DataFrame:
    shared = durable(_twice(found, ["h"]).withColumn("small", F.col("_n") <= group))
    hits = hot_split_join(found, shared, ["h"], "_n", found.count())
    # bounded by the document's own length
    by_doc = hits.groupBy("doc_id", "part").agg(F.collect_list(F.when(F.col("small"), F.struct("pos", "h"))).alias("near"), F.collect_list(F.when(~F.col("small"), F.col("pos"))).alias("hits"))
    candidates = written(texts.join(by_doc, ["doc_id", "part"]).select("doc_id", "text", F.col("near.pos").alias("near"), F.col("near.h").alias("hashes"), "hits"), "candidates")
    runs = extend(contexts(candidates.select("doc_id", "text", "near", "hashes"), period, length), period, length)
    if not shared.where("not small").isEmpty():
        wide = written(grams(candidates.where("size(hits) > 0").select("doc_id", "text", "hits"), period, length), "grams")
        same = hot_split_join(wide, _twice(wide, ["g1", "g2"]), ["g1", "g2"], "_n", wide.count())
        runs = runs.unionByName(same.select("doc_id", F.col("pos").alias("from_char"), (F.col("pos") + length).alias("to_char")))
    # spans that touch or overlap are one run
    before = Window.partitionBy("doc_id").orderBy("from_char", "to_char").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("doc_id").orderBy("from_char", "to_char")
    starts = runs.distinct().withColumn("new", F.coalesce((F.col("from_char") > F.max("to_char").over(before)).cast("int"), F.lit(1)))
    numbered = starts.withColumn("run", F.sum("new").over(up_to))
    return numbered.groupBy("doc_id", "run").agg(F.min("from_char").alias("from_char"), F.max("to_char").alias("to_char")).drop("run")


def shared_report(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, shared_part) of each document that is not null; shared_part of an empty or null
    text is 0."""
    sums = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("to_char") - F.col("from_char")).alias("shared_chars"))
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    joined = sizes.join(sums, "doc_id", "left").fillna(0, ["n_spans", "shared_chars"])
    return joined.withColumn("shared_part", F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0)))
