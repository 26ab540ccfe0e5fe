"""Corpus metrics of generated text: BLEU, CIDEr, ROUGE-L, and the metrics of short answers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.functions import text as T
from benthos.session import ship_code

MAX_N = 4
#: Pairs whose words are Python objects at one time.
AT_ONCE = 256


def words(c: Column) -> Column:
    """Words in lower case, signs at their ends taken off."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}']+", " "), " +"), lambda w: w != "")


def grams(tokens: Column, n: int) -> Column:
    k = F.size(tokens) - (n - 1)
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _counts(pairs: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, key, n, gram, <column>): how often each n-gram stands in each text."""
    of = lambda n: F.transform(grams(F.col(column), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    each = F.inline(F.flatten(F.array(*(of(n) for n in range(1, MAX_N + 1)))))
    return pairs.select(*by, "key", each).groupBy(*by, "key", "n", "gram").agg(F.count(F.lit(1)).alias(f"{column}_n"))


def bleu(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_pairs, bleu1..bleu4) of pairs (by, key, hyp, ref) of word lists, one a key: clipped n-gram precision over the corpus,
    geometric mean and brevity penalty; 0 where an order has no match. The n-grams of a pair are counted where its row is, so
    that none is shuffled or broadcast."""
    ship_code(pairs.sparkSession)
    orders = range(1, MAX_N + 1)
    counts = ["hyp_len", "ref_len", *(f"{c}{n}" for n in orders for c in ("hit", "all"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for start in range(0, batch.num_rows, AT_ONCE):
                few = batch.slice(start, AT_ONCE)
                for a, b in zip(few.column("hyp").to_pylist(), few.column("ref").to_pylist()):
                    row = [len(a), len(b)]
                    for n in orders:
                        h, r = (Counter(zip(*(x[i:] for i in range(n)))) for x in (a, b))
                        row += [(h & r).total(), max(0, len(a) - n + 1)]
                    rows.append(row)
            columns = zip(*rows) if rows else [()] * len(counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.array(c, pa.int64()) for c in columns)], names=[*by, *counts])

    kinds = ", ".join([*(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by), *(f"{c} long" for c in counts)])
    sums = pairs.select(*by, "hyp", "ref").mapInArrow(run, kinds).groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), *(F.sum(c).alias(c) for c in counts)).where("all1 > 0")
    wide = sums.withColumns({f"p{n}": F.try_divide(f"hit{n}", f"all{n}") for n in orders})
    brevity = F.when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    score = lambda k: F.when(F.least(*(F.coalesce(f"p{i}", F.lit(0.0)) for i in range(1, k + 1)), F.lit(1.0)) > 0, brevity * F.exp(sum(F.log(f"p{i}") for i in range(1, k + 1)) / k)).otherwise(0.0)
    return wide.select(*by, "n_pairs", *(score(k).alias(f"bleu{k}") for k in orders))


def cider(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, cider): ten times the mean over n of the clipped tf-idf cosine of each pair, damped by the difference in length; the
    document frequency of an n-gram is the number of references that hold it."""
    sizes = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))
    h, r = _counts(pairs, by, "hyp"), _counts(pairs, by, "ref")
    df = r.groupBy(*by, "n", "gram").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(sizes), by)
    idf = df.select(*by, "n", "gram", (F.log("n_pairs") - F.log("df")).alias("idf"))
    whole = h.join(r, [*by, "key", "n", "gram"], "full").fillna(0, ["hyp_n", "ref_n"]).join(idf, [*by, "n", "gram"], "left").join(F.broadcast(sizes), by)
    w = F.coalesce("idf", F.log("n_pairs"))
    each = whole.groupBy(*by, "key", "n").agg(F.sum(F.least("hyp_n", "ref_n") * w * F.col("ref_n") * w).alias("dot"), F.sqrt(F.sum((F.col("hyp_n") * w) ** 2)).alias("a"), F.sqrt(F.sum((F.col("ref_n") * w) ** 2)).alias("b"))
    lengths = pairs.select(*by, "key", (F.size("hyp") - F.size("ref")).alias("d"))
    per = each.join(lengths, [*by, "key"]).withColumn("s", F.coalesce(F.try_divide("dot", F.col("a") * F.col("b")), F.lit(0.0)) * F.exp(-(F.col("d") ** 2) / 72.0))
    sums = per.groupBy(*by).agg(F.sum("s").alias("s"))
    return sizes.join(sums, by, "left").select(*by, "n_pairs", (10 * F.coalesce("s", F.lit(0.0)) / MAX_N / F.col("n_pairs")).alias("cider"))


def rouge_l(pairs: DataFrame, by: list[str], beta: float = 1.2) -> DataFrame:
    """(by, rouge_l): the mean F of the longest common subsequence of each pair; found by dynamic programming in Arrow batches."""
    ship_code(pairs.sparkSession)

    def common(a, b) -> int:
        # one bit for each word of a, set while no longer subsequence ends there
        at: dict[str, int] = {}
        for i, w in enumerate(a):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(a)) - 1
        v = full
        for w in b:
            u = v & at.get(w, 0)
            v = ((v + u) | (v - u)) & full
        return len(a) - v.bit_count()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b in zip(f["hyp"], f["ref"]):
                n = common(a, b)
                p, r = (n / len(a) if len(a) else 0.0), (n / len(b) if len(b) else 0.0)
                out.append((1 + beta**2) * p * r / (r + beta**2 * p) if p and r else 0.0)
            yield f[by].assign(f=out)

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    return pairs.select(*by, "hyp", "ref").mapInPandas(run, f"{kinds}, f double").groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("f").alias("rouge_l"))


def soft_score(k: Column) -> Column:
    """The leave-one-out score of an answer that k of ten people gave."""
    return (k * F.least(F.lit(1.0), (k - 1) / 3) + (10 - k) * F.least(F.lit(1.0), k / 3)) / 10


def anls(answer: Column, truths: Column) -> Column:
    """The best of 1 - edit distance / longer length over the truths, 0 below a half; equal empty ones are 1. White space of any
    script around them and letter case do not count."""
    a = T.normal_label(answer)
    near = F.transform(F.transform(truths, T.normal_label), lambda t: F.coalesce(1 - F.try_divide(F.levenshtein(a, t), F.greatest(F.length(a), F.length(t))), F.lit(1.0)))
    best = F.array_max(near)
    return F.when(best >= 0.5, best).otherwise(0.0)
