"""Problem 1: records of the evaluation splits that stand, exactly or almost, in the training split too.

Records with equal pictures and equal normalised turns, spaces aside, are one class (told by a 128-bit hash of its content, so that
copies need no join). Classes are compared across splits by a weighted cosine join within a block (equal set of pictures, number
of turns and digits of each answer, which no case can differ in): a term is a word in its turn, numbers among them, weighted with its inverse document frequency over all records. A class's
terms, rarest first, are put into inverted lists only as long as the rest of its vector could still reach the threshold, by the
rest's norm and by the greatest weights that the other split has for the rest's terms in the block; two entries of a list make a
candidate only if the product of their residual norms, and that of their rarest terms with the norms of the others, can reach it. Candidates get their exact dot product; those that reach it are
aligned turn by turn, since a case may differ by a word or two only."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benthos.functions.text import NUMBER_WORDS
from benthos.llm.related_splits import picture
from benthos.operators.packed_values import turns
from benthos.operators.skew import celled, counted_join, hot_split_join
from benthos.session import durable, ship_code, spread, written

#: Least cosine of candidates that are aligned. Low, since a slip or an added rare word weighs much in a short record.
THRESHOLD = 0.5
#: What may be replaced or added in a turn, typing slips aside: a word counts 1, a number or a word of one or two letters half.
MAX_CHANGED = 2.0
CLASS = ["k1", "k2"]
#: Terms of a vector that its entries in the inverted lists carry, the rarest: what the others can add is bounded by their norm.
HEAD = 128
BANDS = 24
CARRIED = ("rest", "head", "norm", "hn", "rn", "twice", "b0", "b1", "b2", "b3")
#: Rows of a class that are kept together when its pairs are written out.
HELD = 1000
#: Numbers spelt out that are equal to their digits.
SPELT = {w: n for w, n in NUMBER_WORDS.items() if w != "none"}


def normal_turn(value: Column) -> Column:
    """The words of a turn in lower case, parted by one space: `<image>` and all but letters, marks and digits part words, Han
    characters are words, numbers spelt out are digits, and a decimal part of zero is left out. A null value is empty."""
    low = F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("<image>"), F.lit(" "))
    whole = F.when(low.rlike("[0-9][.,]0"), F.regexp_replace(low, r"([0-9])[.,]0{1,2}(?![0-9])", "$1")).otherwise(low)
    words = F.regexp_extract_all(whole, F.lit(r"[a-z0-9[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]]+|\p{IsHan}"), F.lit(0))
    spelt = F.create_map(*(F.lit(x) for kv in SPELT.items() for x in kv))
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(*SPELT), F.try_element_at(spelt, w)).otherwise(w)), " ")


def normalised(samples: DataFrame) -> DataFrame:
    """(row_no, side, block, pictures, norm, k1, k2) of each row of a train, val or test split that has turns.

    norm: the words of each turn but the system's. pictures: the sorted set of pictures; block: a hash of it and of the number of
    turns. k1, k2 tell records that are equal but for spaces."""
    norm = F.transform("turns", lambda t: normal_turn(t["value"]))
    pictures = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col("image"), F.array().cast("array<string>")), picture)))), "|")
    side = F.when(F.col("split_name") == "train", "train").when(F.col("split_name").isin("val", "test"), "eval")
    told = samples.select("row_no", side.alias("side"), "image", turns(F.col("conversations")).alias("turns")).where("side is not null and row_no is not null and size(turns) > 0")
    rows = told.select("row_no", "side", norm.alias("norm"), pictures.alias("pictures"))
    rows = rows.withColumns({"block": F.xxhash64("pictures", F.size("norm")), "_s": F.transform("norm", lambda t: F.replace(t, F.lit(" "), F.lit("")))})
    return rows.withColumns({"k1": F.xxhash64("pictures", "_s"), "k2": F.xxhash64(F.lit(17), "_s", F.lit(23), "pictures")}).drop("_s")


def numbers_told(norm: Column) -> Column:
    """The digits of each answer, in a row. `same_turn` lets no number of an answer be replaced, added or left out, and turns that
    are equal but for spaces have the same digits: records that differ here are no case."""
    return F.transform(F.filter(norm, lambda t, k: k % 2 == 1), lambda t: F.regexp_replace(t, "[^0-9]", ""))


def terms(norm: Column) -> Column:
    """A hash of each different word of each turn and of the turn's number."""
    each = F.transform(norm, lambda t, k: F.transform(F.filter(F.array_distinct(F.split(t, " ")), lambda w: w != ""), lambda w: F.xxhash64(k, w)))
    return F.flatten(each)


def weight(term: Column) -> Column:
    """The weight that a weighted term carries in its upper bits; the lower 44 are of its hash, so that terms in descending order
    are the rarest first."""
    return F.shiftright(term, 44) / F.lit(float(1 << 14))


def norm_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, t: s + weight(t) * weight(t)))


def dot_of(a: Column, b: Column) -> Column:
    """The sum of the products of the weights that two vectors share."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, t: s + weight(t) * weight(t))


def class_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of blocks with both splits, with their texts, and (k1, k2, block, in_train, in_eval, v, norm): their weighted terms,
    the rarest first. rows should be cheap to read again."""
    n_rows = rows.count()
    freq = rows.select(F.explode(terms(F.col("norm"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + F.lit(float(n_rows)) / F.col("df"))
    weights = durable(freq.select("h", "df", (F.shiftleft(F.round(idf * (1 << 14)).cast("long"), 44) + F.shiftrightunsigned("h", 20)).alias("term")))
    # only blocks with both splits can have a case
    blocks = durable(rows.groupBy("block").agg(F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "eval").alias("e"), F.count(F.lit(1)).alias("_n")).where("t > 0 and e > 0").drop("t", "e"))
    live = hot_split_join(rows.drop("row_no"), blocks, ["block"], "_n", n_rows).drop("_n")
    grouped = live.groupBy(*CLASS).agg(F.first("block").alias("block"), F.first("pictures").alias("pictures"), F.min("norm").alias("norm"), (F.count_if(F.col("side") == "train") > 0).alias("in_train"), (F.count_if(F.col("side") == "eval") > 0).alias("in_eval"))
    classes = written(grouped, "classes")
    exploded = classes.select(*CLASS, "block", "in_train", "in_eval", F.explode(terms(F.col("norm"))).alias("h"))
    # no class has a term twice, so df bounds the rows of a term
    weighed = hot_split_join(exploded, weights, ["h"], "df", n_rows)
    vectors = weighed.groupBy(*CLASS, "block", "in_train", "in_eval").agg(F.sort_array(F.collect_list("term"), asc=False).alias("v"))
    return classes, written(vectors.withColumn("norm", norm_of(F.col("v"))), "vectors")


def candidate_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(t1, t2, e1, e2) of every pair of classes of a block whose cosine can reach the threshold, by the bounds of the join."""
    each = vectors.select(*CLASS, "block", "in_train", "in_eval", F.explode("v").alias("term"), (weight(F.col("term")) / F.col("norm")).alias("x"))
    # the greatest weight of a term in each split of the block; terms that the other split hasn't give nothing to any product
    greatest = durable(
        each.groupBy("block", "term")
        .agg(F.max(F.when(F.col("in_train"), F.col("x"))).alias("max_train"), F.max(F.when(F.col("in_eval"), F.col("x"))).alias("max_eval"), F.count_if("in_train").alias("n_train"), F.count_if("in_eval").alias("n_eval"), F.count(F.lit(1)).alias("_n"))
        .where("max_train is not null and max_eval is not null and _n > 1")
    )
    met = hot_split_join(each, greatest, ["block", "term"], "_n", max(1, vectors.count())).drop("_n")
    rest = Window.partitionBy(*CLASS).orderBy("term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = met.withColumns({"rest": F.sqrt(F.sum(F.col("x") * F.col("x")).over(rest)), "most_train": F.sum(F.col("x") * F.col("max_eval")).over(rest), "most_eval": F.sum(F.col("x") * F.col("max_train")).over(rest)})
    slack = threshold - 1e-6
    lists = bounds.withColumns({"as_train": F.col("in_train") & (F.col("most_train") >= slack), "as_eval": F.col("in_eval") & (F.col("most_eval") >= slack)}).where((F.col("rest") >= slack) & (F.col("as_train") | F.col("as_eval")))
    # the rarest terms of each vector, and the norms of these and of the others
    heads = vectors.withColumn("head", F.slice("v", 1, HEAD)).select(*CLASS, "head", "norm", (norm_of(F.col("head")) / F.col("norm")).alias("hn")).withColumn("rn", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("hn") * F.col("hn"))))
    # 256 bits of the head's terms, and how many terms have no bit of their own: together they bound the terms that two heads share
    for k in range(4):
        bits = F.aggregate(F.filter("head", lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(3)) == k), F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))))
        heads = heads.withColumn(f"b{k}", bits)
    heads = heads.withColumn("twice", F.size("head") - sum((F.bit_count(f"b{k}") for k in range(4)), F.lit(0)))
    entries = durable(lists.select(*CLASS, "block", "term", "rest", "as_train", "as_eval", "n_train", "n_eval").join(heads, CLASS))
    salt = F.shiftrightunsigned("k2", 1)
    ends = {}
    for side, own, other in (("t", "n_train", "n_eval"), ("e", "n_eval", "n_train")):
        rows = celled(entries.where("as_train" if side == "t" else "as_eval"), F.col(own), F.col(other), salt, side == "t")
        # train entries lie in bands of their residual norm; an eval entry goes to those bands only whose product with its own can do
        top = F.lit(BANDS - 1)
        if side == "t":
            rows = rows.withColumn("_b", F.least(top, F.floor(F.col("rest") * BANDS).cast("int")))
        else:
            least = F.least(top, F.greatest(F.lit(0), F.ceil(slack / F.col("rest") * BANDS - 1 - 1e-9).cast("int")))
            rows = rows.withColumn("_b", F.explode(F.sequence(least, top)))
        ends[side] = rows.select("block", "term", "_b", "_c1", "_c2", F.col("k1").alias(side + "1"), F.col("k2").alias(side + "2"), *(F.col(c).alias(f"{c}_{side}") for c in CARRIED))
    met = ends["t"].join(ends["e"], ["block", "term", "_b", "_c1", "_c2"])
    sizes = F.col("norm_t") * F.col("norm_e")
    tails = F.col("hn_t") * F.col("rn_e") + F.col("rn_t") * F.col("hn_e") + F.col("rn_t") * F.col("rn_e")
    # no term that the two share is rarer than the first one they meet at
    shared = sum((F.bit_count(F.col(f"b{k}_t").bitwiseAND(F.col(f"b{k}_e"))) for k in range(4)), F.least("twice_t", "twice_e"))
    at_most = shared * weight(F.col("term")) * weight(F.col("term")) / sizes + tails
    heads_dot = dot_of(F.col("head_t"), F.col("head_e")) / sizes + tails
    # in one condition, the cheapest first
    fit = (F.col("rest_t") * F.col("rest_e") >= slack) & (at_most >= slack) & ((F.col("t1") != F.col("e1")) | (F.col("t2") != F.col("e2"))) & (heads_dot >= slack)
    return met.where(fit).select("t1", "t2", "e1", "e2").distinct()


def candidate_classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(t1, t2, e1, e2, norm_t, norm_e, dot): the pairs of different classes of one block, one with train and one with eval rows,
    whose cosine reaches the threshold. rows should be cheap to read again."""
    classes, vectors = class_vectors(rows)
    pairs = durable(candidate_pairs(vectors, threshold))
    # texts and vectors of the classes that are in a candidate only
    in_pair = pairs.select(F.col("t1").alias("k1"), F.col("t2").alias("k2")).union(pairs.select("e1", "e2")).distinct()
    texts = classes.join(in_pair, CLASS, "left_semi").select(*CLASS, "pictures", F.col("norm").alias("text"))
    packed = durable(vectors.select(*CLASS, "v", "norm").join(texts, CLASS))
    of_t = packed.withColumnsRenamed({"k1": "t1", "k2": "t2", "v": "vt", "norm": "nt", "text": "norm_t", "pictures": "pt"})
    of_e = packed.withColumnsRenamed({"k1": "e1", "k2": "e2", "v": "ve", "norm": "ne", "text": "norm_e", "pictures": "pe"})
    full = counted_join(counted_join(pairs, of_t, ["t1", "t2"]), of_e, ["e1", "e2"]).where("pt = pe")
    dot = dot_of(F.col("vt"), F.col("ve")) / (F.col("nt") * F.col("ne"))
    return full.withColumn("dot", dot).where(F.col("dot") >= threshold).select("t1", "t2", "e1", "e2", "norm_t", "norm_e", "dot")


def slip(a: str, b: str) -> bool:
    """Whether b is a with a typing slip (in words of six letters or more, two): a letter left out, put in or swapped with the
    next, in longer words also another one; digits never slip, nor do words of two letters."""
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2 or any(c.isdigit() for c in a + b):
        return a == b
    long = min(len(a), len(b)) >= 6
    last, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (0 if x == y else 1 if long else 2))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
    return row[-1] <= (2 if long else 1)


def _amount(words: list[str]) -> float:
    return sum(0.5 if len(w) < 3 or w.isdigit() else 1.0 for w in words)


def same_turn(a: str, b: str, answer: bool) -> bool:
    """Whether two normalised turns differ only in typing slips and a word or two (MAX_CHANGED) replaced or added. A number may
    be added in a question, but never replaced; an answer of up to three words may only get words added, since another word makes
    it another answer."""
    if a == b or a.replace(" ", "") == b.replace(" ", ""):
        return True
    wa, wb = a.split(), b.split()
    if abs(len(wa) - len(wb)) > 2 * MAX_CHANGED or not wa or not wb:
        return False
    changed, replaced = 0.0, False
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, wa, wb, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        left, right = wa[i1:i2], wb[j1:j2]
        for x in list(left):  # slips, in order
            k = next((k for k, y in enumerate(right) if slip(x, y)), None)
            if k is not None:
                left.remove(x)
                del right[k]
        if any(c.isdigit() for w in left + right for c in w) and (answer or left and right):
            return False
        changed += max(_amount(left), _amount(right))
        replaced |= bool(left and right)
        if changed > MAX_CHANGED:
            return False
    return not (answer and replaced and min(len(wa), len(wb)) <= 3)


def same_record(a: list[str], b: list[str]) -> bool:
    return len(a) == len(b) and all(same_turn(x, y, answer=k % 2 == 1) for k, (x, y) in enumerate(zip(a, b)))


def overlaps(samples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_no_a, row_no_b), the smaller first: each pair of a train row and a val or test row that show the same set of pictures
    (or none) and whose turns are the same but for case, spacing, punctuation, slips and a word or two.

    Rows without turns, of another split or with a null row_no are no case; null values are empty turns; null paths are no
    pictures; repeated rows each give their pairs. Extra columns don't matter; an empty table gives no rows."""
    ship_code(samples.sparkSession)
    rows = written(normalised(samples).withColumn("block", F.xxhash64("block", numbers_told(F.col("norm")))), "rows")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [same_record(list(a), list(b)) for a, b in zip(f["norm_t"], f["norm_e"])]
            yield f.loc[keep, ["t1", "t2", "e1", "e2"]]

    near = candidate_classes(rows, threshold).drop("dot").mapInPandas(check, "t1 long, t2 long, e1 long, e2 long")
    sizes = rows.groupBy(*CLASS).agg(F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "eval").alias("e"))
    equal = sizes.where("t > 0 and e > 0").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    pairs = durable(near.unionByName(equal))
    # the rows of a class in arrays of about HELD, so that a class of many copies is joined as few rows
    wanted = pairs.select(F.lit("train").alias("side"), F.col("t1").alias("k1"), F.col("t2").alias("k2")).union(pairs.select(F.lit("eval"), "e1", "e2")).distinct()
    asked = rows.select("row_no", "side", *CLASS)
    counts = durable(asked.groupBy("side", *CLASS).agg(F.count(F.lit(1)).alias("n")).join(wanted, ["side", *CLASS], "left_semi"))
    # held: arrays of row_no
    dealt = hot_split_join(asked, counts, ["side", *CLASS], "n", asked.count()).withColumn("held", F.pmod(F.xxhash64("row_no"), F.ceil(F.col("n") / HELD)))
    held = durable(dealt.groupBy("side", *CLASS, "held").agg(F.collect_list("row_no").alias("rows")))
    train = held.where("side = 'train'").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("rows").alias("rts"))
    evals = held.where("side = 'eval'").select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("rows").alias("res"))
    joined = spread(pairs.join(train, ["t1", "t2"]).join(evals, ["e1", "e2"]).select("rts", "res"))
    each = joined.select(F.explode("rts").alias("rt"), "res").select("rt", F.explode("res").alias("re"))
    return each.select(F.least("rt", "re").alias("row_no_a"), F.greatest("rt", "re").alias("row_no_b"))


def overlap_report(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split_name, dataset, n_rows, n_overlapping, n_pairs) of each split and dataset, null ones too."""
    ends = pairs.select(F.explode(F.array("row_no_a", "row_no_b")).alias("row_no")).groupBy("row_no").agg(F.count(F.lit(1)).alias("n"))
    joined = samples.select("row_no", "split_name", "dataset").join(ends, "row_no", "left")
    return joined.groupBy("split_name", "dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
