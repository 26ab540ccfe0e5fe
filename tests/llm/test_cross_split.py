import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from benthos.llm import cross_split as X

SCHEMA = "row_no long, image array<string>, conversations array<struct<speaker:string,value:string>>, split_name string, dataset string"


def record(k, split, question, answer, images=("a/X.jpg",), system=False):
    turns = ([("system", "be kind")] if system else []) + [("human", question), ("gpt", answer)]
    return (k, list(images) if images is not None else None, turns, split, "d")


Q, A = "What is the banded sponge doing beside the old tyre?", "Sediment from Hudale Point settled on the cable trench within 14 hours, as the reviewer reported."


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS k1", "2 AS word", "3 AS block", "4 AS norm")
    return sorted((r.row_no_a, r.row_no_b) for r in X.overlaps(df).collect())


def test_cases(spark):
    noise = [record(100 + k, random.Random(k).choice(["train", "val"]), f"What about the {w} here?", f"It is the {w} by the {v}.") for k, (w, v) in enumerate([("reef", "wall"), ("ray", "sand"), ("eel", "rock"), ("net", "line")] * 6)]
    rows = [
        record(1, "train", "<image>\n" + Q, A),
        record(2, "val", Q.upper() + "<image>", A.replace(" ", "  ").rstrip("."), images=("B\\x.PNG ",), system=True),
        record(3, "test", Q.replace("sponge", "sopnge").replace("beside", "next to"), "Please " + A),
        record(4, "test", Q, A.replace("14", "15")),  # another number
        record(5, "test", Q, "It rests."),
        record(6, "test", Q, A, images=("other.jpg",)),
        record(7, "test", Q, A, images=None),
        record(8, "train", Q, A),
        record(9, None, Q, A),
        (10, None, None, "train", "d"),
        (11, [None], [("human", None)], "val", None),
        (12, [], [("human", "")], "train", None),
    ]
    got = [p for p in found(spark, rows + noise) if max(p) < 100]
    assert got == [(1, 2), (1, 3), (2, 8), (3, 8), (11, 12)]


def test_short_answers_must_agree():
    assert X.same_record(["is it here", "yes"], ["is it hree", "yes"])
    assert not X.same_record(["is it here", "yes"], ["is it here", "no"])
    assert not X.same_record(["name the fish on deck", "copper goby"], ["name the fish on deck", "copper ray"])
    assert X.same_record(["name the fish on deck", "copper goby"], ["please name the fish on deck", "coppre goby"])
    assert not X.same_record(["count them", "14"], ["count them", "41"])
    assert not X.same_record(["q", "the red goby rests on a flat rock"], ["q", "the blue ray hides on a flat rock"])


def test_empty(spark):
    assert found(spark, []) == []


def test_join_loses_no_pair(spark):
    """Against comparing all pairs: the records of one block, with numbers, slips and changed words. The cosine over all words may
    lose a short pair with four changed words; no less than nine in ten are found."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(4, 9))) for _ in range(80)] + [str(k) for k in range(20)] + ["three", "2.0", "7"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 16))] for _ in range(25)]
    rows = []
    for k in range(240):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(words))
            w = words[at]
            words[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [w, rng.choice(vocabulary)], [w[1:] or w], [w[:1] + w[2:3] + w[1:2] + w[3:]], []])
        rows.append(record(k, rng.choice(["train", "test"]), " ".join(words[:4]), " ".join(words[4:]), images=None))
    norm = {r.row_no: list(r.norm) for r in X.normalised(spark.createDataFrame(rows, SCHEMA)).collect()}
    side = {r[0]: r[3] for r in rows}
    expected = {(min(a, b), max(a, b)) for a in norm for b in norm if side[a] == "train" and side[b] == "test" and X.same_record(norm[a], norm[b])}
    got = set(found(spark, rows))
    assert len(expected) > 300 and got <= expected
    assert len(got) >= 0.9 * len(expected), (len(got), len(expected))


def test_exact_dot_products(spark):
    """The candidates are all pairs whose cosine reaches the threshold."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    rows = [record(k, rng.choice(["train", "val"]), " ".join(rng.choices(vocabulary, k=5)), " ".join(rng.choices(vocabulary[:9], k=4)), images=None) for k in range(120)]
    norms = X.normalised(spark.createDataFrame(rows, SCHEMA))
    data = norms.collect()
    df = Counter((k, w) for r in data for k, t in enumerate(r.norm) for w in set(t.split()))
    weight = {t: math.log(1 + len(data) / n) for t, n in df.items()}
    vector = {tuple(r.norm): {(k, w): weight[k, w] for k, t in enumerate(r.norm) for w in t.split()} for r in data}
    sides = {}
    for r in data:
        sides.setdefault(tuple(r.norm), set()).add(r.side)
    size = {n: math.sqrt(sum(x * x for x in v.values())) for n, v in vector.items()}
    expected = {(a, b): sum(x * vector[b].get(t, 0) for t, x in vector[a].items()) / size[a] / size[b] for a in vector for b in vector if a != b and "train" in sides[a] and "eval" in sides[b]}
    got = {(tuple(r.norm_t), tuple(r.norm_e)): r.dot for r in X.candidate_classes(norms, 0.4).collect()}
    assert {p for p, x in expected.items() if x >= 0.4001} <= set(got) <= {p for p, x in expected.items() if x >= 0.3999}
    assert all(abs(x - expected[p]) < 1e-4 for p, x in got.items())
    assert len(got) > 20


def test_one_list_with_most_rows(spark):
    """A third of all rows in one block and with one rare word; copies of one record on both sides."""
    rows = [record(k, ["train", "test"][k % 2], f"where is number {k // 2} now", f"the zyx lies by marker {k // 2} of the wall", images=None) for k in range(400)]
    rows += [record(1000 + k, ["train", "val"][k % 2], Q, A) for k in range(60)]
    got = found(spark, rows)
    assert len(got) == 200 + 30 * 30 and len(set(got)) == len(got)


def test_numbers_added_or_spelt_out(spark):
    rows = [
        record(1, "train", Q, "There are two sponges."),
        record(2, "val", Q, "There are 2 sponges."),
        record(3, "val", Q.replace("tyre", "tyre 7"), "There are two sponges."),
        record(4, "val", Q, "There are 3 sponges."),
        record(5, "val", Q.replace("tyre", "tyre 7"), "There are two sponges.", images=("other.jpg",)),
        record(6, "val", Q.replace("tyre", "tyre at stop 7"), "There are two sponges."),
    ]
    noise = [record(100 + k, ["train", "val"][k % 2], f"What about the {w} here?", f"It is the {w} by the rock.") for k, w in enumerate(["reef", "ray", "eel", "net"] * 4)]
    assert [p for p in found(spark, rows + noise) if max(p) < 100] == [(1, 2), (1, 3), (1, 6)]
    bare = [(k, None, *r[2:]) for k, r in zip(range(1, 7), rows)]  # the same without pictures
    assert [p for p in found(spark, bare + noise) if max(p) < 100] == [(1, 2), (1, 3), (1, 5), (1, 6)]
    depth = [record(1, "train", Q, "It lies 10 m below the old buoy."), record(2, "test", Q, "It lies 10.0 m below the old buoy."), record(3, "test", Q, "It lies 15 m below the old buoy."), record(4, "val", Q, "14", images=None), record(5, "train", Q, "15", images=None)]
    assert found(spark, depth + noise) == [(1, 2)]
    assert not X.same_turn("how deep is buoy 3 here", "how deep is buoy 4 here", answer=False)
    assert not X.same_turn("it lies by the old rusty buoy", "it lies by the old rusty buoy 4", answer=True)


def test_numbers_of_answers_part_blocks(spark):
    """What the join compares has the same digits in each answer, and no pair of the same record is lost by it: all pairs of texts
    with numbers in words, beside words, spelt out and parted by spaces."""
    rng = random.Random(5)
    words = ["1", "2", "12", "3", "1 2", "2nd", "b2", "0.5", "10.0", "three", "one", "x1y", "reef", "sponge", "m"]
    turns = {" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(300)}
    rows = [record(k, "train", "Which number is told here?", t) for k, t in enumerate(sorted(turns))]
    got = X.normalised(spark.createDataFrame(rows, SCHEMA)).select("norm", X.numbers_told(F.col("norm")).alias("told")).collect()
    same = [(a, b) for a in got for b in got if a.norm != b.norm and X.same_record(a.norm, b.norm)]
    assert len(same) > 100 and all(a.told == b.told for a, b in same)
    assert got[0].told == [re.sub("[^0-9]", "", got[0].norm[1])]
    # one block of 600 by 600 records without pictures: only those whose answers have the same number are compared
    rows = [record(k, ["train", "test"][k % 2], "How deep is the old rusty buoy here?", f"It lies {k // 2} m below the old rusty buoy.", images=None) for k in range(1200)]
    before, compared = X.candidate_pairs, []

    def counted(vectors, threshold):
        compared.append(vectors.groupBy("block").agg(F.expr("count_if(in_train) * count_if(in_eval)").alias("n")).agg(F.sum("n")).first()[0])
        return before(vectors, threshold)

    X.candidate_pairs = counted
    try:
        assert found(spark, rows) == [(k, k + 1) for k in range(0, 1200, 2)]
    finally:
        X.candidate_pairs = before
    assert compared == [600]
