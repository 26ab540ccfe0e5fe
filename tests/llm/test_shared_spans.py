import random

from hypothesis import given, settings
from hypothesis import strategies as st

from benthos.llm import shared_spans as S


def brute(docs, length):
    owners = {}
    for i, t in docs:
        if i is not None and t:
            for p in range(len(t) - length + 1):
                owners.setdefault(t[p : p + length], set()).add(i)
    out = set()
    for i, t in docs:
        if i is None or not t:
            continue
        marks = [False] * len(t)
        for p in range(len(t) - length + 1):
            if len(owners[t[p : p + length]]) > 1:
                marks[p : p + length] = [True] * length
        start = None
        for k, m in enumerate([*marks, False]):
            if m and start is None:
                start = k
            elif not m and start is not None:
                out.add((i, start, k))
                start = None
    return out


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 130))
def test_cover(v):
    d = S.difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) <= 2 * v**0.5 + 3


def check(spark, docs, length, group=S.GROUP):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS pos", "3 AS hits")
    got = [tuple(r) for r in S.shared_spans(df, length, group=group).select("doc_id", "from_char", "to_char").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, length)
    return got


def test_random_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc é中😀") for _ in range(n))
    common = [word(rng.randint(20, 60)) for _ in range(6)]
    docs = [(k, "".join(rng.choice([word(rng.randint(0, 25)), rng.choice(common)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    docs += [(100, None), (101, ""), (None, common[0] * 2), (102, docs[3][1]), (103, docs[3][1]), (104, common[1] + common[1])]
    assert check(spark, docs, 20)
    assert check(spark, docs, 20, group=3)  # most anchors' groups are larger, and compared by hash


def test_copies_and_repeats(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(400))
    assert sorted(check(spark, [(k, text) for k in range(30)] + [(99, text[:200]), (98, text[:199])], 200))[0] == (0, 0, 400)
    assert len(check(spark, [(k, text) for k in range(40)] + [(99, text[:200]), (98, text[150:] + "z" * 90)], 200)) == 42
    assert check(spark, [(1, "ab" * 300)], 200) == []  # only within itself
    assert check(spark, [(1, text), (1, text)], 200) == []  # one document twice
    assert check(spark, [], 200) == []


def test_report(spark):
    docs = spark.createDataFrame([(1, "x" * 250), (2, "x" * 220), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.n_spans, r.shared_chars, r.shared_part) for r in S.shared_report(docs, S.shared_spans(docs)).collect()}
    assert got == {1: (250, 1, 250, 1.0), 2: (220, 1, 220, 1.0), 3: (0, 0, 0, 0.0)}
