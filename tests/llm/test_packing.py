import itertools
import random

from benthos.llm import packing


def test_window_against_all_subsets():
    rng = random.Random(2)
    for _ in range(60):
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(0, 9))), reverse=True)
        room = rng.randint(0, 60)
        sizes = sorted(set(items), reverse=True)
        used = packing.fill_window(sizes, [items.count(s) for s in sizes], room)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        assert sum(s * n for s, n in used.items()) == best and all(n <= items.count(s) for s, n in used.items())


def test_fillings_use_everything_once():
    rng = random.Random(3)
    items = [rng.randint(1, 256) for _ in range(3000)]
    found = packing.fillings({s: items.count(s) for s in set(items)}, 256)
    assert all(sum(s * n for s, n in used.items()) <= 256 for _, used in found)
    assert {s: sum(t * u.get(s, 0) for t, u in found) for s in set(items)} == {s: items.count(s) for s in set(items)}
    least = max(-(-sum(items) // 256), sum(x > 128 for x in items))  # no two of more than half fit together
    assert sum(t for t, _ in found) <= 1.015 * least
    # a thousand times the items makes no more kinds of filling than there are sizes
    assert len(packing.fillings({s: 1000 * items.count(s) for s in set(items)}, 256)) <= 2 * len(set(items))


def test_pack(spark):
    rows = [(k, k % 9 + 1) for k in range(500)] + [(7, 8), (900, 25), (901, 20), (902, 0), (903, None), (None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").selectExpr("*", "1 AS rank", "2 AS limit_no", "3 AS size")
    got = packing.pack(df, "doc_id", "n_tokens", [(1, 10), (2, 64), (3, None), (4, 0)]).toPandas()
    for limit, capacity in ((1, 10), (2, 64)):
        part = got[got.limit_no == limit]
        assert part.n_tokens.sum() == sum(n or 0 for _, n in rows)
        assert part.groupby("container_no").n_tokens.sum().max() <= capacity
        assert part.container_no.nunique() <= -(-part.n_tokens.sum() // capacity) + 2
    whole = got[got.limit_no == 2]
    assert len(whole) == len(rows) - 2
    pieces = got[(got.limit_no == 1) & (got.doc_id == 900)].sort_values("piece_no")
    assert pieces.n_tokens.tolist() == [10, 10, 5] and pieces.from_token.tolist() == [0, 10, 20] and pieces.container_no.nunique() == 3
    assert got[(got.limit_no == 1) & (got.doc_id == 901)].n_tokens.tolist() == [10, 10]
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", [(1, 10)]).count() == 0
    assert packing.pack(df, "doc_id", "n_tokens", []).count() == 0
