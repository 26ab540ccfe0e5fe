import random
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from benthos.llm import mixing as M
from benthos.llm import related_splits as R

SAMPLE = "row_no long, id string, image array<string>"


def test_groups_against_union_find(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, "a1-web-1", f"a1-D{rng.randint(1, 60):05}-7", f"b2_d{rng.randint(1, 60)}_8", "odd"]), rng.choice([None, [], [None], [f"x/P{rng.randint(1, 150)}.JPG "], [f"y\\p{rng.randint(1, 150)}.jpeg", f"p{rng.randint(1, 150)}.png"]])) for k in range(400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i, images in rows:
        keys = [("p", p.replace("\\", "/").split("/")[-1].split(".")[0].lower()) for p in images or [] if p]
        if i and i[3:4].lower() == "d" and i != "odd":
            keys.append(("d", int(i[4:].replace("_", "-").split("-")[0])))
        find(k)
        for key in keys:
            parent[find(key)] = find(k)
    members = defaultdict(list)
    for k, *_ in rows:
        members[find(k)].append(k)
    expected = {k: min(m) for m in members.values() for k in m}
    df = spark.createDataFrame(rows, SAMPLE).selectExpr("*", "1 AS key", "2 AS anchor", "3 AS group_no")
    assert {r.row_no: r.group_no for r in R.groups(df).collect()} == expected
    assert R.groups(df.limit(0)).count() == 0


def test_forest_spans(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)] + [(k, k + 1) for k in range(400, 470)]
    labels, forest = R.components(spark.createDataFrame(edges, "u long, v long"))
    roots = {r.node: r.root for r in labels.collect()}
    assert all(u == v or roots[u] == roots[v] for u, v in edges)
    chosen = forest.select("u", "v").distinct().collect()
    assert len(chosen) == len(roots) - len(set(roots.values()))  # a tree per component
    assert {(min(e), max(e)) for e in edges} >= {(r.u, r.v) for r in chosen}


def test_deal(spark):
    rows = spark.range(10_000).selectExpr("id AS row_no", "if(id < 1000, 0, id - id % (1 + id % 3)) AS group_no", "'x' AS split_name", "1 AS band", "2 AS n")
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.08), ("test", 0.12), (None, 1.0)], "split_name string, target_share double")
    dealt = R.deal(rows, targets)
    assert dealt.count() == 10_000
    assert dealt.groupBy("group_no").agg(F.countDistinct("split_name").alias("k")).where("k > 1").count() == 0
    shares = {r.split_name: r.share for r in R.split_report(dealt, targets.where("split_name is not null")).collect()}
    assert all(abs(shares[k] - t) < 0.01 for k, t in (("train", 0.8), ("val", 0.08), ("test", 0.12)))
    assert R.deal(rows.limit(0), targets).count() == 0


def test_sainte_lague_against_quotients():
    rng = random.Random(1)
    for _ in range(200):
        weights = {f"k{i}": rng.choice([0, rng.randint(1, 100)]) for i in range(rng.randint(1, 7))}
        seats = rng.randint(0, 60)
        expected = Counter()
        for _ in range(seats if any(weights.values()) else 0):
            expected[min((k for k in weights if weights[k]), key=lambda k: (-Fraction(weights[k], 2 * expected[k] + 1), k))] += 1
        assert M.sainte_lague(weights, seats) == {k: expected[k] for k in weights}
    assert sum(M.sainte_lague({"a": 1, "b": 10**9}, 10**12).values()) == 10**12


def test_mix(spark):
    samples = spark.range(1000).selectExpr("id AS row_no", "if(id % 10 = 0, null, 'i') AS id", "if(id < 20, 'small', if(id < 990, 'big', null)) AS dataset", "if(id % 7 = 6, 'val', 'train') AS split_name", "1 AS n", "2 AS quota", "3 AS source")
    arguments = spark.createDataFrame([(1, " Small%50 , big%50,gone;", 3, 0.5), (2, "big,unlisted%10", None, None), (3, None, 1, 1.0), (4, "small%0", 2, 1.0), (5, "big%30,big%20;small%50", 100, 1.0)], "run_no int, dataset_use string, max_repeat int, size_ratio double")
    registry = spark.createDataFrame([("small",), ("big",), ("gone",), (None,)], "dataset string")
    got = M.mix(samples, arguments, registry, shard_rows=100).collect()
    train = {k: [r.row_no for r in samples.where(f"split_name = 'train' and dataset = '{k}'").collect()] for k in ("small", "big")}
    total = len(train["small"]) + len(train["big"])
    used = Counter((r.run_no, r.dataset) for r in got)
    assert used[1, "small"] == min(3 * len(train["small"]), round(total / 4)) and used[1, "big"] == round(total * 0.5) - round(total / 4)
    assert used[2, "big"] == len(train["big"]) and (2, "unlisted") not in used and not any(r.run_no in (3, 4) for r in got)
    assert abs(used[5, "small"] - total / 2) <= 1
    times = Counter((r.run_no, r.row_no) for r in got)
    assert max(n for (run, _), n in times.items() if run == 1) <= 3 and max(n for (run, _), n in times.items() if run == 2) == 1
    assert {r.row_no for r in got} <= {*train["small"], *train["big"]}
    report = {(r.run_no, r.dataset): r for r in M.shares(samples, arguments, registry).collect()}
    assert report[1, "gone"].target_share is None and report[5, "big"].weight == 50
    assert M.mix(samples.limit(0), arguments, registry).count() == 0 and M.mix(samples, arguments.limit(0), registry).count() == 0


def test_blocks_have_equal_tokens(spark):
    """The ranks that the blocks give are a bijection, and the blocks of a run have the tokens of the source's mean."""
    from benthos.llm import mixing as M

    for n in (1, 5, 16, 17, 33, 100, 1000):
        m = M.blocks_of(n)
        sizes = [M.before_block(k + 1, n) - M.before_block(k, n) for k in range(m)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    rows = [(k, f"a{k}", "reef", "train", (k * 37) % 500) for k in range(1600)] + [(2000 + k, "b", "wall", "train", None) for k in range(400)]
    df = spark.createDataFrame(rows, "row_no long, id string, dataset string, split_name string, num_tokens int")
    runs = spark.createDataFrame([(1, "reef%50,wall%50", 1, 0.4), (2, "reef,wall", 3, 1.5)], "run_no int, dataset_use string, max_repeat int, size_ratio double")
    reg = spark.createDataFrame([("reef",), ("wall",)], "dataset string")
    used = M.mix(df, runs, reg)
    got = {(r.run_no, r.dataset): (r.n, r.most) for r in used.groupBy("run_no", "dataset").agg(F.count("*").alias("n"), F.max("use_no").alias("most")).collect()}
    assert got == {(1, "reef"): (400, 1), (1, "wall"): (400, 1), (2, "reef"): (1500, 1), (2, "wall"): (1200, 3)}
    mean = used.join(df.select("row_no", "num_tokens"), "row_no").where("run_no = 1 and dataset = 'reef'").agg(F.avg("num_tokens")).first()[0]
    assert abs(mean - 249.5) < 8
    assert used.groupBy("run_no", "row_no", "use_no").count().where("count > 1").isEmpty()
    shares = {(r.run_no, r.dataset): (r.actual_share, r.share_of_total) for r in M.shares(df, runs, reg).collect()}
    assert shares[2, "wall"] == (1200 / 2700, 0.4) and shares[1, "reef"] == (0.5, 0.5)


def test_one_giant_component(spark):
    """A third of all records and more in one component, through one picture and through a chain."""
    rows = [(k, None, ["hub.jpg"] + ([f"p{k}.jpg"] if k % 2 else [])) for k in range(3000)] + [(20_000 + k, None, [f"c{k}.jpg", f"c{k + 1}.jpg"]) for k in range(300)] + [(30_000 + k, None, [f"s{k}.jpg"]) for k in range(600)]
    df = spark.createDataFrame(rows, "row_no long, id string, image array<string>")
    sizes = sorted(r[0] for r in R.groups(df).groupBy("group_no").count().select("count").collect())
    assert sizes == [1] * 600 + [300, 3000]
