import json
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from benthos.functions import text as T
from benthos.operators import boxes as B
from benthos.operators import captions as C
from benthos.operators import conversations as V
from benthos.operators import evaluation as E
from benthos.operators import preparation as P
from benthos.operators.skew import hot_split_join, salted_rank
from benthos.sources import files
from benthos.streaming import workers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_classification_from_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc") * 3, rng.choice("abc") * 3) for _ in range(300)]
    df = spark.createDataFrame(rows, "y_true string, y_pred string")
    s = E.label_summary(E.label_report(E.confusion(df, []), []), []).first()
    t, p = (np.array([r[k] for r in rows]) for k in (0, 1))
    labels = sorted({*t, *p})
    m = np.array([[((t == a) & (p == b)).sum() for b in labels] for a in labels])
    n, c, tk, pk = m.sum(), np.trace(m), m.sum(1), m.sum(0)
    assert math.isclose(s.accuracy, c / n)
    assert math.isclose(s.mcc, (c * n - tk @ pk) / math.sqrt((n * n - pk @ pk) * (n * n - tk @ tk)))
    pe = tk @ pk / n / n
    assert math.isclose(s.kappa, (c / n - pe) / (1 - pe))
    auc = sum(tk[i] * (m[i, i] / tk[i] + (n - tk[i] - pk[i] + m[i, i]) / (n - tk[i])) / 2 for i in range(3)) / n
    assert math.isclose(s.auc, auc)


def test_counting_drops_what_is_no_number(spark):
    df = spark.createDataFrame([("m", " 12 ", "10"), ("m", "+5", "5"), ("m", "5 fish", "5"), ("m", None, "1"), ("m", "0", "1.0")], "model_id string, y_true string, y_pred string")
    r = E.counting(df, ["model_id"]).first()
    assert (r.n_scored, r.n_dropped, r.mae, r.max_error) == (2, 3, 1.0, 2.0)


def test_scalar_texts(spark):
    assert one(spark, T.normal_answer(F.lit("The two dogs, isnt it? a-b. 3.5"))) == "2 dogs isn't it b 3.5"
    assert one(spark, T.drop_trailing_signs(F.lit("café."))) == "café"
    assert one(spark, T.yes_or_no(F.lit("No, it is. yes"))) == "no"
    assert one(spark, T.yes_or_no(F.lit("Nothing"))) == "yes"
    assert one(spark, T.option_letter(F.lit("So. The answer is B."))) == "B"
    assert one(spark, T.option_letter(F.lit("The answer is B. The answer is C."))) == "FAILED"
    assert list(one(spark, T.score_pair(F.lit("7, 8\nx")))) == [-1.0, -1.0]
    assert list(one(spark, T.score_pair(F.lit("7 8.5\nx")))) == [7.0, 8.5]
    assert one(spark, T.question_of_prompt(F.lit("Reference OCR token: a\nWhat?\nx"))) == "what?"
    assert one(spark, T.model_name(F.lit("a/run/checkpoint-5/"))) == "run_checkpoint-5"
    assert one(spark, T.word_count(F.lit(" a b  "))) == 2


def test_boxes(spark):
    box = one(spark, B.parse_plain(F.lit("red fish 1: [100,200,300,400]\nnoise\nray: [0.1,0.2,0.3,0.4]")))
    assert [(b.category, b.x1) for b in box] == [("red fish", 0.1), ("ray", 0.1)]
    assert one(spark, B.parse_plain(F.lit("a: [1,x,2,3]"))) is None
    assert one(spark, B.rescale_text(F.lit("at [10, 20, 30, 41] and [1,2]"), F.lit(0.5), F.lit(0.5))) == "at [5, 10, 15, 20] and [1,2]"
    r = one(spark, B.smart_resize(F.lit(428), F.lit(640)))
    assert (r.height, r.width) == (420, 644)
    assert one(spark, B.smart_resize(F.lit(20), F.lit(640))) is None


def test_average_precision_against_loop(spark):
    """One box a picture, equal scores: greedy matching is a threshold on the overlap."""
    rng = random.Random(3)
    truth, found = [], []
    for k in range(60):
        x, y = rng.uniform(0, 500), rng.uniform(0, 500)
        w, h = rng.uniform(20, 300), rng.uniform(20, 300)
        j = rng.choice([0.0, 0.1, 0.6])
        truth.append(("r", f"i{k:03}", "c", 0, x, y, x + w, y + h))
        found.append(("r", f"i{k:03}", "c", 0, x + j * w, y, x + w + j * w, y + h, 0.9))
    schema = "run string, image string, category string, box_no long, x1 double, y1 double, x2 double, y2 double"
    got = {(r.area, r.t): r.ap for r in B.average_precision(B.matches(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema + ", score double"))).collect()}
    for k, t in enumerate(B.THRESHOLDS):
        hits = []
        for a, b in zip(truth, found):
            inter = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
            hits.append(inter / ((a[6] - a[4]) * (a[7] - a[5]) * 2 - inter) >= t)
        tp = np.cumsum(hits)
        p, r = tp / np.arange(1, 61), tp / 60
        env = np.maximum.accumulate(p[::-1])[::-1]
        ap = np.mean([env[np.searchsorted(r, q / 100 - 1e-12)] if r[-1] >= q / 100 - 1e-12 else 0 for q in range(101)])
        assert math.isclose(got["all", k], ap, abs_tol=1e-9), t


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=10, max_size=10))
def test_soft_score_closed_form(answers):
    k = answers.count("a")
    loop = sum(min(1, sum(x == "a" for j, x in enumerate(answers) if j != i) / 3) for i in range(10)) / 10
    assert math.isclose((k * min(1, (k - 1) / 3) + (10 - k) * min(1, k / 3)) / 10, loop)


def test_rouge_l(spark):
    df = spark.createDataFrame([("m", "a b c d".split(), "a x c d".split()), ("m", [], ["a"])], "m string, hyp array<string>, ref array<string>")
    assert math.isclose(C.rouge_l(df, ["m"]).first().rouge_l, 0.75 / 2)


def test_conversations(spark):
    turns = F.from_json(F.lit(json.dumps([{"speaker": "system", "value": "s"}, {"speaker": "human", "value": "q"}, {"speaker": "gpt", "value": ""}])), "array<struct<speaker:string,value:string>>")
    t = V.rounds(turns)
    assert one(spark, V.prompt(t, V.TEMPLATES["two"])) == "A chat. USER: q ASSISTANT:"
    assert one(spark, V.prompt(t, V.TEMPLATES["llama"])) == "[INST] <<SYS>>\nA chat.\n<</SYS>>\n\nq [/INST]"
    assert one(spark, V.interleave(F.lit("a <image>\n b"))) == ["t:a", "i:0", "t:b", "i:1"]


def test_exact_sample_and_chunks(spark):
    df = spark.range(1000).selectExpr("id AS k", "if(id < 900, 'a', 'b') AS g", "0.25D AS share")
    got = {r.g: r["count"] for r in P.exact_sample(df, "g", "k", "share").groupBy("g").count().collect()}
    assert got == {"a": 225, "b": 25}
    places = sorted(r.place for r in V.chunk_places(spark.range(5, 505, 5).selectExpr("id AS k"), "k").collect())
    assert places == list(range(100))


def test_length_groups_keep_all_rows(spark):
    df = spark.range(203).selectExpr("id AS k", "id % 17 AS n")
    got = P.length_grouped(df, "k", "n", 8, 4).toPandas()
    assert sorted(got["key"]) == list(range(203))
    assert (got.groupby("megabatch").size()[:-1] == 32).all()
    assert (got[got.megabatch == 0].groupby("chunk").size() == 8).all()


def test_skewed_join_and_rank(spark):
    left = spark.range(60_000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS v")
    keyed = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = hot_split_join(left, keyed, ["k"], "n", 60_000)
    assert joined.count() == 60_000 and joined.where("k = 0").first().n == 20_000
    ranks = salted_rank(left.where("k = 0"), ["k"], [F.col("v")], F.pmod(F.col("v"), F.lit(7)).cast("int"), 7)
    assert sorted(r.rank for r in ranks.collect()) == list(range(20_000))


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "a1", "image": "x.jpg", "conversations": [{"from": "human", "value": "q"}]}, {"id": "b", "image": ["p", "q"], "conversations": [{"role": "user", "content": "r"}]}]))
    got = {r.id: r for r in files.read_samples(spark, str(tmp_path / "a.json")).collect()}
    assert got["a1"].image == ["x.jpg"] and got["b"].image == ["p", "q"] and got["b"].conversations[0].value == "r"
    (tmp_path / "t.tsv").write_text("a\tb\n1\tnan\n")
    assert files.read_tsv(spark, str(tmp_path / "t.tsv")).first().b is None
    files.split_write(spark.createDataFrame([(1, True), (2, None)], "k int, ok boolean"), "ok", str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o_problems")).first().k == 2


def test_streaming_windows_and_registry(spark, tmp_path):
    beats = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:20"), (2, "2024-01-01 00:00:05"), (2, "2024-01-01 00:05:00")], "worker long, ts string").selectExpr("worker", "cast(ts AS timestamp) AS ts")
    beats.write.parquet(str(tmp_path / "in"))
    assert sorted((r.worker, r.n_beats) for r in workers.sessions(beats).collect()) == [(1, 2), (2, 1), (2, 1)]
    stream = spark.readStream.schema(beats.schema).parquet(str(tmp_path / "in"))
    q = workers.registry(stream).writeStream.format("memory").queryName("reg").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    states = [(r.worker, r.state) for r in spark.sql("SELECT * FROM reg").collect()]
    assert (1, "registered") in states and (1, "expired") in states
    log = stream.selectExpr("ts", "'x' AS type", "1.0D AS value")
    q = workers.write_daily_log(log, str(tmp_path / "log"), str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_bleu_counts_where_the_pair_is(spark, tmp_path):
    pairs = [("m", "1", "a b a b c d e", "a b c d e"), ("m", "2", "", "a"), ("m", "3", "x y z w", "x y z w v u"), ("n", "1", "a", "b"), ("o", "1", "", "b")]
    spark.createDataFrame([(m, k, h.split(), r.split()) for m, k, h, r in pairs], "by string, key string, hyp array<string>, ref array<string>").write.parquet(str(tmp_path / "p"))
    df = C.bleu(spark.read.parquet(str(tmp_path / "p")), ["by"])
    # a join of n-grams is planned as a broadcast by the size of the file, whatever number of n-grams comes out of it
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    found = {r["by"]: r for r in df.collect()}
    hit, every, brevity = [9, 7, 5, 3], [11, 9, 7, 5], math.exp(1 - 12 / 11)
    want = [brevity * math.prod(hit[i] / every[i] for i in range(k)) ** (1 / k) for k in range(1, 5)]
    assert found["m"].n_pairs == 3 and all(math.isclose(found["m"][f"bleu{k + 1}"], w) for k, w in enumerate(want))
    assert set(found) == {"m", "n"} and found["n"].bleu1 == 0
