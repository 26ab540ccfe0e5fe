import pytest
from pyspark.sql import functions as F

from benthos.operators import preparation as P
from benthos.operators import review as R
from benthos.operators import sequences as S


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_guard_and_default(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, c string")
    dim = spark.createDataFrame([("a", 1.0), ("default", 0.5)], "c string, x double")
    assert {(r.k, r.x) for r in R.with_default(left, dim, "c", "default").collect()} == {(1, 1.0), (2, 0.5), (3, 0.5)}
    assert R.guarded(left.where("k = 1"), dim, ["c"]).count() == 1
    with pytest.raises(R.MissingKeys):
        R.guarded(left, dim, ["c"])


def test_registry(spark):
    m = R.Metrics()
    m.register("a", lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    with pytest.raises(ValueError):
        m.register("a", lambda df: df)
    with pytest.raises(KeyError):
        m.run({"b": spark.range(1)}, ["k"])
    assert [tuple(r) for r in m.run({"a": spark.createDataFrame([(1,), (1,)], "k int")}, ["k"]).collect()] == [(1, "a", "n", 2.0)]
    reg = spark.createDataFrame([(" Reef ",), (None,)], "dataset string")
    assert P.named(reg, ["reef%50", ""]).count() == 1
    with pytest.raises(ValueError, match="wreck"):
        P.named(reg, ["reef", "wreck"])


def test_text_steps(spark):
    assert one(spark, R.marked_names(F.lit("9, 8 both\nAssistant 1 wins over Assistant 2"))) == "**Assistant 1** wins over **Assistant 2**"
    assert one(spark, R.without_first_lines(F.lit("a\nb"), 5)) == ""
    assert [one(spark, R.renumbered(F.lit(n))) for n in (1, 20, 21, 80)] == [2, 20, 21, 10] or sorted(one(spark, R.renumbered(F.lit(n))) for n in range(1, 81)) == list(range(1, 81))
    assert one(spark, S.until_stop(F.lit("one. two"), [". ", "###"])) == "one"
    assert one(spark, S.until_stop(F.lit("one "), ["###"])) == "one"
    assert one(spark, R.frame_indices(F.lit(101), F.lit(10.0), 2.0, 2, 5)) == [0, 25, 50, 75, 100]


def test_masks(spark):
    turns = F.array(F.struct(F.lit(True).alias("human"), F.lit("hi").alias("value")), F.struct(F.lit(False).alias("human"), F.lit("yo").alias("value")))
    got = [(x.token, x.told) for x in one(spark, S.masked(S.round_parts(turns, "two")))]
    assert got == [("A", False), ("chat", False), (".", False), ("USER", False), (":", False), ("hi", False), ("ASSISTANT", False), (":", False), ("yo", True), ("</s>", True)]
    assert not any(x.told for x in one(spark, S.masked(S.round_parts(turns, "two"), whole=F.lit("other length"))))
    shown = one(spark, S.with_visual_tags(F.array(F.struct(F.lit(True).alias("human"), F.lit("<image>a<image>").alias("value"))), F.array(F.lit(1), F.lit(2))))
    assert shown[0].value == "<|vision_start|><|image_pad|><|image_pad|><|vision_end|>a<|vision_start|>" + "<|image_pad|>" * 4 + "<|vision_end|>"


def test_shuffle_and_union(spark):
    df = spark.range(100).toDF("id")
    a, b = ([r.id for r in R.shuffled(df, "id", s).collect()] for s in (1, 2))
    assert sorted(a) == sorted(b) == list(range(100)) and a != b and a != list(range(100))
    assert P.union_of([df, df.withColumn("x", F.lit(1))]).where("x is null").count() == 100
