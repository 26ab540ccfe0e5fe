from pyspark.sql import functions as F

from benthos.operators import boxes as B


def test_both_plain_shapes(spark):
    texts = ["Red fish 2: [0.1,0.2,0.12,0.702]", "<ref>Ray</ref><box>[[100,200,300,400]]</box>", "eel: [1,2]\nray: [0.1, 0.2, 0.3, 0.4]", "eel: [a,b,c,d]", "eel: []", "no box", "a:b:[0,0,1,1]\nray: [0,0,1,1]"]
    got = [r.b and [tuple(x) for x in r.b] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(B.parse_plain(F.col("t")).alias("b")).collect()]
    assert got == [[("red fish", 0.1, 0.2, 0.12, 0.702)], [("ray", 0.1, 0.2, 0.3, 0.4)], [("ray", 0.1, 0.2, 0.3, 0.4)], None, None, [], [("ray", 0.0, 0.0, 1.0, 1.0)]]


def test_grounding_rules(spark):
    one = lambda f, t: spark.range(1).select(f(F.lit(t)).alias("v")).first().v
    assert one(B.one_plain, "[0.1,0.2,0.3,0.4]") == [0.1, 0.2, 0.3, 0.4]
    assert one(B.one_plain, "<ref>ray</ref><box>[[100,200,300,402]]</box>") == [0.1, 0.2, 0.3, 0.402]
    assert one(B.one_plain, "[1,2,3,4],[5,6,7,8]") is None and one(B.one_plain, "ray: [0.1,0.2,0.3,0.4]") is None
    assert one(B.one_json, '{"bbox_2d": [1, 2, 3, 4], "label": "ray"}') == [1.0, 2.0, 3.0, 4.0]
    assert one(B.one_json, '[{"bbox_2d": [1, 2, 3, 4]}]') == [1.0, 2.0, 3.0, 4.0]
    assert one(B.one_json, '{"bbox_2d": [1, 2, 3, 4], "label": "Fish"}') is None and one(B.one_json, '{"bbox_2d": [1, 2') == [0.0] * 4


def test_golden_box_in_both_spaces(spark):
    """A box of a picture of 640 x 428, in thousandths and in the resized picture."""
    row = spark.range(1).select(F.lit(428).alias("h"), F.lit(640).alias("w")).withColumn("r", B.smart_resize(F.col("h"), F.col("w"))).first()
    assert (row.r.height, row.r.width) == (420, 644)
    box = spark.createDataFrame([(146.0, 137.0, 615.0, 415.0)], "x1 double, y1 double, x2 double, y2 double")
    moved = box.select(*(B.between_sizes(F.col(c), F.lit(n / s), F.lit(n - 1)).alias(c) for c, n, s in (("x1", 644, 640), ("y1", 420, 428), ("x2", 644, 640), ("y2", 420, 428)))).first()
    assert tuple(moved) == (147, 134, 619, 407)
    parts = box.select(*(B.between_sizes(F.col(c), F.lit(1000 / s), F.lit(1000)).alias(c) for c, s in (("x1", 640), ("y1", 428), ("x2", 640), ("y2", 428)))).first()
    assert tuple(parts) == (228, 320, 961, 970)


def test_a_category_with_most_boxes(spark):
    """Average precision against a plain loop, with many pictures in one category and few found boxes allowed."""
    rows = [("m", f"p{k}", "ray", j, 10.0 * j, 0.0, 10.0 * j + 8, 8.0) for k in range(60) for j in range(3)]
    truth = spark.createDataFrame(rows, "run string, image string, category string, box_no long, x1 double, y1 double, x2 double, y2 double")
    found = truth.withColumns({"x1": F.when(F.col("box_no") == 1, F.col("x1") + 100).otherwise(F.col("x1")), "x2": F.when(F.col("box_no") == 1, F.col("x2") + 100).otherwise(F.col("x2")), "score": F.lit(0.9)})
    cells = {(r.most, r.t): r for r in B.average_precision(B.matches(truth, found, 10), (1, 10)).where("area = 'all'").collect()}
    assert abs(cells[1, 0].recall - 1 / 3) < 1e-12 and abs(cells[10, 0].recall - 2 / 3) < 1e-12
    assert abs(cells[1, 0].ap - 34 / 101) < 1e-12  # every first box hits
    hits, points = 0, []
    for n, (_, j) in enumerate(sorted((f"p{k}", j) for k in range(60) for j in range(3)), 1):
        hits += j != 1
        points.append((hits / 180, hits / n))
    expected = sum(max((p for r, p in points if r >= q / 100 - 1e-12), default=0.0) for q in range(101)) / 101
    assert abs(cells[10, 0].ap - expected) < 1e-9


def test_precision_of_a_category_in_several_ranges(spark):
    """One row a found box, whatever the number of cells; no join is a broadcast; the ranges of a category add up."""
    schema = "run string, image string, category string, box_no long, x1 double, y1 double, x2 double, y2 double"
    truth = [("r", f"{i:03d}", "c", 0, 0.0, 0.0, 100.0, 100.0) for i in range(300)]
    found = [("r", f"{i:03d}", "c", 0, *((0.0, 0.0, 100.0, 100.0) if i % 3 else (200.0, 0.0, 300.0, 100.0)), 0.9) for i in range(299, 40, -1)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        matched = B.matches(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema + ", score double"))
        assert matched.where("pred_no >= 0").count() == len(found)
        cells = B.average_precision(matched, (1, 100))
        assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
        got = {(r.area, r.t, r.most): r for r in cells.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    points, tp = [], 0
    for n, i in enumerate(range(41, 300), 1):
        tp += i % 3 > 0
        points.append((tp / 300, tp / n))
    ap = sum(max((p for r, p in points if r >= j / 100 - 1e-12), default=0.0) for j in range(101)) / 101
    assert set(got) == {(a, t, m) for a in ("all", "large") for t in range(10) for m in (1, 100)}
    assert all(r.n_truth == 300 and abs(r.ap - ap) < 1e-12 and abs(r.recall - tp / 300) < 1e-12 for r in got.values())
