import math

import pytest

from benthos.plans import boxes as Q

J = '{{"bbox_2d": {}, "label": "{}"}}'
ROWS = [
    # both in JSON, the sides known: overlap 1 and a half
    ("j1", J.format([100, 100, 300, 300], "Ray"), J.format([100, 100, 300, 300], "ray"), 1000, 500),
    ("j2", J.format([0, 0, 100, 200], "ray"), J.format([0, 0, 100, 100], "ray"), 1000, 500),
    # in plain
    ("p1", "eel 1: [0.1,0.1,0.2,0.2]", "eel 1: [0.1,0.1,0.2,0.2]", 1000, 500),
    # one side in each dialect, the same box
    ("m1", "eel 1: [0.1,0.2,0.3,0.6]", J.format([100, 100, 300, 300], "eel"), 1000, 500),
    # in JSON without sides: compared in pixels
    ("u1", J.format([10, 10, 20, 20], "eel"), J.format([10, 10, 20, 20], "eel"), None, None),
    # one in each dialect without sides: left out
    ("u2", "eel 1: [0.1,0.2,0.3,0.6]", J.format([100, 100, 300, 300], "eel"), None, None),
    # cut off: the answer finds nothing, the truth is no truth
    ("b1", J.format([1, 1, 9, 9], "eel"), '{"bbox_2d": [717, 480, 1054, 699', 1000, 500),
    ("b2", '{"bbox_2d": [717, 480, 1054, 699', J.format([1, 1, 9, 9], "eel"), 1000, 500),
    ("c1", "a caption", None, 1000, 500),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("boxes")
    rows = [(k, "m", i, gt, text, w, h, "2024-01-01 00:00:00") for k, (i, gt, text, w, h) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "pred_no long, model_id string, id string, gt string, text string, input_width int, input_height int, at string")
    df.selectExpr("* except (at)", "cast(at AS timestamp) AS answered_at").write.parquet(f"{d}/predictions.parquet")
    spark.createDataFrame([(1, "j1", ["a.jpg"])], "row_no long, id string, image array<string>").write.parquet(f"{d}/samples.parquet")
    spark.createDataFrame([("a.jpg", 640, 480)], "image string, width int, height int").write.parquet(f"{d}/image_meta.parquet")
    return str(d)


def test_audit_counts_every_answer(spark, tables):
    r = Q.box_audit(spark, tables).first().asDict()
    assert r["n_answers"] == len(ROWS)
    assert [r[f"n_true_{k}"] for k in ("plain", "json", "none", "unreadable")] == [3, 4, 1, 1]
    assert [r[f"n_found_{k}"] for k in ("plain", "json", "none", "unreadable")] == [1, 6, 1, 1]
    assert (r["n_boxes_true"], r["n_boxes_found"], r["n_unscaled"], r["n_unscalable"]) == (7, 7, 2, 1)


def test_grounding_of_both_dialects(spark, tables):
    r = Q.grounding_metrics(spark, tables).first()
    assert (r.n_pictures, r.n_boxes, r.n_found) == (6, 6, 5)
    assert math.isclose(r.miou, 4.5 / 6) and r.precision50 == 1.0 and r.precision75 == 0.8


def test_detection_of_both_dialects(spark, tables):
    got = {r.category: r.n_truth for r in Q.detection_by_category(spark, tables).where("t = 0").collect()}
    assert got == {"eel": 4, "ray": 2}
    r = Q.detection_coco_ap(spark, tables).first()
    assert 0 < r.ap75 < r.ap50 <= 1 and r.n_unscalable == 1
