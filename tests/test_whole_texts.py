import math

from benthos.plans import preparation as Q


def test_anls_of_all_scripts(spark, tmp_path):
    rows = [
        ("label", "veiled hawkfish\n", "Veiled hawkfish"),
        ("label", "　рыба\t", "рыба"),
        ("label", "рыбы", "рыба"),
        ("label", "鱼", "虾"),
        ("label", "", "eel"),
        ("label", "café", "cafe"),
        ("label", None, "eel"),
        ("caption", "eel", "eel"),
    ]
    df = spark.createDataFrame([("m", *r) for r in rows], "model_id string, answer_form string, text string, gt string")
    df.write.parquet(f"{tmp_path}/predictions.parquet")
    r = Q.vqa_anls(spark, str(tmp_path)).first()
    assert r.n == 6 and math.isclose(r.anls, (1 + 1 + 0.75 + 0 + 0 + 0.75) / 6)


def test_tokens_part_at_unicode_white_space(spark, tmp_path):
    human, gpt = ("human", "one two　three"), ("gpt", "four five six​seven")
    spark.createDataFrame([(1, [human, gpt])], "row_no long, conversations array<struct<speaker:string,value:string>>").write.parquet(f"{tmp_path}/samples.parquet")
    spark.createDataFrame([(1, "a b<image>　c"), (2, None)], "pred_no long, prompt string").write.parquet(f"{tmp_path}/predictions.parquet")
    m = Q.target_masks(spark, str(tmp_path)).first()
    assert (m.n_turns, m.n_tokens, m.n_labels, m.alternates) == (2, 6, 3, True)
    got = {r.pred_no: (r.n_images, r.n_tokens, r.n_doubled) for r in Q.image_splice(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 5, 6), 2: (0, 1, 1)}
