"""Queries on predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benthos.functions import text as T
from benthos.operators import evaluation as E
from benthos.plans.registry import query
from benthos.sources.tables import table

LAST = """lastp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, id ORDER BY answered_at DESC NULLS LAST, pred_no DESC) AS rn FROM predictions WHERE id IS NOT NULL AND model_id IS NOT NULL) WHERE rn = 1),
truth AS (SELECT id, y_true FROM (SELECT id, conversations[len(conversations)].value AS y_true, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS rn FROM samples WHERE split_name IN ('val', 'test') AND id IS NOT NULL) WHERE rn = 1)"""
INT = r"CASE WHEN regexp_matches({0}, '^\s*[+-]?[0-9]{{1,18}}\s*$') THEN trim({0}, E' \t\n\r')::BIGINT END"
STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
TASK = "CASE substr(id, 2, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TASKS.items()) + " END"


def pairs(spark: SparkSession, d: str, task: str) -> DataFrame:
    """(model_id, id, prompt, y_true, y_pred) of the last answers to a task's records that have a ground truth."""
    last = E.last_predictions(table(spark, d, "predictions").select("model_id", "id", "prompt", "text", "answer_form", "answered_at", "pred_no")).where(F.col("task") == task)
    return last.join(E.ground_truth(table(spark, d, "samples")), "id").select("model_id", "id", "prompt", "answer_form", "y_true", F.col("text").alias("y_pred"))


@query(f"WITH {LAST} SELECT model_id, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS n_scored, count(*) FILTER (t IS NULL OR p IS NULL) AS n_dropped, avg(abs(t-p)) AS mae, avg((t-p)*(t-p)) AS mse, sqrt(avg((t-p)*(t-p))) AS rmse, 100*avg(abs(t-p)/nullif(abs(t),0)) AS mape, 1-avg((t-p)*(t-p))/nullif(var_pop(CASE WHEN p IS NOT NULL THEN t END),0) AS r2, max(abs(t-p)) AS max_error, min(abs(t-p)) AS min_error, stddev_pop(abs(t-p)) AS std_error FROM (SELECT model_id, ({INT.format('y_true')})::DOUBLE AS t, ({INT.format('text')})::DOUBLE AS p FROM lastp JOIN truth USING (id) WHERE substr(id,2,1)='6') GROUP BY model_id")
def counting_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.counting(pairs(spark, d, "Counting"), ["model_id"])


CHOICE = f"""WITH {LAST}, pr AS (SELECT model_id, lower({STRIP.format('y_true')}) AS y_true, lower({STRIP.format('text')}) AS y_pred FROM lastp JOIN truth USING (id) WHERE substr(id,2,1)='6' AND y_true IS NOT NULL AND text IS NOT NULL AND contains('abcd', lower({STRIP.format('y_true')}))),"""
REPORT = """cells AS (SELECT model_id, y_true, y_pred, count(*) AS n FROM pr GROUP BY ALL),
roles AS (SELECT model_id, y_true AS label, n AS support, 0 AS predicted, y_true = y_pred AS hit FROM cells UNION ALL SELECT model_id, y_pred, 0, n, false FROM cells),
rep AS (SELECT model_id, label, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted, sum(CASE WHEN hit THEN support ELSE 0 END)::BIGINT AS tp FROM roles GROUP BY ALL),
report AS (SELECT *, coalesce(tp/nullif(predicted,0),0)::DOUBLE AS "precision", coalesce(tp/nullif(support,0),0)::DOUBLE AS recall, coalesce(2*tp/nullif(support+predicted,0),0)::DOUBLE AS f1 FROM rep)"""
SUMMARY = """, tot AS (SELECT model_id, sum(support)::DOUBLE AS n FROM report GROUP BY model_id),
summary AS (SELECT model_id, sum(support)::BIGINT AS n, count(*) AS n_labels, sum(tp)/sum(support) AS accuracy, sum("precision"*support)/sum(support) AS "precision", sum(f1*support)/sum(support) AS f1, avg("precision") AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
 (sum(tp)*sum(support)-sum(support::DOUBLE*predicted))/nullif(sqrt((sum(support)::DOUBLE*sum(support)-sum(predicted::DOUBLE*predicted))*(sum(support)::DOUBLE*sum(support)-sum(support::DOUBLE*support))),0) AS mcc,
 (sum(tp)/sum(support)-sum(support::DOUBLE*predicted)/(sum(support)::DOUBLE*sum(support)))/nullif(1-sum(support::DOUBLE*predicted)/(sum(support)::DOUBLE*sum(support)),0) AS kappa, NULL::DOUBLE AS log_loss FROM report GROUP BY model_id),
auc AS (SELECT model_id, sum((recall+(n-support-predicted+tp)/nullif(n-support,0))/2*support)/sum(support) AS auc FROM report JOIN tot USING (model_id) WHERE support>0 GROUP BY model_id)
SELECT * FROM summary JOIN auc USING (model_id)"""


@query(CHOICE + REPORT + SUMMARY)
def counting_choice_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d, "Counting").where("y_true is not null and y_pred is not null").where(E.is_choice(F.col("y_true")))
    plain = rows.select("model_id", F.lower(T.strip(F.col("y_true"))).alias("y_true"), F.lower(T.strip(F.col("y_pred"))).alias("y_pred"))
    return E.label_summary(E.label_report(E.confusion(plain, ["model_id"]), ["model_id"]), ["model_id"])


LABELS = f"""WITH {LAST}, pr AS (SELECT model_id, y_true, CASE WHEN contains(y_pred, y_true) THEN y_true ELSE y_pred END AS y_pred FROM (SELECT model_id, lower({STRIP.format('y_true')}) AS y_true, lower({STRIP.format('text')}) AS y_pred FROM lastp JOIN truth USING (id) WHERE substr(id,2,1) IN ('4','7') AND y_true IS NOT NULL AND text IS NOT NULL AND regexp_matches(y_true, '[A-Za-z]{{3}}')) ),"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    both = pairs(spark, d, "Fishnet_Classification").unionByName(pairs(spark, d, "Region_Classification")).where(F.col("y_true").rlike("[A-Za-z]{3}"))
    return E.label_pairs(both, ["model_id"])


@query(LABELS + "cells AS (SELECT model_id, y_true, y_pred, count(*) AS n FROM pr GROUP BY ALL) SELECT * FROM cells")
def classification_confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(_labels(spark, d), ["model_id"])


@query(LABELS + REPORT + " SELECT * FROM report")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return E.label_report(E.confusion(_labels(spark, d), ["model_id"]), ["model_id"])


@query(LABELS + REPORT + SUMMARY)
def classification_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.label_summary(E.label_report(E.confusion(_labels(spark, d), ["model_id"]), ["model_id"]), ["model_id"])


@query(f"WITH t AS (SELECT coalesce({TASK}, 'unknown') AS task, split_name FROM samples), n AS (SELECT task, split_name, count(*) AS n_rows FROM t GROUP BY ALL) SELECT *, dense_rank() OVER (ORDER BY task)::INT AS task_no FROM n")
def task_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "samples").groupBy(F.coalesce(T.task(F.col("id")), F.lit("unknown")).alias("task"), "split_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(F.broadcast(E.rank_names(counts, "task", "task_no")), "task")


@query(f"WITH {LAST} SELECT model_id, count(*) AS n_answers, count(t.id) AS n_scored, count(*)-count(t.id) AS n_dropped, (SELECT count(*) FROM truth)-count(t.id) AS n_missing FROM lastp p LEFT JOIN truth t ON p.id=t.id GROUP BY model_id")
def pred_gt_audit(spark: SparkSession, d: str) -> DataFrame:
    return E.audit(E.last_predictions(table(spark, d, "predictions")), E.ground_truth(table(spark, d, "samples")))


@query(r"SELECT pred_no, len(k) AS n_options, array_to_string(list_transform(range(1, len(k)+1), lambda i: k[i] || '=' || v[i]), ' ') AS options FROM (SELECT pred_no, regexp_extract_all(lower(prompt), '([a-d]):([0-9]+)', 1) AS k, regexp_extract_all(lower(prompt), '([a-d]):([0-9]+)', 2) AS v FROM predictions) WHERE len(k) > 0")
def option_parse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "predictions").select("pred_no", E.options(F.col("prompt")).alias("o")).where("size(o) > 0")
    return o.select("pred_no", F.size("o").cast("long").alias("n_options"), F.array_join(F.transform("o", lambda p: F.concat_ws("=", p["k"], p["v"])), " ").alias("options"))


YES = """WITH w AS (SELECT model_id, coalesce(substr(id, 1, 1), '?') AS source, string_split(replace(split_part(text, '.', 1), ',', ''), ' ') AS w, lower(regexp_replace(gt, '\\.+$', '')) AS t FROM predictions WHERE gt IS NOT NULL AND text IS NOT NULL AND lower(regexp_replace(gt, '\\.+$', '')) IN ('yes','no')),
p AS (SELECT model_id, source, NOT list_has_any(w, ['No','not','no']) AS y, t <> 'no' AS t FROM w),
c AS (SELECT model_id, source, count(*) FILTER (y AND t) AS tp, count(*) FILTER (y AND NOT t) AS fp, count(*) FILTER (NOT y AND NOT t) AS tn, count(*) FILTER (NOT y AND t) AS fn FROM p GROUP BY ALL)
SELECT *, tp/nullif(tp+fp,0) AS "precision", tp/nullif(tp+fn,0) AS recall, 2*tp/nullif(2*tp+fp+fn,0) AS f1, (tp+tn)/(tp+fp+tn+fn) AS accuracy, (tp+fp)/(tp+fp+tn+fn) AS yes_ratio FROM c"""


@query(YES)
def pope_by_category(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").where(F.lower(F.regexp_replace("gt", r"\.+$", "")).isin("yes", "no"))
    return E.yes_no_metrics(p.select("model_id", F.coalesce(F.substring("id", 1, 1), F.lit("?")).alias("source"), F.col("gt").alias("y_true"), F.col("text").alias("y_pred")), ["model_id", "source"])


LETTER = """CASE WHEN regexp_matches(upper(text), '^[A-E]$') THEN upper(text) WHEN regexp_matches(upper(text), '^[A-E]\\. ') THEN substr(upper(text),1,1) WHEN len(regexp_extract_all(text, 'The answer is ([A-Z]).', 1)) = 1 THEN regexp_extract(text, 'The answer is ([A-Z]).', 1) ELSE 'FAILED' END"""
MCQ = f"""WITH q AS (SELECT DISTINCT id FROM predictions WHERE answer_form='choice' AND id IS NOT NULL), {LAST}, g AS (SELECT id, max(upper(gt)) AS gt FROM predictions WHERE answer_form='choice' AND id IS NOT NULL GROUP BY id),
a AS (SELECT m.model_id, q.id, g.gt, coalesce({LETTER}, 'FAILED') AS letter, contains(coalesce(p.prompt,''), '<image>') AS has_image FROM q CROSS JOIN (SELECT DISTINCT model_id FROM predictions) m JOIN g ON g.id=q.id LEFT JOIN lastp p ON p.id=q.id AND p.model_id=m.model_id),
s AS (SELECT *, CASE WHEN letter IN ('A','B','C','D') THEN ascii(letter)-65 ELSE -1 END AS idx, coalesce(letter = gt, false) AS ok FROM a)"""


def _mcq(spark: SparkSession, d: str) -> DataFrame:
    """(model_id, id, gt, letter, idx, has_image, ok): every option question for every model; no answer is FAILED, a letter that
    isn't offered has the index -1."""
    p = table(spark, d, "predictions")
    asked = p.where("answer_form = 'choice' and id is not null").groupBy("id").agg(F.max(F.upper("gt")).alias("gt"))
    models = p.where("model_id is not null").select("model_id").distinct()
    last = E.last_predictions(p.select("model_id", "id", "prompt", "text", "answered_at", "pred_no")).select("model_id", "id", "prompt", "text")
    joined = asked.crossJoin(F.broadcast(models)).join(last, ["model_id", "id"], "left")
    raw = F.when(F.length("text") < 4, F.upper("text")).otherwise(F.when(F.upper("text").rlike(r"(?s)^[A-E]\. "), F.upper("text")).otherwise(F.col("text")))
    letter = T.option_letter(F.coalesce(raw, F.lit("FAILED")))
    idx = F.when(letter.isin("A", "B", "C", "D"), F.ascii(letter) - 65).otherwise(-1)
    return joined.select("model_id", "id", "gt", letter.alias("letter"), idx.alias("idx"), F.coalesce(F.col("prompt").contains("<image>"), F.lit(False)).alias("has_image"), F.coalesce(letter == F.col("gt"), F.lit(False)).alias("ok"))


@query(MCQ + " SELECT model_id, count(*) AS n, count(*) FILTER (ok) AS n_correct, count(*) FILTER (ok)/count(*) AS accuracy, count(*) FILTER (has_image) AS n_image, count(*) FILTER (ok AND has_image)/nullif(count(*) FILTER (has_image),0) AS image_accuracy, count(*) FILTER (letter='FAILED') AS n_failed, sum(idx)::BIGINT AS idx_sum FROM s GROUP BY model_id")
def scienceqa_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _mcq(spark, d).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct"), (F.count_if("ok") / F.count(F.lit(1))).alias("accuracy"), F.count_if("has_image").alias("n_image"),
        F.try_divide(F.count_if(F.col("ok") & F.col("has_image")), F.count_if("has_image")).alias("image_accuracy"), F.count_if(F.col("letter") == "FAILED").alias("n_failed"), F.sum("idx").alias("idx_sum"),
    )


@query(MCQ + ", t AS (SELECT id, bool_or(ok) FILTER (model_id='naut7b-a') AS a, bool_or(ok) FILTER (model_id='naut7b-b') AS b, bool_or(letter='FAILED') FILTER (model_id='naut7b-b') AS f FROM s GROUP BY id) SELECT count(*) AS n, count(*) FILTER (b) AS second_correct, count(*) FILTER (CASE WHEN f THEN a ELSE b END) AS ensemble_correct, count(*) FILTER (a OR b) AS upper_bound, count(*) FILTER (f) AS n_failed FROM t")
def scienceqa_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """The second model's options, the first's where the second gave none; unreadable ones count as wrong."""
    of = lambda m, c: F.bool_or(F.when(F.col("model_id") == m, c))
    t = _mcq(spark, d).groupBy("id").agg(of("naut7b-a", F.col("ok")).alias("a"), of("naut7b-b", F.col("ok")).alias("b"), of("naut7b-b", F.col("letter") == "FAILED").alias("f"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if("b").alias("second_correct"), F.count_if(F.when(F.col("f"), F.col("a")).otherwise(F.col("b"))).alias("ensemble_correct"), F.count_if(F.col("a") | F.col("b")).alias("upper_bound"), F.count_if("f").alias("n_failed"))


SCORED = "(SELECT coalesce(category, 'none') AS category, score_pair[1] AS a, score_pair[2] AS b FROM reviews WHERE len(score_pair) = 2)"


@query(f"SELECT CASE WHEN grouping(category)=1 THEN 'all' ELSE category END AS category, count(*) AS n, avg(a) AS first, avg(b) AS second, 100*avg(b)/nullif(avg(a),0) AS ratio FROM {SCORED} GROUP BY GROUPING SETS ((category), ())")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.review_summary(table(spark, d, "reviews"))


@query(f"SELECT category, CASE WHEN a=b THEN 'tie' WHEN a>b THEN 'first' ELSE 'second' END AS outcome, count(*) AS n FROM {SCORED} GROUP BY ALL")
def review_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return E.review_outcomes(table(spark, d, "reviews"))


@query(r"WITH s AS (SELECT review_no, string_split(replace(split_part(content, E'\n', 1), ',', ' '), ' ') AS w FROM reviews WHERE content IS NOT NULL), n AS (SELECT review_no, list_transform(w, lambda x: try_cast(x AS DOUBLE)) AS v FROM s) SELECT review_no, CASE WHEN len(v)=2 AND v[1] IS NOT NULL AND v[2] IS NOT NULL THEN v[1] ELSE -1 END::DOUBLE AS first, CASE WHEN len(v)=2 AND v[1] IS NOT NULL AND v[2] IS NOT NULL THEN v[2] ELSE -1 END::DOUBLE AS second FROM n")
def score_parse(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reviews").where("content is not null").select("review_no", T.score_pair(F.col("content")).alias("s"))
    return r.select("review_no", F.col("s")[0].alias("first"), F.col("s")[1].alias("second"))


@query(r"SELECT review_no, regexp_replace(content, '^[0-9]+[, ]+[0-9]+\n', '') AS body, len(string_split(content, E'\n')) AS n_lines FROM reviews WHERE content IS NOT NULL")
def review_text_clean(spark: SparkSession, d: str) -> DataFrame:
    """The review without its first line, if that is two numbers."""
    return table(spark, d, "reviews").where("content is not null").select("review_no", F.regexp_replace("content", r"^\d+[, ]+\d+\n", "").alias("body"), F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


@query("""SELECT r.review_no, a.model_id AS model_1, b.model_id AS model_2, '[Question]' || E'\\n' || coalesce(a.prompt, '') || E'\\n\\n[Assistant 1]\\n' || coalesce(a.text, '') || E'\\n\\n[Assistant 2]\\n' || coalesce(b.text, '') AS prompt
FROM reviews r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pred_no DESC) rn FROM predictions WHERE answer_id IS NOT NULL) WHERE rn=1) a ON a.answer_id=r.answer1_id JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pred_no DESC) rn FROM predictions WHERE answer_id IS NOT NULL) WHERE rn=1) b ON b.answer_id=r.answer2_id""")
def review_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each review with both answers: the three-sided join and the prompt for a judge."""
    a = E.last_of(table(spark, d, "predictions").select("answer_id", "model_id", "prompt", "text", "pred_no"), ["answer_id"], ["pred_no"])
    one = a.select(F.col("answer_id").alias("answer1_id"), F.col("model_id").alias("model_1"), "prompt", F.col("text").alias("t1"))
    two = a.select(F.col("answer_id").alias("answer2_id"), F.col("model_id").alias("model_2"), F.col("text").alias("t2"))
    joined = table(spark, d, "reviews").select("review_no", "answer1_id", "answer2_id").join(one, "answer1_id").join(two, "answer2_id")
    none = F.lit("")
    return joined.select("review_no", "model_1", "model_2", F.concat(F.lit("[Question]\n"), F.coalesce("prompt", none), F.lit("\n\n[Assistant 1]\n"), F.coalesce("t1", none), F.lit("\n\n[Assistant 2]\n"), F.coalesce("t2", none)).alias("prompt"))
