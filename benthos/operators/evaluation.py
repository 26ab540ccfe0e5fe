"""Predictions held against ground truth: audited joins and the metrics of labels, counts, yes/no, options and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benthos.functions import text as T


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key (null keys aside), the last in the given order: a hash aggregate, combined before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    kept = df.where(F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)).groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return kept.select(*keys, *(F.col("_r")[c].alias(c) for c in cols))


def last_predictions(predictions: DataFrame) -> DataFrame:
    """The last answer of each model to each record, with its task."""
    return last_of(predictions, ["model_id", "id"], ["answered_at", "pred_no"]).withColumn("task", T.task(F.col("id")))


def ground_truth(samples: DataFrame) -> DataFrame:
    """(id, y_true): the last turn of the last val or test record of each id."""
    rows = samples.where("split_name in ('val', 'test')").select("id", "row_no", F.try_element_at("conversations", F.lit(-1))["value"].alias("y_true"))
    return last_of(rows, ["id"], ["row_no"]).select("id", "y_true")


def audit(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per model: answers, those scored against a ground truth, those without one, and ground truths without an answer."""
    n_truth = truth.agg(F.count(F.lit(1)).alias("n_truth"))
    joined = predictions.select("model_id", "id").join(truth.select("id", F.lit(1).alias("hit")), "id", "left")
    per = joined.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_answers"), F.count("hit").alias("n_scored"))
    return per.crossJoin(n_truth).select("model_id", "n_answers", "n_scored", (F.col("n_answers") - F.col("n_scored")).alias("n_dropped"), (F.col("n_truth") - F.col("n_scored")).alias("n_missing"))


# --- labels ----------------------------------------------------------------------------------------------------------


def label_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, y_true, y_pred) normalised; a prediction that holds the true label counts as it. Null labels are left out."""
    t, p = T.normal_label(F.col("y_true")), T.normal_label(F.col("y_pred"))
    both = pairs.where("y_true is not null and y_pred is not null").select(*by, t.alias("y_true"), p.alias("y_pred"))
    return both.withColumn("y_pred", F.when(F.col("y_pred").contains(F.col("y_true")), F.col("y_true")).otherwise(F.col("y_pred")))


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, y_true, y_pred, n): the confusion matrix in long form, cells above 0."""
    return pairs.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def label_report(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, support, predicted, tp, precision, recall, f1) of each label in either role; 0 where a division by 0 stood."""
    roles = cells.select(*by, F.inline(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))), (F.col("y_true") == F.col("y_pred")).alias("hit"))
    sums = roles.groupBy(*by, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum(F.when(F.col("hit"), F.col("support")).otherwise(0)).alias("tp"))
    zero = F.lit(0.0)
    return sums.select(
        *by, "label", "support", "predicted", "tp",
        F.coalesce(F.try_divide("tp", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero).alias("f1"),
    )


def label_summary(report: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, weighted and macro precision and F1, Matthews correlation, kappa, weighted one-against-rest AUC of hard labels
    ((TPR + TNR) / 2 of each class), and log loss, which hard labels haven't (null)."""
    sums = report.groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("c"), F.count(F.lit(1)).alias("n_labels"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp_dot"), F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"), F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("f1") * F.col("support")).alias("wf"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
    )
    n, c, dot = F.col("n"), F.col("c"), F.col("tp_dot")
    joined = report.join(F.broadcast(sums.select(*by, F.col("n").alias("all"))), by) if by else report.crossJoin(F.broadcast(sums.select(F.col("n").alias("all"))))
    tnr = F.try_divide(F.col("all") - F.col("support") - F.col("predicted") + F.col("tp"), F.col("all") - F.col("support"))
    auc = joined.where("support > 0").groupBy(*by).agg(F.try_divide(F.sum((F.col("recall") + tnr) / 2 * F.col("support")), F.sum("support")).alias("auc"))
    out = sums.join(auc, by, "left") if by else sums.crossJoin(auc)
    po, pe = F.try_divide(c, n), F.try_divide(dot, n.cast("double") * n)
    return out.select(
        *by, "n", "n_labels", po.alias("accuracy"), F.try_divide("wp", "n").alias("precision"), F.try_divide("wf", "n").alias("f1"), "macro_precision", "macro_recall", "macro_f1",
        F.try_divide(c.cast("double") * n - dot, F.sqrt((n.cast("double") * n - F.col("pp")) * (n.cast("double") * n - F.col("tt")))).alias("mcc"),
        F.try_divide(po - pe, 1 - pe).alias("kappa"), "auc", F.lit(None).cast("double").alias("log_loss"),
    )


# --- counts ----------------------------------------------------------------------------------------------------------


def is_choice(answer: Column) -> Column:
    """Whether an answer is one of the letters a to d, or a stretch of `abcd` (also the empty one)."""
    return F.lit("abcd").contains(F.lower(T.strip(answer)))


def options(prompt: Column) -> Column:
    """The options of a counting prompt, letter -> number; of a letter that stands twice the last counts."""
    low = F.lower(prompt)
    letters, numbers = (F.regexp_extract_all(low, F.lit(r"([a-d]):(\d+)"), k) for k in (1, 2))
    pairs = F.arrays_zip(letters.alias("k"), numbers.alias("v"))
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(letters, i + 2, F.greatest(F.size(letters), F.lit(1))), lambda x: x == p["k"]))


def counting(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Errors of counts (by, y_true, y_pred): MAE, MSE, RMSE, MAPE in %, R², least and greatest error and their population
    deviation, over pairs of whole numbers; n_dropped pairs are not. MAPE leaves out true counts of 0; R² of equal true counts
    is null."""
    t, p = T.whole_number(F.col("y_true")), T.whole_number(F.col("y_pred"))
    both = pairs.select(*by, t.cast("double").alias("t"), p.cast("double").alias("p"))
    err = F.abs(F.col("t") - F.col("p"))
    ok = F.col("t").isNotNull() & F.col("p").isNotNull()
    e = F.when(ok, err)
    return both.groupBy(*by).agg(
        F.count_if(ok).alias("n_scored"), F.count_if(~ok).alias("n_dropped"), F.avg(e).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.try_divide(e, F.when(F.col("t") != 0, F.abs("t"))))).alias("mape"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(F.when(ok, F.col("t"))))).alias("r2"), F.max(e).alias("max_error"), F.min(e).alias("min_error"), F.stddev_pop(e).alias("std_error"),
    )


# --- yes or no, options, reviews --------------------------------------------------------------------------------------


def yes_no_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Counts of answers read as yes or no against labels (anything but `no` is yes), and what follows from them."""
    yes = T.yes_or_no(F.col("y_pred")) == "yes"
    true = F.lower(T.strip(F.regexp_replace("y_true", r"\.+$", ""))) != "no"
    counts = pairs.where("y_true is not null and y_pred is not null").groupBy(*by).agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & ~true).alias("tn"), F.count_if(~yes & true).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return counts.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))}).withColumns(
        {"f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "accuracy": F.try_divide(F.col("tp") + F.col("tn"), n), "yes_ratio": F.try_divide(F.col("tp") + F.col("fp"), n)}
    )


def review_summary(reviews: DataFrame) -> DataFrame:
    """(category, n, first, second, ratio): per category and for all (`all`), mean scores and 100 * second / first. Unreadable
    pairs (-1, -1) are averaged in; reviews without a pair are left out; a null category is `none`."""
    scored = reviews.where("size(score_pair) = 2").select(F.coalesce("category", F.lit("none")).alias("category"), F.col("score_pair")[0].alias("a"), F.col("score_pair")[1].alias("b"))
    means = scored.groupingSets([["category"], []], "category").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("first"), F.avg("b").alias("second"))
    return means.select(F.coalesce("category", F.lit("all")).alias("category"), "n", "first", "second", F.try_divide(100 * F.col("second"), F.col("first")).alias("ratio"))


def review_outcomes(reviews: DataFrame) -> DataFrame:
    """(category, outcome, n): ties, and wins of the first and second answer."""
    a, b = F.col("score_pair")[0], F.col("score_pair")[1]
    outcome = F.when(a == b, "tie").when(a > b, "first").otherwise("second")
    return reviews.where("size(score_pair) = 2").groupBy(F.coalesce("category", F.lit("none")).alias("category"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def rank_names(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): each value with its place from 1 in the sorted order of distinct values (their number is a vocabulary's)."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)))
