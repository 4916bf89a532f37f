"""Evaluation of predictions: a table with target, prediction (0/1) and probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.functions.scalars import count_if

ODDS_LIMIT, ODDS_STEPS = 40.0, 800
CLASS_NAMES = {0: "Bad Borrower", 1: "Good Borrower"}


def _counts() -> list[Column]:
    def cell(target: int, prediction: int, name: str) -> Column:
        return count_if((F.col("target") == target) & (F.col("prediction") == prediction)).alias(name)

    return [cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp")]


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def slices(split: DataFrame) -> DataFrame:
    """Each row once under its own slice ('test' or 'train') and once under 'all'."""
    return split.withColumn("slice", F.explode(F.array("slice", F.lit("all"))))


def confusion_matrix(predictions: DataFrame, *by: str) -> DataFrame:
    return predictions.groupBy(*by).agg(*_counts())


def class_scores(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1, from the confusion matrix."""
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    return confusion_matrix(predictions, *by).select(
        *by,
        _share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(predictions: DataFrame, *by: str) -> DataFrame:
    """One row per class and rows for accuracy, macro and weighted averages."""
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))

    def row(label: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.alias("support"))

    good = [_share(tp, tp + fp), _share(tp, tp + fn), _share(2 * tp, 2 * tp + fp + fn)]
    bad = [_share(tn, tn + fn), _share(tn, tn + fp), _share(2 * tn, 2 * tn + fp + fn)]
    positives, negatives = tp + fn, tn + fp
    total = positives + negatives
    correct = _share(tp + tn, total)
    macro = [(b + g) / 2 for b, g in zip(bad, good)]
    weighted = [_share(b * negatives + g * positives, total) for b, g in zip(bad, good)]
    rows = F.array(
        row(CLASS_NAMES[0], *bad, negatives),
        row(CLASS_NAMES[1], *good, positives),
        row("accuracy", correct, correct, correct, total),
        row("macro avg", *macro, total),
        row("weighted avg", *weighted, total),
    )
    exploded = confusion_matrix(predictions, *by).select(*by, F.explode(rows).alias("row"))
    return exploded.select(*by, "row.*")


def _odds_bucket(p: Column) -> Column:
    """A step of the log odds that never falls as p rises; the ends of [0, 1] are the outermost steps."""
    odds = F.when(p <= 0, -ODDS_LIMIT).when(p >= 1, ODDS_LIMIT).otherwise(F.log(p / (1.0 - p)))
    return F.floor(F.greatest(F.least(odds, F.lit(ODDS_LIMIT)), F.lit(-ODDS_LIMIT)) * ODDS_STEPS)


def roc_auc(predictions: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve, ties counted half.

    Rows without a probability or target are left out on both sides. A rank over all rows would sort
    them in one task. Rows shrink to one per distinct probability, and the negatives below a probability
    are those of the lower buckets plus those below it inside its own bucket. Buckets are equal steps of
    the log odds, so a model that puts nearly all rows close to 0 or 1 still spreads over many of them;
    there are at most 2 * ODDS_LIMIT * ODDS_STEPS + 1 per slice.
    """
    known = predictions.where(F.col("probability").isNotNull() & F.col("target").isNotNull())
    per_score = (
        known.groupBy(*by, "probability")
        .agg(count_if(F.col("target") == 1).alias("_pos"), count_if(F.col("target") == 0).alias("_neg"))
        .withColumn("_bucket", _odds_bucket(F.col("probability")))
    )
    keys = list(by)
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_score.groupBy(*keys, "_bucket")
        .agg(F.sum("_neg").alias("_in_bucket"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_in_bucket").over(lower), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_score.withColumn("_inside", F.coalesce(F.sum("_neg").over(inside), F.lit(0)))
    below = (F.col("_before") + F.col("_inside")).cast("double") + F.col("_neg") / 2.0
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    won = placed.join(offsets, [*keys, "_bucket"]).groupBy(*keys)
    return won.agg((F.sum(F.col("_pos") * below) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def evaluation(split: DataFrame) -> DataFrame:
    """Scores, AUC and confusion matrix per slice: test, train and all."""
    rows = slices(split)
    matrix = confusion_matrix(rows, "slice")
    scores = class_scores(rows, "slice")
    return matrix.join(scores, "slice").join(roc_auc(rows, "slice"), "slice")


# The feature groups of the importance summary, by version. They leave some features out.
GROUPS_V3 = {
    "Payment Behavior": "successful_payments failed_payments payment_success_rate delayed_payments "
    "failed_payments_30plus avg_delay_days max_delay_days",
    "Loan History": "loans_paid_count total_loans loans_overdue loans_written_off total_amount_borrowed avg_loan_amount",
    "Loan Actions": "times_approved times_in_review times_paid_action times_written_off approval_rate",
    "AKB Credit": "akb_score akb_calculated history_score has_akb_score liab_count total_outstanding_debt max_days_overdue",
    "Income & Debt": "monthly_income monthly_expenses net_income debt_to_income loan_amount_to_income",
    "Cards": "total_cards verified_cards card_verified_rate",
    "Documents": "total_docs_uploaded has_uploaded_docs",
}
GROUPS_V2 = {
    "Payment Behavior": "successful_payments failed_payments payment_success_rate delayed_payments "
    "delayed_payment_rate failed_payments_30plus failed_payment_30plus_rate avg_delay_days max_delay_days",
    "Credit History (AKB)": "akb_score akb_calculated history_score has_akb_score liab_count total_outstanding_debt "
    "max_days_overdue",
    "Income & Debt": "monthly_income monthly_expenses net_income income_total debt_to_income loan_amount_to_income",
    "Loan History": "total_loans loans_paid_count loans_overdue total_amount_borrowed avg_loan_amount",
}


def group_of(feature: Column, groups: dict[str, str]) -> Column:
    result = None
    for name, members in groups.items():
        hit = feature.isin(members.split())
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


def importance_by_group(importances: DataFrame, groups: dict[str, str] = GROUPS_V3) -> DataFrame:
    """Sum of importance per feature group; features in no group are left out."""
    grouped = importances.withColumn("feature_group", group_of(F.col("feature"), groups))
    return grouped.where("feature_group IS NOT NULL").groupBy("feature_group").agg(F.sum("importance").alias("share"))
