"""Model evaluation from a prediction table: one pass, counts only.

Every classification figure is derived from (actual, predicted, n) counts, which are
at most classes x classes rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.numeric import exact_avg, ratio, round_half_up


def confusion(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    return predictions.groupBy(
        F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")
    ).agg(F.count("*").alias("n"))


def confusion_wide(counts: DataFrame, classes: list[str]) -> DataFrame:
    """Matrix form with a column per predicted class; absent cells are 0."""
    return counts.groupBy("actual").pivot("predicted", classes).agg(F.sum("n")).na.fill(0)


def accuracy(counts: DataFrame) -> DataFrame:
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return counts.agg(F.sum("n").alias("total"), hits.alias("correct")).withColumn(
        "accuracy_pct", round_half_up(ratio(F.col("correct") * 100, F.col("total")), 2)
    )


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Hit rate on ``test`` of always answering the most frequent TRAIN class."""
    most_frequent = train.agg(F.mode(F.col(label), True).alias("most_frequent"))
    hits = F.count_if(F.col(label) == most_frequent.scalar())
    return test.agg(
        F.count("*").alias("test_size"),
        hits.alias("baseline_correct"),
        round_half_up(ratio(hits * 100, F.count("*")), 2).alias("baseline_accuracy_pct"),
    )


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs as actual or predicted."""
    cells = counts.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("answered"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("answered"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        ).alias("cell")
    ).select("cell.*")
    per_class = cells.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("answered").alias("answered"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    return per_class.select(
        "label",
        "support",
        round_half_up(F.coalesce(ratio(F.col("hits"), F.col("answered")), zero), 6).alias("precision"),
        round_half_up(F.coalesce(ratio(F.col("hits"), F.col("support")), zero), 6).alias("recall"),
        round_half_up(
            F.coalesce(ratio(F.col("hits") * 2, F.col("support") + F.col("answered")), zero), 6
        ).alias("f1"),
    )


def weighted_f1(counts: DataFrame) -> DataFrame:
    report = class_report(counts)
    weighted = F.sum((F.col("f1") * F.col("support")).cast("decimal(28,6)"))
    return report.agg(round_half_up(ratio(weighted, F.sum("support")), 6).alias("weighted_f1"))


def regression_metrics(predictions: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE and R2, optionally per group (e.g. one row per target).

    R2 is 1 - mean squared error / variance; the variance is merged around means, so neither
    small nor large targets lose it. NULL if all targets are equal.
    """
    y = F.col(actual).cast("double")
    error = y - F.col(predicted).cast("double")
    square = F.avg(error * error)
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n"),
        round_half_up(exact_avg(F.abs(error)), 6).alias("mae"),
        round_half_up(F.sqrt(square), 6).alias("rmse"),
        round_half_up(F.lit(1.0) - ratio(square, F.var_pop(F.when(error.isNotNull(), y))), 6).alias("r2"),
    )


def summary_row(
    spark_counts: DataFrame,
    baseline: DataFrame,
    name: str,
    target: str,
    notes: str,
    method: str = "Most frequent class of the training split",
) -> DataFrame:
    """One line of the evaluation summary, with the improvement in percentage points."""
    acc = accuracy(spark_counts).select(F.col("total").alias("test_size"), "accuracy_pct")
    base = baseline.select("baseline_accuracy_pct")
    return acc.select(
        F.lit(name).alias("model_name"),
        F.lit("Classification").alias("model_type"),
        F.lit(target).alias("target"),
        "test_size",
        F.col("accuracy_pct").alias("model_accuracy_pct"),
        base.scalar().alias("baseline_accuracy_pct"),
        F.lit(method).alias("baseline_method"),
        F.lit(notes).alias("notes"),
    ).withColumn(
        "improvement_pp",
        round_half_up(F.col("model_accuracy_pct") - F.col("baseline_accuracy_pct"), 2),
    )


def evaluate_all(outcomes: DataFrame) -> DataFrame:
    """One row a model from the outcomes of all models in long form: ``model_name``, ``split`` (TRAIN or
    TEST), ``actual`` and ``predicted`` (of the test rows; NULL where a model has none).

    One aggregation with grouping sets counts each model and each of its classes; what is compared
    with the baseline (always the most frequent training class, ties by label) are those counts.
    Rows without a class are left out.
    """
    known = outcomes.where("actual is not null")
    test = F.col("split") == "TEST"
    sums = {
        "train_size": F.count_if(F.col("split") == "TRAIN"),
        "test_size": F.count_if(test),
        "answered": F.count_if(test & F.col("predicted").isNotNull()),
        "correct": F.count_if(test & (F.col("actual") == F.col("predicted"))),
    }
    counted = known.groupingSets([["model_name"], ["model_name", "actual"]], "model_name", "actual").agg(
        *[c.alias(n) for n, c in sums.items()]
    )
    # at most one row a class is left for each model
    of_model = Window.partitionBy("model_name")
    rank = F.row_number().over(of_model.orderBy(F.desc("train_size"), "actual"))
    baseline = counted.where("actual is not null").withColumn("_rank", rank).where("_rank = 1")
    whole = counted.where("actual is null").drop("actual")
    joined = whole.join(baseline.select("model_name", F.col("actual").alias("baseline_class"), F.col("test_size").alias("baseline_correct")), "model_name")
    model = round_half_up(ratio(F.col("correct") * 100, F.col("answered")), 2)
    always = round_half_up(ratio(F.col("baseline_correct") * 100, F.col("test_size")), 2)
    return joined.select(
        "model_name", "train_size", "test_size", "baseline_class", "baseline_correct", always.alias("baseline_accuracy_pct"),
        "answered", "correct", model.alias("model_accuracy_pct"), round_half_up(model - always, 2).alias("improvement_pp"),
    )


def share_by_group(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with the percentage of the grand total (on the grouped frame)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percentage", round_half_up(ratio(F.col("n") * 100, total), 2))
