"""Classification metrics over a table of labels and predictions; any number of slices in one pass."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.session import null_safe_join


def confusion_counts(df: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*by, F.col(label).cast("string").alias("label"),
                      F.col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, by: list[str] | None = None, label: str = "label",
                 prediction: str = "prediction") -> DataFrame:
    """Per class: precision, recall, f1, support. A zero denominator gives 0."""
    by = by or []
    c = F.col
    hit = F.when(c("label") == c("prediction"), c("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(c("label").alias("class"), c("n").alias("support"), none.alias("predicted"), hit.alias("hits")),
        F.struct(c("prediction").alias("class"), none.alias("support"), c("n").alias("predicted"), none.alias("hits")))
    totals = confusion_counts(df, by, label, prediction).select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return totals.select(
        *by, "class", share(c("hits"), c("predicted")).alias("precision"), share(c("hits"), c("support")).alias("recall"),
        share(2 * c("hits"), c("support") + c("predicted")).alias("f1"), "support", "hits")


def classification_metrics(df: DataFrame, by: list[str] | None = None, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """Accuracy, macro and support-weighted precision / recall / F1, per slice."""
    by = by or []
    c = F.col
    report = class_report(df, by, label, prediction)
    weighted = lambda m: (F.sum(c(m) * c("support")) / F.sum("support")).alias(f"{m}_weighted")
    return report.groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[weighted(m) for m in ("precision", "recall", "f1")])


def cv_scores(df: DataFrame, fold: str = "fold", by: list[str] | None = None, label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """Mean and population standard deviation over folds of macro-F1 and accuracy."""
    by = by or []
    folds = classification_metrics(df, [*by, fold], label, prediction)
    return folds.groupBy(*by).agg(
        F.count("*").alias("n_folds"),
        F.avg("f1_macro").alias("f1_mean"), F.stddev_pop("f1_macro").alias("f1_std"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"))


def per_generator_accuracy(df: DataFrame, generator: str = "generator", label: str = "label",
                           prediction: str = "prediction", ai_label=1) -> DataFrame:
    """Accuracy on AI rows per generator."""
    return df.where(F.col(label) == ai_label).groupBy(generator).agg(
        F.count("*").alias("n"), F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def best_model(scores: DataFrame, by: list[str] | None = None, name: str = "model", score: str = "f1_macro") -> DataFrame:
    """The name with the highest score (the first name where scores are equal)."""
    by = by or []
    best = scores.groupBy(*by).agg(F.max(score).alias("best_score"))
    named = null_safe_join(scores, best, by) if by else scores.withColumn("best_score", best.scalar())
    return named.where(F.col(score) == F.col("best_score")).groupBy(*by, "best_score").agg(F.min(name).alias("best"))
