"""Whole studies: what a user calls on a corpus."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.lexical import LEXICAL_FEATURES, lexical_features
from inkprint.functions.logprob import LOGPROB_FEATURES, logprob_features
from inkprint.functions.syntax import SYNTAX_FEATURES, syntax_features
from inkprint.operators.baseline import STABLE_FEATURES, fit_baseline, hbd_score, score_auroc, score_summary
from inkprint.operators.curation import drop_blank
from inkprint.operators.fingerprint import (
    average_linkage, confused_pairs, confusion_rates, derive_class, discriminating_features, index_classes)
from inkprint.operators.metrics import best_model, class_report, classification_metrics, cv_scores
from inkprint.operators.models import (
    Recipe, cross_corpus_eval, cv_predictions, feature_importance, fit, random_forest, subset_lift)
from inkprint.operators.profile import code_length_stats, corpus_balance, value_counts
from inkprint.operators.sampling import (
    cap_per_class, group_folds, mark_capped, stratified_folds, union_corpora)
from inkprint.operators.stats import (
    anova_f, overlap_zone, shift_report, signal_table, stable_conflict_features, top_features)
from inkprint.session import materialised, spread


def feature_matrix(samples: DataFrame, keep_blank: bool = False, logprobs: DataFrame | None = None,
                   key: str = "sample_id") -> DataFrame:
    """37 lexical and 28 syntax features plus all other columns of ``samples``; the text itself is dropped.

    Narrow from scan to sink. ``logprobs`` (key, logprob) adds the nine token features by one join on ``key``."""
    rows = spread(samples if keep_blank else drop_blank(samples))
    matrix = syntax_features(lexical_features(rows)).drop("code")
    if logprobs is not None:
        matrix = matrix.join(logprob_features(logprobs, [key]), key, "left")
    return matrix


def parse_rate_by_class(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Share of Python samples that parse. Missing syntax features are a fact about the parser, not zeros."""
    parsed = matrix.where(F.col("parse_ok").isNotNull())
    return parsed.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("parse_ok").alias("n_parsed"),
                                   F.avg(F.col("parse_ok").cast("double")).alias("parse_rate"))


def corpus_report(df: DataFrame, columns: list[str], code: str = "code", label: str = "label") -> DataFrame:
    """(section, item, value): length statistics, class balance and value counts of a corpus in one table."""
    def rows(wide: DataFrame, section: str) -> DataFrame:
        typed = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
        return typed.unpivot([], typed.columns, "item", "value").withColumn("section", F.lit(section))

    counts = value_counts(df, columns).select(
        F.concat("column", F.lit("="), "value").alias("item"), F.col("n").cast("double").alias("value"),
        F.lit("counts").alias("section"))
    return rows(code_length_stats(df, code), "length").unionByName(rows(corpus_balance(df, label), "balance")).unionByName(
        counts).select("section", "item", "value")


def transfer(first: DataFrame, second: DataFrame, report: DataFrame, features: list[str], recipe: Recipe = random_forest(),
             id_col: str = "sample_id") -> DataFrame:
    """Transfer from the first corpus to the second on all features, and on the stable ones of a shift report if there are
    any. All rows of the first corpus are fit, all of the second predicted."""
    stable = [r["feature"] for r in report.where(F.col("kind") == "stable").select("feature").collect()]
    sets = {"all": features} | ({"stable": sorted(stable)} if stable else {})
    return cross_corpus_eval({"first": first}, {"second": second}, sets, recipe, id_col=id_col)


def forensics(first: DataFrame, second: DataFrame, features: list[str], recipe: Recipe = random_forest(),
              id_col: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(shift report of two corpora, transfer from the first to the second on all versus stable features)."""
    report = materialised(shift_report(first, second, features))
    return report, transfer(first, second, report, features, recipe, id_col)


def model_comparison(matrix: DataFrame, features: list[str], recipes: dict[str, Recipe], label: str = "label",
                     id_col: str = "sample_id", k: int = 5, group: str | None = None,
                     importance: str | None = None) -> dict[str, DataFrame]:
    """Several recipes on the same folds: ``predictions`` pooled over folds with their ``model``, ``scores`` (mean and
    deviation over folds), ``pooled`` metrics, the ``best`` model by mean macro-F1, and the feature ``importance`` of the
    tree recipe named so, fit on all rows. With ``group`` no group is split between folds."""
    folds = materialised(group_folds(matrix, group, k) if group else stratified_folds(matrix, label, id_col, k))
    parts = [cv_predictions(folds, features, recipe, label=label).withColumn("model", F.lit(name)) for name, recipe in recipes.items()]
    pooled = materialised(reduce(DataFrame.unionByName, parts).withColumn("prediction", F.col("prediction").cast("int")))
    scores = cv_scores(pooled, by=["model"], label=label)
    result = {"predictions": pooled, "scores": scores, "pooled": classification_metrics(pooled, ["model"], label),
              "best": best_model(scores, score="f1_mean")}
    if importance is not None:
        result["importance"] = feature_importance(fit(folds, features, recipes[importance], label), features, folds)
    return result


def third_corpus_validation(first: DataFrame, second: DataFrame, third: DataFrame, features: list[str],
                            recipe: Recipe = random_forest(), id_col: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Features that are stable between two corpora, put to the test on an unseen third: (results of three training sets
    and both feature sets, gain of the stable features per training set). Without stable features only all are tried.
    Every row of a training set is fit."""
    kinds = stable_conflict_features(first, second, features)
    stable = sorted(r["feature"] for r in kinds.where(F.col("kind") == "stable").select("feature").collect())
    sets = {"all": features} | ({"stable": stable} if stable else {})
    trains = {"first": first, "second": second, "both": first.unionByName(second, allowMissingColumns=True)}
    results = cross_corpus_eval(trains, {"third": third}, sets, recipe, id_col=id_col)
    return results, subset_lift(results, "stable", "all")


def overlap_study(first: DataFrame, second: DataFrame, third: DataFrame, features: list[str], label: str = "label",
                  top: int = 10) -> tuple[DataFrame, DataFrame]:
    """The overlap table of the first corpus' ``top`` features by ANOVA, and how many of them overlap."""
    best = [r["feature"] for r in top_features(anova_f(first, label, features), top).select("feature").collect()]
    table = overlap_zone(first, second, third, best, label)
    return table, table.agg(F.count("*").alias("n_features"), F.count_if("third_human_in_first_ai_zone").alias("n_overlapping"))


def baseline_report(corpora: dict[str, tuple[DataFrame, int | None]], features: list[str] = STABLE_FEATURES,
                    label: str = "label", id_col: str = "sample_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit the baseline on the class-0 rows of all corpora (of a corpus with a number, on that many of them only), score
    every row of every corpus: (scored rows, summary per corpus and class, AUROC per corpus and overall)."""
    humans = {name: (df.where(F.col(label) == 0), cap) for name, (df, cap) in corpora.items()}
    baseline = fit_baseline(materialised(union_corpora(humans, label, id_col).select(features)), features)
    everything = union_corpora({name: (df, None) for name, (df, _) in corpora.items()}, label, id_col)
    scored = materialised(hbd_score(everything, baseline))  # read by both summaries; also keeps their plans small
    return scored, score_summary(scored, ["corpus", label]), score_auroc(scored, label=label)


def fingerprint_report(matrix: DataFrame, features: list[str], id_col: str = "sample_id", k: int = 5,
                       recipe: Recipe = random_forest(depth=20)) -> dict[str, DataFrame]:
    """Many-class study: pooled predictions, per-class report, confusion rates, confused pairs, linkage, and the
    features that tell the classes apart. Models are fit on every row of the other folds; every row is predicted and
    counted. Classes and predictions are written once."""
    named = derive_class(matrix)
    classes = materialised(index_classes(named))
    indexed = stratified_folds(named, "class", id_col, k).join(classes, "class")
    predicted = cv_predictions(indexed, features, recipe, label="class_index")
    back = classes.select(F.col("class_index").cast("double").alias("prediction"), F.col("class").alias("predicted_class"))
    pooled = materialised(predicted.join(back, "prediction").drop("prediction"))
    rates = materialised(confusion_rates(pooled, label="class", prediction="predicted_class"))
    return {
        "predictions": pooled,
        "classes": class_report(pooled, label="class", prediction="predicted_class"),
        "overall": classification_metrics(pooled, label="class", prediction="predicted_class").withColumn(
            "chance", F.lit(1.0) / classes.agg(F.count("*")).scalar()),
        "confusion": rates,
        "pairs": confused_pairs(rates),
        "linkage": average_linkage(rates),
        "features": discriminating_features(named, features),
    }


def logprob_signal(tokens: DataFrame, labels: DataFrame, key: str, id_col: str, cap: int | None = None,
                   label: str = "label") -> DataFrame:
    """Do token probabilities tell the classes apart? All samples, or ``cap`` per class where that is asked for, tested per
    feature (the token count is left out)."""
    sampled = labels if cap is None else cap_per_class(labels, [label], id_col, cap)
    wanted = tokens.join(sampled.select(key), key, "left_semi")
    features = logprob_features(wanted, [key]).join(sampled, key)
    return signal_table(features, [f for f in LOGPROB_FEATURES if f != "perp_token_count"], label)


def union_experiment(corpora: dict[str, tuple[DataFrame, int | None]], features: list[str], recipe: Recipe,
                     label: str = "label", id_col: str = "sample_id", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Train on the union of corpora with stratified folds: (pooled predictions, metrics per corpus). A corpus' number
    bounds its rows per class that models are fit on; every row is predicted. The predictions are written once."""
    marked = {name: (mark_capped(df, [label], id_col, cap), None) for name, (df, cap) in corpora.items()}
    stacked = stratified_folds(union_corpora(marked, label, id_col), label, id_col, k)
    pooled = materialised(cv_predictions(stacked, features, recipe, label=label, in_fit="in_fit").withColumn(
        "prediction", F.col("prediction").cast("int")))
    return pooled, classification_metrics(pooled, ["corpus"], label)


ALL_FEATURES = LEXICAL_FEATURES + SYNTAX_FEATURES
