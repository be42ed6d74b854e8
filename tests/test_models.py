import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import models
from inkprint.operators.sampling import group_folds, stratified_folds


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 240)
    x = rng.normal(size=(240, 3)) + y[:, None] * np.array([1.2, -0.8, 0.0])
    rows = [(i, int(i % 12), int(y[i]), *map(float, x[i])) for i in range(240)]
    return spark.createDataFrame(rows, "sample_id long, problem int, label int, a double, b double, c double").cache()


FEATURES = ["a", "b", "c"]


def test_logreg_minimises_the_penalised_loss(matrix):
    model = models.fit(matrix, FEATURES, models.logreg())
    data = matrix.select(*FEATURES, "label").toPandas().to_numpy()
    x, y = data[:, :3], data[:, 3]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    w, b = np.zeros(3), 0.0
    for _ in range(50):  # Newton steps on sum of losses + |w|^2 / 2
        p = 1 / (1 + np.exp(-(z @ w + b)))
        zb = np.c_[z, np.ones(len(z))]
        hessian = zb.T @ (zb * (p * (1 - p))[:, None]) + np.diag([1, 1, 1, 0])
        step = np.linalg.solve(hessian, zb.T @ (p - y) + np.append(w, 0))
        w, b = w - step[:3], b - step[3]
    fitted = model.stages[-1]
    assert np.allclose(fitted.coefficients.toArray(), w, atol=1e-3)
    assert fitted.intercept == pytest.approx(b, abs=1e-3)


def test_out_of_fold_predictions_cover_every_row_once(matrix):
    folded = stratified_folds(matrix, "label", "sample_id", 4)
    pooled = models.cv_predictions(folded, FEATURES, models.logreg(50))
    assert pooled.count() == 240 and pooled.select("sample_id").distinct().count() == 240
    assert pooled.where(F.col("prediction") == F.col("label")).count() > 170


def test_held_out_fold_is_unseen(matrix):
    """With one fold's labels flipped, the model for that fold learns nothing from them."""
    folded = group_folds(matrix, "problem", 3).withColumn("label", F.when(F.col("fold") == 0, 1 - F.col("label")).otherwise(F.col("label")))
    pooled = models.cv_predictions(folded, FEATURES, models.logreg(50)).where("fold = 0")
    assert pooled.where(F.col("prediction") == F.col("label")).count() < pooled.count() / 2


def test_forest_importance_and_transfer(matrix):
    forest = models.random_forest(trees=10, depth=4)
    ranked = models.feature_importance(models.fit(matrix, FEATURES, forest), FEATURES, matrix).collect()
    assert ranked[0].feature == "a" and sum(r.importance for r in ranked) == pytest.approx(1)
    result = models.cross_corpus_eval({"m": matrix}, {"m": matrix}, {"all": FEATURES, "noise": ["c"]}, forest)
    scores = {r.feature_set: r for r in result.collect()}
    assert scores["all"].f1_macro > scores["noise"].f1_macro and scores["all"].n == 240
    assert models.subset_lift(result, "all", "noise").first().lift > 0


def test_gbt(matrix):
    model = models.fit(matrix, FEATURES, models.gbt(rounds=5, depth=3))
    assert models.predict(model, matrix, FEATURES).where(F.col("prediction") == F.col("label")).count() > 180


def test_odd_folds_and_bounded_fits(matrix):
    lone = models.cv_predictions(matrix.withColumn("fold", F.lit(1)), FEATURES, models.logreg(20))
    assert lone.count() == 0 and "prediction" in lone.columns
    some = matrix.withColumn("fold", F.when(F.col("problem") > 3, F.col("problem") % 2))
    assert models.cv_predictions(some, FEATURES, models.logreg(20)).count() == 240
    marked = stratified_folds(matrix, "label", "sample_id", 3).withColumn("in_fit", F.col("sample_id") % 3 == 0)
    assert models.cv_predictions(marked, FEATURES, models.logreg(20), in_fit="in_fit").count() == 240


def test_no_query_writes_to_a_local_temporary_folder(spark):
    from inkprint.session import materialised, scratch_folder
    assert scratch_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    files = materialised(spark.range(3).toDF("x")).inputFiles()
    assert files and all(f.startswith(spark.conf.get("spark.checkpoint.dir").replace("file://", "file:")) or
                         f.startswith(spark.conf.get("spark.checkpoint.dir")) for f in files)
