"""Studies fit their models on all rows: more of them a class than any limit there was."""

import pytest
from pyspark.sql import functions as F

from inkprint.operators import forest, models
from inkprint.plans import studies
from registry.queries import QUERIES

N = 50_100  # rows of a class


@pytest.fixture(scope="module")
def corpus(spark):
    """Two classes that one feature tells apart and the other does not."""
    i = F.col("id")
    return spark.range(2 * N).select(
        i.cast("string").alias("sample_id"), (i % 2).cast("int").alias("label"), (i % 2 + i % 3).cast("double").alias("a"),
        (i % 5).cast("double").alias("b")).cache()


def counting(fitted: list[int]):
    return lambda n: fitted.append(n) or forest.Forest(2, 3, 1)


def test_cross_corpus_eval_fits_every_row(corpus):
    fitted: list[int] = []
    small = corpus.limit(100)
    result = models.cross_corpus_eval({"x": corpus}, {"y": small}, {"both": ["a", "b"]}, counting(fitted)).collect()
    assert fitted == [2 * N] and [r.n for r in result] == [100]


def test_balanced_classes_have_the_size_of_the_smallest(corpus):
    fitted: list[int] = []
    models.cross_corpus_eval({"x": corpus.where("label = 0 OR a < 2")}, {"y": corpus.limit(10)}, {"one": ["b"]}, counting(fitted), balanced=True)
    assert fitted == [2 * corpus.where("label = 1 AND a < 2").count()]


def test_forensics_fits_every_row(corpus):
    fitted: list[int] = []
    _, moved = studies.forensics(corpus, corpus, ["a", "b"], counting(fitted))
    assert set(fitted) == {2 * N} and {r.n for r in moved.collect()} == {2 * N}


def test_third_corpus_validation_fits_every_row(corpus):
    fitted: list[int] = []
    results, _ = studies.third_corpus_validation(corpus, corpus, corpus.limit(50), ["a", "b"], counting(fitted))
    assert set(fitted) == {2 * N, 4 * N} and {r.train for r in results.collect()} == {"first", "second", "both"}


def test_fingerprint_report_fits_every_row_of_the_other_folds(corpus):
    fitted: list[int] = []
    matrix = corpus.limit(6000).withColumn("generator", F.when(F.col("label") == 1, "gen")).cache()
    sizes = {r["generator"]: r["count"] for r in matrix.groupBy("generator").count().collect()}
    report = studies.fingerprint_report(matrix, ["a", "b"], k=2, recipe=counting(fitted))
    assert sum(fitted) == sum(sizes.values()) == 6000 and min(sizes.values()) > 2000
    assert report["predictions"].count() == 6000


def test_multiclass_fingerprint_fits_every_row_of_the_other_folds(spark, tmp_path, monkeypatch):
    """The registered query: each of five folds is left out of one fit, so four times all rows are fit."""
    fitted: list[int] = []

    class Counted(forest.Forest):
        def __init__(self, trees, depth, seed):
            super().__init__(2, 3, seed)

        def fit(self, train):
            fitted.append(train.count())
            return super().fit(train)

    monkeypatch.setattr(models, "Forest", Counted)
    i = F.col("id")
    spark.range(2400).select(i.alias("vec_id"), (i % 2).cast("int").alias("label"), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda c: ((i % 2 + c) % 7).cast("float")).alias("embedding")).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    classes = {r["class"]: r["support"] for r in QUERIES["multiclass_fingerprint"](spark, str(tmp_path)).collect()}
    assert sum(fitted) == 4 * 2400 and len(fitted) == 5 and set(classes.values()) == {1200}
