"""Statistics of increments against the same statistics of all rows at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.operators import increments as inc
from inkprint.operators import stats
from inkprint.operators.baseline import fit_baseline

FEATURES = ["a", "b"]
SCHEMA = "sample_id long, corpus string, label int, a double, b double"
KEYS = T.StructType([T.StructField("corpus", T.StringType()), T.StructField("label", T.IntegerType())])


def rows(n=600):
    rng = random.Random(9)
    out = []
    for i in range(n):
        label = rng.randint(0, 1)
        a = rng.choice([None, float("nan"), float(rng.randint(-3, 3) + label), 1e9 + rng.random()])
        out.append((i, rng.choice(["x", "y", None]), label, a, rng.gauss(label, 2.0)))
    return out


def close(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for key, r in want.items():
        for name, value in r.asDict().items():
            assert got[key][name] == (pytest.approx(value, rel=1e-9, abs=1e-9) if isinstance(value, float) else value), (key, name)


@pytest.fixture(scope="module")
def counted(spark, tmp_path_factory):
    """Three shards that arrive one after the other."""
    folder = tmp_path_factory.mktemp("increments")
    source, out, progress = (f"{folder}/{n}" for n in ("in", "out", "progress"))
    df = spark.createDataFrame(rows(), SCHEMA)
    read = []
    for shard in range(3):
        df.where(F.col("sample_id") % 3 == shard).coalesce(1).write.mode("append").parquet(source)
        query = inc.incremental_statistics(spark, source, df.schema, lambda x: x, KEYS.fieldNames(), FEATURES, out, progress,
                                           population=F.col("label") == 0)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    return df, out, read


def test_only_new_files_are_read(counted):
    assert counted[2] == [200, 200, 200]


def test_merged_statistics_equal_the_full_run(spark, counted):
    df, out, _ = counted
    counts = inc.merged_counts(spark, out, KEYS)
    assert counts.agg(F.sum("n")).first()[0] == 2 * 600
    per = ["corpus", "feature"]
    long = stats.melt(df, ["corpus", "label"], FEATURES)
    sides = stats.two_sides(counts, per, F.col("label"))
    close(stats.rank_sum_test(sides, per), stats.mann_whitney(long, per, "value", F.col("label")), per)
    close(stats.area_under_curve(sides, per), stats.auroc(long, per, "value", F.col("label")), per)
    close(stats.transport_distance(sides, per), stats.wasserstein(long, per, "value", F.col("label")), per)
    close(stats.median_of(counts, ["corpus", "label", "feature"]), stats.exact_median(long, ["corpus", "label", "feature"], "value"),
          ["corpus", "label", "feature"])
    close(inc.moments_of(counts, ["corpus", "label"]), stats.moments(df, ["corpus", "label"], FEATURES), ["corpus", "label", "feature"])
    by_label = counts.groupBy("label", "feature", "bucket", "value").agg(F.sum("n").alias("n"))
    close(stats.anova_of(inc.moments_of(by_label, ["label"], missing_as_zero=True)), stats.anova_f(df, "label", FEATURES), ["feature"])


def test_merged_baseline_equals_the_full_fit(spark, counted):
    df, out, _ = counted
    got, want = inc.merged_baseline(spark, out, FEATURES), fit_baseline(df.where("label = 0"), FEATURES)
    assert got.n == want.n
    for name in ("mean", "scale", "covariance", "precision", "shrinkage"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-6), name


def test_repeated_and_unfinished_batches_count_once(spark, tmp_path):
    df, out = spark.createDataFrame(rows(90), SCHEMA), str(tmp_path)
    assert inc.merged_counts(spark, out, KEYS).count() == 0
    for batch in (0, 1, 1, 0):
        inc.add_increment(df.where(F.col("sample_id") % 2 == batch), KEYS.fieldNames(), FEATURES, out, batch)
    inc.increment(df, KEYS.fieldNames(), FEATURES).write.parquet(f"{out}/counts/batch=2")  # stopped before its commit
    assert inc.merged_counts(spark, out, KEYS).agg(F.sum("n")).first()[0] == 2 * 90


def test_moments_near_a_large_mean(spark):
    df = spark.createDataFrame([("k", 1e9 + i / 1000) for i in range(1000)], "k string, a double")
    counts = inc.increment(df, ["k"], ["a"])
    r, x = inc.moments_of(counts, ["k"]).first(), 1e9 + np.arange(1000) / 1000
    assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(ddof=1), rel=1e-6)
