"""Sketch statistics within their stated error of the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import sketches as sk
from inkprint.operators import stats

FEATURES = ["smooth", "steps", "far"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 40_000
    side = rng.integers(0, 2, n)
    smooth = rng.normal(0, 1, n) + 0.4 * side
    steps = rng.integers(0, 4, n) + (rng.random(n) < 0.2 * side)
    far = np.where(rng.random(n) < 0.01, 1e6, rng.exponential(1 + side, n))
    data = [(int(i % 7), ("x", "y", None)[i % 3], int(side[i]), float(smooth[i]), float(steps[i]), None if i % 50 == 0 else float(far[i]))
            for i in range(n)]
    return spark.createDataFrame(data, "shard int, corpus string, side int, smooth double, steps double, far double").repartition(6).cache()


def test_areas_and_distances_of_merged_shards(rows):
    table = sk.merged(sk.sketches(rows, ["shard", "corpus", "side"], FEATURES), ["corpus", "side"])
    long, per = stats.melt(rows, ["corpus", "side"], FEATURES), ["corpus", "feature"]
    exact = {(r.corpus, r.feature): r.auroc for r in stats.auroc(long, per, "value", F.col("side")).collect()}
    got = {(r.corpus, r.feature): r for r in sk.sketch_auroc(table, ["corpus"], F.col("side")).collect()}
    assert got.keys() == exact.keys() and len(got) == 9
    for key, r in got.items():
        assert abs(r.auroc - exact[key]) <= 2 * sk.distribution_error() and r.u1 == pytest.approx(r.auroc * r.n0 * r.n1)
    reach = {(r.corpus, r.feature): r.reach for r in long.groupBy(*per).agg((F.max("value") - F.min("value")).alias("reach")).collect()}
    exact = {(r.corpus, r.feature): r.distance for r in stats.wasserstein(long, per, "value", F.col("side")).collect()}
    for r in sk.sketch_wasserstein(table, ["corpus"], F.col("side")).collect():
        key = (r.corpus, r.feature)
        assert abs(r.distance - exact[key]) <= 2 * sk.distribution_error() * reach[key]


def test_medians_by_rank(rows):
    for r in sk.sketch_median(sk.sketches(rows, ["side"], FEATURES)).collect():
        x = np.array([v[0] for v in rows.where(F.col("side") == r.side).select(r.feature).collect() if v[0] is not None])
        assert r.n == len(x)
        assert (x < r["median"]).mean() <= 0.5 + sk.rank_error() and (x <= r["median"]).mean() >= 0.5 - sk.rank_error()


def test_only_sketches_are_shuffled(rows, plan):
    above, below = plan(sk.sketches(rows, ["side"], FEATURES)).split("Exchange", 1)
    assert "kll_sketch_agg_double" in above and "partial_kll_sketch_agg_double" in below.splitlines()[1]


def test_one_sided_and_empty(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, None)], "shard int, side int, a double")
    table = sk.sketches(df, ["side"], ["a"])
    assert sk.sketch_auroc(table, [], F.col("side")).count() == 0
    assert [r["median"] for r in sk.sketch_median(table).collect()] == [2.0]
    assert sk.sketches(df.limit(0), ["side"], ["a"]).count() == 0
