import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.functions.tails import arrangements_up_to, f_upper_tail, rank_sum_exact
from inkprint.operators import stats


def values(seed=3, n=400):
    rng = random.Random(seed)
    pool = [0.0, -0.0, 1.0, 2.0, -1.5, 1e-300, 5e-324, 1e300, -1e12, 1024.0, 1023.9999999999999, 7.25]
    rows = []
    for key in ("k1", "k2"):
        for _ in range(n):
            v = rng.choice(pool) if rng.random() < 0.4 else rng.choice([rng.random(), rng.gauss(0, 100), 1e9 + rng.random()])
            rows.append((key, float(v), int(rng.random() < 0.45)))
    return rows


def split(rows, key):
    a = np.array([v for k, v, s in rows if k == key and s == 0])
    b = np.array([v for k, v, s in rows if k == key and s == 1])
    return a, b


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(values(), "k string, v double, side int").repartition(5).cache()


def brute_u1(a, b):
    return float((b[:, None] > a[None, :]).sum() + 0.5 * (b[:, None] == a[None, :]).sum())


def test_order_bucket_is_monotone(spark):
    edges = [math.ldexp(m, e) for e in (-1074, -1022, -3, 0, 1, 10, 52, 1000) for m in (1.0, 1.0000000000000002, 1.5, 1.9999999999999998)]
    xs = sorted(set(edges + [-x for x in edges] + [0.0] + [v for _, v, _ in values(9)]))
    df = spark.createDataFrame([(x,) for x in xs], "v double").select("v", stats.order_bucket(F.col("v")).alias("b"))
    got = [r.b for r in df.orderBy("v").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("hot", [None, 3])
def test_rank_statistics_match_brute_force(table, hot):
    hist = stats.value_histogram(table, ["k"], "v", F.col("side"))
    counted = {r.k: r for r in stats.rank_counts(hist, ["k"], hot).collect()}
    moved = {r.k: r.distance for r in stats.wasserstein(table, ["k"], "v", F.col("side"), hot).collect()}
    medians = {r.k: r.median for r in stats.exact_median(table, ["k"], "v", hot=hot).collect()}
    for key in ("k1", "k2"):
        a, b = split(values(), key)
        r = counted[key]
        assert (r.n0, r.n1) == (len(a), len(b))
        assert r.u1 == brute_u1(a, b)
        grid = np.unique(np.concatenate([a, b]))
        fa = np.searchsorted(np.sort(a), grid, "right") / len(a)
        fb = np.searchsorted(np.sort(b), grid, "right") / len(b)
        assert moved[key] == pytest.approx(float((np.diff(grid) * np.abs(fa - fb)[:-1]).sum()), rel=1e-9)
        assert medians[key] == np.median(np.concatenate([a, b]))


def test_mann_whitney_properties(table):
    rows = {r.k: r for r in stats.mann_whitney(table, ["k"], "v", F.col("side")).collect()}
    for key, r in rows.items():
        a, b = split(values(), key)
        assert r.u0 + r.u1 == len(a) * len(b)
        assert 0 <= r.p_value <= 1
    swapped = {r.k: r for r in stats.mann_whitney(table, ["k"], "v", 1 - F.col("side")).collect()}
    assert all(swapped[k].p_value == pytest.approx(rows[k].p_value) for k in rows)
    same = table.withColumn("v", F.lit(2.0))
    assert [r.p_value for r in stats.mann_whitney(same, ["k"], "v", F.col("side")).collect()] == [1.0, 1.0]


def test_known_rank_test(spark):
    rows = [(x, 0) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] + [(x, 1) for x in (4, 6, 8, 10, 12, 14, 16, 18, 20, 22)]
    df = spark.createDataFrame([("f", float(x), s) for x, s in rows], "k string, v double, side int")
    r = stats.mann_whitney(df, ["k"], "v", F.col("side")).first()
    t = 4 * (2 ** 3 - 2)
    sigma = math.sqrt(100 / 12 * (21 - t / (20 * 19)))
    assert r.u1 == 3.5 + 5.5 + 7.5 + 9.5 + 6 * 10
    assert r.z == pytest.approx((86 - 50 - 0.5) / sigma)
    assert r.p_value == pytest.approx(math.erfc(r.z / math.sqrt(2)))


def test_auroc_flips_with_score(table):
    up = {r.k: r.auroc for r in stats.auroc(table, ["k"], "v", F.col("side"), overall="all").collect()}
    down = {r.k: r.auroc for r in stats.auroc(table.withColumn("v", -F.col("v")), ["k"], "v", F.col("side"), overall="all").collect()}
    assert set(up) == {"k1", "k2", "all"}
    assert all(up[k] + down[k] == pytest.approx(1) for k in up)


def test_wasserstein_shift_and_identity(spark):
    base = [(float(x),) for x in (1, 1, 2, 5, 9)]
    df = spark.createDataFrame(base, "v double")
    both = lambda d: df.withColumn("s", F.lit(0)).unionByName(df.withColumn("v", F.col("v") + d).withColumn("s", F.lit(1))).withColumn("k", F.lit(1))
    assert stats.wasserstein(both(0.0), ["k"], "v", F.col("s")).first().distance == 0
    assert stats.wasserstein(both(2.5), ["k"], "v", F.col("s")).first().distance == pytest.approx(2.5)


def test_anova_and_tail(spark):
    groups = [[6, 8, 4, 5, 3, 4], [8, 12, 9, 11, 6, 8], [13, 9, 11, 8, 7, 12]]
    df = spark.createDataFrame([(g, float(x), None) for g, xs in enumerate(groups) for x in xs], "label int, a double, b double")
    got = {r.feature: r for r in stats.anova_f(df, "label", ["a", "b"]).collect()}
    assert got["a"].f_stat == pytest.approx(42.0 / (68 / 15), rel=1e-9)
    assert got["a"].p_value == pytest.approx(0.00240, abs=2e-5)
    assert got["b"].f_stat is None
    assert f_upper_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-9)
    assert f_upper_tail(1.0, 7, 7) == pytest.approx(0.5)
    assert f_upper_tail(3.0, 2, 8) == pytest.approx((1 + 2 * 3.0 / 8) ** -4)


def test_moments_skip_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)], "k string, x double")
    r = stats.class_moments(df, ["k"], ["x"]).first()
    assert (r.n, r.mean, r.std) == (2, 2.0, pytest.approx(math.sqrt(2)))
    assert stats.moments(df, ["k"], ["x"], missing_as_zero=True).first().n == 4


def test_classify_shift(spark):
    rows = [("agree", True, 0.01, 0.04), ("flip", False, 0.001, 0.001), ("weak", True, 0.01, 0.0528), ("none", False, 0.5, 0.6)]
    df = spark.createDataFrame(rows, "feature string, stable boolean, p_first double, p_second double")
    assert {r.feature: r.kind for r in stats.classify_shift(df).collect()} == {
        "agree": "stable", "flip": "conflict", "weak": None, "none": None}


def test_direction_ties_count_down(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 1.0)], "h double, a double")
    assert [r[0] for r in df.select(stats.direction(F.col("h"), F.col("a"))).collect()] == [-1, 1, -1]


def test_small_cells_are_left_out(spark):
    one = spark.createDataFrame([(i % 2, float(i), None if i > 8 else 1.0) for i in range(40)], "label int, x double, y double")
    kept = {r.feature for r in stats.shift_report(one, one, ["x", "y"]).collect()}
    assert kept == {"x"}


def test_plan_has_no_global_window_or_cross_join(table, plan):
    for df in (stats.wasserstein(table, ["k"], "v", F.col("side")), stats.auroc(table, ["k"], "v", F.col("side"))):
        text = plan(df)
        assert "SinglePartition" not in text and "Cartesian" not in text and "NestedLoop" not in text
        assert "Python" not in text


def test_null_keys_are_keys(spark):
    rows = [(None, float(i % 7), i % 2) for i in range(60)] + [("g", float(i % 5), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "generator string, x double, side int")
    for made in (stats.wasserstein(df, ["generator"], "x", F.col("side")), stats.mann_whitney(df, ["generator"], "x", F.col("side")),
                 stats.auroc(df, ["generator"], "x", F.col("side")), stats.exact_median(df, ["generator"], "x")):
        assert {r.generator for r in made.collect()} == {None, "g"}


def test_a_clustered_bucket_is_cut_at_its_quantiles(spark):
    values = [(1.0 + i * 1e-9,) for i in range(20_000)] + [(1.0002,)]
    hist = stats.value_histogram(spark.createDataFrame(values, "x double"), [], "x", F.lit(0)).withColumnRenamed("x", "value")
    cut = stats.split_hot(hist, [], 100)
    sizes = [r["count"] for r in cut.groupBy("bucket", "part").count().collect()]
    assert sum(sizes) == 20_001 and max(sizes) <= 200
    ends = cut.groupBy("part").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("part").collect()
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:]))
    whole = stats.exact_median(spark.createDataFrame(values, "x double").withColumn("k", F.lit(None).cast("string")), ["k"], "x", hot=100)
    assert whole.first().median == values[10_000][0]


def every_order(m, n):
    """The rank-sum statistic of every order of m and n distinct values."""
    return [sum(places) - m * (m - 1) // 2 for places in itertools.combinations(range(m + n), m)]


def test_arrangements_equal_enumeration():
    for m in range(1, 6):
        for n in range(1, 8):
            found = every_order(m, n)
            assert [arrangements_up_to(u, m, n) for u in range(-1, m * n + 1)] == [sum(x <= u for x in found) for u in range(-1, m * n + 1)]


@pytest.mark.parametrize("m, n", [(8, 250), (2, 4000), (5, 600)])
def test_arrangements_equal_the_recurrence_for_long_sides(m, n):
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):  # times (1 - q ** (n + i)) / (1 - q ** i)
        for j in range(m * n, n + i - 1, -1):
            counts[j] -= counts[j - n - i]
        for j in range(i, m * n + 1):
            counts[j] += counts[j - i]
    sums = list(itertools.accumulate(counts))
    assert sums[-1] == math.comb(m + n, m)
    for u in range(0, m * n + 1, 37):
        assert arrangements_up_to(u, m, n) == sums[u]


def test_exact_p_values():
    assert rank_sum_exact(0, 3, 3) == rank_sum_exact(9, 3, 3) == pytest.approx(0.1)  # published table
    assert rank_sum_exact(4.0, 2, 4) == 1.0
    wide = rank_sum_exact(8 * 10 ** 9, 8, 10 ** 9)
    assert wide == pytest.approx(float(Fraction(2, math.comb(10 ** 9 + 8, 8))))


def test_small_sides_without_ties_are_exact(spark):
    rng = random.Random(6)
    rows = [(f"{m}-{n}", rng.random(), side) for m, n in ((1, 1), (2, 5), (4, 4), (8, 9), (5, 3)) for side, k in ((0, m), (1, n)) for _ in range(k)]
    rows += [("tied", float(i % 3), i % 2) for i in range(10)] + [("long", rng.random(), i % 2) for i in range(40)] + [("one side", 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, v double, side int").repartition(3)
    got = {r.k: r for r in stats.mann_whitney(df, ["k"], "v", F.col("side")).collect()}
    assert set(got) == {k for k, _, _ in rows} - {"one side"}
    for key, r in got.items():
        a, b = split(rows, key)
        assert r.u1 == brute_u1(a, b)
        if key in ("tied", "long"):
            assert r.p_value == pytest.approx(min(1.0, math.erfc(max(r.z, 0.0) / math.sqrt(2))))
        else:
            orders, low = every_order(len(a), len(b)), min(r.u1, r.u0)
            assert r.p_value == pytest.approx(min(1.0, 2 * sum(x <= low for x in orders) / len(orders)))


def test_a_shift_report_reads_the_rows_once(spark):
    rows = [(i % 2, float(i % 7) / 3, float("nan") if i % 5 == 0 else None if i % 11 == 0 else i * 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, "label int, x double, y double")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    counting = df.mapInArrow(seen, df.schema)
    got = {r.feature: r for r in stats.shift_report(counting, counting.where("label >= 0"), ["x", "y"]).collect()}
    assert read.value == 2 * len(rows)
    for k, name in ((1, "x"), (2, "y")):
        for side, of in ((0, "human"), (1, "ai")):
            values = [r[k] for r in rows if r[0] == side and r[k] is not None and r[k] == r[k]]
            assert abs(got[name][f"first_{of}_mean"] - sum(values) / len(values)) < 1e-12
