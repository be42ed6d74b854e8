import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import baseline as hbd


def sample(p, n=300):
    rng = np.random.default_rng(p)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + rng.normal(size=p) * 5
    x[:, 0] = 7.0  # constant feature
    return x


def frame(spark, x):
    names = [f"f{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{n} double" for n in names)).repartition(4), names


def brute(x):
    """Definition of the estimator with explicit per-row outer products."""
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(scale == 0, 1, scale)
    n, p = z.shape
    outer = np.einsum("ni,nj->nij", z, z)
    s = outer.mean(axis=0)
    target = np.eye(p) * np.trace(s) / p
    d2 = ((s - target) ** 2).sum()
    b2 = min(((outer - s) ** 2).sum(axis=(1, 2)).mean() / n, d2)
    cov = b2 / d2 * target + (1 - b2 / d2) * s
    return z, cov, b2 / d2


@pytest.mark.parametrize("p", [3, 9, 20])
def test_fit_and_score(spark, p):
    x = sample(p)
    df, names = frame(spark, x)
    fitted = hbd.fit_baseline(df, names)
    z, cov, intensity = brute(x)
    assert 0 <= fitted.shrinkage <= 1
    assert fitted.shrinkage == pytest.approx(intensity, rel=1e-8)
    assert np.allclose(fitted.covariance, cov, atol=1e-9)
    values = np.linalg.eigvalsh(cov)
    assert fitted.condition_number == pytest.approx(values[-1] / values[0], rel=1e-6)
    got = sorted(r.hbd for r in hbd.hbd_score(df, fitted).collect())
    want = sorted(np.sqrt(np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z)))
    assert np.allclose(got, want, rtol=1e-7)
    assert max(abs(r["mean"]) for r in hbd.standardise_check(df, fitted).collect()) < 1e-9


def test_missing_counts_as_zero(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 4.0), (5.0, 2.0)], "a double, b double")
    rows = {r.feature: (r["mean"], r.scale) for r in hbd.baseline_scaler(df, ["a", "b"]).collect()}
    assert rows["a"] == (2.0, pytest.approx(np.std([1, 0, 5]))) and rows["b"][0] == 2.0


def test_save_and_load(spark, tmp_path):
    df, names = frame(spark, sample(4))
    fitted = hbd.fit_baseline(df, names)
    hbd.save_baseline(fitted, spark, str(tmp_path / "b"))
    loaded = hbd.load_baseline(spark, str(tmp_path / "b"))
    assert loaded.features == names and np.array_equal(loaded.precision, fitted.precision)
    assert [r.hbd for r in hbd.hbd_score(df, loaded).collect()] == [r.hbd for r in hbd.hbd_score(df, fitted).collect()]


def test_scoring_is_one_narrow_expression(spark, plan):
    df, names = frame(spark, sample(9))
    text = plan(hbd.hbd_score(df, hbd.fit_baseline(df, names)))
    assert text.count("Exchange") == plan(df).count("Exchange") and "Python" not in text


def test_bands(spark):
    df = spark.createDataFrame([(1.99,), (2.0,), (6.0,), (6.01,), (None,)], "s double")
    assert [r[0] for r in df.select(hbd.score_bands(F.col("s"))).collect()] == ["typical", "ambiguous", "ambiguous", "review", None]


def test_summary(spark):
    df = spark.createDataFrame([("a", 0, x) for x in (1.0, 2.0, 4.0, 9.0)], "corpus string, label int, hbd double")
    r = hbd.score_summary(df, ["corpus", "label"]).first()
    assert (r.n, r["mean"], r.median, r["std"]) == (4, 4.0, 3.0, pytest.approx(np.std([1, 2, 4, 9])))
