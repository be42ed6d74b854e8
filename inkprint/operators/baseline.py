"""Distance of every sample from a reference population ("human baseline distance").

Fitting is two aggregations over the population; only p means and p x p sums come back to the driver, where the small
matrix is shrunk and inverted. Scoring is one column expression over literals: no shuffle, batch or streaming.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators.stats import auroc, exact_median, melt
from inkprint.session import null_safe_join

# The nine stable features, the warning level, and the documented reading bands of the score.
STABLE_FEATURES = [
    "avg_line_length", "max_line_length", "p90_line_length", "digit_ratio", "snake_case_count", "long_ident_count",
    "naming_style_ratio", "early_return_count", "trailing_ws_ratio",
]
CONDITION_WARNING = 100.0
TYPICAL_BELOW, REVIEW_ABOVE = 2.0, 6.0

_SQL_WIDTH = 16  # up to this many features the products are plain SQL sums


def _clean(feature: str) -> Column:
    return F.coalesce(F.nanvl(F.col(feature).cast("double"), F.lit(0.0)), F.lit(0.0))


def baseline_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, scale): mean and population standard deviation, missing values as 0; a zero deviation
    scales by 1."""
    std = F.stddev_pop("value")
    return melt(df.select(*[_clean(f).alias(f) for f in features]), [], features).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("scale"))


def _scaler_arrays(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    held = {r["feature"]: r for r in baseline_scaler(df, features).collect()}  # one row per feature
    return (np.array([held[f]["mean"] for f in features]), np.array([held[f]["scale"] for f in features]))


def standardised(features: list[str], mean, scale) -> list[Column]:
    return [(_clean(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, mean, scale)]


def _product_sums(df: DataFrame, features: list[str], mean, scale) -> tuple[int, np.ndarray, float]:
    """n, sum of z z^T, and sum of |z|^4 over the rows."""
    p = len(features)
    z = df.select(*[e.alias(f"z{i}") for i, e in enumerate(standardised(features, mean, scale))])
    if p <= _SQL_WIDTH:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        norm = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0"))
        row = z.agg(
            F.count("*").alias("n"), F.sum(norm * norm).alias("q"),
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
        sums = np.zeros((p, p))
        for i, j in pairs:
            sums[i, j] = sums[j, i] = row[f"s{i}_{j}"]
        return row["n"], sums, row["q"]

    def partial(batches):
        sums, n, quartic = np.zeros((p, p)), 0, 0.0
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            sums, n, quartic = sums + x.T @ x, n + len(x), quartic + float(((x * x).sum(axis=1) ** 2).sum())
        flat = np.append(sums.ravel(), [n, quartic])
        yield pd.DataFrame({"cell": np.arange(p * p + 2), "value": flat})

    cells = z.mapInPandas(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    flat = np.zeros(p * p + 2)
    for r in cells.collect():  # p * p + 2 rows
        flat[r["cell"]] = r["value"]
    return int(flat[-2]), flat[:-2].reshape(p, p), flat[-1]


def shrink(n: int, sums: np.ndarray, quartic: float) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf shrinkage of the covariance towards a multiple of the identity: (covariance, intensity)."""
    p = sums.shape[0]
    s = sums / n
    target = np.trace(s) / p * np.eye(p)
    squared = float(((s - target) ** 2).sum())
    noise = min((quartic / n - float((s * s).sum())) / n, squared)
    intensity = noise / squared if noise > 0 else 0.0
    return (1.0 - intensity) * s + intensity * target, intensity


@dataclass(frozen=True)
class Baseline:
    """Fitted reference population."""

    features: list[str]
    n: int
    mean: np.ndarray
    scale: np.ndarray
    covariance: np.ndarray
    precision: np.ndarray
    shrinkage: float
    condition_number: float

    @property
    def near_collinear(self) -> bool:
        return self.condition_number > CONDITION_WARNING

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One parameter row."""
        flat = lambda a: [float(x) for x in np.ravel(a)]
        return spark.createDataFrame(
            [(list(self.features), int(self.n), flat(self.mean), flat(self.scale), flat(self.covariance),
              flat(self.precision), float(self.shrinkage), float(self.condition_number))],
            "features array<string>, n long, mean array<double>, scale array<double>, covariance array<double>, "
            "precision array<double>, shrinkage double, condition_number double")


def fit_baseline(population: DataFrame, features: list[str] = STABLE_FEATURES) -> Baseline:
    mean, scale = _scaler_arrays(population, features)
    return baseline_of(features, mean, scale, *_product_sums(population, features, mean, scale))


def baseline_of(features: list[str], mean: np.ndarray, scale: np.ndarray, n: int, sums: np.ndarray, quartic: float) -> Baseline:
    """The baseline of n rows from their scaler, and sum of z z^T and of |z|^4."""
    covariance, intensity = shrink(n, sums, quartic)
    precision = np.linalg.pinv(covariance, hermitian=True)
    spectrum = np.linalg.eigvalsh(covariance)
    condition = float(spectrum[-1] / spectrum[0]) if spectrum[0] > 0 else float("inf")
    return Baseline(list(features), n, mean, scale, covariance, precision, intensity, condition)


def baseline_covariance(df: DataFrame, features: list[str], shrunk: bool = False) -> DataFrame:
    """(feature_i, feature_j, covariance) of the standardised features, divided by n; optionally shrunk."""
    mean, scale = _scaler_arrays(df, features)
    n, sums, quartic = _product_sums(df, features, mean, scale)
    matrix = shrink(n, sums, quartic)[0] if shrunk else sums / n
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(features) for j, b in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature_i string, feature_j string, covariance double")


def save_baseline(baseline: Baseline, spark: SparkSession, path: str) -> None:
    baseline.to_df(spark).write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> Baseline:
    r = spark.read.parquet(path).first()
    p = len(r["features"])
    square = lambda name: np.array(r[name]).reshape(p, p)
    return Baseline(list(r["features"]), r["n"], np.array(r["mean"]), np.array(r["scale"]), square("covariance"),
                    square("precision"), r["shrinkage"], r["condition_number"])


def hbd_score(df: DataFrame, baseline: Baseline, name: str = "hbd") -> DataFrame:
    """Append the Mahalanobis distance from the population; lower is more typical of it."""
    p = len(baseline.features)
    z = standardised(baseline.features, baseline.mean, baseline.scale)
    held = df.select("*", *[e.alias(f"_z{i}") for i, e in enumerate(z)])
    total = F.lit(0.0)
    for i in range(p):
        row = F.lit(float(baseline.precision[i, i])) * F.col(f"_z{i}")
        for j in range(i + 1, p):
            row = row + F.lit(2.0 * float(baseline.precision[i, j])) * F.col(f"_z{j}")
        total = total + F.col(f"_z{i}") * row
    return held.withColumn(name, F.sqrt(F.greatest(total, F.lit(0.0)))).drop(*[f"_z{i}" for i in range(p)])


def score_bands(score: Column) -> Column:
    """Reading aid only; the score itself carries no threshold."""
    return F.when(score < TYPICAL_BELOW, "typical").when(score <= REVIEW_ABOVE, "ambiguous").when(
        score > REVIEW_ABOVE, "review")


def score_summary(df: DataFrame, by: list[str], score: str = "hbd") -> DataFrame:
    """n, mean, exact median and population standard deviation of the score per group."""
    basic = df.groupBy(*by).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return null_safe_join(basic, exact_median(df, by, score), by, "left")


def standardise_check(df: DataFrame, baseline: Baseline) -> DataFrame:
    """(feature, mean) of the standardised features over ``df``; about 0 on the fitted population."""
    z = standardised(baseline.features, baseline.mean, baseline.scale)
    wide = df.agg(*[F.avg(e).alias(f) for f, e in zip(baseline.features, z)])
    return wide.unpivot([], baseline.features, "feature", "mean")


def score_auroc(df: DataFrame, score: str = "hbd", label: str = "label", corpus: str = "corpus") -> DataFrame:
    """AUROC of the score per corpus and over all of them ('Overall')."""
    return auroc(df, [corpus], score, F.col(label), overall="Overall")
