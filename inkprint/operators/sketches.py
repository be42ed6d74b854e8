"""Approximate distribution statistics from mergeable quantile sketches, in one pass.

A KLL sketch per (keys, feature) holds a bounded number of values however many rows it saw, and sketches of parts merge
into that of the whole. Only sketches are shuffled. With ``k`` items at the base, the rank of a value is off by at most
``rank_error(k)`` of the rows with a confidence of 99 %; what is derived here states its error in those terms. The exact
forms in ``stats`` stay the default.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.operators.stats import melt

K = 800  # base size of a sketch
GRID = 256  # quantiles at which two sketches are compared


def rank_error(k: int = K) -> float:
    """Normalised rank error of a sketch for one query, 99 % confidence: the published fit 2.296 / k ** 0.9723."""
    return 2.296 / k ** 0.9723


def distribution_error(k: int = K) -> float:
    """How far the distribution read off the quantile grid of a sketch lies from the data's, as a share of the rows: the
    rank error, and half a step of the grid. ``sketch_auroc`` is off by at most twice that, ``sketch_wasserstein`` by at
    most twice that times the range of the values."""
    return rank_error(k) + 0.5 / GRID


def sketches(df: DataFrame, keys: list[str], features: list[str], k: int = K) -> DataFrame:
    """(keys, feature, n, sketch): one sketch per key and feature, missing values left out. Tables of this form, of shards
    or batches, add up with ``merged``."""
    value = F.col("value")
    return melt(df, keys, features).groupBy(*keys, "feature").agg(
        F.count(value).alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketch tables of parts, summed per (keys, feature)."""
    return parts.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketch: Column | str, at: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(q)) for q in at]))


def sketch_median(table: DataFrame, name: str = "median") -> DataFrame:
    """The median per row of a sketch table: a value whose rank lies within ``rank_error`` of one half."""
    return table.withColumn(name, quantiles("sketch", [0.5])[0]).drop("sketch")


def _grids(table: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """(keys, feature, n0, n1, q0, q1): the quantile grids of both sides beside each other, where both have values."""
    middles = [(i + 0.5) / GRID for i in range(GRID)]
    rows = table.where(F.col("n") > 0).withColumn("q", quantiles("sketch", middles))
    of = lambda column, number: F.max(F.when(side.cast("int") == number, F.col(column)))  # one row per key and side
    wide = rows.groupBy(*keys, "feature").agg(
        of("n", 0).alias("n0"), of("n", 1).alias("n1"), of("q", 0).alias("q0"), of("q", 1).alias("q1"))
    return wide.where(F.col("n0").isNotNull() & F.col("n1").isNotNull())


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.lit(float(GRID))


def sketch_auroc(table: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """(keys, feature, n0, n1, auroc, u1) from a sketch table that tells sides apart: the share of pairs of grid values in
    which side 1 is larger, ties half."""
    above = lambda x: _mean(F.transform("q0", lambda y: F.when(x > y, 1.0).when(x == y, 0.5).otherwise(0.0)))
    area = _grids(table, keys, side).withColumn("auroc", _mean(F.transform("q1", above)))
    return area.select(*keys, "feature", "n0", "n1", "auroc", (F.col("auroc") * F.col("n0") * F.col("n1")).alias("u1"))


def sketch_wasserstein(table: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """(keys, feature, distance): mean distance of the grid values of equal rank."""
    apart = F.zip_with("q0", "q1", lambda x, y: F.abs(x - y))
    return _grids(table, keys, side).select(*keys, "feature", _mean(apart).alias("distance"))
