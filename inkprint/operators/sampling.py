"""Reproducible sampling, balancing and folds.

A sample is "the n rows with the smallest ``md5(seed:id)``", so it does not depend on partitioning, retries or
engine. Ranks are found in two steps: rows are counted per hash prefix (a small table that is summed up), then ranked
inside their prefix only. A class may hold any share of the rows: its work is spread over its 65,536 prefixes.
Rows with a NULL class form a class of their own; rows with a NULL id are hashed like one id and none of them is lost.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprint.session import null_safe_join

SEED = 42
_PREFIX = 4  # hex digits


def sample_hash(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("no id"))))


def _hashed(df: DataFrame, by: list[str], id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    hashed = df.withColumn("_hash", sample_hash(id_col, seed)).withColumn("_prefix", F.substring("_hash", 1, _PREFIX))
    sizes = hashed.groupBy(*by, "_prefix").agg(F.count("*").alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    return hashed, sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))


def hash_rank(df: DataFrame, by: list[str], id_col: str, seed: int = SEED, limit: Column | int | None = None,
              limits: DataFrame | None = None) -> DataFrame:
    """Append ``hash_rank`` (1-based, per ``by``). With ``limit``, only rows ranked up to it are kept and prefixes
    beyond it never reach the sort. ``limits`` gives one limit per group instead (``by`` columns + ``_limit``)."""
    added = [] if by else ["_all"]
    keys = by or added
    df = df if by else df.withColumn("_all", F.lit(0))
    hashed, sizes = _hashed(df, keys, id_col, seed)
    if limits is not None:
        sizes = null_safe_join(sizes, limits, keys)
        limit = F.col("_limit")
    if limit is not None:
        bound = limit if isinstance(limit, Column) else F.lit(limit)
        sizes = sizes.where(F.col("_offset") < bound)
    inside = W.partitionBy(*keys, "_prefix").orderBy("_hash", id_col)
    ranked = null_safe_join(hashed, sizes, [*keys, "_prefix"]).withColumn(
        "hash_rank", F.col("_offset") + F.row_number().over(inside))
    if limit is not None:
        ranked = ranked.where(F.col("hash_rank") <= bound)
    return ranked.drop("_hash", "_prefix", "_size", "_offset", "_limit", *added)


def balance_classes(df: DataFrame, label: str, id_col: str, cap: int | None = None) -> DataFrame:
    """The same number of rows from each class: the smallest class size, at most ``cap``."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    smallest = sizes.agg(F.min("n") if cap is None else F.least(F.min("n"), F.lit(cap))).scalar()
    return hash_rank(df, [label], id_col, limit=smallest).drop("hash_rank")


def cap_per_class(df: DataFrame, by: list[str], id_col: str, cap: int) -> DataFrame:
    """Up to ``cap`` rows of each class, smaller classes whole."""
    return hash_rank(df, by, id_col, limit=cap).drop("hash_rank")


def mark_capped(df: DataFrame, by: list[str], id_col: str, cap: int | None, name: str = "in_fit") -> DataFrame:
    """Append ``name``: whether the row is among the first ``cap`` of its class (all are, where ``cap`` is None). Marks the
    rows a model may be fit on; none is dropped."""
    if cap is None:
        return df.withColumn(name, F.lit(True))
    return hash_rank(df, by, id_col).withColumn(name, F.col("hash_rank") <= cap).drop("hash_rank")


def simple_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """``n`` rows without replacement."""
    return hash_rank(df, [], id_col, limit=n).drop("hash_rank")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5) -> DataFrame:
    """Append ``fold`` in 0..k-1, class-proportional."""
    return hash_rank(df, [label], id_col).withColumn("fold", (F.col("hash_rank") - 1) % k).drop("hash_rank")


def group_folds(df: DataFrame, group: str, k: int | None = None) -> DataFrame:
    """Append ``fold`` so that no group is split. Without ``k`` every group is its own fold (leave one group out), which
    suits reports; model evaluation fits one model per fold, so pass ``k`` there: groups are hashed into k folds. A table
    with one group has no training side and gives no rows."""
    fold = F.col(group) if k is None else F.conv(F.substring(sample_hash(group), 1, 8), 16, 10).cast("long") % k
    groups = df.select(F.min(group).alias("lo"), F.max(group).alias("hi"))
    several = groups.select(F.col("lo") < F.col("hi")).scalar()
    return df.withColumn("fold", fold).where(several)


def head_per_class(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """First ``k`` rows per class in a given order; Spark limits each group before the shuffle."""
    first = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(first)).where(F.col("position") <= k)


def union_corpora(corpora: dict[str, tuple[DataFrame, int | None]], label: str, id_col: str) -> DataFrame:
    """Stack corpora, each capped per class (None keeps it whole), with the slice remembered in ``corpus``."""
    stacked = None
    for name, (df, cap) in corpora.items():
        part = (df if cap is None else cap_per_class(df, [label], id_col, cap)).withColumn("corpus", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked
