"""Distribution statistics per feature.

Rank statistics read a *value histogram*: the rows collapsed to (keys, value, n0, n1). Cumulative counts over it are
taken in two levels. Every value belongs to an order-preserving bucket computed from the value alone; counts are
accumulated inside a bucket in parallel, and the small table of bucket totals supplies the offsets. A bucket with very
many distinct values is cut further at its own quantiles. So one feature is spread over thousands of tasks wherever
its values lie, ties are collapsed before any shuffle, and no sort is global. The histogram is written once and read by
every later pass. NULL keys are keys like any others.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprint.functions.tails import SMALL_SIDE, anova_p, normal_two_sided, rank_sum_p
from inkprint.session import materialised, null_safe_join

_STEPS = 4096  # buckets per power of two
HOT_BUCKET = 1_000_000  # distinct values from which a bucket is cut further
_CUTS = 255  # quantiles at which a crowded bucket is cut


def order_bucket(value: Column) -> Column:
    """Bucket number that never decreases as ``value`` grows. Scaling by a power of two is exact in floating point,
    and an exponent that is off by one at a power of two lands in the same or the adjoining bucket edge."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    scale = F.pow(F.lit(2.0), exponent.cast("double"))
    number = (exponent + 1100) * _STEPS + F.floor((size / scale - 1.0) * _STEPS)
    far = F.lit(10**9).cast("long")
    number = F.when(size == F.lit(float("inf")), far).otherwise(number)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, number).otherwise(-number)


def melt(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Long form (ids, feature, value), missing values dropped."""
    typed = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    long = typed.unpivot(ids, features, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_histogram(df: DataFrame, keys: list[str], value: str, side: Column) -> DataFrame:
    """(keys, bucket, value, n0, n1); rows with a NULL side or value do not count.

    Such rows are left uncounted rather than filtered out: a filter would be pushed below a computed score and
    evaluate its whole expression a second time."""
    x = F.col(value).cast("double") + 0.0
    rows = df.select(*keys, F.when(~F.isnan(x), x).alias("value"), side.cast("int").alias("_side"))
    counted = F.col("value").isNotNull()
    return rows.withColumn("bucket", order_bucket(F.col("value"))).groupBy(*keys, "bucket", "value").agg(
        F.count_if(counted & (F.col("_side") == 0)).alias("n0"), F.count_if(counted & (F.col("_side") == 1)).alias("n1"))


def split_hot(hist: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame:
    """Append ``part`` to a written histogram: 0, or the place of the value among the quantiles of a bucket with more than
    ``hot`` distinct values. Parts keep the order of the values, and wherever those cluster, no part holds many more than
    a 256th of its bucket."""
    hot = hot or HOT_BUCKET
    crowded = hist.groupBy(*keys, "bucket").agg(F.count("*").alias("_distinct")).where(F.col("_distinct") > hot)
    if crowded.isEmpty():
        return hist.withColumn("part", F.lit(0))
    cuts = F.percentile_approx("value", [i / (_CUTS + 1) for i in range(1, _CUTS + 1)], 20 * _CUTS).alias("_cuts")
    inside = null_safe_join(hist, crowded.drop("_distinct"), [*keys, "bucket"])
    marked = null_safe_join(hist, inside.groupBy(*keys, "bucket").agg(cuts), [*keys, "bucket"], "left")
    part = F.size(F.filter("_cuts", lambda x: x < F.col("value")))
    return marked.withColumn("part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")


_CELL = ["bucket", "part"]


def _earlier(keys: list[str]):
    return W.partitionBy(*keys).orderBy(*_CELL).rowsBetween(W.unboundedPreceding, -1)


def rank_counts(hist: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame:
    """From a written histogram, per key: ``n0``, ``n1``, ``u1`` (pairs in which side 1 is larger, ties half) and ``ties`` = sum(t^3 - t)."""
    before = W.partitionBy(*keys, *_CELL).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    d = lambda name: F.col(name).cast("double")
    tied = d("n0") + d("n1")
    local = split_hot(hist, keys, hot).withColumn("_below", F.coalesce(F.sum("n0").over(before), F.lit(0)).cast("double"))
    cells = local.groupBy(*keys, *_CELL).agg(
        F.sum(d("n1") * (F.col("_below") + d("n0") / 2.0)).alias("_u"),
        F.sum(tied * tied * tied - tied).alias("_ties"),
        F.sum("n0").alias("_n0"), F.sum("n1").alias("_n1"),
    )
    offset = F.coalesce(F.sum("_n0").over(_earlier(keys)), F.lit(0)).cast("double")
    return cells.withColumn("_offset", offset).groupBy(*keys).agg(
        F.sum("_n0").alias("n0"), F.sum("_n1").alias("n1"),
        F.sum(F.col("_u") + d("_n1") * F.col("_offset")).alias("u1"),
        F.sum("_ties").alias("ties"),
    )


def mann_whitney(df: DataFrame, keys: list[str], value: str, side: Column) -> DataFrame:
    """Two-sided rank-sum test of side 0 against side 1 per key: ``u0``, ``u1``, tie- and continuity-corrected
    ``z`` and ``p_value``. Where all values are equal, z is 0 and p is 1. Where a side has at most eight values and no
    values tie, p counts all orders of the values; else it is the normal tail of z."""
    return rank_sum_test(materialised(value_histogram(df, keys, value, side)), keys)


def rank_sum_test(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``mann_whitney`` of a written histogram (keys, bucket, value, n0, n1)."""
    c = F.col
    counts = rank_counts(hist, keys).where((c("n0") > 0) & (c("n1") > 0))
    pairs = c("n0").cast("double") * c("n1")
    n = (c("n0") + c("n1")).cast("double")
    spread = pairs / 12.0 * ((n + 1.0) - c("ties") / F.nullif(n * (n - 1.0), F.lit(0.0)))
    excess = F.greatest(c("u1"), pairs - c("u1")) - pairs / 2.0 - 0.5
    z = F.when(spread > 0, excess / F.sqrt(F.abs(spread))).otherwise(F.lit(0.0))
    scored = counts.select(*keys, "n0", "n1", (pairs - c("u1")).alias("u0"), "u1", z.alias("z"),
                           (spread > 0).alias("_varies"), ((c("ties") == 0) & (F.least("n0", "n1") <= SMALL_SIDE)).alias("exact"))
    p = F.when(c("_varies"), normal_two_sided(F.greatest(c("z"), F.lit(0.0)))).otherwise(F.lit(1.0))
    few = rank_sum_p(*[F.when(c("exact"), c(name)).otherwise(F.lit(1)) for name in ("u1", "n0", "n1")])
    return scored.withColumn("p_value", F.when(c("exact"), few).otherwise(p)).drop("_varies", "exact")


def auroc(df: DataFrame, keys: list[str], score: str, label: Column, overall: str | None = None) -> DataFrame:
    """Area under the ROC curve of ``score`` for label 1, per key; ties count half. ``overall`` adds one row over
    all rows, named so in the first key."""
    hist = materialised(value_histogram(df, keys, score, label))
    if overall is not None:  # the overall row adds the keys' histograms up
        rest = keys[1:]
        whole = hist.groupBy(*rest, "bucket", "value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        hist = hist.withColumn(keys[0], F.col(keys[0]).cast("string")).unionByName(whole.withColumn(keys[0], F.lit(overall)))
    return area_under_curve(hist, keys)


def area_under_curve(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``auroc`` of a written histogram (keys, bucket, value, n0, n1)."""
    counts = rank_counts(hist, keys)
    pairs = F.col("n0").cast("double") * F.col("n1")
    return counts.select(*keys, "n0", "n1", (F.col("u1") / F.nullif(pairs, F.lit(0.0))).alias("auroc"))


def wasserstein(df: DataFrame, keys: list[str], value: str, side: Column, hot: int | None = None) -> DataFrame:
    """First Wasserstein distance between the values of side 0 and side 1, per key."""
    return transport_distance(materialised(value_histogram(df, keys, value, side)), keys, hot)


def transport_distance(hist: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame:
    """``wasserstein`` of a written histogram (keys, bucket, value, n0, n1)."""
    c = F.col
    hist = split_hot(hist, keys, hot)
    all_of = W.partitionBy(*keys)
    cells = hist.groupBy(*keys, *_CELL).agg(
        F.sum("n0").alias("_n0"), F.sum("n1").alias("_n1"), F.min("value").alias("_first"))
    cells = cells.select(
        *keys, *_CELL,
        F.coalesce(F.sum("_n0").over(_earlier(keys)), F.lit(0)).alias("_o0"),
        F.coalesce(F.sum("_n1").over(_earlier(keys)), F.lit(0)).alias("_o1"),
        F.sum("_n0").over(all_of).alias("_t0"), F.sum("_n1").over(all_of).alias("_t1"),
        F.lead("_first").over(all_of.orderBy(*_CELL)).alias("_next"),
    ).where((c("_t0") > 0) & (c("_t1") > 0))
    inside = W.partitionBy(*keys, *_CELL).orderBy("value")
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    gaps = null_safe_join(hist, cells, [*keys, *_CELL]).select(
        *keys,
        (F.coalesce(F.lead("value").over(inside), c("_next")) - c("value")).alias("_gap"),
        F.abs((c("_o0") + F.sum("n0").over(so_far)) / c("_t0")
              - (c("_o1") + F.sum("n1").over(so_far)) / c("_t1")).alias("_height"),
    )
    return gaps.groupBy(*keys).agg(F.coalesce(F.sum(c("_gap") * c("_height")), F.lit(0.0)).alias("distance"))


def value_counts_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, bucket, value, n): every value with its number of rows, counted before the shuffle. Missing values are one
    row with a NULL value."""
    x = F.col(value).cast("double") + 0.0
    rows = df.select(*keys, F.when(~F.isnan(x), x).alias("value"))
    return rows.withColumn("bucket", order_bucket(F.col("value"))).groupBy(*keys, "bucket", "value").agg(F.count("*").alias("n"))


def two_sides(counts: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """(keys, bucket, value, n0, n1) from value counts that are told apart by more than ``keys``."""
    of = lambda number: F.coalesce(F.sum(F.when(side.cast("int") == number, F.col("n"))), F.lit(0)).alias(f"n{number}")
    return counts.where(F.col("value").isNotNull()).groupBy(*keys, "bucket", "value").agg(of(0), of(1))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", hot: int | None = None) -> DataFrame:
    """Exact median per key. The rows collapse to value counts, written once; totals per bucket locate the one or two
    buckets that hold the middle ranks, and values are ordered in those buckets only."""
    return median_of(materialised(value_counts_of(df, keys, value)), keys, name, hot)


def median_of(counts: DataFrame, keys: list[str], name: str = "median", hot: int | None = None) -> DataFrame:
    """``exact_median`` of written value counts (keys, bucket, value, n)."""
    c = F.col
    rows = counts.where(c("value").isNotNull())
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("n").alias("_n"))
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                       F.sum("_n").over(W.partitionBy(*keys)).alias("_total"))
    low, high = F.floor((c("_total") - 1) / 2), F.ceil((c("_total") - 1) / 2)
    wanted = sums.where((c("_offset") <= high) & (c("_offset") + c("_n") > low)).drop("_n")
    near = materialised(null_safe_join(rows, wanted, [*keys, "bucket"]).withColumnRenamed("n", "n0"))
    hist = split_hot(near, keys, hot)
    cells = hist.groupBy(*keys, *_CELL).agg(F.sum("n0").alias("_m"))
    within = W.partitionBy(*keys, "bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_earlier", F.coalesce(F.sum("_m").over(within), F.lit(0))).drop("_m")
    upto = W.partitionBy(*keys, *_CELL).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    placed = null_safe_join(hist, cells, [*keys, *_CELL]).withColumn(
        "_upto", c("_offset") + c("_earlier") + F.sum("n0").over(upto))
    middle = lambda rank: F.min(F.when(c("_upto") > rank, c("value")))
    return placed.groupBy(*keys).agg(((middle(low) + middle(high)) / 2.0).alias(name))


def moments(df: DataFrame, keys: list[str], features: list[str], missing_as_zero: bool = False) -> DataFrame:
    """(keys, feature, n, mean, std, var): sample moments of every feature per key.

    Long form keeps three accumulators per (key, feature) in generated code; one aggregate over all features at once
    has hundreds of them, too many for one generated method, and measured several times slower. Rows are combined
    before the shuffle, which carries (keys x features) rows per task."""
    if missing_as_zero:
        clean = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f)
        df = df.select(*keys, *[clean(f) for f in features])
    value = F.col("value")
    return melt(df, keys, features).groupBy(*keys, "feature").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("var"))


def class_moments(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Mean and sample standard deviation per feature and key (corpus, class)."""
    return moments(df, keys, features).drop("var")


def anova_f(df: DataFrame, label: str, features: list[str], by: list[str] | None = None) -> DataFrame:
    """One-way ANOVA of each feature over the classes in ``label`` (missing values count as 0): ``f_stat``,
    ``p_value``, optionally per slice ``by``."""
    by = by or []
    return anova_of(moments(df.where(F.col(label).isNotNull()), [*by, label], features, missing_as_zero=True), by)


def anova_of(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``anova_f`` of the moments (feature, n, mean, var) of every class."""
    by = by or []
    c = F.col
    feature = W.partitionBy(*by, "feature")
    centred = cells.withColumn("_grand", F.sum(c("n") * c("mean")).over(feature) / F.sum("n").over(feature))
    sums = centred.groupBy(*by, "feature").agg(
        F.sum(c("n") * F.pow(c("mean") - c("_grand"), F.lit(2.0))).alias("_between"),
        F.sum((c("n") - 1) * F.coalesce(c("var"), F.lit(0.0))).alias("_within"),
        (F.count("*") - 1).alias("df_between"), (F.sum("n") - F.count("*")).alias("df_within"),
    )
    f = (c("_between") / F.nullif(c("df_between"), F.lit(0))) / F.nullif(
        c("_within") / F.nullif(c("df_within"), F.lit(0)), F.lit(0.0))
    tested = sums.select(*by, "feature", f.alias("f_stat"), "df_between", "df_within")
    return tested.withColumn("p_value", anova_p("f_stat", c("df_between").cast("double"), c("df_within").cast("double")))


def top_features(anova: DataFrame, n: int) -> DataFrame:
    return anova.orderBy(F.desc_nulls_last("f_stat"), "feature").limit(n)


def significance_flag(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def direction(human_mean: Column, ai_mean: Column) -> Column:
    """+1 where class 1 has the larger mean, else -1 (equal means give -1)."""
    return F.when(ai_mean > human_mean, 1).otherwise(-1)


def signal_table(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Two-class signal per feature: class means, U test, significance mark, which class is higher, and delta."""
    c = F.col
    tested = mann_whitney(melt(df, [label], features), ["feature"], "value", c(label))
    means = _class_means(df, [], features, label)
    return tested.join(means, "feature").select(
        "feature", "human_mean", "ai_mean", "z", "p_value", significance_flag(c("p_value")).alias("signal"),
        F.when(c("human_mean") > c("ai_mean"), "H>AI").otherwise("AI>H").alias("direction"),
        (c("human_mean") - c("ai_mean")).alias("delta"),
    )


def strongest_signals(signals: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` significant features with the largest absolute delta."""
    return signals.where(F.col("p_value") < 0.05).orderBy(F.desc(F.abs("delta")), "feature").limit(n)


def _class_means(df: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    return _sides(moments(df, [*keys, label], features), keys, label)


def _sides(cells: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Class means and sizes side by side, of cells (keys, label, feature, n, mean)."""
    side = lambda name, of: F.max(F.when(F.col(label) == of, F.col(name)))
    return cells.groupBy(*keys, "feature").agg(
        side("mean", 0).alias("human_mean"), side("mean", 1).alias("ai_mean"),
        F.coalesce(side("n", 0), F.lit(0)).alias("n_human"), F.coalesce(side("n", 1), F.lit(0)).alias("n_ai"))


def shift_directions(first: DataFrame, second: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Class means and direction per feature in two corpora; ``stable`` where the directions agree. Features with
    no value in one of the four cells are left out."""
    return _directions(_class_means(_stack(first, second, features, label), ["corpus"], features, label), 1)


def _stack(first: DataFrame, second: DataFrame, features: list[str], label: str) -> DataFrame:
    of = lambda df, name: df.select(F.lit(name).alias("corpus"), label, *features)
    return of(first, "first").unionByName(of(second, "second"))


def _directions(means: DataFrame, min_cell: int) -> DataFrame:
    c = F.col
    means = means.where(F.least("n_human", "n_ai") >= min_cell)
    side = lambda name, corpus: F.max(F.when(c("corpus") == corpus, c(name))).alias(f"{corpus}_{name}")
    wide = means.groupBy("feature").agg(
        *[side(m, corpus) for corpus in ("first", "second") for m in ("human_mean", "ai_mean")],
        F.count("*").alias("_corpora"),
    ).where(c("_corpora") == 2)
    wide = wide.select(
        "feature",
        direction(c("first_human_mean"), c("first_ai_mean")).alias("dir_first"),
        direction(c("second_human_mean"), c("second_ai_mean")).alias("dir_second"),
        "first_human_mean", "first_ai_mean", "second_human_mean", "second_ai_mean",
    )
    return wide.withColumn("stable", c("dir_first") == c("dir_second"))


def classify_shift(shift: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Append ``kind``: 'stable' or 'conflict' where both corpora are significant, else NULL. Needs ``stable``,
    ``p_first`` and ``p_second``."""
    both = (F.col("p_first") < alpha) & (F.col("p_second") < alpha)
    return shift.withColumn("kind", F.when(both, F.when(F.col("stable"), "stable").otherwise("conflict")))


def _counted(stacked: DataFrame, features: list[str], label: str) -> DataFrame:
    """Value counts of every feature by corpus and class, written once: all rank statistics of a report read them."""
    return materialised(value_counts_of(melt(stacked, ["corpus", label], features), ["corpus", label, "feature"], "value"))


def _tested(counts: DataFrame, label: str, min_cell: int) -> DataFrame:
    """Directions and tests from the value counts alone; the rows are not read again."""
    c = F.col
    tests = rank_sum_test(materialised(two_sides(counts, ["corpus", "feature"], c(label))), ["corpus", "feature"])
    side = lambda name, corpus, alias: F.max(F.when(c("corpus") == corpus, c(name))).alias(alias)
    paired = tests.groupBy("feature").agg(
        side("z", "first", "z_first"), side("z", "second", "z_second"),
        side("p_value", "first", "p_first"), side("p_value", "second", "p_second"))
    cells = counts.groupBy("corpus", label, "feature").agg(
        F.sum("n").alias("n"), (F.sum(c("value") * c("n")) / F.sum("n")).alias("mean"))
    return _directions(_sides(cells, ["corpus"], label), min_cell).join(paired, "feature")


def stable_conflict_features(first: DataFrame, second: DataFrame, features: list[str], label: str = "label",
                             min_cell: int = 10) -> DataFrame:
    """Features significant in both corpora, as 'stable' (same direction) or 'conflict' (opposite)."""
    stacked = _stack(first, second, features, label)
    tested = _tested(_counted(stacked, features, label), label, min_cell)
    return classify_shift(tested).where(F.col("kind").isNotNull())


def shift_report(first: DataFrame, second: DataFrame, features: list[str], label: str = "label",
                 min_cell: int = 10) -> DataFrame:
    """Every shift column per feature: directions, means, per-corpus tests, and how far the human and the AI
    distribution move between the corpora. Computed on all values."""
    stacked = _stack(first, second, features, label)
    counts = _counted(stacked, features, label)
    corpora = two_sides(counts, [label, "feature"], F.when(F.col("corpus") == "first", 0).otherwise(1))
    moved = transport_distance(materialised(corpora), [label, "feature"])
    side = lambda of, alias: F.max(F.when(F.col(label) == of, F.col("distance"))).alias(alias)
    moved = moved.groupBy("feature").agg(side(1, "ai_shift_w"), side(0, "human_shift_w"))
    return classify_shift(_tested(counts, label, min_cell)).join(moved, "feature")


def shift_counts(report: DataFrame) -> DataFrame:
    """How many features are stable, unstable, significant in both, agreeing and conflicting."""
    c = F.col
    return report.agg(
        F.count("*").alias("n_features"), F.count_if("stable").alias("n_stable"),
        F.count_if(~c("stable")).alias("n_unstable"), F.count("kind").alias("n_significant"),
        F.count_if(c("kind") == "stable").alias("n_agree"), F.count_if(c("kind") == "conflict").alias("n_conflict"))


def overlap_zone(first: DataFrame, second: DataFrame, third: DataFrame, features: list[str],
                 label: str = "label") -> DataFrame:
    """Per feature, the six class means of three corpora and whether the third corpus' class-0 mean lies within one
    sample standard deviation of the first corpus' class-1 mean."""
    c = F.col
    of = lambda df, name: df.select(F.lit(name).alias("corpus"), label, *features)
    cells = moments(
        of(first, "first").unionByName(of(second, "second")).unionByName(of(third, "third")),
        ["corpus", label], features)
    pick = lambda name, corpus, side: F.max(F.when((c("corpus") == corpus) & (c(label) == side), c(name)))
    names = {0: "human", 1: "ai"}
    wide = cells.groupBy("feature").agg(
        *[pick("mean", corpus, s).alias(f"{corpus}_{names[s]}_mean")
          for corpus in ("first", "second", "third") for s in (0, 1)],
        pick("std", "first", 1).alias("_std"))
    inside = F.abs(c("third_human_mean") - c("first_ai_mean")) < c("_std")
    return wide.withColumn("third_human_in_first_ai_zone", F.coalesce(inside, F.lit(False))).drop("_std")
