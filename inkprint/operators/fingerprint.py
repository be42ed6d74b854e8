"""Which classes are confusable with which: confusion rates, class distances, average linkage."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprint.operators.metrics import confusion_counts
from inkprint.operators.stats import anova_f, significance_flag
from inkprint.session import materialised, null_safe_join

MIN_RATE = 0.01  # fixed value: pairs below this rate are not listed


def derive_class(df: DataFrame, generator: str = "generator") -> DataFrame:
    """``class`` = the generator, or 'human' where there is none."""
    return df.withColumn("class", F.coalesce(generator, F.lit("human")))


def index_classes(df: DataFrame, column: str = "class") -> DataFrame:
    """(class, class_index): classes numbered in alphabetical order from 0; one row per class."""
    names = df.where(F.col(column).isNotNull()).select(F.col(column).alias("class")).distinct()
    place = F.row_number().over(W.orderBy("class")) - 1  # over one row per class
    return names.select(place.alias("class_index"), "class")


def confusion_rates(df: DataFrame, by: list[str] | None = None, label: str = "label",
                    prediction: str = "prediction") -> DataFrame:
    """(true_class, pred_class, n, rate): share of each true class predicted as another. Pairs that occur are
    listed; correct predictions keep their count but have rate 0, like every pair that does not occur."""
    by = by or []
    c = F.col
    counts = confusion_counts(df, by, label, prediction)
    sizes = counts.groupBy(*by, "label").agg(F.sum("n").alias("_size"))
    rate = F.when(c("label") == c("prediction"), F.lit(0.0)).otherwise(c("n") / c("_size"))
    return null_safe_join(counts, sizes, [*by, "label"]).select(
        *by, c("label").alias("true_class"), c("prediction").alias("pred_class"), "n", rate.alias("rate"))


def confusion_matrix(rates: DataFrame, classes: list[str]) -> DataFrame:
    """Dense report form, one column per class; unobserved pairs are 0."""
    return rates.groupBy("true_class").pivot("pred_class", classes).agg(F.sum("rate")).na.fill(0.0)


def confused_pairs(rates: DataFrame, top: int = 20, min_rate: float = MIN_RATE) -> DataFrame:
    """Most confused (true, predicted) pairs above a rate."""
    listed = rates.where((F.col("true_class") != F.col("pred_class")) & (F.col("rate") > min_rate))
    return listed.orderBy(F.desc("rate"), F.desc("true_class"), F.desc("pred_class")).limit(top)


def class_distance(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(class_i < class_j, distance): 1 - the larger confusion rate of the two directions. Pairs never confused have
    distance 1 and are not listed."""
    pairs = rates.where(F.col("true_class") != F.col("pred_class")).select(
        *(by or []), F.least("true_class", "pred_class").alias("class_i"),
        F.greatest("true_class", "pred_class").alias("class_j"), "rate")
    return pairs.groupBy(*(by or []), "class_i", "class_j").agg((1.0 - F.max("rate")).alias("distance"))


def nearest_class(distances: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Closest other class of every class (the first by name where several are equally close)."""
    by = by or []
    both = F.array(F.struct(F.col("class_i").alias("class"), F.col("class_j").alias("other")),
                   F.struct(F.col("class_j").alias("class"), F.col("class_i").alias("other")))
    best = F.min(F.struct("distance", "other")).alias("_best")
    return distances.select(*by, "distance", F.inline(both)).groupBy(*by, "class").agg(best).select(
        *by, "class", F.col("_best.other").alias("nearest"), F.col("_best.distance").alias("distance"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Append ``name``: the place of the row, from 0, in its group by ``order`` (whose columns decide every tie). With
    ``weight`` also ``{name}_sum``: that column summed up to and including the row. No group is brought together: rows are
    dealt out by range and numbered inside their range, and the small table of range totals gives the offsets."""
    dealt = materialised(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = [F.count("*").alias("_rows")] + ([F.sum(weight).alias("_weight")] if weight else [])
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_range").agg(*totals)
    offsets = offsets.select(*keys, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                             *([F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_sum")] if weight else []))
    inside = W.partitionBy(*keys, "_range").orderBy(*order)
    placed = dealt.withColumn(name, F.row_number().over(inside) - 1)
    if weight:
        placed = placed.withColumn(f"{name}_sum", F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    joined = null_safe_join(placed, offsets, [*keys, "_range"]).withColumn(name, F.col(name) + F.col("_before"))
    return (joined.withColumn(f"{name}_sum", F.col(f"{name}_sum") + F.col("_sum")) if weight else joined).drop("_range", "_before", "_sum")


def _merge_round(pairs: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """One round over (_slice, a, b, alike, size_a, size_b), a before b: the pairs that are each other's nearest merge, all at
    once. Returns the written merges and the pairs of the clusters that are left."""
    c = F.col
    distance = 1.0 - c("alike") / (c("size_a") * c("size_b"))
    near = F.struct(c("distance"), c("a"), c("b"), c("size"))
    known = pairs.withColumn("distance", distance).withColumn("size", c("size_a") + c("size_b")).withColumn("near", near)
    # the order by distance, then names is the same from both sides, so the closest pair of a slice always merges
    nearest = known.select("_slice", F.explode(F.array("a", "b")).alias("of"), "near").groupBy("_slice", "of").agg(
        F.min("near").alias("near"))
    mutual = nearest.groupBy("_slice", c("near.a").alias("low"), c("near.b").alias("high")).agg(
        F.count("*").alias("_both"), F.first("near.distance").alias("distance"), F.first("near.size").alias("size"))
    merges = materialised(mutual.where(c("_both") == 2).select("_slice", "low", "high", "distance", "size", F.lit(step).alias("round")))
    moved = merges.select("_slice", F.explode(F.array("low", "high")).alias("_old"), c("low").alias("_new"), c("size").alias("_grown"))

    def renamed(df: DataFrame, side: str) -> DataFrame:
        joined = df.join(moved.withColumnRenamed("_old", side), ["_slice", side], "left")
        return joined.withColumns({side: F.coalesce("_new", side), f"size_{side}": F.coalesce("_grown", f"size_{side}")}).drop("_new", "_grown")

    both = renamed(renamed(pairs, "a"), "b").where(c("a") != c("b"))
    side = lambda name, first: F.when((c("a") < c("b")) == first, c(name + "a")).otherwise(c(name + "b"))
    left = both.select("_slice", side("", True).alias("a"), side("", False).alias("b"), "alike",
                       side("size_", True).alias("size_a"), side("size_", False).alias("size_b"))
    return merges, left.groupBy("_slice", "a", "b").agg(
        F.sum("alike").alias("alike"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))


def average_linkage(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Merge table (step, idx1, idx2, distance, count) of the classes of each slice, numbered alphabetically; merges are
    numbered on from there by distance.

    Only pairs that were confused are held; others stand at distance 1. Of two clusters the sum of what their classes are
    closer than 1 is held, so a merge adds sums up and the average distance is exact. Merging each other's nearest
    clusters never brings other ones closer, so all such pairs of all slices merge in the same round; every round is a few
    aggregations over what is left, written to shared storage. Clusters without a confused pair between them merge last, at
    distance 1, in the order of their first classes. Slices may be NULL; a slice with one class has no merges."""
    c = F.col
    keys = by or []
    slice_of = F.to_json(F.struct(*[c(k) for k in keys])) if keys else F.lit("all")
    named = materialised(rates.withColumn("_slice", slice_of).select("_slice", "true_class", "pred_class", "rate", *keys))
    leaves = numbered(named.select("_slice", F.explode(F.array("true_class", "pred_class")).alias("class")).distinct(),
                      ["_slice"], ["class"], "leaf")
    one = F.lit(1).cast("long")
    pairs = materialised(class_distance(named, ["_slice"]).select(
        "_slice", c("class_i").alias("a"), c("class_j").alias("b"), (1.0 - c("distance")).alias("alike"),
        one.alias("size_a"), one.alias("size_b")))
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        merges, pairs = _merge_round(pairs, len(rounds))
        pairs = materialised(pairs)
        rounds.append(merges)
    merged = rounds[0] if rounds else pairs.select(
        "_slice", c("a").alias("low"), c("b").alias("high"), c("alike").alias("distance"), c("size_a").alias("size"), F.lit(0).alias("round"))
    for merges in rounds[1:]:
        merged = merged.unionByName(merges)
    merged = materialised(merged)

    # what is left of every slice merges at distance 1, one cluster after the other
    at = ["_slice", "class"]
    sizes = merged.groupBy("_slice", c("low").alias("class")).agg(F.max("size").alias("size"))
    roots = leaves.join(merged.select("_slice", c("high").alias("class")), at, "left_anti").join(sizes, at, "left").select(
        *at, F.coalesce("size", one).alias("size"))
    roots = numbered(roots, ["_slice"], ["class"], "root", "size")
    placed = numbered(merged, ["_slice"], ["distance", "round", "low"], "step")
    counts = leaves.groupBy("_slice").agg(F.count("*").alias("n")).join(
        merged.groupBy("_slice").agg(F.count("*").alias("merged")), "_slice", "left").na.fill(0, ["merged"])

    # a cluster is the last merge that kept its first class, else that class; there are as many such merges as rounds at most
    placed = placed.join(counts, "_slice").withColumn("node", c("n") + c("step"))
    first = leaves.select(*at, F.lit(-1).alias("made"), c("leaf").alias("node"))
    nodes = materialised(first.unionByName(placed.select("_slice", c("low").alias("class"), c("round").alias("made"), "node")))

    def latest(side: str) -> DataFrame:
        asked = placed.select("_slice", "step", "round", c(side).alias("class"))
        return asked.join(nodes, at).where(c("made") < c("round")).groupBy("_slice", "step").agg(
            F.max_by("node", "made").alias(f"{side}_node"))

    listed = placed.select("_slice", "step", "distance", c("size").alias("count")).join(latest("low"), ["_slice", "step"]).join(
        latest("high"), ["_slice", "step"]).select("_slice", "step", "low_node", "high_node", "distance", "count")
    tops = roots.join(nodes.groupBy(*at).agg(F.max_by("node", "made").alias("node")), at).join(counts, "_slice")
    start = tops.where(c("root") == 0).select("_slice", c("node").alias("first"))
    before = F.when(c("root") == 1, c("first")).otherwise(c("n") + c("merged") + c("root") - 2)
    chain = tops.where(c("root") > 0).join(start, "_slice").select(
        "_slice", (c("merged") + c("root") - 1).alias("step"), before.alias("low_node"), c("node").alias("high_node"),
        F.lit(1.0).alias("distance"), c("root_sum").alias("count"))
    table = listed.unionByName(chain).select(
        "_slice", c("step").cast("int"), F.least("low_node", "high_node").cast("double").alias("idx1"),
        F.greatest("low_node", "high_node").cast("double").alias("idx2"), "distance", c("count").cast("double"))
    if not keys:
        return table.drop("_slice")
    values = named.select("_slice", *keys).dropDuplicates(["_slice"])
    return table.join(values, "_slice").select("step", "idx1", "idx2", "distance", "count", *keys)


def discriminating_features(df: DataFrame, features: list[str], label: str = "class") -> DataFrame:
    """Features ranked by how strongly they separate the classes (ANOVA F), with significance marks."""
    tested = anova_f(df, label, features)
    return tested.select("feature", "f_stat", "p_value", significance_flag(F.col("p_value")).alias("signal")).orderBy(
        F.desc_nulls_last("f_stat"), "feature")
