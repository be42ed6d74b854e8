"""Statistics of a growing corpus from mergeable increments.

What a batch of new samples adds is written once, as value counts per (keys, feature, value) and as sums of products of
the features of one population. Both only ever add up, so reading them summed over all batches gives what counting all
rows would: rank-sum tests, areas under curves, Wasserstein distances, medians, moments, variance analysis and the baseline
of a population, without reading an old sample again. A batch has a folder of its own that is overwritten when the batch
is repeated, and the sums read committed batches only; so a batch that failed half-way or ran twice counts once.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkprint.operators.baseline import Baseline, baseline_of
from inkprint.operators.stats import order_bucket
from inkprint.session import materialised, null_safe_join


def _clean(feature: str) -> Column:
    x = F.col(f"`{feature}`").cast("double") + 0.0
    return F.when(~F.isnan(x), x).alias(feature)


def increment(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, bucket, value, n) of some samples; missing values are counted under a NULL value."""
    long = df.select(*keys, *map(_clean, features)).unpivot(keys, features, "feature", "value")
    return long.withColumn("bucket", order_bucket(F.col("value"))).groupBy(
        *keys, "feature", "bucket", "value").agg(F.count("*").alias("n"))


def product_increment(population: DataFrame, features: list[str]) -> DataFrame:
    """(cell, value): sums of the products of (1, x, x squared) over samples of a population, missing values as 0. They
    hold what its scaler, its covariance and the shrinkage of that covariance read, under whatever scaling comes later."""
    p = len(features)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * p + 1, 2 * p + 1))
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(i), np.float64) for i in range(p)])
            powers = np.hstack([np.ones((len(x), 1)), x, x * x])
            total += powers.T @ powers
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    filled = population.select(*[F.coalesce(_clean(f), F.lit(0.0)).alias(f) for f in features])
    return filled.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))


def baseline_of_products(products: DataFrame, features: list[str]) -> Baseline:
    """The baseline of a population from its summed products; (2 p + 1) squared numbers are collected."""
    p = len(features)
    cells = np.zeros((2 * p + 1) ** 2)
    for r in products.collect():
        cells[r["cell"]] = r["value"]
    cells = cells.reshape(2 * p + 1, -1)
    n, mean = cells[0, 0], cells[0, 1:p + 1] / cells[0, 0]
    crossed = cells[1:p + 1, 1:p + 1] - n * np.outer(mean, mean)
    variance = np.where(np.diag(crossed) < 1e-12 * np.maximum(cells[0, p + 1:], 1e-300), 0.0, np.diag(crossed)) / n
    scale = np.where(variance > 0, np.sqrt(np.maximum(variance, 0.0)), 1.0)
    # the square of a scaled feature in terms of (1, x, x squared), so that fourth powers are products of those
    square = np.zeros((p, 2 * p + 1))
    square[:, 0], square[:, 1:p + 1], square[:, p + 1:] = (mean / scale) ** 2, np.diag(-2 * mean / scale ** 2), np.diag(1 / scale ** 2)
    quartic = float((square @ cells @ square.T).sum())
    return baseline_of(features, mean, scale, int(n), crossed / np.outer(scale, scale), quartic)


def moments_of(counts: DataFrame, keys: list[str], missing_as_zero: bool = False) -> DataFrame:
    """(keys, feature, n, mean, std, var) of merged value counts: moments within a bucket, whose values lie close together,
    then over the buckets, so no digits are lost to large means."""
    c = F.col
    value = F.coalesce("value", F.lit(0.0)) if missing_as_zero else c("value")
    rows = counts.select(*keys, "feature", F.coalesce("bucket", F.lit(0)).alias("bucket"), value.alias("value"), "n")
    per = [*keys, "feature"]
    rows = rows.where(c("value").isNotNull())
    # a value near the others of its bucket, the same for all batches: sums of differences from it lose nothing
    first = rows.groupBy(*per, "bucket").agg(F.min("value").alias("_first"))
    near = null_safe_join(rows, first, [*per, "bucket"]).withColumn("_d", c("value") - c("_first"))
    inside = near.groupBy(*per, "bucket").agg(
        F.sum("n").alias("_n"), F.first("_first").alias("_first"), F.sum(c("n") * c("_d")).alias("_s"),
        F.sum(c("n") * c("_d") * c("_d")).alias("_q"))
    inside = inside.withColumn("_mean", c("_first") + c("_s") / c("_n")).withColumn("_m2", c("_q") - c("_s") * c("_s") / c("_n"))
    whole = W.partitionBy(*per)  # as many rows as buckets
    centred = inside.withColumn("_grand", F.sum(c("_n") * c("_mean")).over(whole) / F.sum("_n").over(whole))
    merged = centred.groupBy(*per).agg(
        F.sum("_n").alias("n"), F.first("_grand").alias("mean"),
        F.sum(c("_m2") + c("_n") * F.pow(c("_mean") - c("_grand"), F.lit(2.0))).alias("_m2"))
    variance = F.when(c("n") > 1, F.greatest(c("_m2"), F.lit(0.0)) / (c("n") - 1))
    return merged.select(*per, "n", "mean", F.sqrt(variance).alias("std"), variance.alias("var"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def commit(spark: SparkSession, folder: str, batch: int) -> None:
    """Mark a batch's folders as whole."""
    spark.range(1).select(F.lit(batch).alias("batch_id")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")


def committed(spark: SparkSession, folder: str, part: str, schema: T.StructType) -> DataFrame:
    """The rows of the part's committed batches, with ``batch``."""
    if not _exists(spark, f"{folder}/commits"):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())]))
    done = spark.read.parquet(f"{folder}/commits").select(F.col("batch").alias("_batch")).distinct()
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/{part}")
    return rows.join(done, rows["batch"] == F.col("_batch"), "left_semi")


_COUNTS = [T.StructField("feature", T.StringType()), T.StructField("bucket", T.LongType()),
           T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType())]
_CELLS = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("value", T.DoubleType())])


def add_increment(df: DataFrame, keys: list[str], features: list[str], folder: str, batch: int,
                  population: Column | None = None) -> None:
    """Write what the samples ``df`` add under ``folder`` as batch number ``batch``; a batch written before is replaced.
    ``population`` picks the rows of the baseline's population."""
    spark = df.sparkSession
    increment(df, keys, features).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")
    if population is not None:
        product_increment(df.where(population), features).write.mode("overwrite").parquet(f"{folder}/products/batch={batch}")
    commit(spark, folder, batch)


def merged_counts(spark: SparkSession, folder: str, keys: T.StructType) -> DataFrame:
    """(keys, feature, bucket, value, n) over all committed batches, written once for the statistics that read it."""
    rows = committed(spark, folder, "counts", T.StructType([*keys.fields, *_COUNTS]))
    return materialised(rows.groupBy(*keys.fieldNames(), "feature", "bucket", "value").agg(F.sum("n").alias("n")))


def merged_baseline(spark: SparkSession, folder: str, features: list[str]) -> Baseline:
    """The baseline of the population of all committed batches."""
    return baseline_of_products(committed(spark, folder, "products", _CELLS).groupBy("cell").agg(F.sum("value").alias("value")), features)


def incremental_statistics(spark: SparkSession, source: str, schema: T.StructType | str,
                           transform: Callable[[DataFrame], DataFrame], keys: list[str], features: list[str], folder: str,
                           checkpoint: str, population: Column | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Count the Parquet files under ``source`` that are not counted yet into ``folder`` and stop. ``transform`` turns
    samples into keys and features. Old files are not read; progress is kept under ``checkpoint``."""
    def add(batch: DataFrame, number: int) -> None:
        rows = materialised(transform(batch).select(*keys, *features))
        add_increment(rows, keys, features, folder, number, population)

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
