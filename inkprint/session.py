"""Session-level helpers: spreading CPU-bound work, intermediate tables, joins on crowded keys."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[str] = []


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give a CPU-bound stage a few partitions per core when its scans have too few splits for that.

    Splits are estimated from the plan's own statistics, as the scan cuts files; large inputs have more and are returned
    as they are, whatever their number of files. Nothing runs and no file is listed here."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    conf = spark._jsparkSession.sessionState().conf()
    split = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), size // cores))
    return df.repartition(cores * per_core) if size < split * cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name for intermediate tables inside the shared folder. ``release`` deletes all of this session's."""
    path = f"{shared_folder(spark)}/inkprint-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the scratch folders handed out so far, through the Hadoop file system. Call it when no result that reads
    them is needed any more; returns the number of folders deleted."""
    deleted, hadoop = 0, spark._jvm.org.apache.hadoop.fs
    while _SCRATCH:
        path = hadoop.Path(_SCRATCH.pop())
        deleted += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return deleted


def materialised(df: DataFrame) -> DataFrame:
    """Write a table that several passes read to shared storage, and read it back. Later passes then prune columns and
    share no lineage with the extraction, so a lost executor never re-runs it."""
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys and other columns of ``left``, then those of ``right``."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") if k in keys else F.col(f"`{k}`") for k in right.columns])
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(named[f"_right_{key}"])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def join_hot_safe(rows: DataFrame, per_key: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join many rows to a table with one row per key when a key may hold a large share of all rows.

    ``per_key`` carries the number of rows behind each key in ``weight``. Keys with at least a thousandth of all
    rows (so at most a thousand keys, the only thing broadcast) are spread over salts; the rest join plainly.
    """
    salts = 64
    total = per_key.agg(F.sum(weight).alias("n")).select(F.col("n").cast("double"))
    hot = per_key.where(F.col(weight) * 1000.0 >= total.scalar()).where(F.col(weight) > 100_000).select(
        F.col(key).alias("_hot"))
    mark = lambda df: df.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), F.col(key).eqNullSafe(F.col("_hot")), "left")
    salted_rows = mark(rows).withColumn(
        "_salt", F.when(F.col("_is_hot").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        .cast("int")).drop("_hot", "_is_hot")
    salted_keys = mark(per_key).withColumn(
        "_salt", F.explode(F.when(F.col("_is_hot").isNull(), F.array(F.lit(0)))
                           .otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop("_hot", "_is_hot")
    return null_safe_join(salted_rows, salted_keys, [key, "_salt"], how).drop("_salt")
