"""Incremental extraction and scoring: new files are processed once, a restart resumes where it stopped.

The work per sample is narrow, so no state and no watermark is needed; the file sink commits each batch atomically.
``append_once`` also keeps a sample that arrives again, in another file or a later run, from being written again.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkprint.operators.increments import commit, committed
from inkprint.operators.sampling import hash_rank
from inkprint.session import materialised, null_safe_join


def incremental_features(spark: SparkSession, source: str, schema: T.StructType | str,
                         transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                         files_per_batch: int = 1000) -> StreamingQuery:
    """Apply a narrow ``transform`` (features, scores) to the Parquet files under ``source`` that are not processed
    yet, append the results under ``out``, and stop. Progress is kept under ``checkpoint``."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        transform(arriving).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


_KEYS = T.StructType([T.StructField("digest", T.StringType())])


def append_batch(batch: DataFrame, number: int, transform: Callable[[DataFrame], DataFrame], keys: list[str], out: str) -> None:
    """Append the samples of one batch whose key was not appended before, with the digests of their keys beside them, as
    batch ``number`` of ``out``.

    Of rows that share a key within the batch one stays, the smallest by a hash of the row, so that a repeated batch keeps
    the same. Keys of the same batch number do not count as appended before: a batch that is run again after a failure
    replaces what it wrote. A batch counts from the moment its commit is written, after data and keys."""
    spark = batch.sparkSession
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{k}`").cast("string")), F.lit("null")) for k in keys]
    digest = F.sha2(F.to_json(F.array(*parts)), 256)  # keys that are NULL are keys like any others
    row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    first = batch.select(digest.alias("digest"), row.alias("row")).groupBy("digest").agg(
        F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    arrived = materialised(first)
    before = committed(spark, out, "keys", _KEYS).where(F.col("batch") != number).select(F.col("digest").alias("_seen"))
    # only the batch's keys are looked for: the long list of old ones is scanned, not shuffled, while the batch is small
    seen = before.join(arrived.select("digest"), F.col("_seen") == F.col("digest"), "left_semi").distinct()
    new = materialised(arrived.join(seen, F.col("digest") == F.col("_seen"), "left_anti"))
    transform(new.select("row.*")).write.mode("overwrite").parquet(f"{out}/data/batch={number}")
    new.select("digest").write.mode("overwrite").parquet(f"{out}/keys/batch={number}")
    commit(spark, out, number)


def append_once(spark: SparkSession, source: str, schema: T.StructType | str, transform: Callable[[DataFrame], DataFrame],
                keys: list[str], out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """``incremental_features`` for sources that may deliver a sample again: every key is written once, whatever file,
    batch or run it comes in. Read the result with ``appended``."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    def append(batch: DataFrame, number: int) -> None:
        append_batch(batch, number, transform, keys, out)
    return arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, out: str, schema: T.StructType | str) -> DataFrame:
    """The samples of all committed batches of ``append_once``; ``schema`` is that of ``transform``'s result."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return committed(spark, out, "data", schema).drop("batch")


def resume(planned: DataFrame, done: DataFrame, by: list[str], id_col: str, need: int) -> DataFrame:
    """What is left of a run that takes ``need`` samples of every class, in the order of their hash: of each class the
    planned samples from the number of finished ones on, with their ``position`` (from 0). A run that stopped anywhere goes
    on at its per-class offset; classes that are finished give no rows."""
    counts = done.groupBy(*by).agg(F.count("*").alias("_done"))
    ranked = hash_rank(planned, by, id_col, limit=need).withColumn("position", F.col("hash_rank") - 1).drop("hash_rank")
    offset = F.coalesce("_done", F.lit(0))
    return null_safe_join(ranked, counts, by, "left").where(F.col("position") >= offset).drop("_done")
