"""Reading and writing corpora: shards, labelled sources, JSON records, label columns, routed and sharded output."""

import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

SAMPLE_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("label", T.IntegerType()),
    T.StructField("language", T.StringType()), T.StructField("generator", T.StringType()),
])
_PROBLEM = T.StructType([
    T.StructField("problem_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("rating", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType())),
])


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


PAIRED_SCHEMA = T.StructType([
    *_strings("id", "problem_id", "label", "language", "model", "author", "source", "repo", "file",
              "created_at", "file_last_modified", "code"),
    T.StructField("problem", _PROBLEM),
])
TASK_SCHEMA = T.StructType(
    _strings("task_id", "label", "language", "source", "model", "entry_point", "code", "prompt"))
GENERATED_SCHEMA = T.StructType([
    *_strings("id", "label", "language", "model", "prompt", "code"),
    T.StructField("generated_at", T.TimestampType()),
])

# Label names of the binary and of the model-family task.
BINARY_NAMES = {0: "human", 1: "ai"}
FAMILY_NAMES = {
    0: "human", 1: "deepseek", 2: "qwen", 3: "yi", 4: "starcoder", 5: "gemma", 6: "phi", 7: "llama",
    8: "granite", 9: "mistral", 10: "gpt",
}
SHARD_ROWS = 50_000


def scan_shards(spark: SparkSession, directory: str, columns: list[str] | None = None,
                schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """All Parquet shards of a directory (or file), with every column that any shard has. A directory without shards
    gives no rows of ``schema``; a path that does not exist is an error."""
    try:
        shards = spark.read.option("mergeSchema", True).parquet(directory)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        shards = spark.createDataFrame([], schema)
    return shards.select(*columns) if columns else shards


def union_sources(sources: list[tuple[DataFrame, int]], label: str = "label") -> DataFrame:
    """Stack sources, each with the label of its directory; columns a source lacks become NULL."""
    labelled = [df.withColumn(label, F.lit(value)) for df, value in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def scan_json_records(spark: SparkSession, directory: str | list[str], schema: T.StructType) -> DataFrame:
    """One JSON document per file, with the file name kept as ``source_file``; ``directory`` may be a list of folders.
    Spark's own deal of at most 32 small files per task is mostly task start; a few tasks per core share them instead."""
    records = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(directory)
    records = records.withColumn("source_file", F.col("_metadata.file_name"))
    return records.coalesce(spark.sparkContext.defaultParallelism * 8)


def _record_files(directory: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = f"{TaskContext.get().partitionId():05d}"
        folder = f"{task}-{uuid.uuid4().hex}"
        os.makedirs(f"{directory}/{folder}")
        records = (record for batch in batches for record in batch.column(0))
        for number, record in enumerate(records):
            with open(f"{directory}/{folder}/{task}-{number:07d}.json", "xb") as file:
                file.write(record.as_py() + b"\n")
        yield pa.RecordBatch.from_pydict({"folder": [folder]})
    return write


def write_json_records(df: DataFrame, directory: str) -> list[str]:
    """One JSON document per row and file, as collectors leave them; returns the folders to scan, one per task that ended
    well, so that files of a failed or repeated task are never read. Rows are dealt out evenly, whatever their keys.

    On a mounted file system the tasks create the files themselves, as Hadoop's local one starts two ``chmod`` processes
    per file, which took most of the time. Other stores get Spark's writer."""
    spark = df.sparkSession
    rows = df.repartition(spark.sparkContext.defaultParallelism * 3)
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() != "file":
        rows.write.option("maxRecordsPerFile", 1).json(directory)
        return [directory]
    documents = rows.select(F.to_json(F.struct("*")).cast("binary").alias("document"))
    written = documents.mapInArrow(_record_files(uri.getPath()), "folder string").collect()
    return [f"{directory}/{row.folder}" for row in written]


def parse_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Records that arrive as JSON text in a table: fields of ``schema`` appended as columns."""
    parsed = df.withColumn("_parsed", F.from_json(F.col(column), schema))
    return parsed.select(*df.columns, "_parsed.*")


def normalize_label(df: DataFrame) -> DataFrame:
    """Rename the first column whose name contains 'label' (any case) to ``label``."""
    found = next((c for c in df.columns if "label" in c.lower()), None)
    return df if found in (None, "label") else df.withColumnRenamed(found, "label")


def label_names(df: DataFrame, label: str = "label", names: dict[int, str] = BINARY_NAMES) -> DataFrame:
    """Append ``label_str``; labels without a name give NULL."""
    entries = [F.lit(x) for item in names.items() for x in item]
    return df.withColumn("label_str", F.try_element_at(F.create_map(*entries), F.col(label).cast("int")))


def route_by_label(df: DataFrame, subtask: str = "subtask", label: str = "label") -> DataFrame:
    """Append ``route``: rows of the binary subtask 'A' go to 'human' or 'ai' by label (other labels are dropped);
    rows of the other subtasks all go to 'ai', where the label tells them apart."""
    binary = F.col(subtask) == "A"
    route = F.when(binary & (F.col(label) == 0), "human").when(binary & (F.col(label) == 1), "ai").when(~binary, "ai")
    return df.withColumn("route", route).where(F.col("route").isNotNull())


def write_routed(df: DataFrame, path: str, subtask: str = "subtask", split: str = "split") -> None:
    route_by_label(df, subtask).write.mode("overwrite").option("maxRecordsPerFile", SHARD_ROWS).partitionBy(
        "route", subtask, split).parquet(path)


def write_sharded(df: DataFrame, path: str, rows_per_file: int = SHARD_ROWS) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report tables (at most one row per feature, class or class pair) as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def skip_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose key is not among the finished ones."""
    return work.join(done.select(*keys), keys, "left_anti")


def still_needed(work: DataFrame, done: DataFrame, key: str, need: int) -> DataFrame:
    """Work items with fewer than ``need`` finished results, with ``have`` and how many are ``missing``."""
    have = done.groupBy(key).agg(F.count("*").alias("have"))
    counted = work.join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return counted.where(F.col("have") < need).withColumn("missing", F.lit(need) - F.col("have"))
