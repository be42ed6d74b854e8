"""Pipeline from raw documents to packed training sequences.

Each stage is written as Parquet to the shared folder and read again as the next one's documents. All stages but the last
return the columns of documents:

* quality: documents whose quality score is below the classifier's cut-off go;
* toxicity: documents whose toxicity score reaches the classifier's cut-off go;
* near_duplicates: one document of each group of near copies stays, that with the smallest id;
* secrets: all documents stay; every secret in a text is replaced by a mark, and n_chars recounted;
* packing: every document's token pieces and their places in sequences of at most 2048 tokens.

Null texts count as empty and null ids stay null; rows with a null id are never near copies. Repeated rows become one in
near_duplicates. An empty table passes through all stages. Further columns of the table are dropped at the start of a
stage, as they are not columns of documents.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkprint.llm import near_dup, packing, quality, secret_scan, toxicity
from inkprint.llm.common import scratch_folder, table
from inkprint.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; the classifier learns from the documents it is given and ``labels``."""
    return quality.kept(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; the classifier learns from the documents it is given and ``labels``."""
    return toxicity.kept(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.kept(docs.select(COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return secret_scan.masked(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # the classifiers cannot be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
