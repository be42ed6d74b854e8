"""Registered queries of the training-data operators, each over its whole table, and their DuckDB counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkprint.llm import alignment, hard_negatives, license_scan, merkle, near_dup, packing, pii, quality, secret_scan, topk, toxicity, viterbi, warc
from inkprint.llm.common import scratch_folder, table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


@query("op1_secrets", secret_scan.ORACLE)
def _(spark, sf):
    return secret_scan.digests(secret_scan.scan(table(spark, sf, "documents")))


@query("op2_near_dup", near_dup.ORACLE)
def _(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents"))


@query("op3_merkle")
def _(spark, sf):
    return merkle.edited_pairs(table(spark, sf, "documents"))


@query("op4_quality")
def _(spark, sf):
    return quality.classified(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_packing")
def _(spark, sf):
    return packing.pack(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@query("op6_pii")
def _(spark, sf):
    return pii.digests(pii.find(table(spark, sf, "documents")))


@query("op7_warc", warc.ORACLE)
def _(spark, sf):
    folder = scratch_folder(spark)
    warc.write(table(spark, sf, "pages"), folder)
    return warc.read_back(spark, folder)


@query("op8_topk", topk.ORACLE)
def _(spark, sf):
    return topk.search(spark, table(spark, sf, "embeddings"))


@query("op9_sentencepiece")
def _(spark, sf):
    return viterbi.round_trip(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op10_toxicity")
def _(spark, sf):
    return toxicity.classified(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op11_hard_negatives", hard_negatives.ORACLE)
def _(spark, sf):
    return hard_negatives.search(spark, table(spark, sf, "embeddings"))


@query("op12_licenses", license_scan.ORACLE)
def _(spark, sf):
    return license_scan.scan(table(spark, sf, "documents"))


@query("op13_alignment")
def _(spark, sf):
    return alignment.align(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
