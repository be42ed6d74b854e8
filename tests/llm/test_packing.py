import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkprint.llm import packing
from inkprint.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int"


def reference_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts, size):
    """Brute force: every document's ids come back, every sequence is gapless and no longer than the size."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = reference_ids(text)
        parts = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // size)))
        for r in parts:
            part = ids[r.piece * size:(r.piece + 1) * size]
            assert (r.start, r.length) == (r.piece * size, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert not by_doc
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_whole_table(spark, sf_dir):
    rows = QUERIES["op5_packing"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used = check(rows, texts, packing.SIZE)
    total = sum(r.length for r in rows)
    assert used <= 1.02 * total / packing.SIZE + 1


def test_odd_rows(spark):
    texts = {0: None, 1: "", 2: "a " * 30, 3: "Don't STOP... \t 12,5 É é 東京 🙂🙂, x., <|endoftext|>b", 4: "tie", 5: "tie"}
    df = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], SCHEMA)
    check(packing.pack(df, PATH, 8).collect(), texts, 8)
    twice = packing.pack(df.unionByName(df), PATH, 8)
    assert twice.count() == 2 * packing.pack(df, PATH, 8).count()
    assert packing.pack(df.where("doc_id is null"), PATH).count() == 0
    null_id = packing.pack(df.withColumn("doc_id", F.lit(None).cast("long")), PATH, 8)
    assert null_id.where("doc_id is null").count() == packing.pack(df, PATH, 8).count()


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_up(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(np.clip(rng.lognormal(5, 1.2, 5000).astype(int), 1, 2048), minlength=2049)
    if seed == 3:
        histogram = np.bincount([1025] * 50 + [2048] * 3 + [1] * 7, minlength=2049)
    made = packing.plan(histogram)
    back = np.zeros_like(histogram)
    for shape, n in made:
        assert sum(shape) <= 2048
        for x in shape:
            back[x] += n
    assert (back == histogram).all()
    least = -(-int((histogram * np.arange(2049)).sum()) // 2048)
    assert sum(n for _, n in made) <= (53 if seed == 3 else least * 1.01 + 1)


def test_fit_is_a_least_squares_solution():
    shapes = np.array([(3, 1, 0), (2, 2, 0), (4, 0, 0), (2, 1, 1)])
    w = packing.fit_counts(shapes, np.array([0, 9, 10, 5, 2]), 4000)
    made = np.bincount(shapes.ravel(), np.repeat(w, 3), 5)[1:]
    assert np.allclose(made, [9, 10, 5, 2], atol=0.01)
