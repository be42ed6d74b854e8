from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from inkprint.llm import merkle
from inkprint.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, block int, extra string"


def brute(rows):
    """Edited texts by the definition, on plain lists."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[:len(text) - n] + nxt[:n]
        a, b, c = (merkle.tree(x)[0] for x in (text, edited, nxt))
        out.append((i, len(text), sha256(edited.encode()).hexdigest(), a.fingerprint(), b.fingerprint(),
                    merkle.likeness(a, b), merkle.likeness(a, c)))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in merkle.edited_pairs(df).collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op3_merkle"](spark, sf_dir).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    long_enough = [r for r in got if r[1] > 300]
    assert sum(r[5] > r[6] for r in long_enough) > 0.97 * len(long_enough)


def test_odd_rows(spark):
    rows = [(5, "one two three four " * 40), (5, "tie"), (9, None), (3, ""), (None, "no id"), (4, "é🙂" * 9), (4, "é🙂" * 9),
            (8, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    assert run(df) == brute(rows)
    assert run(df.where("doc_id = 8")) == brute([rows[-1]])
    assert run(df.where("doc_id = 99")) == []
    assert run(df.where("doc_id is null")) == brute([(None, "no id")])
    assert merkle.fingerprints(df).columns == ["doc_id", "fingerprint"]


def test_order_across_many_blocks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = [(i * 37 % 1000, f"text {i} " * (i % 9)) for i in range(200)]
        assert run(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_fingerprint_round_trip_and_edits():
    text = "\n".join(f"Paragraph {i} holds words that differ by number {i * 7} and more {i}." for i in range(40))
    at = text.index("number 140")
    changed = text[:at] + "NUMBER 999" + text[at + 10:]
    a, b = merkle.tree(text)[0], merkle.tree(changed)[0]
    assert merkle.parse(a.fingerprint()) == a
    assert merkle.likeness(a, a) == 1.0 and 0.9 < merkle.likeness(a, b) < 1.0
    (s1, e1, s2, e2), = merkle.edits(a, b)
    assert s1 <= at and e1 >= at + 10 and e1 - s1 < 300
    assert text[:s1] == changed[:s2] and text[e1:] == changed[e2:]
    assert merkle.edits(a, a) == []
    empty = merkle.tree("")[0]
    assert merkle.parse(empty.fingerprint()) == empty and merkle.likeness(empty, a) == 0.0


@pytest.mark.parametrize("text", ["", " ", "\n", "\n\n a", "word", "a b " * 50 + "\n", "é" * 20 + " ü\n"])
def test_leaves_cover_the_text(text):
    made, leaves = merkle.tree(text)
    assert sum(n for _, n in made.leaves()) == len(text)
    assert (leaves[-1][0] if leaves else 0) == len(text.encode())


@pytest.mark.parametrize("unit", ["".join(chr(0x4E00 + i * i * 31 % 20_000) for i in range(200)), "x", "0123456789abcdef" * 9,
                                  "".join(f"{i * i * 7919 % 100_003:x}" for i in range(300)), "a a a a b a a a "])
def test_every_text_has_leaves_in_its_unchanged_part(unit):
    text = (unit * 1_000)[:600]
    edited = text[:400] + "Ü-" * 100
    a, b = merkle.tree(text)[0], merkle.tree(edited)[0]
    assert all(n <= merkle.GREATEST for _, n in a.leaves())
    assert merkle.likeness(a, b) > 0.5
    start, *_ = merkle.edits(a, b)[0]
    assert 400 - merkle.GREATEST <= start <= 400


def test_leaves_meet_again_after_an_insertion():
    text = "".join(f"{i * i * 7919 % 100_003:x}" for i in range(2_000))
    a, b = merkle.tree(text)[0], merkle.tree(text[:900] + "inserted" + text[900:])[0]
    assert merkle.likeness(a, b) > 0.95
