import math

import numpy as np
from pyspark.sql import functions as F

from inkprint.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, list int"


def brute(rows, k, every):
    ok = {}
    for vec_id, x in rows:
        if vec_id is not None and x and all(c is not None and math.isfinite(c) for c in x):
            ok[vec_id] = [math.floor(256 * c) for c in x]
    out = []
    for q in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5, every=50):
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % every == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.2, (300, 16)).astype("float32")
    base[40:140] = base[7]  # a crowd of equal vectors, among them queries
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 16), (450, [float("inf")] * 16), (None, [1.0] * 16),
             (500, [0.5] * 5), (550, []), (600, [0.0] * 16), (650, [-1.0] * 16)]
    rows += rows[:3]  # repeated rows
    assert run(spark, rows) == brute(rows, 5, 50)


def test_small_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    assert run(spark, rows) == brute(rows, 5, 50)
    equal = [(i, [0.25, 0.5]) for i in range(120)]
    assert run(spark, equal) == brute(equal, 5, 50)


def test_large_components(spark):
    rows = [(i, [float(2 ** 20) * (i % 7 - 3), float(i)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 5, 50)


def test_blocks_of_queries_are_not_broadcast(spark, monkeypatch, plan):
    """The queries' side is repeated for every block of rows, so its files, which Spark's estimate follows, say little of its
    size: with many blocks it filled the driver. It is shuffled however small the files are."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 3, raising=False)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0, raising=False)
    plans = []
    plain = topk.materialised
    monkeypatch.setattr(topk, "materialised", lambda df: plans.append(plan(df)) or plain(df))
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(0, 0.3, 6).astype("float32")]) for i in range(120)]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 3)
    text = "\n".join([*plans, plan(got)])
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 10)
    compared = [i for i, line in enumerate(text.splitlines()) if "MapInPandas" in line or "FlatMapCoGroupsInArrow" in line]
    assert compared and not any("Broadcast" in line for i in compared for line in text.splitlines()[i + 1:i + 4])
