"""Hard negatives against all pairs in plain Python; bounds and pruning by themselves."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkprint.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score int, aid int, rank int"


def brute(rows, every=50):
    ok = set()
    for vec_id, x, label in rows:
        if vec_id is not None and label is not None and x and all(c is not None and math.isfinite(c) for c in x):
            moved = (label + 1) % 10 if vec_id % 7 == 0 else label
            ok.add((vec_id, tuple(math.floor(256 * c) for c in x), moved))
    out = []
    for a, v, label in ok:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for i, w, other in ok if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and -50 * s <= -100 * r[0] <= -95 * s][:3]
            out += [(a, i, n, j, -s, -t) for n, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, every=50):
    df = spark.createDataFrame([(i, x, y, 1, 2, 3) for i, x, y in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hn.mine(df, F.col("vec_id") % every == 0, label)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def crowd():
    rng = np.random.default_rng(3)
    base = (rng.normal(0, 0.3, (10, 16))[rng.integers(0, 10, 400)] + rng.normal(0, 0.25, (400, 16))).astype("float32")
    base[60:200] = base[7]  # a third of the rows share one vector: ties in every range
    return [(i, [float(c) for c in v], int(rng.integers(0, 10))) for i, v in enumerate(base)]


@pytest.mark.parametrize("blocks", [(8192, 512, 1024), (64, 2, 16)])
def test_against_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "BLOCK_ANCHORS", "TILE"), blocks):
        monkeypatch.setattr(hn, name, value)
    rows = crowd() + [
        (400, None, 1), (450, [1.0, None], 1), (500, [float("nan")] * 16, 1), (550, [float("inf")] * 16, 2), (None, [1.0] * 16, 1),
        (600, [0.5] * 5, 3), (650, [], 3), (700, [0.0] * 16, 4), (750, [-1.0] * 16, 5), (800, [0.3] * 16, None)]
    rows += rows[:60]  # repeated rows
    want = brute(rows)
    assert len(want) > 40 and run(spark, rows) == want


def test_small_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [0.0], None), (50, None, 1)]) == []
    rows = [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 1), (2, [1.0, 0.5], 3), (3, [-1.0, 0.0], 1), (50, [0.0, 0.0], 3), (4, [0.0, 0.0], 2)]
    assert run(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(i, [float(2 ** 17) * (i % 7 - 3), float(i), 2.0 ** 15], i % 4) for i in range(120)]
    want = brute(rows)
    assert want and run(spark, rows) == want


vector = st.lists(st.integers(-500, 500), min_size=1, max_size=40)


@settings(max_examples=100, deadline=None)
@given(st.lists(vector, min_size=1, max_size=6), st.lists(vector, min_size=1, max_size=6))
def test_bounds_hold(a, b):
    width = max(map(len, a + b))
    x, y = (hn.Vectors(np.array([v + [0] * (width - len(v)) for v in rows])) for rows in (a, b))
    score, mine, theirs = x.values @ y.values.T, np.arange(len(a)), np.arange(len(b))
    for level in range(len(x.levels)):
        low, high = x.bounds(y, mine, theirs, level)
        assert (low <= score).all() and (score <= high).all()


def test_ranges_prune_before_exact_scores(monkeypatch):
    """On smooth vectors, whose segments say much, few pairs are left for exact scores, and none that counts is lost."""
    rng = np.random.default_rng(1)
    values = np.repeat(rng.integers(-60, 60, (600, 4)), 16, axis=1) + rng.integers(-4, 5, (600, 64))
    x = hn.Vectors(values)
    exact = x.values @ x.values.T
    cut = np.sort(exact, axis=1)[:, -5].astype(float)
    scored = []
    plain = hn.Vectors.exact
    monkeypatch.setattr(hn.Vectors, "exact", lambda s, o, m, t: scored.append(len(m) * len(t)) or plain(s, o, m, t))
    kept = 0
    for i in range(0, 600, 4):
        a = hn.Vectors(values[i:i + 4])
        mine, theirs, scores = hn.scores_within(a, x, np.ones((4, 600), bool), cut[i:i + 4], np.full(4, np.inf))
        for m, line in zip(mine, scores):
            found = theirs[line >= cut[i + m]]
            assert set(found) == set(np.flatnonzero(exact[i + m] >= cut[i + m]))
        kept += np.count_nonzero(scores > hn.NONE)
    assert kept < 0.1 * 600 * 600 and sum(scored) < 0.3 * 600 * 600
