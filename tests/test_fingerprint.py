import itertools
import random

import numpy as np
import pytest

from inkprint.operators import fingerprint as fp
from inkprint.operators import metrics


def brute_linkage(d):
    """Mean pairwise distance between the members of clusters, recomputed from scratch at every merge."""
    k = len(d)
    clusters, merges = {i: [i] for i in range(k)}, []
    for step in range(k - 1):
        best = min(itertools.combinations(sorted(clusters), 2), key=lambda ab: np.mean([d[i, j] for i in clusters[ab[0]] for j in clusters[ab[1]]]))
        height = np.mean([d[i, j] for i in clusters[best[0]] for j in clusters[best[1]]])
        members = clusters.pop(best[0]) + clusters.pop(best[1])
        clusters[k + step] = members
        merges.append((*best, height, len(members)))
    return merges


def rates_of(spark, d, slices=None):
    """Confusion rates that stand for the distances ``d``; pairs at distance 1 are not listed."""
    rows = [(f"c{i:03d}", f"c{j:03d}", 1 - float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d)) if d[i, j] < 1]
    rows += [(f"c{i:03d}", f"c{i:03d}", 0.0) for i in range(len(d))]
    return spark.createDataFrame(rows, "true_class string, pred_class string, rate double")


def merges_of(df):
    return df.toPandas().sort_values("step")[["idx1", "idx2", "distance", "count"]].to_numpy()


@pytest.mark.parametrize("n, listed", [(17, 1.0), (24, 0.15), (9, 0.0), (2, 1.0)])
def test_linkage_matches_brute_force(spark, n, listed):
    """Full, sparse and empty pair tables: distances recomputed from scratch at every merge; ties at 1 go by first class."""
    rng = np.random.default_rng(n)
    d = np.where(rng.random((n, n)) < listed, rng.random((n, n)), 1.0)
    d = np.triu(d, 1) + np.triu(d, 1).T
    got, want = merges_of(fp.average_linkage(rates_of(spark, d))), np.array(brute_linkage(d))
    below = want[:, 2] < 1 - 1e-12
    assert np.allclose(got[below], want[below]) and len(got) == n - 1
    assert np.allclose(got[:, 2:3], want[:, 2:3]) and got[-1, 3] == n
    clusters = {i: {i} for i in range(n)}
    for step, (a, b, distance, count) in enumerate(got):  # the rest joins whole clusters, each once
        members = clusters.pop(int(a)) | clusters.pop(int(b))
        assert len(members) == count
        clusters[n + step] = members


def test_rounds_work_on_all_slices_at_once(spark, monkeypatch):
    """Eight pairs of close classes in each of three slices, one without a name: two rounds merge what is listed."""
    rounds = []
    plain = fp._merge_round
    monkeypatch.setattr(fp, "_merge_round", lambda pairs, step: rounds.append(step) or plain(pairs, step))
    rows = [(s, f"a{i}", f"b{i}", 0.5) for s in ("x", "y", None) for i in range(8)]
    merged = fp.average_linkage(spark.createDataFrame(rows, "s string, true_class string, pred_class string, rate double"), ["s"])
    table = merged.toPandas()
    assert len(table) == 45 and sorted(table["s"].fillna("-").unique()) == ["-", "x", "y"] and len(rounds) == 1
    for _, part in table.groupby(table["s"].fillna("-")):
        assert part.sort_values("step")["distance"].tolist() == [0.5] * 8 + [1.0] * 7
        assert part.sort_values("step")["count"].tolist() == [2.0] * 8 + [2.0 * k for k in range(2, 9)]
    assert fp.average_linkage(spark.createDataFrame([("a", "a", 0.0)], "true_class string, pred_class string, rate double")).count() == 0


def test_no_stage_of_linkage_gathers_a_slice(spark, plan, monkeypatch):
    pairs = spark.createDataFrame([("s", "a", "b", 0.5, 1, 1)], "_slice string, a string, b string, alike double, size_a long, size_b long")
    merges, left = fp._merge_round(pairs, 0)
    text = plan(left)
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text and "hashpartitioning(_slice#" not in "".join(
        line for line in text.splitlines() if ", a#" not in line and ", b#" not in line and "_old" not in line)


def test_numbers_without_gathering(spark):
    rows = [("x" if i % 3 else None, f"n{i:04d}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, name string, w long").repartition(5)
    got = {r["name"]: (r["place"], r["place_sum"]) for r in fp.numbered(df, ["k"], ["name"], "place", "w").collect()}
    for key in ("x", None):
        total = 0
        for place, (_, name, w) in enumerate(r for r in rows if r[0] == key):
            total += w
            assert got[name] == (place, total)


@pytest.fixture(scope="module")
def predicted(spark):
    rng = random.Random(1)
    rows = [(s, f"c{i % 6}", f"c{i % 6}" if rng.random() < 0.5 else f"c{rng.randint(0, 5)}") for s in ("x", "y") for i in range(600)]
    return spark.createDataFrame(rows, "slice string, label string, prediction string").cache()


def test_rates_distances_and_linkage(predicted):
    rates = fp.confusion_rates(predicted, ["slice"])
    data = predicted.toPandas()
    for r in rates.collect():
        part = data[(data.slice == r.slice) & (data.label == r.true_class)]
        hits = (part.prediction == r.pred_class).sum()
        assert r.n == hits and r.rate == (0 if r.true_class == r.pred_class else hits / len(part))
    held = {(r.slice, r.true_class, r.pred_class): r.rate for r in rates.collect()}
    for r in fp.class_distance(rates, ["slice"]).collect():
        assert r.distance == 1 - max(held.get((r.slice, r.class_i, r.class_j), 0), held.get((r.slice, r.class_j, r.class_i), 0))
    merged = fp.average_linkage(rates, ["slice"]).toPandas()
    for name, part in merged.groupby("slice"):
        d = np.ones((6, 6))
        for i in range(6):
            for j in range(6):
                d[i, j] = 0 if i == j else 1 - max(held.get((name, f"c{i}", f"c{j}"), 0), held.get((name, f"c{j}", f"c{i}"), 0))
        assert np.allclose(part.sort_values("step")[["idx1", "idx2", "distance", "count"]].to_numpy(), brute_linkage(d))


def test_pairs_and_nearest(spark):
    rows = [("a", "b", 30, 0.3), ("b", "a", 10, 0.1), ("b", "c", 1, 0.01), ("a", "a", 70, 0.0), ("c", "b", 20, 0.2)]
    rates = spark.createDataFrame(rows, "true_class string, pred_class string, n long, rate double")
    assert [(r.true_class, r.pred_class) for r in fp.confused_pairs(rates, 2).collect()] == [("a", "b"), ("c", "b")]
    assert fp.confused_pairs(rates).count() == 3
    near = {r["class"]: (r.nearest, round(r.distance, 9)) for r in fp.nearest_class(fp.class_distance(rates)).collect()}
    assert near == {"a": ("b", 0.7), "b": ("a", 0.7), "c": ("b", 0.8)}
    assert {r.true_class: r.b for r in fp.confusion_matrix(rates, ["a", "b", "c"]).collect()} == {"a": 0.3, "b": 0.0, "c": 0.2}


def test_metrics_by_hand(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, 0)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert (report["0"].precision, report["0"].recall) == (5 / 8, 5 / 6)
    assert (report["2"].precision, report["2"].recall, report["2"].f1) == (0, 0, 0)
    m = metrics.classification_metrics(df).first()
    f = [2 * 5 / (6 + 8), 2 * 2 / (4 + 3), 0]
    assert m.accuracy == 7 / 11 and m.f1_macro == pytest.approx(sum(f) / 3)
    assert m.f1_weighted == pytest.approx((f[0] * 6 + f[1] * 4) / 11)


def test_best_model_prefers_the_first_name_on_ties(spark):
    df = spark.createDataFrame([("rf", 0.9), ("gbt", 0.9), ("lr", 0.5)], "model string, f1_macro double")
    assert metrics.best_model(df).first().best == "gbt"


def test_classes(spark):
    df = fp.derive_class(spark.createDataFrame([("m2",), (None,), ("m1",)], "generator string"))
    assert {r["class"]: r.class_index for r in fp.index_classes(df).collect()} == {"human": 0, "m1": 1, "m2": 2}
