import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import forest, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 3)), 1)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=1500) * 0.3 > 0).astype(int) + (x[:, 2] > 1)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(1500)]
    return spark.createDataFrame(rows, "sample_id long, label int, a double, b double, c double").repartition(4).cache()


def predicted(df, recipe):
    model = models.fit(df, FEATURES, recipe)
    rows = models.predict(model, df, FEATURES).orderBy("sample_id").collect()
    return model, [(r.sample_id, int(r.prediction), r.label) for r in rows]


def plain_tree(x, y, w, classes, depth):
    """One CART tree over all features, node by node: a function from rows to class shares."""
    counts = np.bincount(y, w, classes)
    best = (1e-9 * w.sum(), None, None)
    if depth and (counts > 0).sum() > 1:
        for f in range(x.shape[1]):
            for cut in range(32):
                left = x[:, f] <= cut
                a, b = np.bincount(y[left], w[left], classes), np.bincount(y[~left], w[~left], classes)
                if a.sum() and b.sum():
                    gain = (a ** 2).sum() / a.sum() + (b ** 2).sum() / b.sum() - (counts ** 2).sum() / counts.sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
    if best[1] is None:
        return lambda row: int(counts.argmax())
    left = x[:, best[1]] <= best[2]
    low, high = (plain_tree(x[s], y[s], w[s], classes, depth - 1) for s in (left, ~left))
    return lambda row: low(row) if row[best[1]] <= best[2] else high(row)


def test_one_tree_is_the_tree_of_plain_code(matrix):
    rng = np.random.default_rng(7)
    x, w = rng.integers(0, 32, (400, 4)).astype(np.uint8), rng.integers(1, 4, 400).astype(float)
    y = (x[:, 0] > 12).astype(np.int64) + (x[:, 1] > 20) * (rng.random(400) > 0.2)
    tree = forest._grow(x, y, w, 3, 4, 3, [1])
    plain = plain_tree(x, y, w, 3, 3)
    ends = forest._route(x, tree["feature"], tree["cut"], tree["child"])
    assert [int(c) for c in tree["stats"][ends].argmax(1)] == [plain(row) for row in x]


def test_the_forest_does_not_depend_on_partitions(matrix):
    recipe = models.random_forest(trees=8, depth=30)
    first, second = predicted(matrix, recipe)[1], predicted(matrix.repartition(13, "a"), recipe)[1]
    assert first == second and len(first) == 1500
    assert sum(p == label for _, p, label in first) > 1400


def test_large_nodes_are_split_before_their_rows_are_dealt_out(matrix, monkeypatch):
    monkeypatch.setattr(forest, "HELD", 200)
    monkeypatch.setattr(forest, "ROW_BLOCK", 400)
    monkeypatch.setattr(forest, "OPEN_BYTES", 8 * 2 * 32 * 3 * 3)  # three open nodes a pass
    model, rows = predicted(matrix, models.random_forest(trees=6, depth=30))
    assert (model.top.feature >= 0).sum() > 20
    held = model.grown.select("tree", "node").collect()
    assert len(held) == len(set(held)) and {r.tree for r in held} == set(range(6))
    assert len(rows) == 1500 and sum(p == label for _, p, label in rows) > 1400
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)


def test_copies_and_unseen_values(spark, matrix):
    copied = matrix.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(2.0)).withColumn("c", F.col("label").cast("double"))
    model, rows = predicted(copied, models.random_forest(trees=40, depth=3))
    assert all(p == label for _, p, label in rows)
    other = spark.createDataFrame([(1, 0, 9.0, None, 99.0), (2, 0, float("nan"), 2.0, -5.0)], matrix.schema)
    assert sorted(r.prediction for r in models.predict(model, other, FEATURES).collect()) == [0.0, 2.0]


def test_labels_are_numbers_from_zero(matrix):
    for bad in (F.lit(None).cast("int"), F.lit(-1)):
        with pytest.raises(ValueError):
            models.fit(matrix.withColumn("label", F.when(F.col("sample_id") == 3, bad).otherwise(F.col("label"))), FEATURES, models.random_forest(3, 3))


def test_values_behind_a_crowded_one_get_thresholds_of_their_own():
    values = np.concatenate([np.zeros(600), np.arange(1.0, 401.0)])
    cuts = forest._cuts(values)
    assert len(cuts) == 31 and list(cuts[:5]) == [0.5, 1.5, 2.5, 3.5, 4.5]
    assert list(forest._cuts(np.array([3.0, 1.0, 1.0, 2.0]))) == [1.5, 2.5]
