"""Random forests grown on binned rows: trees side by side, large nodes by histograms, the rest of a tree in one group.

Spark's own forest sends full histograms of every open node from every partition, 20 KB a node for ten classes, however
few rows the node has. Trees grown to depth 30 are mostly such nodes. Here a feature is cut into at most 32 bins, rows
with the same bins and label become one cell with a count, and

* nodes with more than ``HELD`` rows are split level by level: one pass adds up histograms of all trees' large nodes;
* the cells of every other node are dealt out to a group of its own, which grows the rest of the tree there.

No group holds more than ``HELD`` cells and the driver holds only the splits of large nodes. The forest is the usual one:
Poisson bootstrap per tree (of single rows: a cell of n rows draws with mean n, seeded by its content), Gini impurity, a
new subset of features per node, sibling leaves with the same class merged, class shares of the leaves added up. Results
do not depend on how the rows are partitioned.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.session import materialised

BINS = 32
HELD = 100_000  # cells that one group grows a subtree of
DEALT = 2000  # cells whose draws by all trees a task holds
OPEN_BYTES = 64_000_000  # histograms that a task holds in one pass
GRID = 4096  # quantiles of a feature that its bins are made from
TREE_BLOCKS, ROW_BLOCK = 30, 250_000  # a task of a prediction: one block of trees over one block of rows
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.append(1.0, np.arange(1.0, 20.0))))


def _cuts(values: np.ndarray) -> np.ndarray:
    """At most 31 thresholds halfway between values, as Spark's trees choose them: each as near as can be to its share of the
    rows; behind a value with many rows the next values get the thresholds it took the place of."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(found) <= BINS:
        return between
    stride, out, before = len(values) / BINS, [], int(counts[0])
    for i in range(1, len(found)):
        if abs(before - stride * (len(out) + 1)) < abs(before + counts[i] - stride * (len(out) + 1)):
            out.append(between[i - 1])
        before += int(counts[i])
    return np.array(out[:BINS - 1])


def _binned(df: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``df`` with ``_bins``: a byte per feature of the vector ``features``."""
    @F.pandas_udf("binary")
    def bins(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, len(cuts)))
        out = np.stack([np.searchsorted(c, x[:, i]).astype(np.uint8) for i, c in enumerate(cuts)], axis=1)
        return pd.Series([line.tobytes() for line in out], index=vectors.index, dtype=object)
    return df.withColumn("_bins", bins(vector_to_array("features")))


def _weights(seeds: np.ndarray, counts: np.ndarray, trees: int) -> np.ndarray:
    """How often each tree draws each cell, (trees, cells)."""
    with np.errstate(over="ignore"):
        z = seeds.astype(np.uint64)[None, :] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, trees + 1, dtype=np.uint64)[:, None]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    out = np.searchsorted(_POISSON, (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0 ** 64)
    for i in np.flatnonzero(counts > 1):
        out[:, i] = np.random.default_rng(int(seeds[i]) & (2 ** 63 - 1)).poisson(counts[i], trees)
    return out


def _best(hist: np.ndarray, node: np.ndarray, place: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node the largest decrease of impurity times rows, and its bin, from counts (lines, classes) of (node, bin) in
    that order; every node has a line."""
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    left = np.cumsum(hist, axis=0)
    left -= (left[first] - hist[first])[node]
    right = total[node] - left
    a, b = left.sum(1), right.sum(1)
    gain = np.where((a > 0) & (b > 0), (left ** 2).sum(1) / np.maximum(a, 1) + (right ** 2).sum(1) / np.maximum(b, 1), 0.0)
    best = np.maximum.reduceat(gain, first)
    lines = np.flatnonzero(gain == best[node])
    at = lines[np.unique(node[lines], return_index=True)[1]]
    return best - (total ** 2).sum(1) / np.maximum(total.sum(1), 1), place[at]


def _subsets(rng: np.random.Generator, nodes: int, p: int, m: int) -> np.ndarray:
    return np.argsort(rng.random((nodes, p)), axis=1)[:, :m]


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, m: int, depth: int, seed: list[int]) -> dict[str, np.ndarray]:
    """A tree over cells (bins, class, weight), all nodes of a level at once: feature (-1 in leaves), cut, left child (the
    right one follows it), class counts and gain of every node."""
    rng, node = np.random.default_rng(seed), np.zeros(len(y), np.int64)
    feature, cut, child, gains = ([np.array([v])] for v in (-1, 0, 0, 0.0))
    stats = [np.bincount(y, w, classes)[None, :]]
    start, size = 0, 1
    for _ in range(depth):
        total = stats[-1]
        splittable = (total > 0).sum(1) > 1
        kept = splittable[node]
        x, y, w, node = x[kept], y[kept], w[kept], node[kept]
        if not len(y):
            break
        ids = np.flatnonzero(splittable)
        node = (np.cumsum(splittable) - 1)[node]
        k, total = len(ids), total[ids]
        chosen = _subsets(rng, k, x.shape[1], m)
        best, which, where = np.full(k, 0.0), np.full(k, -1), np.zeros(k, np.int64)
        for j in range(m):
            key = node * BINS + x[np.arange(len(y)), chosen[node, j]]
            if k * BINS <= len(y):
                lines = np.arange(k * BINS)
            else:
                lines, key = np.unique(key, return_inverse=True)
            hist = np.bincount(key * classes + y, w, len(lines) * classes).reshape(-1, classes)
            gain, place = _best(hist, lines // BINS, lines % BINS, total)
            better = gain > np.maximum(best, 1e-9 * total.sum(1))
            best, which, where = np.where(better, gain, best), np.where(better, chosen[:, j], which), np.where(better, place, where)
        split = which >= 0
        places = np.cumsum(split) - 1
        children = start + size + 2 * places
        feature[-1][ids], cut[-1][ids], child[-1][ids], gains[-1][ids] = which, where, np.where(split, children, 0), best
        kept = split[node]
        x, y, w, node = x[kept], y[kept], w[kept], node[kept]
        if not len(y):
            break
        node = 2 * places[node] + (x[np.arange(len(y)), which[node]] > where[node])
        start, size = start + size, 2 * int(split.sum())
        stats.append(np.bincount(node * classes + y, w, size * classes).reshape(-1, classes))
        for part, value in ((feature, -1), (cut, 0), (child, 0), (gains, 0.0)):
            part.append(np.full(size, value))
    tree = {"feature": np.concatenate(feature), "cut": np.concatenate(cut), "child": np.concatenate(child),
            "stats": np.concatenate(stats), "gain": np.concatenate(gains)}
    named = tree["stats"].argmax(1)
    for level in reversed(np.split(np.arange(len(named)), np.cumsum([len(f) for f in feature])[:-1])):
        inner = level[tree["feature"][level] >= 0]
        a = tree["child"][inner]
        same = (tree["feature"][a] < 0) & (tree["feature"][a + 1] < 0) & (named[a] == named[a + 1])
        tree["feature"][inner[same]], tree["gain"][inner[same]] = -1, 0.0
    return tree


def _packed(tree: dict[str, np.ndarray]) -> tuple[bytes, bytes, bytes, bytes]:
    """The nodes that are left: features, cuts, left children, class counts of the leaves (a leaf's child is its line)."""
    feature, child = tree["feature"], tree["child"]
    alive, level = np.zeros(len(feature), bool), np.array([0])
    while len(level):
        alive[level] = True
        a = child[level[feature[level] >= 0]]
        level = np.concatenate([a, a + 1])
    place, leaf = np.cumsum(alive) - 1, alive & (feature < 0)
    goes = np.where(leaf, np.cumsum(leaf) - 1, place[child])[alive]
    return (feature[alive].astype(np.int16).tobytes(), tree["cut"][alive].astype(np.uint8).tobytes(),
            goes.astype(np.int32).tobytes(), tree["stats"][leaf].astype(np.float32).tobytes())


def _route(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, start: int = 0) -> np.ndarray:
    """The node without a split that each row ends in."""
    node, moving = np.full(len(x), start, np.int64), np.arange(len(x))
    while len(moving):
        at = node[moving]
        inner = feature[at] >= 0
        moving, at = moving[inner], at[inner]
        node[moving] = child[at] + (x[moving, feature[at]] > cut[at])
    return node


@dataclass
class _Top:
    """Splits of the large nodes of all trees, node t being the root of tree t. ``stats`` holds the leaves among them."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    stats: dict[int, np.ndarray]

    def route(self, x: np.ndarray, tree: int) -> np.ndarray:
        return _route(x, self.feature, self.cut, self.child, tree)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``DEALT``: every piece is held once per tree."""
    for batch in batches:
        for start in range(0, batch.num_rows, DEALT):
            yield batch.slice(start, DEALT)


def _cells(batch: pa.RecordBatch, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([np.frombuffer(b, np.uint8) for b in batch.column("_bins").to_pylist()])
    n, seeds = np.asarray(batch.column("n")), np.asarray(batch.column("seed"))
    return x, np.asarray(batch.column("label")).astype(np.int64), _weights(seeds, n, trees)


def _splits(cells: DataFrame, top: _Top, open_: np.ndarray, chosen: np.ndarray, classes: int, trees: int) -> list:
    """(place among the open nodes, feature, cut, gain, left counts, right counts); feature -1 where no split gains."""
    m, width = chosen.shape[1], chosen.shape[1] * BINS * classes
    place = np.full(len(top.feature), -1)
    place[open_] = np.arange(len(open_))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(open_), width))
        for batch in _small(batches):
            x, y, weights = _cells(batch, trees)
            for t in range(trees):
                rows = np.flatnonzero(weights[t])
                at = place[top.route(x[rows], t)]
                rows, at = rows[at >= 0], at[at >= 0]
                if not len(rows):
                    continue
                used, near = np.unique(at, return_inverse=True)
                for j in range(m):
                    key = (near * BINS + x[rows, chosen[at, j]]) * classes + y[rows]
                    got = np.bincount(key, weights[t][rows], len(used) * BINS * classes)
                    hist[used, j * BINS * classes:(j + 1) * BINS * classes] += got.reshape(len(used), -1)
        used = np.flatnonzero(hist.any(1))
        for some in np.array_split(used, max(1, len(used) // 500)):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(
                [line.tobytes() for line in hist[some]], pa.binary())], ["node", "hist"])

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        hist = np.sum([np.frombuffer(b) for b in part["hist"]], axis=0).reshape(m, BINS, classes)
        total = hist[0].sum(0)
        found = (-1, 0, 1e-9 * total.sum(), total, total)
        for j in range(m):
            gain, cut = _best(hist[j], np.zeros(BINS, np.int64), np.arange(BINS), total[None, :])
            if gain[0] > found[2]:
                left = hist[j][:cut[0] + 1].sum(0)
                found = (int(chosen[key[0], j]), int(cut[0]), float(gain[0]), left, total - left)
        return pd.DataFrame([(key[0], *found)], columns=["node", "feature", "cut", "gain", "left", "right"])

    return cells.mapInArrow(partial, "node int, hist binary").groupBy("node").applyInPandas(
        choose, "node int, feature int, cut int, gain double, left array<double>, right array<double>").collect()


class Forest:
    """Estimator over ``features`` (vector) and ``label_index`` (0, 1, ...), with ``fit`` as in Spark ML."""

    def __init__(self, trees: int, depth: int, seed: int):
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, train: DataFrame) -> "ForestModel":
        x, y = vector_to_array("features"), F.col("label_index")
        size = train.agg(F.count("*").alias("n"), F.max("label_index").alias("top"), F.max(F.size(x)).alias("p"), F.count_if(
            F.isnull(y) | F.isnan(y) | (y < 0) | (y != F.floor(y))).alias("bad")).first()
        if not size["n"] or size["bad"]:
            raise ValueError("a forest needs training rows, and labels 0, 1, ... without NULL")
        p, classes, trees, seed = size["p"], int(size["top"]) + 1, self.trees, self.seed
        m = p if trees == 1 else int(np.ceil(np.sqrt(p)))
        shares = F.expr(f"array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))})")
        grid = train.select(F.posexplode(x).alias("feature", "x")).groupBy("feature").agg(
            F.percentile_approx("x", shares, 10_000).alias("values")).collect()  # one row per feature
        cuts = [_cuts(np.array(r["values"])) for r in sorted(grid)]
        label = y.cast("int").alias("label")
        cells = materialised(_binned(train, cuts).groupBy("_bins", label).agg(F.count("*").alias("n")).withColumn(
            "seed", F.xxhash64("_bins", "label")))

        top = _Top(np.full(trees, -1), np.zeros(trees, np.int64), np.zeros(trees, np.int64), np.zeros(trees, np.int64), {})
        importance = np.zeros((trees, p))
        tree_of = np.arange(trees)
        waiting = np.arange(trees if cells.count() > HELD else 0)
        per_pass = max(1, OPEN_BYTES // (8 * m * BINS * classes))
        while len(waiting):
            open_, waiting = waiting[:per_pass], waiting[per_pass:]
            chosen = np.concatenate([_subsets(np.random.default_rng([seed, 1, int(v)]), 1, p, m) for v in open_])
            large = []
            for r in sorted(_splits(cells, top, open_, chosen, classes, trees)):
                v = open_[r["node"]]
                if r["feature"] < 0:
                    top.stats[int(v)] = np.array(r["left"])
                    continue
                a = len(top.feature)
                top.feature[v], top.cut[v], top.child[v] = r["feature"], r["cut"], a
                importance[tree_of[v], r["feature"]] += r["gain"]
                below = top.depth[v] + 1
                for name, value in (("feature", -1), ("cut", 0), ("child", 0), ("depth", below)):
                    setattr(top, name, np.append(getattr(top, name), [value, value]))
                tree_of = np.append(tree_of, [tree_of[v]] * 2)
                for node, counts in ((a, np.array(r["left"])), (a + 1, np.array(r["right"]))):
                    if below >= self.depth or (counts > 0).sum() < 2:
                        top.stats[node] = counts
                    elif counts.sum() > HELD:
                        large.append(node)
            waiting = np.concatenate([waiting, np.array(large, np.int64)])
        return ForestModel(cuts, classes, trees, top, self._finished(cells, top, classes, m, p), importance)

    def _finished(self, cells: DataFrame, top: _Top, classes: int, m: int, p: int) -> DataFrame:
        trees, seed, depth = self.trees, self.seed, self.depth

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _small(batches):
                x, y, weights = _cells(batch, trees)
                out: list[tuple] = []
                for t in range(trees):
                    rows = np.flatnonzero(weights[t])
                    at = top.route(x[rows], t)
                    for v in np.unique(at):
                        if int(v) not in top.stats:
                            own = rows[at == v]
                            out.append((t, int(v), x[own].tobytes(), y[own].astype(np.int32).tobytes(),
                                        weights[t][own].astype(np.int32).tobytes()))
                for some in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(
                        zip(*out[some:some + 64]), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["tree", "node", "x", "y", "w"])

        def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(b"".join(part["x"]), np.uint8).reshape(-1, p)
            y, w = (np.frombuffer(b"".join(part[c]), np.int32).astype(np.int64) for c in ("y", "w"))
            tree = _grow(x, y, w.astype(float), classes, m, depth - int(top.depth[key[1]]), [seed, 2, int(key[1])])
            inner = tree["feature"] >= 0
            gains = np.bincount(tree["feature"][inner], tree["gain"][inner], p)
            return pd.DataFrame([(*key, *_packed(tree), gains.tolist())], columns=["tree", "node", "feature", "cut", "child", "stats", "gains"])

        parts = max(trees, cells.sparkSession.sparkContext.defaultParallelism)
        return materialised(
            cells.mapInArrow(deal, "tree int, node int, x binary, y binary, w binary").repartition(parts, "tree", "node").groupBy(
                "tree", "node").applyInPandas(grow, "tree int, node int, feature binary, cut binary, child binary, stats binary, gains array<double>"))


@dataclass
class ForestModel:
    cuts: list[np.ndarray]
    classes: int
    trees: int
    top: _Top
    grown: DataFrame
    top_gains: np.ndarray  # (trees, features)

    @property
    def featureImportances(self) -> SimpleNamespace:  # noqa: N802 - as in Spark ML
        """Decrease of impurity by feature: shares within a tree, averaged over the trees."""
        gains = self.top_gains.copy()
        added = F.array(*[F.sum(F.col("gains")[i]) for i in range(len(self.cuts))]).alias("gains")
        for r in self.grown.groupBy("tree").agg(added).collect():  # one row per tree
            gains[r["tree"]] += np.array(r["gains"])
        shares = (gains / np.maximum(gains.sum(1, keepdims=True), 1e-300)).sum(0)
        return SimpleNamespace(toArray=lambda: shares / max(shares.sum(), 1e-300))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``; rows with the same bins are predicted once."""
        p, classes, trees, top = len(self.cuts), self.classes, self.trees, self.top
        rows = _binned(df, self.cuts)
        asked = materialised(rows.select("_bins").distinct())
        blocks = max(1, -(-asked.count() // ROW_BLOCK))
        block = F.pmod(F.xxhash64("_bins"), F.lit(blocks)).cast("int").alias("block")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        groups = min(trees, TREE_BLOCKS)
        parts = min(groups * blocks * 2, 2000)
        queries = asked.select("_bins", block, every(groups).alias("group")).repartition(parts, "block", "group")
        forest = self.grown.drop("gains").withColumn("group", F.col("tree") % groups).select(
            "*", every(blocks).alias("block")).repartition(parts, "block", "group")

        def vote(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"_bins": [], "votes": []})
            x = np.frombuffer(b"".join(left["_bins"]), np.uint8).reshape(-1, p)
            votes = np.zeros((len(x), classes))
            ends = {t: top.route(x, t) for t in range(int(key[1]), trees, groups)}
            for at in ends.values():
                for v in np.unique(at):
                    if int(v) in top.stats:
                        votes[at == v] += top.stats[int(v)] / top.stats[int(v)].sum()
            for r in right.itertuples():
                own = np.flatnonzero(ends[r.tree] == r.node)
                feature, cut, child = (np.frombuffer(b, k) for b, k in ((r.feature, np.int16), (r.cut, np.uint8), (r.child, np.int32)))
                stats = np.frombuffer(r.stats, np.float32).reshape(-1, classes).astype(float)
                leaf = child[_route(x[own], feature, cut, child)]
                votes[own] += (stats / stats.sum(1, keepdims=True))[leaf]
            return pd.DataFrame({"_bins": left["_bins"], "votes": list(votes)})

        votes = queries.groupBy("block", "group").cogroup(forest.groupBy("block", "group")).applyInPandas(
            vote, "_bins binary, votes array<double>")
        summed = votes.groupBy("_bins").agg(*[F.sum(F.col("votes")[i]).alias(f"_{i}") for i in range(classes)])
        shares = F.transform(F.array(*[f"_{i}" for i in range(classes)]), lambda v: F.round(v, 9))
        found = summed.select("_bins", (F.array_position(shares, F.array_max(shares)) - 1).cast("double").alias("prediction"))
        return rows.join(found, "_bins").drop("_bins")
