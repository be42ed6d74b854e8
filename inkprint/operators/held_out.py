"""Leave-one-group-out logistic regression for any number of groups, without a fit per group.

The model of a group is the standardised, L2-penalised regression of all rows outside the group. One fit over all rows
gives weights w. One aggregation at w gives every group's share of the sums that a Newton step reads, and *total minus
group* is the system of the rows outside it, standardisation included; the small systems are solved in parallel, group
by group. For a group that holds a small share of the rows this step ends so close to its optimum that what remains can
be bounded: the gradient there is at most max|s''| / 2 * d' M d, where d is the step, s the logistic function and M the
sum of |x| x x' over all rows. Groups with a row whose class that may still change go on together: one pass over the
rows is one Newton step of a whole block of models. The bound falls faster than the groups grow in number.

Samples are (group, label, features); groups may hold any share of the rows. What comes back to the driver is as large
as a block of models or the square of the features.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.operators.baseline import baseline_scaler
from inkprint.session import materialised, null_safe_join

BLOCK = 256  # models that go on together
HELD = 2000  # groups whose sums a task holds before it passes them on
CURVATURE = 1.0 / (6.0 * np.sqrt(3.0))  # the largest value of |s''|


def _clean(feature: str) -> Column:
    return F.coalesce(F.nanvl(F.col(f"`{feature}`").cast("double"), F.lit(0.0)), F.lit(0.0))


def _rows(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised features with a constant column, and labels."""
    x = (np.asarray(batch.column(2).flatten()).reshape(-1, len(mean)) - mean) / scale
    return np.hstack([x, np.ones((len(x), 1))]), np.asarray(batch.column(1), np.float64)


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * margin))


def _packed(square: np.ndarray) -> np.ndarray:
    return square[np.triu_indices(len(square))]


def _square(packed: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    out[np.triu_indices(q)] = packed
    return out + np.triu(out, 1).T


def _shares(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What some rows add: rows, rows of class 1, sums and sums of squares of the features, gradient, Hessian."""
    p = _logistic(x @ w)
    return np.concatenate([
        [len(y), y.sum()], x[:, :-1].sum(0), (x[:, :-1] ** 2).sum(0), x.T @ (p - y), _packed(x.T @ (x * (p * (1 - p))[:, None]))])


@dataclass(frozen=True)
class System:
    """The sums of a Newton step over some rows, taken apart."""

    n: float
    ones: float
    deviation: np.ndarray  # population standard deviations
    gradient: np.ndarray
    hessian: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, q: int) -> "System":
        n, ones, rest = sums[0], sums[1], sums[2:]
        first, second, gradient, packed = np.split(rest, [q - 1, 2 * (q - 1), 3 * q - 2])
        variance = second / max(n, 1) - (first / max(n, 1)) ** 2
        return cls(n, ones, np.sqrt(np.where(variance < 1e-12 * np.maximum(second / max(n, 1), 1e-300), 0.0, variance)),
                   gradient, _square(packed, q))

    def penalty(self, scale: np.ndarray, strength: float) -> np.ndarray:
        """Of the weights in the coordinates of the whole table: these rows' own standardisation gives every weight its
        deviation here as unit; a constant feature has the unit of its raw values."""
        return strength * np.append(np.where(self.deviation > 0, self.deviation, 1.0 / scale) ** 2, 0.0)


def _newton(hessian: np.ndarray, gradient: np.ndarray, penalty: np.ndarray, w: np.ndarray) -> np.ndarray:
    return -np.linalg.lstsq(hessian + np.diag(penalty), gradient + penalty * w, rcond=None)[0]


def _model_sums(rows: DataFrame, models: list[tuple[str | None, np.ndarray]], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Per model (key of the group left out or None, weights): loss, gradient and packed Hessian over the other rows. One
    pass for all models; every task adds up its rows, and a model's sums meet in one group of as many rows as tasks."""
    keys, weights = [k for k, _ in models], np.stack([w for _, w in models], axis=1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = len(weights), None
        for batch in batches:
            x, y = _rows(batch, mean, scale)
            own = np.array(batch.column(0).to_pylist(), object)[:, None] == np.array(keys, object)[None, :]
            margin = x @ weights
            p = _logistic(margin)
            loss = np.where(own, 0.0, np.logaddexp(0.0, margin) - y[:, None] * margin).sum(0)
            gradient = x.T @ np.where(own, 0.0, p - y[:, None])
            spread = np.where(own, 0.0, p * (1 - p))
            hessian = np.stack([_packed(x.T @ (x * spread[:, [m]])) for m in range(len(keys))], axis=1)
            sums = np.vstack([loss, gradient, hessian])
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(list(total.T), pa.list_(pa.float64()))], ["model", "sums"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [key[0]], "sums": [np.sum(np.stack(part["sums"]), axis=0)]})

    schema = "model int, sums array<double>"
    added = rows.mapInArrow(partial, schema).groupBy("model").applyInPandas(add, schema)
    q = len(weights)
    out = np.zeros((len(models), 1 + q + q * (q + 1) // 2))
    for r in added.collect():  # one row per model of the block
        out[r["model"]] = r["sums"]
    return out


def _descend(rows: DataFrame, models: dict[str | None, tuple[np.ndarray, np.ndarray]], mean: np.ndarray, scale: np.ndarray,
             tolerance: float, steps: int) -> dict[str | None, np.ndarray]:
    """Minimise the penalised losses of several models together from their starting weights: {key: (weights, penalty)} to
    {key: weights}. Each pass is one Newton step of all models still moving; a step that raises the loss is halved."""
    q, found = len(mean) + 1, {}
    moving = {k: (w, None, np.inf, penalty) for k, (w, penalty) in models.items()}
    for _ in range(steps):
        if not moving:
            break
        sums = _model_sums(rows, [(k, state[0]) for k, state in moving.items()], mean, scale)
        after = {}
        for (key, (w, last, least, penalty)), line in zip(moving.items(), sums):
            loss = line[0] + 0.5 * (penalty * w * w).sum()
            if last is not None and loss > least * (1 + 1e-12) + 1e-12:
                if np.abs(w - last).max() <= tolerance:
                    found[key] = last
                else:
                    after[key] = ((w + last) / 2, last, least, penalty)
                continue
            step = _newton(_square(line[1 + q:], q), line[1:1 + q], penalty, w)
            if np.abs(step).max() <= tolerance:
                found[key] = w + step
            else:
                after[key] = (w + step, w, loss, penalty)
        moving = after
    return {**found, **{k: state[0] for k, state in moving.items()}}


def _total(rows: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares of all rows at w, and the sum of |x| x x'."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, y = _rows(batch, mean, scale)
            cubic = x.T @ (x * np.sqrt((x ** 2).sum(1))[:, None])
            sums = np.concatenate([_shares(x, y, w), _packed(cubic)])
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    def add(part: pd.DataFrame) -> pd.DataFrame:  # as many rows as tasks
        return pd.DataFrame({"sums": [np.sum(np.stack(part["sums"]), axis=0)]})

    row = rows.mapInArrow(partial, "sums array<double>").groupBy().applyInPandas(add, "sums array<double>").first()
    q = len(w)
    sums = np.array(row["sums"])
    at = len(sums) - q * (q + 1) // 2
    return sums[:at], _square(sums[at:], q)


def _group_sums(rows: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """key, sums: each group's shares at w, added up within the tasks first."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        pack = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["key", "sums"])
        for batch in batches:
            x, y = _rows(batch, mean, scale)
            codes, names = pd.factorize(np.array(batch.column(0).to_pylist(), object))
            order = np.argsort(codes, kind="stable")
            for name, places in zip(names, np.split(order, np.cumsum(np.bincount(codes))[:-1])):
                sums = _shares(x[places], y[places], w)
                held[name] = held[name] + sums if name in held else sums
            if len(held) > HELD:
                yield pack()
                held = {}
        yield pack()
    return rows.mapInArrow(partial, "key string, sums array<double>")


_SOLVED = "key string, weights array<double>, penalty array<double>, constant int, settled boolean, ahead double"
_SOLVED_COLUMNS = ["key", "weights", "penalty", "constant", "settled", "ahead"]


def _one_step(sums: DataFrame, total: np.ndarray, cubic: np.ndarray, w: np.ndarray, scale: np.ndarray,
              strength: float, tolerance: float) -> DataFrame:
    """key, weights after one Newton step of total minus group, penalty, constant (the only class outside the group, if
    there is but one; -1 if there are no rows), settled (what further steps would change stays within the tolerance)."""
    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        q = len(w)
        rest = System.of(total - np.sum(np.stack(part["sums"]), axis=0), q)
        if rest.n < 0.5:
            return pd.DataFrame([(key[0], None, None, -1, True, 0.0)], columns=_SOLVED_COLUMNS)
        if rest.ones < 0.5 or rest.n - rest.ones < 0.5:
            return pd.DataFrame([(key[0], None, None, int(rest.ones > 0.5), True, 0.0)], columns=_SOLVED_COLUMNS)
        penalty = rest.penalty(scale, strength)
        step = _newton(rest.hessian, rest.gradient, penalty, w)
        least = np.linalg.eigvalsh(rest.hessian + np.diag(penalty))[0]
        ahead = CURVATURE / 2.0 * step @ cubic @ step / least if least > 0 else np.inf
        return pd.DataFrame([(key[0], w + step, penalty, None, bool(ahead <= tolerance), ahead)], columns=_SOLVED_COLUMNS)
    return sums.groupBy("key").applyInPandas(solve, _SOLVED)


def fit_all(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, strength: float, tolerance: float, steps: int = 50) -> np.ndarray:
    """Weights of the standardised features, then the intercept, fit on all ``rows`` (key, label 0 or 1, x)."""
    ridge = strength * np.append(np.ones(len(mean)), 0.0)
    return _descend(rows, {None: (np.zeros(len(mean) + 1), ridge)}, mean, scale, tolerance, steps)[None]


def _standardised(x: Column, mean: np.ndarray, scale: np.ndarray) -> Column:
    units = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, scale)])
    return F.zip_with(x, units, lambda x, u: (x - u["m"]) / u["s"])


def _margin(z: Column, weights: Column, features: int) -> Column:
    return F.aggregate(F.zip_with(z, F.slice(weights, 1, features), lambda a, b: a * b),
                       F.get(weights, F.lit(features)), lambda a, b: a + b)


def _doubtful(asked: DataFrame, open_: DataFrame, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Keys of the open groups with a row in ``asked`` (key, x) whose class what is ahead may still change."""
    z = _standardised(F.col("x"), mean, scale)
    length = F.sqrt(F.aggregate(z, F.lit(1.0), lambda total, a: total + a * a))
    margin = F.abs(_margin(z, F.col("weights"), len(mean)))
    certain = margin > 2.0 * F.col("ahead") * length + 1e-9
    return asked.join(open_.select("key", "weights", "ahead"), "key").where(~F.coalesce(certain, F.lit(False))).select("key").distinct()


def held_out_weights(rows: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, strength: float = 1.0,
                     tolerance: float = 1e-6, steps: int = 50, asked: DataFrame | None = None) -> DataFrame:
    """key, weights, constant (of the only class of the other rows; -1 without other rows): the model of the rows outside
    each group of ``rows``, from the weights ``w`` of all rows. With ``asked`` (key, x) only the classes of those rows are
    wanted: a group goes on only while one of its rows lies closer to the border than its weights may still move. That
    distance falls with the square of the number of rows, so few groups go on, however many there are."""
    total, cubic = _total(rows, w, mean, scale)
    solved = materialised(_one_step(_group_sums(rows, w, mean, scale), total, cubic, w, scale, strength, tolerance))
    open_ = solved.where("not settled")
    if asked is not None:
        doubtful = materialised(_doubtful(asked, open_, mean, scale))
        done = solved.join(doubtful, "key", "left_anti").select("key", "weights", "constant")
        open_ = open_.join(doubtful, "key", "left_semi")
    else:
        done = solved.where("settled").select("key", "weights", "constant")
    open_ = open_.select("key", "weights", "penalty")
    keys = materialised(open_.withColumn("_block", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-open_.count() // BLOCK) * 2)))))
    for block in [r["_block"] for r in keys.select("_block").distinct().collect()]:
        models = {r["key"]: (np.array(r["weights"]), np.array(r["penalty"])) for r in keys.where(F.col("_block") == block).collect()}
        found = _descend(rows, models, mean, scale, tolerance, steps)
        done = done.unionByName(rows.sparkSession.createDataFrame(
            [(k, v.tolist(), None) for k, v in found.items()], "key string, weights array<double>, constant int"))
    return done


def leave_one_group_out(df: DataFrame, features: list[str], group: str, label: str = "label", strength: float = 1.0,
                        tolerance: float = 1e-6) -> DataFrame:
    """``df`` with ``prediction`` (0 or 1): every row predicted by the logistic regression of the rows outside its group,
    equal to a refit per group. Features are standardised by those rows (population deviations, constant features by 1)
    and missing ones are 0; the penalty is ``strength`` / 2 times the squared weights beside the summed loss. NULL groups
    are one group. Rows whose label is not 0 or 1 are predicted but not fit on. Where the other rows hold one class, that
    class is predicted; without other rows (a single group) there is no prediction and the group's rows are left out."""
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("null"))
    table = materialised(df.withColumn("_key", key).withColumn("_x", F.array(*[_clean(f) for f in features])))
    labelled = table.where(F.col(label).isin(0, 1))
    rows = labelled.select(F.col("_key").alias("key"), F.col(label).cast("int").alias("label"), F.col("_x").alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    if not size["n"]:
        return table.drop("_key", "_x").withColumn("prediction", F.lit(None).cast("int")).limit(0)
    held = {r["feature"]: r for r in baseline_scaler(labelled, features).collect()}  # one row per feature
    mean, scale = (np.array([held[f][name] for f in features]) for name in ("mean", "scale"))
    mixed = 0 < size["ones"] < size["n"]
    w = fit_all(rows, mean, scale, strength, tolerance) if mixed else np.zeros(len(features) + 1)
    asked = table.select(F.col("_key").alias("key"), F.col("_x").alias("x"))
    models = held_out_weights(rows, w, mean, scale, strength, tolerance, asked=asked)
    models = models.select(F.col("key").alias("_key"), F.col("weights").alias("_weights"), F.col("constant").alias("_constant"))
    seen = null_safe_join(table, models, ["_key"], "left")

    # a group without labelled rows takes nothing away: the fit of all rows is its model
    weights = F.coalesce("_weights", F.array(*[F.lit(float(x)) for x in w]))
    margin = _margin(_standardised(F.col("_x"), mean, scale), weights, len(features))
    only = F.coalesce("_constant", F.lit(None if mixed else int(size["ones"] > 0)).cast("int"))
    predicted = F.coalesce(only, (margin > 0).cast("int"))
    return seen.withColumn("prediction", predicted).where(F.col("prediction") >= 0).drop("_key", "_x", "_weights", "_constant")
