"""Classifiers and evaluation protocols on Spark ML.

A recipe is a function from (number of training rows) to an unfitted estimator over ``features`` / ``label_index``.
"""

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.operators.forest import Forest
from inkprint.operators.metrics import classification_metrics
from inkprint.operators.profile import zero_fill
from inkprint.operators.sampling import balance_classes
from inkprint.session import materialised

Recipe = Callable[[int], Estimator | Forest]
SEED = 42


def logreg(max_iter: int = 1000, c: float = 1.0) -> Recipe:
    """Standardised L2 logistic regression; ``c`` is the inverse penalty on the summed loss."""
    def build(n: int) -> Estimator:
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        model = LogisticRegression(
            featuresCol="scaled", labelCol="label_index", maxIter=max_iter, regParam=1.0 / (c * max(n, 1)),
            elasticNetParam=0.0, standardization=False)
        return Pipeline(stages=[scaler, model])
    return build


def random_forest(trees: int = 300, depth: int = 30) -> Recipe:
    """Depth 30 as Spark's forest has it at most; the reference protocol leaves it open, or uses 20 for many classes."""
    return lambda n: Forest(trees, depth, SEED)


def gbt(rounds: int = 200, depth: int = 5) -> Recipe:
    return lambda n: GBTClassifier(
        labelCol="label_index", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=SEED, checkpointInterval=10)


def assemble(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Vector column ``features`` (missing = 0) and double ``label_index``; the single feature columns go."""
    filled = zero_fill(df, features).withColumn("label_index", F.col(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled).drop(*features)


def fit(df: DataFrame, features: list[str], recipe: Recipe, label: str = "label"):
    train = assemble(df, features, label).select("features", "label_index")
    return recipe(train.count()).fit(train)


def predict(model, df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Rows with ``prediction`` (of the label's scale); metadata kept, vectors dropped."""
    scored = model.transform(assemble(df, features, label))
    return scored.drop("features", "scaled", "rawPrediction", "probability", "label_index")


def cv_predictions(df: DataFrame, features: list[str], recipe: Recipe, fold: str = "fold", label: str = "label",
                   parallelism: int = 4, in_fit: str | None = None) -> DataFrame:
    """Pooled out-of-fold predictions: every row is predicted by a model that saw none of its fold.

    Fits of different folds are independent and run side by side, each one a distributed Spark ML job; there is one per
    fold, so hash many groups into k folds first (``group_folds(df, group, k)``). ``in_fit`` names a boolean column that
    bounds the rows models are fit on; all rows are predicted. Rows with a NULL fold are a fold of their own. Without a
    training side (one fold, or no rows) there are no predictions. The vectors are written once, to shared storage."""
    data = materialised(assemble(df, features, label))
    usable = F.lit(True) if in_fit is None else F.coalesce(F.col(in_fit), F.lit(False))
    sizes = {r[fold]: r["n"] for r in data.groupBy(fold).agg(F.count_if(usable).alias("n")).collect()}
    total = sum(sizes.values())

    def one(value) -> DataFrame | None:
        rest = total - sizes[value]
        if rest == 0:
            return None
        own = F.col(fold).eqNullSafe(F.lit(value))
        return recipe(rest).fit(data.where(~own & usable)).transform(data.where(own))

    with ThreadPool(max(1, min(parallelism, len(sizes)))) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(one), sorted(sizes, key=lambda v: (v is not None, v)))
    drop = ["features", "scaled", "rawPrediction", "probability", "label_index"]
    parts = [p.drop(*drop) for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else data.drop(*drop).withColumn(
        "prediction", F.lit(None).cast("double")).limit(0)


def feature_importance(model, features: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance), largest first; one row per feature."""
    rows = [(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def cross_corpus_eval(trains: dict[str, DataFrame], tests: dict[str, DataFrame], feature_sets: dict[str, list[str]],
                      recipe: Recipe, label: str = "label", id_col: str = "sample_id", balanced: bool = False) -> DataFrame:
    """Train on each corpus, test on each other one, for each feature set: macro-F1 and accuracy per combination.

    Models are fit on every row of their corpus; only ``balanced`` cuts the larger classes to the size of the smallest.
    Every row of every test corpus is predicted. A training set is written once for all its fits."""
    results = []
    for train_name, train in trains.items():
        rows = materialised(balance_classes(train, label, id_col) if balanced else train)
        for set_name, features in feature_sets.items():
            model = fit(rows, features, recipe, label)
            for test_name, test in tests.items():
                results.append(predict(model, test, features, label).select(
                    F.lit(train_name).alias("train"), F.lit(test_name).alias("test"),
                    F.lit(set_name).alias("feature_set"), F.lit(len(features)).alias("n_features"),
                    label, "prediction"))
    keys = ["train", "test", "feature_set", "n_features"]
    pooled = reduce(DataFrame.unionByName, results)
    return classification_metrics(
        pooled.withColumn("prediction", F.col("prediction").cast("int")), keys, label).select(
        *keys, "n", "f1_macro", "accuracy")


def subset_lift(results: DataFrame, subset: str, full: str) -> DataFrame:
    """Gain in macro-F1 of one feature set over another, per (train, test)."""
    of = lambda name: F.max(F.when(F.col("feature_set") == name, F.col("f1_macro")))
    return results.groupBy("train", "test").agg((of(subset) - of(full)).alias("lift"))
