import hashlib

import pytest
from pyspark.sql import functions as F

from inkprint.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("label"),
        (F.col("id") % 97).alias("group")).repartition(6).cache()


def expected_ranks(rows):
    by = {}
    for r in rows.collect():
        by.setdefault(r.label, []).append((hashlib.md5(f"42:{r.id}".encode()).hexdigest(), r.id))
    return {i: n for members in by.values() for n, (_, i) in enumerate(sorted(members), 1)}


def test_hash_rank_is_exact(rows):
    want = expected_ranks(rows)
    assert {r.id: r.hash_rank for r in sampling.hash_rank(rows, ["label"], "id").collect()} == want
    few = sampling.hash_rank(rows, ["label"], "id", limit=50).collect()
    assert {r.id: r.hash_rank for r in few} == {i: n for i, n in want.items() if n <= 50}


def test_balance_and_caps(rows):
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    balanced = {r.label: r["count"] for r in sampling.balance_classes(rows, "label", "id").groupBy("label").count().collect()}
    assert set(balanced.values()) == {min(sizes.values())} and set(balanced) == set(sizes)
    capped = {r.label: r["count"] for r in sampling.cap_per_class(rows, ["label"], "id", 400).groupBy("label").count().collect()}
    assert capped == {k: min(v, 400) for k, v in sizes.items()}
    assert sampling.simple_sample(rows, "id", 123).count() == 123


def test_stratified_folds_are_proportional(rows):
    folded = sampling.stratified_folds(rows, "label", "id", 5)
    assert folded.count() == 3000
    for r in folded.groupBy("label").agg(F.collect_list("fold").alias("folds")).collect():
        per = [r.folds.count(k) for k in range(5)]
        assert max(per) - min(per) <= 1


def test_group_folds_never_split_a_group(spark, rows):
    hashed = sampling.group_folds(rows, "group", 4)
    assert hashed.groupBy("group").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert hashed.count() == 3000 and hashed.select("fold").distinct().count() == 4
    assert sampling.group_folds(rows, "group").where("fold <> `group`").count() == 0
    assert sampling.group_folds(spark.range(5).withColumn("group", F.lit(1)), "group").count() == 0


def test_head_limits_before_the_shuffle(rows, plan):
    head = sampling.head_per_class(rows, ["label"], ["id"], 3)
    assert head.count() == 12
    assert "WindowGroupLimit" in plan(head)


def test_union_remembers_the_corpus(rows):
    union = sampling.union_corpora({"x": (rows, 10), "y": (rows.drop("group"), None)}, "label", "id")
    assert {r.corpus: r["count"] for r in union.groupBy("corpus").count().collect()} == {"x": 40, "y": 3000}


def test_null_ids_and_classes_are_kept(spark):
    df = spark.createDataFrame([("a", 0), ("b", None), (None, 1), (None, None), (None, 1)], "id string, label int")
    assert sampling.stratified_folds(df, "label", "id", 2).count() == 5
    assert sampling.cap_per_class(df, ["label"], "id", 10).count() == 5
    assert sampling.simple_sample(df, "id", 10).count() == 5 and sampling.simple_sample(df, "id", 3).count() == 3
    assert sampling.union_corpora({"x": (df, 10)}, "label", "id").count() == 5
    marked = sampling.mark_capped(df, ["label"], "id", 1)
    assert marked.count() == 5 and marked.where("in_fit").count() == 3
