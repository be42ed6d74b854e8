import pytest

import corpus_pipeline
from inkprint.llm import near_dup, packing, quality, secret_scan, toxicity
from inkprint.llm.common import table
from inkprint.llm.queries import QUERIES
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """What every stage gets and returns, over the whole table."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir).cache()
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in made.collect()], made.columns))
        docs = made
    return {name: rest for name, *rest in out}


def test_stages_return_documents(steps):
    assert list(steps) == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    for name in list(steps)[:-1]:
        assert steps[name][2] == corpus_pipeline.COLUMNS


def test_classifiers_decide(spark, sf_dir, steps):
    labels = {r.doc_id: r for r in table(spark, sf_dir, "labels").collect()}
    before, after = ({r["doc_id"] for r in x} for x in steps["quality"][:2])
    good = {i for i in before if i in labels and labels[i].quality == 1}
    bad = {i for i in before if i in labels and labels[i].quality == 0}
    assert len(good & after) >= 0.9 * len(good) and len(bad & after) <= 0.5 * len(bad)
    scores = {r.doc_id: r.predicted for r in QUERIES["op4_quality"](spark, sf_dir).collect()}
    assert after == {i for i in before if scores[i] == 1}


def test_one_of_each_group_stays(steps):
    before, after, _ = steps["near_duplicates"]
    sets = {r["doc_id"]: near_dup.shingles(r["text"]) for r in before}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if near_dup.similar(sets[a], sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in after) == [i for i in ids if top(i) == i]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)


def test_secrets_are_masked(spark, steps):
    before, after, _ = steps["secrets"]
    old = {r["doc_id"]: r for r in before}
    assert len(before) == len(after)
    found = secret_scan.scan(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string"))
    with_secret = {r.doc_id for r in found.collect() if any(r[k] for k in secret_scan.KINDS)}
    for r in after:
        assert (r["text"] != old[r["doc_id"]]["text"]) == (r["doc_id"] in with_secret)
        assert r["n_chars"] == len(r["text"]) and "AKIA" not in r["text"]


def test_packing_takes_all_that_is_left(spark, steps):
    before, after, columns = steps["packing"]
    rows = spark.createDataFrame([tuple(r[c] for c in columns) for r in after], (
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")).collect()
    check(rows, {r["doc_id"]: r["text"] for r in before}, packing.SIZE)


def test_empty_and_odd_tables(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _id long, kept boolean"
    for rows in ([], [(None, None, None, None, None, 0.5, 1, True), (7, "", "en", "a", 0, None, 2, None),
                      (8, "tie words here " * 9, "en", "a", 135, None, 2, None), (8, "tie words here " * 9, "en", "a", 135, None, 2, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf_dir)
            made.collect()
            if name != "packing":
                assert made.columns == corpus_pipeline.COLUMNS
        kept = near_dup.kept(docs).collect()
        assert len(kept) == (3 if rows else 0)
        assert quality.kept(docs, table(spark, sf_dir, "labels")).columns == docs.columns
        assert toxicity.kept(docs, table(spark, sf_dir, "labels")).columns == docs.columns
