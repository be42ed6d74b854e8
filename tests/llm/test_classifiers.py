import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.llm import quality, toxicity
from inkprint.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
MODULES = {"quality": (quality, "op4_quality", "quality", 0.7), "toxicity": (toxicity, "op10_toxicity", "toxic", 0.3)}


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name", list(MODULES))
def test_held_out_accuracy(spark, name):
    _, query, label, cutoff = MODULES[name]
    rows = QUERIES[query](spark, SF).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cutoff)
    known = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    score, y, predicted = map(np.array, zip(*known))
    assert auc(score, y) > 0.85 and (predicted == y).mean() > 0.85


@pytest.mark.parametrize("name", list(MODULES))
def test_odd_rows(spark, name):
    module, _, label, _ = MODULES[name]
    texts = [None, "", "word", "x" * 200_000, "idiot " * 9, "A | B | C | D", "tie", "tie", "é 🙂 \t\n"]
    docs = spark.createDataFrame([(i if i else None, t, 0.5, True) for i, t in enumerate(texts)],
                                 "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None), (3, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.where("doc_id = 99"), labels.where(f"{label} = 1")):
        rows = module.classified(docs, known).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
        ties = {r.score for r in rows if r.doc_id in (6, 7)}
        assert len(ties) == 1
        assert module.kept(docs, known).columns == docs.columns
    assert module.classified(docs.where("doc_id = 99"), labels).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted(tuple(r) for r in quality.classified(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_non_negative_risk_recovers_a_mixture():
    rng = np.random.default_rng(1)
    draw = lambda n, m: np.hstack([rng.normal(m, 1, (n, 2)), rng.normal(0, 1, (n, quality.N_FEATURES - 2))])
    # enough rows for the risk estimate to be close: with a tenth of them the mixture is told apart less sharply
    unlabelled = np.vstack([draw(10_500, 2), draw(4_500, -2)])
    model = quality.fit_network(draw(6_000, 2), unlabelled, 0.7)
    assert model.score(draw(500, 2)).mean() > 0.9 and model.score(draw(500, -2)).mean() < 0.2


def test_pooling_reads_whole_texts():
    docs = [np.array(toxicity.buckets(f"a{i} b{i} c{i} {'vile' if i % 2 else 'fine'} d{i}".split())) for i in range(200)]
    model = toxicity.fit_network(docs, np.arange(200) % 2)
    words = model.words()
    far = " ".join(["plain"] * (toxicity.CHUNK + 500))
    assert model.judge(words(far + " vile " + far))[0] > model.judge(words(far + " fine " + far))[0] + 1
    at_border = " ".join(["plain"] * (toxicity.CHUNK - 1)) + " vile words"
    assert model.judge(words(at_border))[0] > model.judge(words(far))[0] + 1
    assert toxicity.LANGUAGES[model.judge(words("der Hund und die Katze"))[1] - 1] == "de"
    assert model.judge(words(""))[1] == 0


def test_thresholds_count_every_labelled_row_left(spark):
    texts = [("the and of to is " if i % 2 else "der die und das ist ") + ("vile " if i % 4 < 2 else "fine ") + "pad " * (1_500 if i % 5 == 0 else 3)
             for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(400)], "doc_id long, toxic int")
    model, fitted = toxicity.fit(docs, labels, 100)
    ids = {r.doc_id for r in fitted.collect()}
    left = [i for i in range(400) if i not in ids and zlib.crc32(str(i).encode()) % 4 != 2]
    assert 0 < len(ids) < 150 and any(i % 5 == 0 for i in ids)
    counts = toxicity.calibration_counts(toxicity.judged(docs, model, "j").select("doc_id", "j"), labels, fitted, "j")
    for k, language in enumerate(("de", "en")):
        own = counts[1 + toxicity.LANGUAGES.index(language)].sum(0)
        mine = [i for i in left if i % 2 == k]
        assert own.tolist() == [sum(i % 4 >= 2 for i in mine), sum(i % 4 < 2 for i in mine)]


def test_every_language_has_a_threshold_of_its_own():
    bins, unit, zero = 2 * toxicity.WIDEST * toxicity.FINEST + 1, toxicity.FINEST, toxicity.WIDEST * toxicity.FINEST
    counts = np.zeros((5, bins, 2))
    counts[1, zero - unit, 0], counts[1, zero, 1] = 900, 100  # English: toxic from 0
    counts[2, zero, 0], counts[2, zero + unit, 1] = 120, 12  # French: from 1, with few documents
    model = toxicity.Model(None, [], None, None, 0.0, [9.0] * 5)
    toxicity.calibrate(model, counts)
    assert -1 < model.thresholds[1] <= 0 < model.thresholds[2] <= 1 and model.thresholds[3] == model.thresholds[0]
