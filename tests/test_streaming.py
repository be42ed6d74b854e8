import shutil

from pyspark.sql import functions as F

from inkprint.functions.lexical import lexical_features
from inkprint.functions.syntax import syntax_features
from inkprint.operators.baseline import fit_baseline, hbd_score
from inkprint.streaming.incremental import append_batch, append_once, appended, incremental_features, resume
from registry.fixtures import code_samples


def test_new_files_are_processed_once_and_equal_the_batch(spark, sf_dir, tmp_path):
    samples = code_samples(spark, sf_dir)
    fitted = fit_baseline(lexical_features(samples))
    transform = lambda df: hbd_score(syntax_features(lexical_features(df)).drop("code"), fitted)
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        incremental_features(spark, source, samples.schema, transform, out, progress, files_per_batch=1).awaitTermination()
        return spark.read.parquet(out)

    samples.where("doc_id < 60").repartition(2).write.mode("append").parquet(source)
    assert run().count() == samples.where("doc_id < 60").count()
    samples.where("doc_id >= 60").write.mode("append").parquet(source)
    final = run()
    assert run().count() == samples.count()
    batch = transform(samples)
    assert final.select(*batch.columns).exceptAll(batch).count() == 0 and batch.exceptAll(final.select(*batch.columns)).count() == 0


SAMPLES = "sample_id long, part string, code string"


def test_a_sample_is_written_once_whatever_file_it_comes_in(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    transform = lambda df: df.withColumn("n_chars", F.length("code"))
    schema = SAMPLES + ", n_chars int"

    def run():
        append_once(spark, source, SAMPLES, transform, ["sample_id", "part"], out, progress, files_per_batch=1).awaitTermination()
        return appended(spark, out, schema)

    def arrive(rows):
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(source)

    assert appended(spark, out, schema).count() == 0
    arrive([(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (None, None, "n"), (None, "a", "m")])  # repeated within a file
    arrive([(2, "a", "y"), (3, "b", "zz"), (None, None, "n")])  # and in a second one
    first = run()
    want = {(1, "a"), (2, "a"), (3, "b"), (None, None), (None, "a")}
    assert sorted(first.select("sample_id", "part").collect(), key=str) == sorted(want, key=str)
    arrive([(3, "b", "other text"), (4, "b", "w")])  # and in a later run: the sample that was there first stays
    later = run()
    assert later.count() == 6 and later.where("sample_id = 3").first()["code"] == "zz"
    assert later.where("sample_id = 4").first()["n_chars"] == 1


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(i, "p", f"text {i}") for i in range(20)]
    df = spark.createDataFrame(rows, SAMPLES)
    half = df.where("sample_id < 12")
    append_batch(half, 0, lambda x: x, ["sample_id"], out)
    # the next batch fails after it wrote its data and keys, before its commit
    append_batch(df, 1, lambda x: x, ["sample_id"], out)
    shutil.rmtree(f"{out}/commits/batch=1")
    assert appended(spark, out, SAMPLES).count() == 12
    for _ in range(2):  # it is run again, and once more by mistake
        append_batch(df, 1, lambda x: x, ["sample_id"], out)
        got = appended(spark, out, SAMPLES)
        assert got.count() == 20 and got.select("sample_id").distinct().count() == 20
    append_batch(half, 0, lambda x: x, ["sample_id"], out)
    assert appended(spark, out, SAMPLES).count() == 20


def test_the_smallest_row_of_a_key_stays_however_the_batch_is_dealt(spark, tmp_path):
    rows = [(i % 5, "p", f"text {i}") for i in range(50)]
    kept = []
    for n in (1, 7):
        out = str(tmp_path / f"out{n}")
        append_batch(spark.createDataFrame(rows, SAMPLES).repartition(n), 0, lambda x: x, ["sample_id"], out)
        kept.append(sorted(tuple(r) for r in appended(spark, out, SAMPLES).collect()))
    assert kept[0] == kept[1] and len(kept[0]) == 5


def test_resume_goes_on_at_the_offset_of_every_class(spark):
    planned = spark.createDataFrame([(i, i % 2 if i < 90 else None, f"c{i}") for i in range(100)], "sample_id long, label int, code string")
    whole = resume(planned, planned.limit(0), ["label"], "sample_id", 20).collect()
    of = lambda label, found: [r["sample_id"] for r in sorted(found, key=lambda r: r["position"]) if r["label"] == label]
    assert [len(of(x, whole)) for x in (0, 1, None)] == [20, 20, 10]
    done = spark.createDataFrame([(i, 0) for i in of(0, whole)[:20]] + [(i, 1) for i in of(1, whole)[:7]], "sample_id long, label int")
    rest = resume(planned, done, ["label"], "sample_id", 20).collect()
    assert of(0, rest) == [] and of(1, rest) == of(1, whole)[7:] and of(None, rest) == of(None, whole)
