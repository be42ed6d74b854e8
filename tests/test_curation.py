import html
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkprint.operators import curation
from inkprint.sources import corpus as io
from registry.queries import QUERIES


def test_blank_and_strip(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), (" \t\x1c ",), ("\x85x ",)], "code string")
    assert {r.code for r in curation.drop_blank(df).collect()} == {"\x85x ", "a"}
    bounded = curation.length_bounds(df, "code", 1, 1).collect()
    assert sorted(r.code for r in bounded) == ["a", "x"]


def test_language_filter(spark):
    df = spark.createDataFrame([("Python",), ("python",), ("Java",), (None,)], "language string")
    assert curation.language_filter(df).count() == 2
    assert curation.language_filter(df, "Python", case_sensitive=True).count() == 1


def test_provenance_rejects_unknown(spark):
    df = spark.createDataFrame([("2021-12-31",), ("2022-01-01",), (None,)], "d string").withColumn("d", F.to_date("d"))
    assert [str(r.d) for r in curation.provenance_cutoff(df, "d").collect()] == ["2021-12-31"]


def test_accepted_submissions(spark):
    rows = [(1, ("A",), "OK", "Python 3", 5), (2, ("A",), "OK", "PyPy", 5), (3, ("B",), "OK", "Python 2", 5),
            (4, ("A",), "WRONG", "Python 3", 5), (5, ("A",), "OK", "Python 3", 1669766400), (6, ("A",), "OK", "Python 3", None)]
    df = spark.createDataFrame(rows, "id int, problem struct<index:string>, verdict string, programmingLanguage string, creationTimeSeconds long")
    assert sorted(r.id for r in curation.accepted_submissions(df, "A").collect()) == [1, 6]


def test_dedup_keeps_the_first(spark, plan):
    df = spark.createDataFrame([("r", "p", 3), ("r", "p", 1), ("r", "q", 2)], "repo string, path string, rank int")
    kept = curation.candidate_dedup(df, ["repo", "path"], ["rank"])
    assert sorted((r.path, r["rank"]) for r in kept.collect()) == [("p", 1), ("q", 2)]
    assert "WindowGroupLimit" in plan(kept)


def test_problem_files(spark):
    problems = spark.createDataFrame([("1300B",), ("7a",)], "problem_id string")
    names = {(r.problem_id, r.file_name) for r in curation.problem_key_variants(problems).collect()}
    assert {n for p, n in names if p == "1300B"} == {"1300B.py", "1300b.py", "1300_B.py", "1300_b.py"}
    files = spark.createDataFrame([("1300_b.py", 1), ("7a.py", 2), ("8.py", 3)], "file_name string, n int")
    assert sorted((r.problem_id, r.n) for r in curation.match_problem_files(problems, files).collect()) == [("1300B", 1), ("7a", 2)]


def test_cap_counts_what_is_there_and_tries_only_the_first(spark):
    rows = [("p", i, i % 2 == 0) for i in range(20)] + [("q", i, True) for i in range(5)] + [("r", i, i > 8) for i in range(12)]
    df = spark.createDataFrame(rows, "problem_id string, pos int, good boolean")
    have = spark.createDataFrame([("q", 2)], "problem_id string, have long")
    kept = curation.cap_per_problem(df, "problem_id", ["pos"], have=have, usable=F.col("good"))
    assert sorted((r.problem_id, r.pos) for r in kept.collect()) == [("p", 0), ("p", 2), ("p", 4), ("q", 0)]


def test_html_source(spark):
    inner = " a &lt; b &amp;&amp; c &eacute; &#65; &#x42; &copy &amp;lt; &bogus; "
    pages = [f"<p><pre class='x' id=\"program-source-text\" data>{inner}\n</pre><pre id='program-source-text'>no</pre>",
             "<pre id='program-source-text'>x &lt; y &#39;z&#39;</pre>", "<pre>nothing</pre>", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, page string")
    got = {r.i: r.source for r in curation.extract_source_html(df, "page").collect()}
    assert got == {0: html.unescape(inner + "\n").strip(), 1: "x < y 'z'", 2: None, 3: None}


def test_keys_members_and_times(spark):
    df = spark.createDataFrame([("a/b:c", [("h",)], 1669766400), ("x", [], 0), ("y", None, 86399)],
                               "k string, members array<struct<handle:string>>, t long")
    rows = df.select(curation.safe_key(F.col("k")), curation.first_member(F.col("members")), curation.epoch_iso(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("a__b_c", "h", "2022-11-30T00:00:00+00:00"), ("x", "unknown", "1970-01-01T00:00:00+00:00"),
                                        ("y", "unknown", "1970-01-01T23:59:59+00:00")]


def test_pairing_is_linear_and_survives_a_crowded_problem(spark):
    human = spark.range(250_000).select(F.lit("hot").alias("problem_id"), F.col("id").alias("h")).unionByName(
        spark.createDataFrame([("p", 1), ("q", 2)], "problem_id string, h long"))
    ai = spark.createDataFrame([("hot", 9), ("hot", 4), ("p", 3), (None, 5)], "problem_id string, source_file long")
    paired = curation.pair_by_problem(human, ai, "problem_id", "source_file")
    got = {r.problem_id: tuple(r)[1:] for r in paired.groupBy("problem_id").agg(
        F.count("*"), F.min("n_ai"), F.max("first_ai"), F.max("n_human"), F.min("paired")).collect()}
    assert got == {"hot": (250_002, 2, 4, 250_000, True), "p": (2, 1, 3, 1, True), "q": (1, 0, None, 1, False), None: (1, 1, 5, 0, False)}


def test_json_records(spark, tmp_path):
    for name, record in (("b.json", {"id": "2", "problem_id": "7A", "label": "ai", "code": "x\ny", "model": "m"}),
                         ("a.json", {"id": "1", "problem_id": "7A", "label": "human", "code": "z", "problem": {"name": "N", "rating": 900, "tags": ["t"]}})):
        (tmp_path / name).write_text(json.dumps(record, indent=2))
    (tmp_path / "notes.txt").write_text("no record")
    rows = {r.source_file: r for r in io.scan_json_records(spark, str(tmp_path), io.PAIRED_SCHEMA).collect()}
    assert set(rows) == {"a.json", "b.json"}
    assert rows["b.json"].code == "x\ny" and rows["a.json"].problem.rating == 900 and rows["b.json"].author is None


ODD_RECORDS = [("a", 1, None), ("a", 1, None), ("\u00e9\U0001f600\n\t\"\\", 2, ["x", ""]), (None, None, None), ("", 0, [])]
RECORD = "code string, n long, tags array<string>"


def test_json_records_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame(ODD_RECORDS, RECORD)
    folders = io.write_json_records(df, f"file://{tmp_path}/out")
    (tmp_path / "out" / "left-by-a-failed-task").mkdir()
    (tmp_path / "out" / "left-by-a-failed-task" / "x.json").write_text('{"code": "twice"}')
    rows = io.scan_json_records(spark, folders, df.schema).collect()
    key = lambda row: repr(tuple(row)[:3])
    assert sorted(map(key, rows)) == sorted(repr(r) for r in ODD_RECORDS)
    assert len({r.source_file for r in rows}) == len(ODD_RECORDS) and all(r.source_file.endswith(".json") for r in rows)
    empty = io.write_json_records(df.limit(0), f"{tmp_path}/none")
    assert io.scan_json_records(spark, empty, df.schema).drop("source_file").schema == df.schema
    assert io.scan_json_records(spark, empty, df.schema).count() == 0


def test_json_records_of_a_store_that_is_not_mounted(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.records.link./in", f"file://{tmp_path}")
    df = spark.createDataFrame(ODD_RECORDS, RECORD)
    folders = io.write_json_records(df, "viewfs://records/in/out")
    rows = io.scan_json_records(spark, folders, df.schema).drop("source_file").collect()
    assert folders == ["viewfs://records/in/out"] and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, ODD_RECORDS))


def test_json_records_cost_no_process_and_no_task_each(spark, tmp_path):
    """All turns in one conversation: files come from all tasks, no process is started per file, no task reads a few."""
    started = lambda: next(int(line.split()[1]) for line in open("/proc/stat") if line.startswith("processes"))
    turns = spark.range(0, 3000, 1, 1).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                              F.lit("user").alias("role"), F.lit("text").alias("text"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, then = set(Path(shared).glob("inkprint-*")), started()
    result = QUERIES["scan_json_records"](spark, str(tmp_path))
    assert started() - then < 3000
    (folder,) = set(Path(shared).glob("inkprint-*")) - before
    names = [path.name.removeprefix("part-") for path in folder.rglob("*.json")]
    assert len(names) == 3000 and len({name.split("-")[0] for name in names}) > 1  # names begin with the task
    assert result.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism * 8
    assert result.agg(F.count("*"), F.countDistinct("turn"), F.min("kind")).first() == (3000, 3000, "turn")


def test_empty_directory_keeps_the_schema(spark, tmp_path):
    assert io.scan_shards(spark, str(tmp_path)).schema == io.SAMPLE_SCHEMA
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.scan_shards(spark, str(tmp_path / "absent"))


def test_shards_keep_the_columns_of_all(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "code string, label int").write.parquet(f"{tmp_path}/one/p1")
    spark.createDataFrame([("b", 0, "gen")], "code string, label int, generator string").write.parquet(f"{tmp_path}/one/p2")
    both = io.scan_shards(spark, f"{tmp_path}/one/*")
    assert set(both.columns) == {"code", "label", "generator"} and {r.generator for r in both.collect()} == {None, "gen"}


def test_epoch_after_2038_and_before_1970(spark):
    df = spark.createDataFrame([(2_147_483_648,), (4_102_444_800,), (-1,), (None,)], "t long")
    assert [r[0] for r in df.select(curation.epoch_iso(F.col("t"))).collect()] == [
        "2038-01-19T03:14:08+00:00", "2100-01-01T00:00:00+00:00", "1969-12-31T23:59:59+00:00", None]


def test_labels_and_routes(spark, tmp_path):
    df = spark.createDataFrame([("A", 0, "t"), ("A", 1, "t"), ("A", 5, "t"), ("B", 0, "t"), ("C", 2, "v")], "subtask string, Target_Label int, split string")
    named = io.normalize_label(df)
    assert named.columns == ["subtask", "label", "split"]
    io.write_routed(named, str(tmp_path / "out"))
    routes = spark.read.parquet(str(tmp_path / "out")).groupBy("route").count().collect()
    assert {r.route: r["count"] for r in routes} == {"human": 1, "ai": 3}
    assert [r.label_str for r in io.label_names(named, names=io.FAMILY_NAMES).orderBy("label").collect()] == ["human", "human", "deepseek", "qwen", "gemma"]
    assert [r.label_str for r in io.label_names(named).where("label = 5").collect()] == [None]


def test_shards_hold_at_most_the_limit(spark, tmp_path):
    io.write_sharded(spark.range(0, 2500, 1, 1), str(tmp_path / "s"), 1000)
    sizes = spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in sizes) == [500, 1000, 1000]


def test_done_work(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "k string")
    assert [r.k for r in io.skip_done(work, done, ["k"]).collect()] == ["c"]
    assert sorted(tuple(r) for r in io.still_needed(work, done, "k", 3).collect()) == [("b", 1, 2), ("c", 0, 3)]
