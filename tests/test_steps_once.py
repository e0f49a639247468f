"""Costly steps that must not be done over: patterns, JSON, text shuffles, files moved."""

import glob
import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from faultline import session
from faultline.operators import retrieval, rules, scoring
from faultline.sources.logs import read_incident_files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_run_where_a_required_string_is_held(spark):
    texts = ["panic: x", "PANIC: y", "DI\u017fK QUOTA EXCEEDED", "\u212aILLED PROCE\u017f\u017f", "nothing", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "representative_log string").coalesce(1)
    ruled = rules.with_rule(rows)
    plain = rows.select("*", rules.rule_position(F.col("representative_log"), rules.standard_rules()).alias("at"))
    names = [r[1] for r in rules.standard_rules()]
    want = {r[0]: None if r.at is None else names[r.at] for r in plain.collect()}
    assert {r.representative_log: r.rule_name for r in ruled.collect()} == want
    assert want["PANIC: y"] == "go_panic" and want["DI\u017fK QUOTA EXCEEDED"] == "disk_full"
    assert "contains(rule_text" in plan(ruled).lower()


def test_an_answer_is_read_as_json_once(spark):
    told = spark.createDataFrame([('{"severity": "P0_CRITICAL", "reason": "r", "action": "a"}',)], "content string")
    told = told.withColumn("error", F.lit(None).cast("string"))
    judged = scoring.with_verdict(told)
    assert judged.first().severity == "P0_CRITICAL"
    assert plan(judged).lower().count("from_json(") + plan(judged).lower().count("jsontostructs(") <= 1


def test_texts_of_found_files_do_not_meet_the_tree(spark):
    asked = spark.createDataFrame([("v1", "a", 1), ("v1", "b", 1), ("v1", "c", 1), ("v1", "n", 1)], "ref string, file_path string, center int")
    files = spark.createDataFrame([("v1", "a", "own a", "sha"), ("v1", "n", None, "sha")], "ref string, file_path string, text string, commit_sha string")
    tree = spark.createDataFrame([("a", "tree a"), ("a", "tree a"), ("b", "tree b"), ("n", "tree n"), ("z", "z")], "file_path string, text string")
    cut = retrieval.cut_snippets(asked, files, 3, tree)
    got = sorted((r.file_path, r.window[0], r.commit_sha) for r in cut.collect())
    assert got == [("a", "own a", "sha"), ("a", "own a", "sha"), ("b", "tree b", "sha"), ("n", "tree n", "sha")]
    assert "Union" in plan(cut) and "LeftOuter" not in plan(cut)


def test_text_files_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([(7, "one\ntwo"), (8, "three")], "part long, value string")
    session.write_texts(rows, f"{tmp_path}/files", "part")
    assert sorted(glob.glob(f"{tmp_path}/files/part=*"))[0].endswith("part=7")
    read = read_incident_files(spark, f"{tmp_path}/files", recursiveFileLookup=True)
    assert sorted(r.raw_log for r in read.collect()) == ["one\ntwo\n", "three\n"]


def test_text_files_are_those_of_sparks_writer_and_nothing_else(spark, tmp_path):
    names = [None, "", "a b", "x/y=z:%{[]}^'\"#*?\\\t\x7f", "ü", "a b"]
    rows = spark.createDataFrame([(n, f"{at}\r\n\u00e9") for at, n in enumerate(names)] + [("none", None)], "`p q` string, value string")
    rows.coalesce(1).write.partitionBy("p q").text(f"{tmp_path}/want")
    session.write_texts(rows.coalesce(1), f"{tmp_path}/got", "p q")

    def held(top):
        found = {}
        for folder, _, files in os.walk(f"{tmp_path}/{top}"):
            for file in files:
                with open(f"{folder}/{file}", "rb") as f:
                    found.setdefault(os.path.relpath(folder, f"{tmp_path}/{top}"), []).append((file, sorted(f.read().splitlines(True))))
        return found

    want, got = held("want"), held("got")
    texts = {folder: [text for file, text in files if file.startswith("part-") and file.endswith(".txt")] for folder, files in want.items()}
    assert {folder: [text for _, text in files] for folder, files in got.items()} == {f: t for f, t in texts.items() if f != "."}
    # Sums of the files' bytes lie beside those that Hadoop writes, with a process of the system for each file that it makes.
    assert [file for files in got.values() for file, _ in files] == ["part-00000.txt"] * len(got)
    read = {r.raw_log for r in read_incident_files(spark, f"{tmp_path}/got", plain=True, recursiveFileLookup=True).collect()}
    assert read == {r.raw_log for r in read_incident_files(spark, f"{tmp_path}/want", recursiveFileLookup=True).collect()}


def test_text_files_of_several_tasks(spark, tmp_path):
    rows = spark.range(0, 600, 1, 3).select((F.col("id") % 200).alias("part"), F.concat_ws("\n", "id", F.lit("x")).alias("value"))
    session.write_texts(rows, f"{tmp_path}/files", "part")
    read = read_incident_files(spark, f"{tmp_path}/files", plain=True, recursiveFileLookup=True)
    assert sorted(r.raw_log for r in read.collect()) == sorted(f"{i}\nx\n" for i in range(600))
    session.write_texts(rows.filter("false"), f"{tmp_path}/none", "part")
    assert read_incident_files(spark, f"{tmp_path}/none", recursiveFileLookup=True).count() == 0


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    most = session.LISTING_TASKS * spark.sparkContext.defaultParallelism
    for at in range(most + 50):
        (tmp_path / f"part={at}").mkdir()
        (tmp_path / f"part={at}" / "a.txt").write_text("x")
    group = f"listing-{uuid.uuid4().hex}"
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.sparkContext.setJobGroup(group, group)
    try:
        read = read_incident_files(spark, str(tmp_path), recursiveFileLookup=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    seen = spark.sparkContext.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= most
    assert spark.conf.get(setting) == before and read.count() == most + 50


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    most = session.READING_TASKS * spark.sparkContext.defaultParallelism
    held = spark.conf.get("spark.sql.files.openCostInBytes")
    for at in range(most + 20):
        (tmp_path / f"part={at}").mkdir()
        (tmp_path / f"part={at}" / "a.txt").write_text(f"{at}")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # one file for each task, as with thousands of files at 4 MB each
    try:
        for plain in (False, True):
            read = read_incident_files(spark, str(tmp_path), plain=plain, recursiveFileLookup=True)
            assert read.rdd.getNumPartitions() <= most
            rows = read.select("log_id", "raw_log", F.regexp_extract("_metadata.file_path", "/part=(\\d+)/", 1).alias("part")).collect()
            assert sorted(int(r.raw_log) for r in rows) == list(range(most + 20)) and all(r.raw_log == r.part for r in rows)
            assert len({r.log_id for r in rows}) == most + 20
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)


def test_text_files_written_again_by_a_task(spark, tmp_path, monkeypatch):
    class First:
        @staticmethod
        def get():
            return First

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(session, "TaskContext", First)
    batch = pa.RecordBatch.from_pydict({"name": ["7", "8"], "value": [b"one", b"two"]})
    for _ in range(2):
        assert [b.to_pydict() for b in session._text_files(str(tmp_path), "part")(iter([batch]))] == [{"files": [2]}]
        held = sorted((f, (tmp_path / f / "part-00003.txt").read_bytes()) for f in os.listdir(tmp_path))
        assert held == [("part=7", b"one\n"), ("part=8", b"two\n")]
        assert os.listdir(tmp_path / "part=7") == ["part-00003.txt"]
