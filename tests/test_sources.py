import json
import os
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import tuning
from faultline.session import drop_scratch, shared_folder, written
from faultline.sources.code import read_snapshot
from faultline.operators.stacktrace import frame_table, parse_logs
from faultline.sources.logs import logs_from_messages, read_incident_files, read_log_lines, read_numbered_lines
from faultline.sources.sft import read_sft_json
from faultline.sources.views import log_view


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"first \t\n\n   \nsec\xffond\r\n  third\xe3\x80\x80\n")
    (tmp_path / "b.log").write_bytes(b"other")
    df = read_log_lines(spark, str(tmp_path), "svc")
    assert sorted(r.raw_log for r in df.collect()) == ["  third", "first", "other", "sec�ond"]
    assert df.select("log_id").distinct().count() == 4 and {r.service_name for r in df.collect()} == {"svc"}


def test_messages(spark):
    message = json.dumps({"log_id": 7, "ts": "2024-01-02T03:04:05Z", "service_name": "s", "raw_log": "x\ny"})
    row = logs_from_messages(spark.createDataFrame([(bytearray(message.encode()),)], "value binary")).first()
    assert (row.log_id, row.service_name, row.raw_log) == (7, "s", "x\ny")


def test_incident_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n  at x\n")
    (tmp_path / "b.txt").write_text("two")
    assert sorted(r.raw_log for r in read_incident_files(spark, str(tmp_path)).collect()) == ["one\n  at x\n", "two"]


def test_snapshot(spark, tmp_path):
    (tmp_path / "src" / "a b").mkdir(parents=True)
    (tmp_path / "src" / "a b" / "x.py").write_text("1\n2\n")
    (tmp_path / "src" / "y.txt").write_text("no")
    rows = read_snapshot(spark, str(tmp_path / "src"), "v1", "abc", "*.py").collect()
    assert [tuple(r) for r in rows] == [("v1", "a b/x.py", "1\n2\n", "abc")]


def test_sft(spark, tmp_path):
    label = json.dumps({"severity": "P2_WARNING", "reason": "r"})
    rows = [{"instruction": "i", "input": "q\nq", "output": label}, {"instruction": "j", "input": "p", "output": "# text"}]
    (tmp_path / "d.json").write_text(json.dumps(rows, indent=1))
    sft = tuning.sft_rows(read_sft_json(spark, str(tmp_path)))
    assert sft.columns == ["prompt", "query", "response"]
    chat = tuning.sft_chat(sft.filter("prompt = 'i'")).first().messages
    assert [tuple(m) for m in chat] == [("user", "i\n\nq\nq"), ("assistant", label)]
    counts = {r.severity: r.n for r in tuning.label_distribution(sft).collect()}
    assert counts == {"P0_CRITICAL": 0, "P1_HIGH": 0, "P2_WARNING": 1, "P3_IGNORE": 0, "UNKNOWN": 1}
    assert tuning.capped(sft, 1, "prompt").first().prompt == "i" and tuning.capped(sft, None).count() == 2
    assert [r.over_cutoff for r in tuning.within_cutoff(sft, 6).orderBy("prompt").collect()] == [True, False]


def test_split_is_stable_and_near_its_share(spark):
    rows = spark.range(4000).withColumn("prompt", F.lit("x"))
    shares = [tuning.with_split(rows.repartition(n), 0.1, "id").filter("split = 'validation'") for n in (1, 7)]
    a, b = [sorted(r.id for r in s.collect()) for s in shares]
    assert a == b and 300 < len(a) < 500


def test_scratch_can_be_dropped(spark):
    df = written(spark.range(5), "test")
    place = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(place)
    drop_scratch(spark)
    assert not os.path.exists(place)


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == shared_folder(spark)

    class Elsewhere:
        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return {}

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        shared_folder(Elsewhere)


@pytest.mark.parametrize("size", ["64", "1000", "100000"])
def test_line_numbers_do_not_hang_on_splits(spark, tmp_path, size):
    rng = random.Random(4)
    files = {}
    for name in ("b.log", "a.log", "c.log", "empty.log"):
        lines = ["" if rng.random() < 0.2 else f"{name} {i} " + "x" * rng.randrange(30) for i in range(rng.randrange(150, 300))]
        files[name] = [] if name.startswith("empty") else lines
        (tmp_path / name).write_text("".join(line + "\n" for line in files[name]))
    (tmp_path / "d.log").write_text("last line has no end")
    files["d.log"] = ["last line has no end"]
    want, at = [], 0
    for name in sorted(files):
        want += [(at + i, name, i + 1, line.rstrip()) for i, line in enumerate(files[name]) if line.strip()]
        at += len(files[name])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = read_numbered_lines(spark, str(tmp_path), "svc")
        got = sorted((r.log_id, r.file_path.rsplit("/", 1)[1], r.line_no, r.raw_log) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
    assert {r.service_name for r in lines.collect()} == {"svc"}


def test_logs_name_every_document(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    logs = log_view(spark.read.parquet(f"{sf_dir}/events.parquet"), documents.count())
    frames = frame_table(parse_logs(logs))
    named = frames.select(F.regexp_extract("file_path", r"(?:Doc|mod|/h)(\d+)\.", 1).alias("doc")).filter("doc <> ''").distinct()
    ids = {r.doc_id for r in documents.select("doc_id").collect()}
    assert {int(r.doc) for r in named.collect()} == ids
    assert frames.agg(F.max("line_number")).first()[0] > 60


def test_views_meet_every_noise_pattern_and_length(spark, sf_dir):
    logs = log_view(spark.read.parquet(f"{sf_dir}/events.parquet").limit(500)).cache()
    for pattern in (r"\b[0-9a-f]{32}\b", r"'[^']*\d{4,}[^']*'", r"\d\d:\d\d:\d\d\.\d+\+08:00"):
        assert logs.filter(F.col("raw_log").rlike(pattern)).count() > 0
    assert logs.filter(F.length("raw_log") > 3000).count() > 0
