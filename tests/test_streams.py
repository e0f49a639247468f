from pyspark.sql import functions as F
from test_windows import emitted, fold

from faultline.functions.fingerprint import with_fingerprint
from faultline.plans.stub_model import stub_model
from faultline.plans.triage import triage
from faultline.sources.logs import LOG_SCHEMA, read_log_stream
from faultline.streaming.dedup import emitted_groups, storm_counts, stream_dedup, stream_triage

TEXTS = ["panic: boom", "curl/7 hit", "slow query", "disk quota exceeded", "KeyError: 'x'"]


def write(spark, folder, no, rows):
    df = spark.createDataFrame([(i, float(t), "svc", TEXTS[k]) for i, t, k in rows], "log_id long, s double, service_name string, raw_log string")
    df = df.select("log_id", F.timestamp_seconds("s").alias("ts"), "service_name", "raw_log")
    df.coalesce(1).write.parquet(f"{folder}/part{no}")
    return df


def source(spark, folder):
    return read_log_stream(spark, f"{folder}/*", schema=LOG_SCHEMA, maxFilesPerTrigger=1)


def rows(a, b):
    return [(i, i * 3, i * i % 5) for i in range(a, b)]


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_table_over_restarts(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    parts = [write(spark, folder, 0, rows(0, 40)), write(spark, folder, 1, rows(40, 90))]
    options = dict(window_seconds=30, threshold=4)
    run(stream_dedup(source(spark, folder), root, **options))
    parts.append(write(spark, folder, 2, rows(90, 130)))
    run(stream_dedup(source(spark, folder), root, **options))  # goes on from its checkpoint
    logs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    keyed = with_fingerprint(logs).select("fingerprint", F.unix_micros("ts"), "log_id").collect()
    want = fold([(r[0], r[1] / 1e6, r[2]) for r in keyed], 30, 4)
    got = emitted_groups(spark, root, flush=True)
    assert emitted(got) == want
    texts = {r.log_id: r.raw_log for r in logs.collect()}
    assert all(texts[r.log_id] == r.representative_log for r in got.collect())
    assert emitted(emitted_groups(spark, root)) == [r for r in want if r[1] != "FLUSH"]


def test_stream_triage_tables(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    logs = write(spark, folder, 0, rows(0, 60)).unionByName(write(spark, folder, 1, rows(60, 100)))
    run(stream_triage(source(spark, folder), root, stub_model, window_seconds=30, threshold=4))
    keys = ["fingerprint", "kind", "log_id", "severity", "source", "count"]
    want = triage(logs, stub_model, window_seconds=30, threshold=4).filter("kind <> 'FLUSH'").select(*keys)
    got = spark.read.parquet(f"{root}/results").select(*keys)
    assert sorted(got.collect()) == sorted(want.collect())
    ignored = got.filter("severity = 'P3_IGNORE'").count()
    assert spark.read.json(f"{root}/audit").count() == got.count()
    assert spark.read.json(f"{root}/ignored").count() == ignored > 0
    assert spark.read.parquet(f"{root}/outbox").count() == got.count() + ignored


def test_late_logs_are_dropped_from_clock_windows(spark, tmp_path):
    folder = f"{tmp_path}/in"
    write(spark, folder, 0, [(1, 100, 0), (2, 110, 0), (3, 2000, 1)])
    write(spark, folder, 1, [(5, 2010, 1)])
    write(spark, folder, 2, [(4, 105, 0), (7, 2015, 1)])  # the first is behind the watermark
    write(spark, folder, 3, [(6, 9000, 2)])
    counts = storm_counts(source(spark, folder), "1 minute", "5 minutes")
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/c")
    run(writer.option("checkpointLocation", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/c").select(F.unix_seconds("window_start").alias("s"), "count").collect()
    assert sorted(map(tuple, got)) == [(60, 2), (1980, 3)]
    table = storm_counts(spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/*"), "1 minute")
    assert sorted(r["count"] for r in table.collect()) == [1, 3, 3]


def test_outdated_open_windows_are_deleted(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    for no in range(5):
        write(spark, folder, no, rows(no * 20, no * 20 + 20))
    run(stream_dedup(source(spark, folder), root, window_seconds=30, threshold=4))
    held = sorted(p.parent.name for p in (tmp_path / "out" / "groups").glob("batch_id=*/state=open"))
    assert held == ["batch_id=3", "batch_id=4"]
