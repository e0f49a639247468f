"""Streams with timers and late logs against plain folds."""

import os
import random

from pyspark.sql import functions as F
from test_streams import TEXTS, run, source, write
from test_windows import emitted, fold

from faultline.functions.fingerprint import with_fingerprint
from faultline.plans.stub_model import stub_model
from faultline.plans.triage import triage
from faultline.streaming import late, timers


def dedup(spark, folder, root, window, threshold, delay="0 seconds"):
    told = timers.timer_dedup(source(spark, folder), window, threshold, delay).writeStream.format("parquet")
    run(told.option("path", f"{root}/groups").option("checkpointLocation", f"{root}/cp"))
    return spark.read.parquet(f"{root}/groups")


def timed_fold(rows, window, threshold, delay=0):
    """The eager fold, with windows past their span at the last watermark closed."""
    newest = int(max(t for _, t, _ in rows) * 1000) - delay * 1000
    out = fold(rows, window, threshold, eager=True)
    return sorted((r[0], "EXPIRED", *r[2:]) if r[1] == "FLUSH" and int((r[3] + window) * 1000) < newest else r for r in out)


def keyed_rows(logs):
    rows = with_fingerprint(logs).select("fingerprint", F.unix_micros("ts"), "log_id").collect()
    return [(r[0], r[1] / 1e6, r[2]) for r in rows]


def test_timers_close_windows_over_restarts(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    rng = random.Random(3)
    logs, at = None, 0
    for no in range(6):
        part = []
        for _ in range(rng.choice([5, 60])):
            at += rng.choice([0, 1, 1, 2, 40])
            part.append((len(part) + no * 1000, at, 1 if rng.random() < 0.6 else rng.randrange(5)))
        at += 1  # the next part lies past this one's newest log
        frame = write(spark, folder, no, part)
        logs = frame if logs is None else logs.unionByName(frame)
        if no in (1, 5):  # goes on from its checkpoint
            told = dedup(spark, folder, root, 30, 7)
    want = timed_fold(keyed_rows(logs), 30, 7)
    still = timers.open_windows(spark, f"{root}/cp")
    assert emitted(told.unionByName(still)) == want
    assert emitted(still) == [r for r in want if r[1] == "FLUSH"]
    assert {r[1] for r in want} == {"NEW", "THRESHOLD", "EXPIRED", "FLUSH"}


def test_delay_keeps_late_logs_and_windows(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    parts = [[(1, 100, 0), (2, 400, 1)], [(3, 110, 0), (4, 390, 1)], [(5, 100, 2), (6, 300, 0), (7, 399, 3)], [(8, 401, 1)]]
    for no, part in enumerate(parts):
        write(spark, folder, no, part)
    told = emitted(dedup(spark, folder, root, 20, 50, "250 seconds"))
    still = emitted(timers.open_windows(spark, f"{root}/cp"))
    # The watermark is 150 from the second part on: what is at or before it is late and left out.
    assert sorted(r[5] for r in told if r[1] == "NEW") == [1, 2, 6, 7]
    assert [(r[2], r[3], r[5]) for r in told if r[1] == "EXPIRED"] == [(1, 100.0, 1)]
    assert sorted((r[2], r[5]) for r in still) == [(1, 6), (1, 7), (3, 2)]


def test_batches_store_only_the_states_they_touch(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"

    def part(no, keys, at):
        rows = [(no * 10_000 + k, at + k / 1000, f"Odd{'x' * (k % 40)}{'y' * (k // 40)}Error: z") for k in keys]
        df = spark.createDataFrame([(i, float(t), "svc", x) for i, t, x in rows], "log_id long, s double, service_name string, raw_log string")
        df.select("log_id", F.timestamp_seconds("s").alias("ts"), "service_name", "raw_log").coalesce(1).write.parquet(f"{folder}/part{no}")

    def stored():
        files = [os.path.join(d, f) for d, _, names in os.walk(f"{root}/cp/state") for f in names if f.endswith(".changelog")]
        return {f: os.path.getsize(f) for f in files}

    part(0, range(2000), 1)
    dedup(spark, folder, root, 10_000, 50)
    first = stored()
    part(1, range(10), 20)
    dedup(spark, folder, root, 10_000, 50)
    second = {f: n for f, n in stored().items() if f not in first}
    assert timers.open_windows(spark, f"{root}/cp").count() == 2000
    assert 0 < sum(second.values()) < sum(first.values()) / 10


def test_a_storm_of_one_fingerprint_comes_as_packs(spark):
    logs = spark.range(50_000).select(
        F.col("id").alias("log_id"), F.timestamp_seconds(F.col("id") / 10).alias("ts"), F.lit("svc").alias("service_name"), F.lit("panic: x").alias("raw_log")
    )
    packs = timers.packs(logs.coalesce(4)).collect()
    assert len(packs) <= 4 * -(-50_000 // 10_000) and sum(len(p.times) for p in packs) == 8 * 50_000


def test_states_hold_shares_of_the_fingerprints(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    shape = F.concat(*[F.char(97 + F.pmod(F.floor(F.col("id") / 26**p), F.lit(26))) for p in range(3)])
    for no in range(2):  # every fingerprint in both parts
        logs = spark.range(3000).select(
            (F.col("id") + no * 3000).alias("log_id"), F.timestamp_seconds(F.lit(10 + no)).alias("ts"), F.lit("svc").alias("service_name"),
            F.concat(F.lit("X"), shape, F.lit("Error: z")).alias("raw_log"),
        )
        logs.coalesce(1).write.parquet(f"{folder}/part{no}")
        told = dedup(spark, folder, root, 30, 50)
    still = timers.open_windows(spark, f"{root}/cp")
    assert told.count() == still.count() == 3000
    assert still.filter("count = 2 and first_seen < last_seen and log_id < 3000").count() == 3000
    # A call to Python for each share, not for each fingerprint.
    assert spark.read.format("statestore").load(f"{root}/cp").count() <= timers.BUCKETS


def test_triage_by_timers(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    logs = write(spark, folder, 0, [(i, i * 3, i * i % 5) for i in range(60)])
    logs = logs.unionByName(write(spark, folder, 1, [(i, i * 3, i * i % 5) for i in range(60, 100)]))
    run(timers.timer_triage(source(spark, folder), logs, root, stub_model, window_seconds=30, threshold=4, delay="0 seconds"))
    keys = ["fingerprint", "log_id", "severity", "source", "count", "representative_log"]
    want = triage(logs, stub_model, window_seconds=30, threshold=4, eager=True).select(*keys)
    closed = spark.read.parquet(f"{root}/results").count()
    timers.triage_open(spark, logs, root, stub_model)
    got = spark.read.parquet(f"{root}/results").select(*keys)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > closed
    assert {r.representative_log for r in got.collect()} == {TEXTS[k] for k in (0, 1, 4)}
    assert spark.read.json(f"{root}/audit").count() == got.count()


def test_late_logs_are_kept_apart(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    parts = [[(1, 100, 0), (2, 900, 1)], [(3, 300, 0), (4, 301, 0), (5, 50, 2)], [(6, 2000, 1)], [(7, 1400, 1), (8, 1401, 1)]]
    for no, part in enumerate(parts):
        write(spark, folder, no, part)
    taken = {}
    writer = late.stream_split_late(source(spark, folder), root, lambda logs, no: taken.update({no: sorted(r.log_id for r in logs.collect())}), 600)
    run(writer)
    assert taken == {0: [1, 2], 1: [4], 2: [6], 3: [8]}
    assert sorted(r.log_id for r in late.stored_logs(spark, root, True).collect()) == [3, 5, 7]
    assert late.stored_logs(spark, root, False).count() + 3 == late.stored_logs(spark, root).count() == 8
    counts = [tuple(r) for r in late.late_counts(spark, root).orderBy("batch_id").collect()]
    s = 1_000_000
    assert counts == [(0, None, 900 * s, 2, 0), (1, 300 * s, 900 * s, 1, 2), (2, 300 * s, 2000 * s, 1, 0), (3, 1400 * s, 2000 * s, 1, 1)]


def test_late_split_repeats_and_empty_batches(spark, tmp_path):
    root = str(tmp_path)
    logs = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None)], "log_id long, s double").select("log_id", F.timestamp_seconds("s").alias("ts"))
    none = logs.filter("false")
    assert late.split_late(none, 0, root, 5).count() == 0
    for _ in range(2):  # a batch that runs again gives the same
        assert late.split_late(logs, 1, root, 5).count() == 3
        assert sorted(r.log_id for r in late.split_late(logs, 2, root, 5).collect()) == [2, 3]
    assert late.split_late(none, 3, root, 5).count() == 0
    assert [r.newest for r in late.late_counts(spark, root).orderBy("batch_id").collect()] == [None, 20_000_000, 20_000_000, 20_000_000]
