"""Anchored windows against a plain fold, however the rows are sliced."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import windows
from faultline.operators.windows import anchored_windows, expired_at, open_windows, storm_groups, with_representatives
from faultline.streaming.dedup import dedup_batch, emitted_groups


def fold(rows, window, threshold, eager=False):
    """(fingerprint, kind, count, first, last, id) by going through the rows one by one."""
    out, state = [], {}
    for fp, ts, log_id in sorted(rows):
        s = state.get(fp)
        if s and ts - s[1] > window:
            out.append((fp, "EXPIRED", *s))
            state[fp] = [1, ts, ts, log_id]
            if eager:
                out.append((fp, "NEW", 1, ts, ts, log_id))
        elif s:
            s[0], s[2] = s[0] + 1, ts
            if s[0] >= threshold:
                out.append((fp, "THRESHOLD", *s))
                del state[fp]
        else:
            state[fp] = [1, ts, ts, log_id]
            out.append((fp, "NEW", 1, ts, ts, log_id))
    return sorted(out + [(fp, "FLUSH", *s) for fp, s in state.items()])


def table(spark, rows):
    named = [(i, fp, float(ts), f"log {i}", "svc", "") for fp, ts, i in rows]
    return spark.createDataFrame(
        named, "log_id long, fingerprint string, sec double, raw_log string, service_name string, error_type string"
    ).withColumn("ts", F.timestamp_seconds("sec"))


def emitted(df):
    rows = df.select("fingerprint", "kind", "count", F.unix_micros("first_seen"), F.unix_micros("last_seen"), "log_id").collect()
    return sorted((r[0], r[1], r[2], r[3] / 1e6, r[4] / 1e6, r[5]) for r in rows)


def fingerprint(i):
    return f"{i:012x}"


def mixed(seed, n, keys, span, hot=0.4):
    rng = random.Random(seed)
    return [
        (fingerprint(7 if rng.random() < hot else rng.randrange(keys)), float(rng.randrange(span)), 10**18 + i)
        for i in range(n)
    ]


def test_worked_example(spark):
    fp = fingerprint(1)
    rows = [(fp, float(t), i) for i, t in enumerate([100, 110, 120, 125, 185, 186])]
    assert emitted(anchored_windows(table(spark, rows), 60, 3)) == sorted(
        [
            (fp, "NEW", 1, 100.0, 100.0, 0),
            (fp, "THRESHOLD", 3, 100.0, 120.0, 0),
            (fp, "NEW", 1, 125.0, 125.0, 3),
            (fp, "EXPIRED", 2, 125.0, 185.0, 3),
            (fp, "FLUSH", 1, 186.0, 186.0, 5),
        ]
    )


@pytest.mark.parametrize("slices", [1, 3, 40])
@pytest.mark.parametrize("window,threshold", [(60, 50), (10, 3), (0, 2), (5000, 10**6), (25, 1)])
def test_equals_fold_for_any_slicing(spark, window, threshold, slices):
    rows = mixed(window + slices, 1500, 30, 2000)
    got = anchored_windows(table(spark, rows), window, threshold, slices=slices)
    want = fold(rows, window, max(2, threshold))
    assert emitted(got) == want
    assert sum(r[2] for r in want if r[1] != "NEW") == len(rows)


def test_one_fingerprint_fills_all_slices(spark):
    rows = [(fingerprint(9), float(i // 7), i) for i in range(3000)]
    for window, threshold in [(60, 50), (3, 1000), (10**6, 10**6), (100, 700)]:
        got = anchored_windows(table(spark, rows), window, threshold, slices=25)
        assert emitted(got) == fold(rows, window, threshold)


@pytest.mark.parametrize("window,threshold", [(10**6, 10_000), (200, 90)])
def test_a_thousand_slices_of_one_fingerprint(spark, monkeypatch, window, threshold):
    """Summaries compose to a tree; no group of them is larger than its fan allows."""
    groups, plain = [], windows._groups

    def counted(*frames):
        out = plain(*frames)
        groups.append(out.groupBy("fp", "above").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(windows, "_groups", counted)
    rng = random.Random(window)
    at, rows = 0, []
    for i in range(24_000):
        at += rng.choice([0, 0, 0, 1, 3])
        rows.append((fingerprint(9), float(at), i))
    got = anchored_windows(table(spark, rows).coalesce(8), window, threshold, slices=1000)
    assert emitted(got) == fold(rows, window, threshold)
    assert len(groups) == 3 + 4 and max(groups) <= windows.FAN * min(threshold, len(rows))


def test_many_small_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = mixed(3, 600, 12, 900)
        for eager in (False, True):
            got = anchored_windows(table(spark, rows), 20, 4, eager=eager, slices=5)
            assert emitted(got) == fold(rows, 20, 4, eager)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_empty_input(spark):
    assert emitted(anchored_windows(table(spark, [(fingerprint(1), 1.0, 1)]).limit(0), 60, 3)) == []


def test_representatives_and_views(spark):
    rows = mixed(5, 300, 9, 500)
    logs = table(spark, rows)
    groups = anchored_windows(logs, 30, 5)
    told = with_representatives(groups, logs)
    assert told.count() == groups.count()
    assert told.filter(F.col("representative_log") != F.concat(F.lit("log "), "log_id")).count() == 0
    assert {r.kind for r in storm_groups(groups).collect()} <= {"THRESHOLD"}
    late = expired_at(groups, F.timestamp_seconds(F.lit(490)), 30).collect()
    want = [r for r in fold(rows, 30, 5) if r[1] == "FLUSH" and 490 - r[3] > 30]
    assert len(late) == len(want) and open_windows(groups).count() >= len(want)


@pytest.mark.parametrize("cuts", [[200], [10, 20, 300, 301]])
def test_batches_equal_one_run(spark, tmp_path, cuts):
    rows = sorted(mixed(11, 500, 15, 800), key=lambda r: (r[1], r[2]))
    root = str(tmp_path)
    for no, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        dedup_batch(table(spark, rows[a:b]), no, root, 25, 6)
        if no == 1:  # a batch that runs again replaces its own output
            dedup_batch(table(spark, rows[a:b]), no, root, 25, 6)
    assert emitted(emitted_groups(spark, root, flush=True)) == fold(rows, 25, 6)


def test_idle_windows_close(spark, tmp_path):
    rows = sorted(mixed(12, 300, 15, 800), key=lambda r: (r[1], r[2]))
    root = str(tmp_path)
    for no, (a, b) in enumerate([(0, 120), (120, 300)]):
        dedup_batch(table(spark, rows[a:b]), no, root, 25, 6, close_idle=True)
    got = [(r[0], r[2:]) for r in emitted(emitted_groups(spark, root, flush=True))]
    assert sorted(got) == sorted((r[0], r[2:]) for r in fold(rows, 25, 6, eager=True))
    newest = rows[-1][1]
    still = emitted_groups(spark, root, flush=True).filter("kind = 'FLUSH'").collect()
    assert all(newest - r.first_seen.timestamp() <= 25 for r in still)


def test_late_logs_join_the_open_window(spark, tmp_path):
    fp, root = fingerprint(4), str(tmp_path)
    dedup_batch(table(spark, [(fp, 100.0, 1), (fp, 110.0, 2)]), 0, root, 60, 50)
    dedup_batch(table(spark, [(fp, 90.0, 3), (fp, 120.0, 4)]), 1, root, 60, 50)
    assert emitted(emitted_groups(spark, root, flush=True)) == [
        (fp, "FLUSH", 4, 100.0, 120.0, 1),
        (fp, "NEW", 1, 100.0, 100.0, 1),
    ]
