"""Dedup of a log stream by keyed state with event-time timers.

Each live fingerprint has one open window: its count, first and last time and first log. A window closes
when its storm threshold is reached, when a later log lies past it, or by a timer once the watermark is past it; so a closed
window costs nothing any more. That is the eager way of closing: the next log of the fingerprint is NEW.

A keyed state holds the open windows of one of ``BUCKETS`` shares of the fingerprints, with a timer for the window that ends
first. A call to Python for each fingerprint would cost more than all its logs; so a share's windows and logs are swept at once, as
columns. A micro-batch reads and writes the states of the shares that it touches or that a timer ends, no others.

Before the shuffle the logs of a fingerprint are folded into packs, a row for each fingerprint and ``PACK_ROWS`` logs of a task with
sixteen bytes a log and without texts, so a storm of one fingerprint comes to its task as a few rows.

A log at or before the watermark when its micro-batch starts is late and left out; ``late.split_late`` keeps such logs.
"""

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as V
from ..functions.fingerprint import keyed
from ..operators.scoring import ChatFactory
from ..operators.windows import EXPIRED, FLUSH, KINDS, as_number, as_text, emit, with_representatives
from .dedup import batch_folder, triage_writer

_PACK = "fp long, latest timestamp, times binary, ids binary"
_WINDOW = ["fp", "n", "first", "last", "log_id"]
_STATE = ", ".join(f"{c} array<long>" for c in _WINDOW)
_OUT = "fp long, kind int, n long, first long, last long, log_id long"
_OUT_COLUMNS = [part.split()[0] for part in _OUT.split(", ")]
# Places of a window's first time, and of what is told's kind.
_FIRST, _KIND = 2, 1

# Shares of the fingerprints; they hold for the life of a checkpoint.
BUCKETS = 1024

# Logs of a task that are folded at a time.
PACK_ROWS = 100_000

# The folder of what is told when a stream has ended, beside those of its micro-batches.
AT_END = -1


def packs(logs: DataFrame) -> DataFrame:
    """fp, latest, times, ids: the logs of a fingerprint in one row for each ``PACK_ROWS`` logs of a task."""
    narrow = keyed(logs).select(
        as_number(F.col("fingerprint")).alias("fp"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "log_id"
    )
    return narrow.mapInArrow(_packed, _PACK)


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in source:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACK_ROWS:
            yield _folded(held)
            held, rows = [], 0
    if rows:
        yield _folded(held)


def _folded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    fp, ts, ids = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
    order = np.lexsort((ids, ts, fp))
    fp, ts, ids = fp[order], ts[order], ids[order]
    starts = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
    ends = np.r_[starts[1:], len(fp)]
    offsets = pa.array(np.r_[starts, len(fp)] * 8, pa.int32()).buffers()[1]
    columns = [
        pa.array(fp[starts]),
        pa.array(ts[ends - 1], pa.timestamp("us", tz="UTC")),
        *[pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(x.tobytes())]) for x in (ts, ids)],
    ]
    return pa.RecordBatch.from_arrays(columns, ["fp", "latest", "times", "ids"])


def _unpacked(packs: pd.DataFrame) -> np.ndarray:
    """fp, time and id of each log, a row of each."""
    ts, ids = (np.frombuffer(b"".join(packs[c]), np.int64) for c in ("times", "ids"))
    sizes = np.fromiter(map(len, packs["times"]), np.int64, len(packs)) // 8
    return np.stack([np.repeat(packs["fp"].to_numpy(), sizes), ts, ids])


def _stepped(span: int, limit: int) -> Any:
    def step(key: tuple, source: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        windows = np.array(state.get if state.exists else [[]] * len(_WINDOW), np.int64)
        told = []
        if not state.hasTimedOut:
            logs = np.concatenate([_unpacked(part) for part in source], axis=1)
            if now > 0:  # there is a watermark
                logs = logs[:, logs[1] > now * 1000]
            if logs.size:
                out, windows = _swept(windows, logs, span, limit)
                told.append(out)
        due = (windows[_FIRST] + span) // 1000  # a timer goes off when the watermark is past it
        past = due < now
        told.append(np.insert(windows[:, past], _KIND, EXPIRED, axis=0))
        windows, due = windows[:, ~past], due[~past]
        if windows.size:
            state.update(tuple(windows.tolist()))
            state.setTimeoutTimestamp(int(due.min()))
        elif state.exists:
            state.remove()
        rows = np.concatenate(told, axis=1)
        if rows.size:
            yield pd.DataFrame(dict(zip(_OUT_COLUMNS, rows, strict=True))).astype({"kind": np.int32})

    return step


def _swept(windows: np.ndarray, logs: np.ndarray, span: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """What open windows and logs of many fingerprints give, and the windows that are then open."""
    fp, ts, ids = logs
    met = np.isin(windows[0], fp)
    held, none = windows[:, met], np.zeros(len(fp), np.int64)
    rows = np.concatenate([held, [fp, none, ts, ts, ids]], axis=1)
    # A window held precedes its fingerprint's logs.
    is_log = np.arange(rows.shape[1]) >= held.shape[1]
    fp, n, first, last, log_id = rows[:, np.lexsort((rows[4], rows[_FIRST], is_log, rows[0]))]
    out, window = emit(fp, first, log_id, n, last, span, limit, True)
    told = out[_OUT_COLUMNS].to_numpy(np.int64).T
    opened = [np.delete(told[:, told[_KIND] == FLUSH], _KIND, axis=0)]
    if window is not None:  # that of the last fingerprint is told apart
        at, first, log_id, n, last = window
        opened.append(np.array([[at], [n], [first], [last], [log_id]]))
    return told[:, told[_KIND] != FLUSH], np.concatenate([windows[:, ~met], *opened], axis=1)


def _named(rows: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return rows.select(
        as_text(F.col("fp")).alias("fingerprint"),
        kind.alias("kind"),
        F.col("n").alias("count"),
        F.timestamp_micros("first").alias("first_seen"),
        F.timestamp_micros("last").alias("last_seen"),
        "log_id",
    )


def timer_dedup(
    stream: DataFrame,
    window_seconds: float = V.WINDOW_SECONDS,
    threshold: int = V.STORM_THRESHOLD,
    delay: str = "10 minutes",
) -> DataFrame:
    """Emitted groups of a log stream, as a stream: fingerprint, kind, count, first_seen, last_seen, log_id.

    Windows close when they are past their span at the newest log time less ``delay``. ``log_id`` is the window's first
    log, by which texts are joined.
    """
    folded = packs(stream).withWatermark("latest", delay)
    step = _stepped(int(window_seconds * 1_000_000), max(2, threshold))
    shares = folded.withColumn("bucket", F.pmod("fp", F.lit(BUCKETS)))
    told = shares.groupBy("bucket").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _named(told)


def open_windows(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Windows that a stream's state holds, as FLUSH groups, after its last micro-batch or the one named."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    state = reader.load(checkpoint).select(F.inline(F.arrays_zip(*[F.col(f"value.groupState.{c}").alias(c) for c in _WINDOW])))
    return _named(state.select("fp", F.lit(KINDS.index("FLUSH")).alias("kind"), "n", "first", "last", "log_id"))


def _told(groups: DataFrame, logs: DataFrame, at: str) -> DataFrame:
    """Groups with their first logs' texts, written once; of ``logs`` only what is as recent as the groups is read."""
    oldest = groups.agg(F.min("first_seen")).first()[0]
    recent = logs if oldest is None else logs.filter(F.col("ts") >= F.lit(oldest))
    told = with_representatives(groups, recent)
    told.write.mode("overwrite").parquet(at)
    return groups.sparkSession.read.schema(told.schema).parquet(at)


def timer_triage(
    stream: DataFrame,
    logs: DataFrame,
    root: str,
    chat_factory: ChatFactory | None = None,
    rules: list[tuple] | None = None,
    routes: DataFrame | None = None,
    **options,
) -> DataStreamWriter:
    """Dedup by timers, rules, model and outboxes; results, audit, ignored and outbox tables below ``root``.

    ``logs`` is the table that keeps the stream's logs, where the texts of windows' first logs are looked up.
    """
    then = triage_writer(root, chat_factory, rules, routes)

    def step(groups: DataFrame, batch_id: int) -> None:
        at = batch_folder(f"{root}/emitted", batch_id)
        groups.write.mode("overwrite").parquet(at)  # states step once, whatever is done with the groups
        emitted = groups.sparkSession.read.schema(groups.schema).parquet(at)
        then(_told(emitted, logs, batch_folder(f"{root}/groups", batch_id)), batch_id)

    return timer_dedup(stream, **options).writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")


def triage_open(
    spark: SparkSession,
    logs: DataFrame,
    root: str,
    chat_factory: ChatFactory | None = None,
    rules: list[tuple] | None = None,
    routes: DataFrame | None = None,
) -> None:
    """Triage of the windows that an ended ``timer_triage`` has left open, into the same tables, as batch ``AT_END``."""
    groups = open_windows(spark, f"{root}/checkpoint")
    told = _told(groups, logs, batch_folder(f"{root}/groups", AT_END))
    triage_writer(root, chat_factory, rules, routes)(told, AT_END)
