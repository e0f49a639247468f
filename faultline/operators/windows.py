"""Anchored-window dedup over a log table.

Per fingerprint, in the order (ts, log_id): the first log opens a window and is
reported as NEW; a log within the window is merged; the merge that reaches the
threshold closes the window (THRESHOLD) and the next log is NEW again; a log
past the window closes it (EXPIRED) and opens the next one, silently or, with
``eager=True``, as NEW. Windows open at the end of input are FLUSH.

Where a window ends depends on where it starts, so the rows of a fingerprint
form a chain, and one fingerprint may hold a third of all rows. The chain is
therefore cut by a range partitioning on (fingerprint, ts, log_id), which splits
a hot fingerprint into as many slices as it needs:

1. a slice of a cut fingerprint is summed up as a table of at most ``threshold``
   rows: for each row a window may first start at, the window left open at the
   slice's end (a window that comes in from the left closes within that many rows);
2. a summary is a function from the window that comes in to the one that is left open, and functions of
   neighbours compose to one of the same size: ``FAN`` slices at a time they are composed to a tree, and from its top
   the windows that come in are handed down, level by level;
3. all slices are then swept at once, in constant memory.

Only (fingerprint, ts, log_id) take part. The texts of the windows' first logs
are joined on ``log_id`` afterwards.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.fingerprint import error_type, keyed
from ..session import shared_folder, written, written_side

# A task holds no more than a slice of rows of three numbers.
ROWS_PER_SLICE = 2_000_000

# Slices whose summaries meet in one place; a group of them has at most FAN * threshold rows.
FAN = 8

KINDS = ["NEW", "THRESHOLD", "EXPIRED", "FLUSH"]
NEW, THRESHOLD, EXPIRED, FLUSH = range(4)

_SUMMARY = "fp long, slice int, at long, n long, head long, first long, id long, held long, last long"
_ENTRY = "fp long, slice int, in_first long, in_id long, in_held long, in_last long"
_EMISSION = "fp long, kind int, n long, first long, last long, log_id long"


def anchored_windows(
    logs: DataFrame,
    window_seconds: float = V.WINDOW_SECONDS,
    threshold: int = V.STORM_THRESHOLD,
    eager: bool = False,
    carried: DataFrame | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Emitted groups: fingerprint, kind, count, first_seen, last_seen, log_id.

    ``log_id`` is the window's first log. ``carried`` holds windows left open by
    earlier input (same columns); they precede the logs of their fingerprint.
    ``slices`` fixes the number of range partitions (default: by the number of rows).
    """
    spark = logs.sparkSession
    shared_folder(spark)
    span = int(window_seconds * 1_000_000)
    # A merge is what tests the count, so a threshold below 2 acts at 2.
    limit = max(2, threshold)

    index = _ranged(_index(logs, carried), slices)
    cuts = written_side(_cuts(index), "cuts")  # at most two rows per partition of the index
    entries = written_side(_entries(cuts, index, span, limit), "entries")
    placed = index.join(entries, ["fp", "slice"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("in_first", "in_id", "in_held", "in_last")}
        | {"final": F.coalesce("final", F.lit(True))}
    )
    swept = placed.mapInPandas(lambda parts: _sweep(parts, span, limit, eager), _EMISSION)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return swept.select(
        as_text(F.col("fp")).alias("fingerprint"),
        kind.alias("kind"),
        F.col("n").alias("count"),
        F.timestamp_micros("first").alias("first_seen"),
        F.timestamp_micros("last").alias("last_seen"),
        "log_id",
    )


def with_representatives(groups: DataFrame, logs: DataFrame) -> DataFrame:
    """Add representative_log, service_name and error_type of the groups' first logs.

    ``log_id`` is unique in ``logs``: no key of this join can be hot. Where dedup
    leaves few groups, they go to the texts and the texts are not shuffled.
    """
    groups = written_side(groups, "groups")
    texts = logs.select("log_id", "raw_log", "service_name", *_known(logs, "error_type"))
    joined = groups.join(texts, "log_id")
    if "error_type" not in texts.columns:
        joined = joined.withColumn("error_type", error_type(F.col("raw_log")))
    return joined.withColumnRenamed("raw_log", "representative_log")


def storm_groups(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("kind") == "THRESHOLD")


def open_windows(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("kind") == "FLUSH")


def expired_at(groups: DataFrame, now: Column, window_seconds: float = V.WINDOW_SECONDS) -> DataFrame:
    """Open windows that are past their span at ``now``."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros("first_seen")
    return open_windows(groups).filter(age > int(window_seconds * 1_000_000))


# --- the index ------------------------------------------------------------------


def _known(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def as_number(fingerprint: Column) -> Column:
    return F.conv(fingerprint, 16, 10).cast("long")


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), V.FINGERPRINT_CHARS, "0"))


def _index(logs: DataFrame, carried: DataFrame | None) -> DataFrame:
    rows = keyed(logs).select(
        as_number(F.col("fingerprint")).alias("fp"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        "log_id",
    )
    if carried is not None:
        held = carried.select(
            as_number(F.col("fingerprint")).alias("fp"),
            F.unix_micros("first_seen").alias("ts"),
            "log_id",
            F.col("count").alias("held"),
            F.unix_micros("last_seen").alias("last"),
        )
        rows = rows.select("*", F.lit(0).cast("long").alias("held"), F.col("ts").alias("last"))
        rows = rows.unionByName(held)
    # The fingerprints are the costly part, and range partitioning reads its input twice.
    return written(rows, "window-index")


def _ranged(rows: DataFrame, slices: int | None) -> DataFrame:
    held = [F.col("held").desc()] if "held" in rows.columns else []
    order = [F.col("fp"), *held, F.col("ts"), F.col("log_id")]
    if not slices:
        n = rows.count()
        cores = rows.sparkSession.sparkContext.defaultParallelism
        slices = max(-(-n // ROWS_PER_SLICE), min(cores, n // 10_000 + 1))
    ordered = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    # Both the summaries and the sweep must see the very same slices.
    return ordered.withColumn("slice", F.spark_partition_id()).checkpoint()


def _cuts(index: DataFrame) -> DataFrame:
    """(fp, slice, piece, final) for fingerprints that lie in several slices; pieces are numbered from 0, gaps allowed.

    Built from one row per partition of the index: a fingerprint can only be cut
    where it is the lowest or the highest of a partition.
    """
    ends = index.groupBy("slice").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    edges = ends.select("slice", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("fp"))
    of_fp = Window.partitionBy("fp")
    return (
        edges.select(
            "fp",
            "slice",
            F.count(F.lit(1)).over(of_fp).alias("pieces"),
            (F.col("slice") - F.min("slice").over(of_fp)).alias("piece"),
            (F.col("slice") == F.max("slice").over(of_fp)).alias("final"),
        )
        .filter("pieces > 1")
        .drop("pieces")
    )


def _entries(cuts: DataFrame, index: DataFrame, span: int, limit: int) -> DataFrame:
    """(fp, slice, final) with the window that comes in from the left."""
    rows = index.join(cuts.select("fp", "slice", "piece"), ["fp", "slice"]).drop("slice")
    rows = rows.withColumnRenamed("piece", "slice")
    levels = [rows.mapInPandas(lambda parts: _summarise(parts, span, limit), _SUMMARY)]
    pieces = cuts.agg(F.max("piece") + 1).first()[0] or 0
    while pieces > FAN:
        levels[-1] = written(levels[-1], "summaries")
        levels.append(_groups(levels[-1]).mapInPandas(lambda parts: _compose(parts, span, limit), _SUMMARY))
        pieces = -(-pieces // FAN)
    entries = None
    for summaries in reversed(levels):
        entries = _groups(summaries, entries).mapInPandas(lambda parts: _follow(parts, span, limit), _ENTRY)
    return cuts.join(entries.withColumnRenamed("slice", "piece"), ["fp", "piece"]).drop("piece")


def _groups(summaries: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Summaries by groups of neighbours, in order, with the window that comes into each group."""
    grouped = summaries.withColumn("above", F.floor(F.col("slice") / FAN).cast("int"))
    if entries is None:
        nothing = {c: F.lit(0).cast("long") for c in ("in_first", "in_id", "in_held", "in_last")}
        grouped = grouped.withColumns(nothing)
    else:
        grouped = grouped.join(entries.withColumnRenamed("slice", "above"), ["fp", "above"])
    return grouped.repartition("fp", "above").sortWithinPartitions("fp", "above", "slice", "at")


# --- inside the tasks: whole columns of a batch at a time -------------------------


def _next_starts(fp, ts, held, span, limit):
    """For every row, the row at which the next window starts if one starts here."""
    n = len(ts)
    run = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
    run_of = np.repeat(np.arange(len(run)), np.diff(np.r_[run, n]))
    run_end = np.r_[run[1:], n][run_of]
    low = int(ts.min())
    width = int(ts.max()) - low + span + 1
    past = np.empty(n, dtype=np.int64)
    # Runs are laid side by side on one axis, so that one search serves many runs.
    per_block = max(1, (2**62) // width)
    for a in range(0, len(run), per_block):
        b = min(a + per_block, len(run))
        lo, hi = run[a], run[b] if b < len(run) else n
        shift = (run_of[lo:hi] - a) * width - low
        axis = ts[lo:hi] + shift
        goal = axis + span
        if held is not None:
            # A carried window precedes its run even if late logs are older.
            axis = np.where(held[lo:hi] > 0, shift + low, axis)
        past[lo:hi] = lo + np.searchsorted(axis, goal, side="right")
    merged = 0 if held is None else np.maximum(held - 1, 0)
    filled = np.arange(n) + limit - merged
    # A late log may be older than its window's start; the next row is the least step.
    past = np.maximum(past, np.arange(n) + 1)
    return run, np.minimum(np.minimum(past, filled), run_end)


def _summarise(parts: Iterator[pd.DataFrame], span: int, limit: int) -> Iterator[pd.DataFrame]:
    for (fp, slice_), rows in _whole_runs(parts):
        ts = rows["ts"].to_numpy()
        held = rows["held"].to_numpy() if "held" in rows else None
        n = len(ts)
        _, nxt = _next_starts(np.zeros(n, np.int64), ts, held, span, limit)
        here = np.arange(n)
        far = np.where(nxt < n, nxt, here)
        while not np.array_equal(hop := far[far], far):
            far = hop
        starts = far[: min(limit, n)]
        weight = n - starts
        if held is not None:
            weight = weight + np.maximum(held[starts] - 1, 0)
        last = rows["last"] if "last" in rows else rows["ts"]
        yield pd.DataFrame(
            {
                "fp": fp,
                "slice": slice_,
                "at": here[: len(starts)],
                "n": n,
                "head": ts[: len(starts)],
                "first": ts[starts],
                "id": rows["log_id"].to_numpy()[starts],
                "held": np.where(weight >= limit, 0, weight),
                "last": last.iloc[-1],
            }
        )


def _whole_runs(parts):
    """The rows of one (fp, slice) at a time; a run is at most a partition's rows."""
    key, pieces = None, []
    for batch in parts:
        fp, slice_ = batch["fp"].to_numpy(), batch["slice"].to_numpy()
        changes = (fp[1:] != fp[:-1]) | (slice_[1:] != slice_[:-1])
        cuts = np.flatnonzero(np.r_[True, changes]) if len(fp) else []
        for a, b in zip(cuts, [*cuts[1:], len(fp)]):
            here = (int(fp[a]), int(slice_[a]))
            if here != key:
                if pieces:
                    yield key, pd.concat(pieces)
                key, pieces = here, []
            pieces.append(batch.iloc[a:b])
    if pieces:
        yield key, pd.concat(pieces)


def _follow(parts: Iterator[pd.DataFrame], span: int, limit: int) -> Iterator[pd.DataFrame]:
    """Hand the open window of each group of neighbours from one to the next."""
    columns = ["fp", "slice", "in_first", "in_id", "in_held", "in_last"]
    last_group, window, out = None, None, []
    for (fp, slice_), summary in _whole_runs(parts):
        group = (fp, slice_ // FAN)
        if group != last_group:
            came_in = tuple(int(summary[c].iat[0]) for c in columns[2:])
            last_group, window = group, came_in if came_in[2] else None
        out.append((fp, slice_, *(window or (0, 0, 0, 0))))
        window = _after_slice(window, summary, span, limit)
        if len(out) == 1000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def _after_slice(window, summary, span, limit):
    """The window left open by a slice that ``window`` comes into."""
    left = (np.zeros(1, np.int64),) * 4 if window is None else tuple(np.array([x]) for x in window)
    first, log_id, held, last = (int(x[0]) for x in _through(left, summary, span, limit))
    return (first, log_id, held, last) if held else None


def _through(windows, summary, span, limit):
    """Windows (first, id, held, last; none where held is 0) after a slice, for many of them at once."""
    first, log_id, held, _ = windows
    n, end = int(summary["n"].iat[0]), int(summary["last"].iat[0])
    past = np.searchsorted(summary["head"].to_numpy(), first + span, side="right")
    missing = limit - held
    goes_on = (held > 0) & (past >= n) & (missing > n)
    start = np.where(held > 0, np.minimum(past, missing), 0)
    opened = ~goes_on & (start < n)
    at = np.where(opened, start, 0)
    told = {c: summary[c].to_numpy()[at] for c in ("first", "id", "held")}
    return (
        np.where(goes_on, first, told["first"]),
        np.where(goes_on, log_id, told["id"]),
        np.where(goes_on, held + n, np.where(opened, told["held"], 0)),
        np.full(len(held), end),
    )


def _compose(parts: Iterator[pd.DataFrame], span: int, limit: int) -> Iterator[pd.DataFrame]:
    """One summary for each group of neighbours: what the group does to a window that starts at each of its first rows."""
    key, whole = None, None
    for (fp, slice_), summary in _whole_runs(parts):
        group = (fp, slice_ // FAN)
        if group != key:
            if whole is not None:
                yield whole
            key, whole = group, summary[[c.split()[0] for c in _SUMMARY.split(", ")]].assign(slice=group[1])
            continue
        windows = tuple(whole[c].to_numpy() for c in ("first", "id", "held", "last"))
        told = dict(zip(("first", "id", "held", "last"), _through(windows, summary, span, limit), strict=True))
        n, more = int(whole["n"].iat[0]), summary["n"].iat[0]
        # Rows of the next one at which a window may start first, where those before are few.
        beyond = summary[whole.columns].iloc[: max(0, limit - n)].assign(slice=group[1])
        whole = pd.concat([whole.assign(**told), beyond.assign(at=beyond["at"] + n)]).assign(
            n=n + int(more), last=summary["last"].iat[-1]
        )
    if whole is not None:
        yield whole


def _sweep(parts: Iterator[pd.DataFrame], span: int, limit: int, eager: bool) -> Iterator[pd.DataFrame]:
    window, final, previous = None, True, None
    for batch in parts:
        if not len(batch):
            continue
        fp = batch["fp"].to_numpy()
        ts = batch["ts"].to_numpy()
        log_id = batch["log_id"].to_numpy()
        held = batch["held"].to_numpy() if "held" in batch else np.zeros(len(fp), np.int64)
        last = batch["last"].to_numpy() if "last" in batch else ts
        _check_order(fp, previous)
        if previous is None and batch["in_held"].iat[0]:
            window = tuple(int(batch[c].iat[0]) for c in ("fp", "in_first", "in_id", "in_held", "in_last"))
        previous = int(fp[-1])
        final = bool(batch["final"].iat[-1])
        if window is not None:
            fp, ts, log_id, held, last = (
                np.r_[w, a] for w, a in zip(window, (fp, ts, log_id, held, last))
            )
        out, window = emit(fp, ts, log_id, held, last, span, limit, eager)
        yield out
    if window is not None and final:
        fp, first, log_id, held, last = window
        yield pd.DataFrame(
            {"fp": [fp], "kind": [FLUSH], "n": [held], "first": [first], "last": [last], "log_id": [log_id]}
        )


def _check_order(fp, previous):
    if (fp[1:] < fp[:-1]).any() or (previous is not None and fp[0] < previous):
        raise RuntimeError("window index lost its order within a partition")


def emit(fp, ts, log_id, held, last, span, limit, eager):
    n = len(fp)
    run, nxt = _next_starts(fp, ts, held, span, limit)
    step = nxt.tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = step[at]
    starts = np.array(starts)
    ends = np.r_[starts[1:], n]
    count = ends - starts + np.maximum(held[starts] - 1, 0)
    at_run_end = np.isin(ends, np.r_[run[1:], n])
    kind = np.where(count >= limit, THRESHOLD, np.where(at_run_end, FLUSH, EXPIRED))
    fresh = np.isin(starts, run) | np.r_[True, kind[:-1] == THRESHOLD] | eager
    fresh &= held[starts] == 0
    closed = np.ones(len(starts), bool)
    window = None
    if kind[-1] == FLUSH:  # may go on in the next batch or slice
        closed[-1] = False
        s = starts[-1]
        window = (int(fp[s]), int(ts[s]), int(log_id[s]), int(count[-1]), int(last[-1]))
    new, old = starts[fresh], starts[closed]
    out = pd.DataFrame(
        {
            "fp": np.r_[fp[new], fp[old]],
            "kind": np.r_[np.full(len(new), NEW), kind[closed]].astype(np.int32),
            "n": np.r_[np.ones(len(new), np.int64), count[closed]],
            "first": np.r_[ts[new], ts[old]],
            "last": np.r_[ts[new], last[ends[closed] - 1]],
            "log_id": np.r_[log_id[new], log_id[old]],
        }
    )
    return out, window
