"""Periodic runs of words: suffix classes united by decreasing common prefix.

Method. The words of a document are numbered and its suffixes sorted. Edges between neighbours in that order are taken by
decreasing common prefix, as in Kruskal's algorithm: each unites two classes of suffixes, whose ordered sets of positions are
merged, the smaller into the larger. Two positions that become neighbours in a set when the common prefix is l are the
first two occurrences of a string of l words at that distance d, so words from the first one repeat with period d for d + l
words. Where l is long enough for the exponent asked for and the word before does not go on with the period, that is a
run, with its smallest period: a smaller one would have put another position between the two. Every run comes about in this
way, at the level of its length less its period.

An edge below ``least_prefix`` words can seed no run, so only suffixes whose first so many words occur twice in their
document are sorted. Hashes choose them, and a chance meeting of hashes only lets one more in; what follows compares word
numbers. Sorting is by doubled prefixes, common prefixes follow from one suffix to the next in text order.

Scale. No shuffle: a document is judged where its row is, documents together in slices of about a megabyte, a longer one alone.

Defined results. Words are runs of anything but white space (blank, tab to carriage return). Null and empty texts, and those of
white space only, have no words, no runs and an empty collapsed text. A null identifier and repeated rows are documents of
their own. No rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, batches, texts
from .rolling import mixed, row_slices

MIN_LENGTH, EXPONENT = 6, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def least_prefix(min_length: int, exponent: int) -> int:
    """The shortest common prefix that a run's first two periods can have."""
    return min(max(min_length - q, (exponent - 1) * q) for q in range(1, max(2, min_length)))


def _repeated(ids: np.ndarray, doc: np.ndarray, end_of: np.ndarray, k: int) -> np.ndarray:
    """Positions whose ``k`` words occur again in their document, and at times others."""
    at = np.flatnonzero(np.arange(len(ids)) + k <= end_of)
    value = mixed(doc[at].astype(np.uint64))
    for step in range(k):
        value = mixed(value * _STEP + ids[at + step].astype(np.uint64))
    order = np.argsort(value)
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = value[order[1:]] == value[order[:-1]]
    return np.sort(at[order[same[1:] | same[:-1]]])


def _sorted_suffixes(ids: np.ndarray, doc: np.ndarray, end_of: np.ndarray, kept: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Neighbours, in the order of suffixes, of those kept that share ``k`` words or more within a document."""
    border = kept + k
    places = np.union1d(kept, border[border < end_of[kept]])
    keys = []
    for step in reversed(range(k)):
        inside = places + step < end_of[places]
        keys.append(np.where(inside, ids[np.minimum(places + step, len(ids) - 1)], -1))
    order = np.lexsort((*keys, doc[places]))
    places = places[order]
    fresh = np.ones(len(places), bool)
    fresh[1:] = doc[places[1:]] != doc[places[:-1]]
    for key in keys:
        fresh[1:] |= key[order[1:]] != key[order[:-1]]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
    rank = np.full(len(ids), -1, np.int64)
    rank[places] = first
    groups = first  # of k words: neighbours are asked for within these
    length = k
    while True:
        sizes = np.bincount(first, minlength=len(places))
        open_at = np.flatnonzero(sizes[first] > 1)
        if not len(open_at):
            break
        here = places[open_at]
        then = here + length
        after = np.where(then < end_of[here], rank[np.minimum(then, len(ids) - 1)], -1)
        order = np.lexsort((after, first[open_at]))
        here, after, old = here[order], after[order], first[open_at]
        places[open_at] = here
        changed = np.ones(len(here), bool)
        changed[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
        first = first.copy()
        first[open_at] = np.maximum.accumulate(np.where(changed, open_at, 0))
        rank[here] = first[open_at]
        length *= 2
    together = np.flatnonzero(groups[1:] == groups[:-1])
    return list(zip(places[together].tolist(), places[together + 1].tolist(), strict=True))


def _common_prefixes(ids: list[int], end_of: list[int], pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(common prefix, a, b) of neighbours that share ``k`` words; what one shares, the next in the text shares but for a word."""
    before = {b: a for a, b in pairs}
    out, held, last = [], 0, -2
    for b in sorted(before):
        a = before[b]
        held = max(held - 1, k) if b == last + 1 else k
        most = end_of[a] - max(a, b)
        while held < most and ids[a + held] == ids[b + held]:
            held += 1
        out.append((held, a, b))
        last = b
    return out


def _seeds(edges: list[tuple[int, int, int]], min_length: int, exponent: int) -> dict[tuple[int, int], int]:
    """(position, distance) -> common prefix, of positions that become neighbours and may begin a run."""
    edges.sort(key=lambda e: -e[0])
    above: dict[int, int] = {}
    sets: dict[int, list[int]] = {}
    seeds: dict[tuple[int, int], int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for level, united in groupby(edges, lambda e: e[0]):
        moved: list[int] = []
        for _, a, b in united:
            a, b = top(a), top(b)
            large, small = sets.pop(a, None) or [a], sets.pop(b, None) or [b]
            if len(large) < len(small):
                a, b, large, small = b, a, small, large
            if 8 * len(small) > len(large):
                large = sorted(large + small)  # two ordered runs are merged
            else:
                for x in small:
                    insort(large, x)
            moved += small
            above[b], sets[a] = a, large
        # Neighbours are looked at when all classes of a level are united.
        widest = level // (exponent - 1)
        narrowest = min_length - level
        for x in moved:
            members = sets[top(x)]
            at = bisect_left(members, x)
            for i in (at, at + 1):
                if 0 < i < len(members):
                    d = members[i] - members[i - 1]
                    if narrowest <= d <= widest:
                        seeds.setdefault((members[i - 1], d), level)
    return seeds


def runs_of(words: list[list], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[Run]]:
    """The runs of each document's words, by start, then period."""
    k = least_prefix(min_length, exponent)
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for document in words for w in document]
    ends = np.cumsum([0, *map(len, words)])
    found: list[list[Run]] = [[] for _ in words]
    held = np.array(ids, np.int64)
    doc = np.repeat(np.arange(len(words)), np.diff(ends))
    end_of = ends[1:][doc]
    kept = _repeated(held, doc, end_of, k)
    if not len(kept):
        return found
    pairs = _sorted_suffixes(held, doc, end_of, kept, k)
    edges = _common_prefixes(ids, end_of.tolist(), pairs, k)
    for (p, d), level in sorted(_seeds(edges, min_length, exponent).items()):
        document = int(doc[p])
        start = int(ends[document])
        if p == start or ids[p - 1] != ids[p + d - 1]:
            found[document].append((p - start, level + d, d))
    return found


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exponent; of equal ones the first, then the one of the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = (
    "doc_id long, runs array<struct<start: long, length: long, period: long>>, "
    "strongest struct<start: long, length: long, period: long>, collapsed string"
)


def _judged(min_length: int, exponent: int) -> Callable:
    def named(run: Run | None) -> dict | None:
        return run and dict(zip(("start", "length", "period"), run, strict=True))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            column = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            for a, b in row_slices(np.diff(offsets)):
                words = [text.split() for text in column[a:b].to_pylist()]  # of bytes: at ASCII white space
                found = runs_of(words, min_length, exponent)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([list(map(named, runs)) for runs in found], pa.list_(_RUN)),
                        pa.array([named(strongest(runs)) for runs in found], _RUN),
                        pa.array(
                            [b" ".join(collapsed(w, runs)) for w, runs in zip(words, found, strict=True)], pa.binary()
                        ).cast(pa.string()),
                    ],
                    ["doc_id", "runs", "strongest", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    exponent: int = EXPONENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), strongest (or null), collapsed: a row per row of ``docs``.

    A run is a stretch of at least ``min_length`` words and ``exponent`` periods that no word beside it carries on; word numbers
    count from 0. ``collapsed`` holds the words that no run holds after its first period, joined by blanks.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    return texts(docs, id_col, text_col).mapInArrow(_judged(min_length, exponent), _SCHEMA)


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where about a tenth of the texts repeat from some word on.

    With h the checksum of the decimal identifier, g = h div 10 and n words: if h ends in 0, words from a = g mod n on are those
    of a stretch of p = 1 + (n - a) div (3 + g mod 8) words, again and again. A text without identifier stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = texts(docs, id_col, text_col).withColumn("h", h)
    marked = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    words = F.when(marked, F.array_remove(F.split("text", WHITE_SPACE + "+"), ""))
    rows = rows.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), words.alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("left", n - F.col("a"))
    rows = rows.withColumn("p", 1 + F.floor(F.col("left") / (3 + F.col("g") % 8)))

    def part(array: Column | str, start: Column, length: Column) -> Column:
        return F.slice(array, start.cast("int"), length.cast("int"))

    unit = part("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(unit, F.ceil(F.col("left") / F.col("p")).cast("int")))
    edited = F.concat(part("words", F.lit(1), F.col("a")), part(again, F.lit(1), F.col("left")))
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(edited, " ")).alias("text"))


def run_digests(judged: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the collapsed text."""

    def line(run: Column) -> Column:
        return F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))

    lines = F.array_join(F.transform("runs", line), "")
    top = F.col("strongest")
    return judged.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
