"""Removal of repeated byte strings of ``LENGTH`` bytes with suffix arrays by linear grouping.

Rule. A byte goes if a string of ``LENGTH`` bytes of its document covers it that also starts earlier: in a document of
a smaller identifier, or further left in the same one. Strings are judged on the input.

Method. Every string of ``LENGTH`` bytes has an anchor, the substring of ``ANCHOR`` bytes with the least hash, so equal
strings meet where their anchors do. Neighbouring strings of one anchor make a segment; a document's strings fall
into few segments. Equal segments collapse to their first occurrence, inside each task before the shuffle (a passage
that a third of all rows hold then arrives once per task), and all later ones are repeats whole. Different
segments of one anchor are compared by a suffix array: their bytes are parsed at hashed cuts into phrases, the suffixes
of the phrase sequences are sorted by linear grouping (``suffix_sort``), and two strings are equal if their phrases lie in
one interval of that array and the few bytes before the first and after the last cut agree. Of each set of equal
strings all but the first are repeats. Sorting phrases, not bytes, makes the array about eight times shorter.

Scale. Two shuffles of fixed-width rows (one per segment, about a 30th of the bytes), one of the texts of open segments, two of
whole texts to bring results home; all streamed in sorted order. Only the different segments of one anchor are held together.
Shuffle files go as soon as what they made is written.

Defined results. A null text is empty. Texts shorter than ``LENGTH`` bytes lose nothing. A null identifier comes after all
others. Rows with equal identifier and text are one document: repeats of a row are not repeats of its text, and all its rows
get the same result. Different texts under one identifier are different documents. No rows give no rows; other
columns are not looked at. Kept bytes may end inside a character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffles_dropped, written
from .common import batches, column, texts, tidy
from .rolling import PrefixHash, mixed, row_slices, text_bytes
from .suffix_sort import shared_prefixes, suffix_array

LENGTH = 100
ANCHOR = 32
FLUSH = 500_000
CHUNK_BYTES = 1 << 19
CUT_BYTES = 4

# A document is an identifier and a mark, the 64-bit hash of its text. A place packs start, strings in the segment less one
# (7 bits) and the anchor's offset (7).
_N, _AT = 7, 7
PLACE = "id long, mark long, place long"


def _pack(start: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    return start << 14 | (n - 1) << 7 | at


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 14, (place >> 7 & 0x7F) + 1, place & 0x7F


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` neighbours, from running minima of blocks in both directions."""
    filled = np.concatenate([x, np.full(-len(x) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    forward = np.minimum.accumulate(filled, axis=1).ravel()
    backward = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(backward[:m], forward[w - 1 : w - 1 + m])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Key, hash, text, start in the text, number of strings and anchor offset of each segment of a buffer of texts."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 4))
    if len(data) < length:
        return none
    prefix = PrefixHash(data)
    hashes = mixed(prefix.all_of(anchor))
    # A long text has a run of its own, so positions may need more than 24 bits; the hash keeps the rest.
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _sliding_least(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), length - anchor + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    p = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][text])
    if not len(p):
        return none
    at, of = (least[p] & low).astype(np.int64), text[p]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    last = np.append(first[1:], len(p)) - 1
    start, end, at, of = p[first], p[last] + length, at[first], of[first]
    own = mixed(PrefixHash(data, 1).raw(start, end) + (at - start).astype(np.uint64))
    return hashes[at], own, of, start - offsets[of], p[last] - p[first] + 1, at - start


def _segment_rows(length: int, anchor: int) -> Callable:
    names = ["key", "segment", "id", "mark", "place"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def firsts() -> pa.RecordBatch:
            key, own, doc, mark, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, mark, doc, own, key))
            key, own, doc, mark, place = (x[order] for x in (key, own, doc, mark, place))
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
            # Later ones are repeats already: a negative place, and a key that spreads them evenly.
            key = np.where(fresh, key, mixed(mixed(doc.astype(np.uint64) + mark.view(np.uint64)) + place.astype(np.uint64)))
            lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            same = ~fresh & (doc == doc[lead]) & (mark == mark[lead]) & (place == place[lead])
            place = np.where(fresh, place, -1 - place)
            return pa.RecordBatch.from_arrays(
                [pa.array(x[~same]) for x in (key.view(np.int64), own.view(np.int64), doc, mark, place)], names
            )

        for batch in batches(source):
            data, offsets = text_bytes(batch.column(2))
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in row_slices(np.diff(offsets)):
                key, own, of, start, n, at = segments(
                    data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, anchor
                )
                of = of + a
                held.append((key, own, ids[of], marks[of], _pack(start, n, at)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield firsts()
                held.clear()
        if sum(len(x[0]) for x in held):
            yield firsts()

    return run


def _by_key(source: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], int], most: int) -> Iterator[pa.Table]:
    """Whole keys of rows that come sorted by key, about ``most`` of size at a time."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches(source):
        held.append(batch)
        total += size(batch)
        values = batch.column(0).to_numpy()
        if total >= most and values[0] != values[-1]:
            cut = len(values) - int(np.argmax(values[::-1] != values[-1]))  # where the last key begins
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
            total = size(held[0])
    if held:
        yield pa.Table.from_batches(held)


def _judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and segment: repeats (place negative) and first segments that must be compared."""
    for rows in _by_key(source, lambda b: b.num_rows, 1 << 16):
        key, own, doc, mark, place = (rows.column(i).to_numpy() for i in range(5))
        names = ["key", "id", "mark", "place"]
        known = place < 0
        yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in (key, doc, mark, place)], names)
        key, own, doc, mark, place = (x[~known] for x in (key, own, doc, mark, place))
        order = np.lexsort((place, mark, doc, own, key))
        key, own, doc, mark, place = (x[order] for x in (key, own, doc, mark, place))
        if not len(key):
            continue
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = new_key | np.concatenate([[True], own[1:] != own[:-1]])
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        repeat = ~fresh & ((doc != doc[lead]) | (mark != mark[lead]) | (place != place[lead]))
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, weights=fresh)[group] > 1
        held = repeat | (fresh & several)
        place = np.where(repeat, -1 - place, place)
        yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (key, doc, mark, place)], names)


def _cut_out(length: int) -> Callable:
    """The bytes of each document's open segments."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets = text_bytes(batch.column(2))
            lists = batch.column(3)
            inner = lists.flatten()
            key, place = inner.field(0), inner.field(1).to_numpy()
            counts = np.diff(lists.offsets.to_numpy())
            start, n, _ = _unpack(place)
            start = start + np.repeat(offsets[:-1], counts)
            end = start + n + length - 1
            raw = data.tobytes()
            found = pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
            id_, mark = (pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([key, id_, mark, pa.array(place), found], ["key", "id", "mark", "place", "bytes"])

    return run


def equal_strings(data: np.ndarray, offsets: np.ndarray, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every string of ``length`` bytes in the given segments, and a number that equal ones share.

    ``strings``: how many strings begin in each segment.
    """
    size = np.diff(offsets)
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data))
    # A cut falls behind four bytes of one segment, an eighth of all places.
    behind = np.zeros(len(data) + 1, bool)
    prefix = PrefixHash(data)
    if len(data) >= CUT_BYTES:
        behind[CUT_BYTES:] = mixed(prefix.all_of(CUT_BYTES)) >> np.uint64(61) == 0
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = at + 1 - offsets[:-1][of] >= CUT_BYTES
    cuts = np.flatnonzero(behind & inside)
    segment = of[cuts - 1]
    ends = np.append(segment[1:] != segment[:-1], True) if len(cuts) else np.zeros(0, bool)
    # One symbol per cut: the phrase up to the next cut, or 1 at a segment's last cut; 0 ends all.
    following = np.append(cuts[1:], 0)
    held = ~ends
    symbols = np.ones(len(cuts) + 1, np.int64)
    phrases = prefix.raw(cuts[held], following[held])
    symbols[:-1][held] = np.unique(phrases, return_inverse=True)[1] + 2
    symbols[-1] = 0
    order = np.array(suffix_array(symbols), np.int64)
    shared = shared_prefixes(symbols, order, stop=1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # The strings, the first cut behind their first bytes and the last cut inside them.
    start = np.flatnonzero(at - offsets[:-1][of] < strings[of])
    before = np.concatenate([[0], np.cumsum(behind & inside)])
    x, y = before[start + CUT_BYTES], before[start + length + 1] - 1
    parsed = y >= x
    phrase_count = np.where(parsed, y - x, -1)
    interval = np.zeros(len(start), np.int64)
    for n in np.unique(phrase_count[phrase_count >= 0]).tolist():
        which = np.flatnonzero(phrase_count == n)
        interval[which] = np.cumsum(shared < n)[rank[x[which]]]
    positions = np.append(cuts, 0)
    head_end = np.where(parsed, positions[np.minimum(x, len(cuts))], start + length)
    tail_start = np.where(parsed, positions[np.maximum(y, 0)], start + length)
    number = mixed((interval + 1).astype(np.uint64) * np.uint64(64) + (phrase_count + 1).astype(np.uint64))
    number = mixed(number + prefix.raw(start, head_end) + (head_end - start).astype(np.uint64))
    number = mixed(number + prefix.raw(tail_start, start + length))
    return start, number


def _compare(length: int) -> Callable:
    """Repeated strings among different segments of one key, as places of runs (place packs their start and number)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(source, lambda b: text_bytes(b.column(4))[1][-1], CHUNK_BYTES):
            key, doc, mark, place = (rows.column(i).to_numpy() for i in range(4))
            data, offsets = text_bytes(rows.column(4))
            begin, n, _ = _unpack(place)
            start, number = equal_strings(data, offsets, n, length)
            of = np.searchsorted(offsets, start, side="right") - 1
            where = start - offsets[of] + begin[of]
            # By key too: strings of different keys differ.
            number = mixed(number + key[of].view(np.uint64))
            order = np.lexsort((where, mark[of], doc[of], number))
            same = number[order][1:] == number[order][:-1]
            repeat = np.zeros(len(start), bool)
            repeat[order[1:][same]] = True
            hit = np.flatnonzero(repeat)
            if not len(hit):
                continue
            first = np.concatenate([[True], (np.diff(hit) > 1) | (of[hit][1:] != of[hit][:-1])])
            opening = hit[first]
            count = np.diff(np.append(np.flatnonzero(first), len(hit)))
            own = of[opening]
            packed = _pack(where[opening], count, np.zeros(len(own), np.int64))
            found = (doc[own], mark[own], -1 - packed)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "mark", "place"])

    return run


def _without(length: int, as_text: bool) -> Callable:
    """Takes text, places and columns to carry along; gives the carried ones, sizes and what is kept."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets = text_bytes(batch.column(0))
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            start, n, _ = _unpack(-1 - lists.flatten().to_numpy(zero_copy_only=False))
            start = start + np.repeat(offsets[:-1], counts)
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, start + n + length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            opens = np.zeros(len(data) + 1, bool)
            opens[offsets] = True
            runs = gone & (~np.concatenate([[False], gone[:-1]]) | opens[:-1]) if len(data) else gone
            whole = data[~gone].tobytes()
            sums = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, runs, ~gone)]
            kept = [whole[a:b] for a, b in zip(sums[2][:-1].tolist(), sums[2][1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(sums[0])),
                    pa.array(np.diff(sums[1])),
                    pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
                ],
                ["carried", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def _removed(docs: DataFrame, carried: list[str], as_text: bool, length: int, anchor: int, id_col: str, text_col: str) -> DataFrame:
    """carried (a struct of the named columns), n_bytes, n_removed, n_spans, kept."""
    if not CUT_BYTES < anchor < length or length - anchor >= 1 << _N:
        raise ValueError("an anchor is shorter than a string, by less than 128 bytes")
    named = texts(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64("text").alias("mark"), "text"
    )
    rows = named.mapInArrow(tidy(_segment_rows(length, anchor)), "key long, segment long, " + PLACE)
    meeting = rows.repartition("key").sortWithinPartitions("key", "segment")
    with shuffles_dropped(docs.sparkSession):
        judged = written(meeting.mapInArrow(tidy(_judge), "key long, " + PLACE), "judged")
    opened = (
        judged.filter("place >= 0")
        .groupBy("id", "mark")
        .agg(F.collect_list(F.struct("key", "place")).alias("open"))
    )
    pieces = (
        named.join(opened, ["id", "mark"])
        .select("id", "mark", "text", "open")
        .mapInArrow(tidy(_cut_out(length)), "key long, " + PLACE + ", bytes binary")
    )
    compared = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_compare(length)), PLACE)
    with shuffles_dropped(docs.sparkSession):
        repeats = written(judged.filter("place < 0").select("id", "mark", "place").unionByName(compared), "repeats")
    by_text = repeats.groupBy("id", "mark").agg(F.collect_list("place").alias("places"))
    whole = docs.select(
        F.struct(*[column(c) for c in carried]).alias("carried"),
        F.coalesce(column(text_col), F.lit("")).alias("text"),
        F.coalesce(column(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"),
    ).withColumn("mark", F.xxhash64("text"))
    joined = whole.join(by_text, ["id", "mark"], "left").select(
        "text", F.coalesce("places", F.array().cast("array<long>")).alias("places"), "carried"
    )
    schema = T.StructType(
        [
            T.StructField("carried", joined.schema["carried"].dataType),
            *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
            T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
        ]
    )
    return joined.mapInArrow(tidy(_without(length, as_text)), schema)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the other bytes): one row per row of ``docs``."""
    found = _removed(docs, [id_col], False, length, anchor, id_col, text_col)
    return found.select(F.col("carried")[id_col].cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def with_kept_text(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the kept text in place of the text, and ``n_chars``, if there is such a column, made to fit it.

    A row that loses nothing keeps its text, null or not. Fragments of characters at the seams are dropped.
    """
    found = _removed(docs, docs.columns, True, length, anchor, id_col, text_col)
    changed = F.col("n_removed") > 0

    def out(name: str) -> Column:
        old = F.col("carried")[name]
        if name == text_col:
            return F.when(changed, F.col("kept")).otherwise(old).alias(name)
        if name == "n_chars":
            return F.when(changed, F.length("kept").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return found.select(*[out(c) for c in docs.columns])


def removal_digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
