"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Method. A text's shingles are its strings of ``SHINGLE`` bytes. Each is hashed once; the hash's upper bits choose one of ``BINS``
bins, and a bin keeps its least value. An empty bin j tries bins given by a hash of (j, attempt), the same for all texts,
until one holds a value of its own, and takes that (optimal densification: every empty bin borrows independently). Of each
value, mixed with its bin's number, the lowest ``BITS`` bits are kept, packed and written in hexadecimal. Two fingerprints agree in a bin with a probability of
J + (1 - J) / 2**BITS for a similarity J of the sets, so the share of agreeing bins, less what chance gives, estimates J.

The next document. Rows are dealt to ranges of (identifier, hash of the text, file, position), cut at sampled rows.
Those rows are known, so the first row of each range goes, as a guard, to the end of the range before as well. Every range is then
sorted, and each row meets its follower inside its own task: one shuffle of texts, and nothing crosses tasks.

Defined results. A null text is empty. An empty text has an empty fingerprint, like another empty one (1) and unlike all others
(0). A shorter text than a shingle is one shingle. Of equal identifiers the order is that of texts' hashes; null identifiers
come last; repeated rows follow one another. The only row of a table is followed by itself. No rows give no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, column, keyed, texts
from .ranges import splitters
from .rolling import PrefixHash, mixed, row_slices, text_bytes

SHINGLE = 10
BINS, BITS = 512, 4
_EMPTY = np.uint64(2**64 - 1)


def least_values(data: np.ndarray, offsets: np.ndarray, bins: int = BINS, shingle: int = SHINGLE) -> np.ndarray:
    """One row of ``bins`` least values for each text; all bins of an empty text, and no others, stay empty."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.full(n * bins, _EMPTY)
    hashes = PrefixHash(data)
    ends = np.repeat(offsets[1:], sizes)
    at = np.flatnonzero(np.arange(len(data)) + shingle <= ends)
    values = [hashes.all_of(shingle)[at]] if len(at) else []
    of = [np.repeat(np.arange(n), np.maximum(sizes - shingle + 1, 0))]
    short = np.flatnonzero((sizes > 0) & (sizes < shingle))
    values.append(hashes.raw(offsets[short], offsets[short + 1]))
    of.append(short)
    value, of = mixed(np.concatenate(values)), np.concatenate(of)
    upper = np.uint64(64 - (bins.bit_length() - 1))
    np.minimum.at(out, of * bins + (value >> upper).astype(np.int64), value & ((np.uint64(1) << upper) - np.uint64(1)))
    return _densified(out.reshape(n, bins))


def _densified(values: np.ndarray) -> np.ndarray:
    n, bins = values.shape
    own = values != _EMPTY
    empty = np.flatnonzero((~own & own.any(axis=1, keepdims=True)).ravel())
    flat, held = values.ravel(), own.ravel()
    attempt = 0
    while len(empty):
        attempt += 1
        row, j = empty // bins, empty % bins
        probe = (mixed((j + attempt * bins).astype(np.uint64)) & np.uint64(bins - 1)).astype(np.int64)
        source = row * bins + probe
        hit = held[source]
        flat[empty[hit]] = flat[source[hit]]
        empty = empty[~hit]
    return values


def low_bits(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The lowest bits of values mixed with their bins, so that what bins have borrowed does not meet by chance in all of them."""
    salt = np.arange(values.shape[1], dtype=np.uint64) << np.uint64(55)
    return (mixed(values ^ salt) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(low: np.ndarray, filled: np.ndarray, bits: int = BITS) -> list[str]:
    """Fingerprints in hexadecimal, the first bin in the highest bits; empty for empty texts."""
    spread = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    rows = np.packbits(spread.reshape(len(low), -1).astype(bool), axis=1)
    return [row.tobytes().hex() if held else "" for row, held in zip(rows, filled.tolist(), strict=True)]


def likenesses(a: np.ndarray, b: np.ndarray, filled_a: np.ndarray, filled_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated similarities of two lists of texts, by their low bits."""
    chance = 0.5**bits
    near = np.maximum(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0)
    return np.where(filled_a & filled_b, near, (filled_a == filled_b).astype(float))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated similarity, 0 to 1, of two fingerprints of ``BITS`` (four) bits, of which a bin is a digit."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda equal: equal))
    chance = 0.5**BITS
    near = F.greatest((same / bins - chance) / (1 - chance), F.lit(0.0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(near)


class _Marks:
    """Low bits and fingerprints of a list of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = low_bits(least_values(data, offsets))
        self.filled = np.diff(offsets) > 0
        self.names = packed(self.low, self.filled)


def _marked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        data, offsets = text_bytes(batch.column(1))
        for a, b in row_slices(np.diff(offsets)):
            marks = _Marks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(marks.names)], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: one row per row of ``docs``, without a shuffle."""
    return texts(docs, id_col, text_col).mapInArrow(_marked, "doc_id long, fingerprint string")


# --- each document beside the next ------------------------------------------------------

_KEY = ["none", "id", "mix", "file", "at"]
_DEALT = "none boolean, id long, mix long, file long, at long, text string, range int, guard boolean"
_PAIRED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _dealt(cuts: list[tuple]) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(_KEY))], strict=True))
            ranges = [bisect_right(cuts, key) - 1 for key in keys]
            guards = [i for i, key in enumerate(keys) if cuts[ranges[i]] == key]
            before = [(ranges[i] - 1) % len(cuts) for i in guards]
            for rows, of, guard in ((batch, ranges, False), (batch.take(pa.array(guards, pa.int64())), before, True)):
                columns = [*rows.columns, pa.array(of, pa.int32()), pa.array([guard] * len(of), pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "range", "guard"])

    return run


def _edited(text: str, then: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + then[:cut]


def _beside_next(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order, the guard last; each is told once its follower is there."""
    waiting: tuple | None = None  # range, guard, id, text, low bits, whether it has any, fingerprint
    for batch in batches(source):
        data, offsets = text_bytes(batch.column(5))
        ids = [None if none else i for none, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        ranges, guard = batch.column(6).to_pylist(), batch.column(7).to_pylist()
        for a, b in row_slices(np.diff(offsets)):
            marks = _Marks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            rows = list(
                zip(ranges[a:b], guard[a:b], ids[a:b], batch.column(5)[a:b].to_pylist(), marks.low, marks.filled, marks.names, strict=True)
            )
            rows = rows if waiting is None else [waiting, *rows]
            waiting = rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1]]
            if not pairs:
                continue
            if any(x[0] != y[0] for x, y in pairs):
                raise RuntimeError("a range has lost its guard")
            changed = [_edited(x[3], y[3]).encode() for x, y in pairs]
            other = _Marks(np.frombuffer(b"".join(changed), np.uint8), np.cumsum([0, *map(len, changed)]))
            low, filled = np.stack([x[4] for x, _ in pairs]), np.array([x[5] for x, _ in pairs])
            low_next, filled_next = np.stack([y[4] for _, y in pairs]), np.array([y[5] for _, y in pairs])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(text).hexdigest() for text in changed]),
                    pa.array([x[6] for x, _ in pairs]),
                    pa.array(other.names),
                    pa.array(likenesses(low, other.low, filled, other.filled)),
                    pa.array(likenesses(low, low_next, filled, filled_next)),
                ],
                [part.split()[0] for part in _PAIRED.split(", ")],
            )


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of ``docs``.

    In a document's edited text its last quarter (rounded down, in characters) gives way to as much of the next document's
    beginning, by identifier; the first document follows the last. ``parts``: ranges, by default the shuffle's partitions.
    """
    rows, key = keyed(docs)
    text = F.coalesce(column(text_col), F.lit(""))
    own = column(id_col).cast("long")
    rows = rows.select(
        own.isNull().alias("none"),
        F.coalesce(own, F.lit(0)).alias("id"),
        F.xxhash64(text).alias("mix"),
        column(key)["file"].alias("file"),
        column(key)["at"].alias("at"),
        text.alias("text"),
    )
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(rows.select(*_KEY), F.xxhash64("file", "at"), parts)
    return (
        rows.mapInArrow(_dealt(cuts), _DEALT)
        .repartitionById(max(len(cuts), 1), F.col("range"))
        .sortWithinPartitions("range", "guard", *_KEY)
        .mapInArrow(_beside_next, _PAIRED)
    )
