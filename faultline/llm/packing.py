"""Hierarchical packing of token sequences into windows of several lengths.

Method. Documents become token ids with an end mark. Whole top-length windows are cut off first; what is
left of a document is routed to the shortest tier that holds it. Each tier is packed from the longest
down: a window opens with one of its own documents, its gap is filled by the largest shorter-tier
documents that fit, and last by cutting the head off one. A window that nothing is left to fill is cut
into windows of the next powers of two, so every sequence is full. Less than the shortest tier is carried
into the next pool, and at the end of a task cut into powers of two (a dozen short sequences a task).
Sequences of a pool are dealt to step groups of about ``STEP_TOKENS``, always to the emptiest.

All of it runs where the rows are: no shuffle, one pool of about ``POOL_TOKENS`` ids (or one document,
if larger) in memory, numbers made from the task's partition. Tokens are found once for each different
blank-separated word of a batch (the tokenizer drops white space and never joins words across it).

Defined results. A null text is empty; an empty document is its end mark alone. Null identifiers and
repeated rows are documents of their own. No rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts, tidy, worker_memory
from .token_counts import word_lists

TIERS = (256, 512, 1024, 2048, 4096)
POOL_TOKENS = 1 << 20
STEP_TOKENS = 8 * 4096
CACHED_WORDS = 1_000_000
JOINED = 500
WORD_END = "</w>"

_LATIN = re.compile("[\\0-\u00ff]*")  # of these characters none composes with another
_LETTERS = "[a-z\u00df-\u00f6\u00f8-\u00ff]+"
_PLAIN = re.compile(_LETTERS)
_MARKED = re.compile(f"({_LETTERS})([.,;:!?]+)")

FIELDS = {
    "doc_id": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "ids": pa.binary(),
    "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(),
    "offset": pa.int64(),
    "window": pa.int64(),
    "step_group": pa.int64(),
}
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, step_group long"


class WordTokens:
    """Token ids of texts, found word by word with a bounded memory of words."""

    def __init__(self, tokenizer_path: str, end_id: int, most: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.end_id, self.most = end_id, most
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _folded(self, word: str) -> str:
        """The word in lower case, if that changes no id: the tokenizer composes characters and finds added tokens before it lower-cases."""
        if not word.isascii() and not _LATIN.fullmatch(word):
            return word
        low = word.lower()
        return word if self.special.search(low) else low

    def _places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))

    def _gathered(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at some places of the tables, one after another, and where each word's end."""
        starts, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        reach = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(reach[-1], dtype=np.int32)
        at += np.repeat((starts - reach[:-1]).astype(np.int32), sizes)  # a batch's ids and the tables are far below 2**31
        return self.ids[at], reach

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of words in the tables, after adding those that are missing."""
        place = self._places(words)
        missing = np.flatnonzero(place < 0)
        if not len(missing):
            return place
        if len(self.known) + 2 * len(missing) > self.most:
            # Keep what this batch uses, which holds the common words.
            held = np.flatnonzero(place >= 0)
            ids, ends = self._gathered(place[held])
            self._forget()
            self.ids, self.ends = ids, ends
            self.known = dict(zip([words[i] for i in held.tolist()], range(len(held)), strict=True))
            place[held] = np.arange(len(held))
        fresh = [words[i] for i in missing.tolist()]
        folded = list(map(self._folded, fresh))
        new = [w for w in dict.fromkeys(folded) if w not in self.known]
        # A mark never joins the letters before it, so such a word is its letters' ids, then its mark's.
        cut = {w: m.groups() for w, m in zip(new, map(_MARKED.fullmatch, new), strict=True) if m}
        units = dict.fromkeys([w for w in new if w not in cut])
        units.update(dict.fromkeys([u for parts in cut.values() for u in parts]))
        self._add([u for u in units if u not in self.known])
        if cut:
            flat, reach = self._gathered(self._places([u for parts in cut.values() for u in parts]))
            self._append(list(cut), flat, np.diff(reach[::2]))
        self.known.update(zip(fresh, map(self.known.__getitem__, folded), strict=True))
        place[missing] = self._places(fresh)
        return place

    def _append(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.ends) - 1
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _add(self, words: list[str]) -> None:
        """Ask the tokenizer: plain words joined by blanks, many in a call, and told apart by the tokens that end a word."""
        plain, others = [], []
        for w, fits in zip(words, map(_PLAIN.fullmatch, words), strict=True):
            (plain if fits else others).append(w)
        lines = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        found = self.tokenizer.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)
        for line, e in zip(lines, found, strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(line) and ends[-1] == len(ids):
                self._append(line, ids, np.diff(ends, prepend=0))
            else:  # a tokenizer that does not mark words' ends
                others += line
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        sizes = np.fromiter(map(len, alone), np.int64, len(alone))
        self._append(others, np.fromiter((i for ids in alone for i in ids), np.int32, int(sizes.sum())), sizes)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Each text's ids with the end mark."""
        words, ends = word_lists(column)
        place = self._learn(words.dictionary.to_pylist())
        if len(words):
            flat, reach = self._gathered(place[words.indices.to_numpy(zero_copy_only=False)])
        else:
            reach, flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        end = np.array([self.end_id], np.int32)
        return [
            np.concatenate([flat[reach[a] : reach[b]], end]) for a, b in zip(ends[:-1], ends[1:], strict=True)
        ]


def word_tokens(tokenizer_path: str, end_id: int) -> WordTokens:
    """One memory of words per Python worker, which its tasks share."""
    held, key = worker_memory(), ("words", tokenizer_path, end_id)
    if key not in held:
        held[key] = WordTokens(tokenizer_path, end_id)
    return held[key]


# A part of a document: (doc_id, all its ids, first, end).
Part = tuple[int | None, np.ndarray, int, int]


class Packer:
    """Turns parts of documents into full sequences, a pool at a time."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tuple(sorted(tiers)), step_tokens
        self.base = partition << 36
        self.n_sequences = self.n_steps = 0
        self.carried: list[Part] = []
        self.rows: list[tuple] = []
        self.made: list[tuple[int, list[Part]]] = []

    def _emit(self, parts: list[Part]) -> None:
        self.made.append((sum(p[3] - p[2] for p in parts), parts))

    def _windows(self, parts: list[Part], sizes: list[int]) -> list[Part]:
        """Cut a run of parts into full windows of the given sizes, largest first; the rest."""
        left = sum(p[3] - p[2] for p in parts)
        parts = list(reversed(parts))
        for size in sizes:
            while left >= size:
                window, gap = [], size
                while gap:
                    doc, ids, a, b = parts.pop()
                    cut = min(b, a + gap)
                    window.append((doc, ids, a, cut))
                    if cut < b:
                        parts.append((doc, ids, cut, b))
                    gap -= cut - a
                self._emit(window)
                left -= size
        return list(reversed(parts))

    def pool(self, docs: list[tuple[int | None, np.ndarray]]) -> None:
        top = self.tiers[-1]
        rest: list[Part] = []
        for part in self.carried + [(doc, ids, 0, len(ids)) for doc, ids in docs]:
            doc, ids, a, b = part
            while b - a >= top:
                self._emit([(doc, ids, a, a + top)])
                a += top
            if b > a:
                rest.append((doc, ids, a, b))
        self.carried = []
        # Longest last; keys are lengths, parallel to the parts.
        rest.sort(key=lambda p: p[3] - p[2])
        keys = [p[3] - p[2] for p in rest]

        def put(part: Part) -> None:
            n = part[3] - part[2]
            at = bisect_right(keys, n)
            keys.insert(at, n)
            rest.insert(at, part)

        while rest:
            keys.pop()
            first = rest.pop()
            own = first[3] - first[2]
            window, gap = [first], next(t for t in self.tiers if t >= own) - own
            while gap and rest:
                at = bisect_right(keys, gap) - 1
                if at >= 0:
                    part = rest.pop(at)
                    gap -= keys.pop(at)
                    window.append(part)
                else:  # none fits whole: the head of the shortest one
                    doc, ids, a, b = rest.pop(0)
                    keys.pop(0)
                    window.append((doc, ids, a, a + gap))
                    put((doc, ids, a + gap, b))
                    gap = 0
            if gap:
                self.carried = self._windows(window, list(reversed(self.tiers)))
            else:
                self._emit(window)
        self._number()

    def finish(self) -> None:
        sizes = [1 << k for k in reversed(range(self.tiers[0].bit_length()))]
        self._windows(self.carried, sizes)
        self.carried = []
        self._number()

    def _number(self) -> None:
        """Number the sequences made and deal them to step groups of even size."""
        steps = max(1, round(sum(n for n, _ in self.made) / self.step_tokens))
        load = [(0, s) for s in range(steps)]
        for size, parts in sorted(self.made, key=lambda m: -m[0]):
            held, step = heapq.heappop(load)
            heapq.heappush(load, (held + size, step))
            at = 0
            for doc, ids, a, b in parts:
                self.rows.append(
                    (doc, a, b - a, ids[a:b].astype("<u4").tobytes(), len(ids), self.base + self.n_sequences, at, size,
                     self.base + self.n_steps + step)
                )
                at += b - a
            self.n_sequences += 1
        self.n_steps += steps
        self.made = []

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], list(FIELDS)
    )


def _packed(tokenizer_path: str, end_id: int, tiers: tuple[int, ...], pool_tokens: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path, end_id)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0
        for batch in batches(source):
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1)), strict=True):
                held.append((doc, ids))
                size += len(ids)
                if size >= pool_tokens:
                    packer.pool(held)
                    held, size = [], 0
                    yield _record(packer.taken())
        packer.pool(held)
        packer.finish()
        yield _record(packer.taken())

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    tiers: tuple[int, ...] = TIERS,
    pool_tokens: int = POOL_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset in the sequence, window (its length), step_group. ``tiers`` are powers of two."""
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers are powers of two")
    return texts(docs, id_col, text_col).mapInArrow(
        tidy(_packed(tokenizer_path, end_id, tuple(tiers), pool_tokens), keeps=True), SCHEMA
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "window", "step_group",
    )
