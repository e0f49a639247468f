"""Toxicity by class-conditional Kneser-Ney models of spellings, told by length-normalised likelihoods.

Method. A toxic and an ordinary model predict every byte of every word, and its end, from the ``ORDER`` - 1 bytes before it (the
word's start included): a context that slides along the word. A class discounts its counts by ``DISCOUNT``; what that frees is spread
by backoff counts that both classes share, Kneser-Ney's: in how many different longer strings a shorter one occurs. Contexts shorten
byte by byte from their far end, down to the byte alone. So an expression that a class has rarely or never seen is
judged by shared counts, and says little by itself. A word's log-likelihood ratio is the sum over its bytes. A text is judged by two
ratios normalised by its length in words: the mean of its words' ratios, and the mean of what exceeds ``EXCESS``, which plain prose
cannot outweigh. A logistic curve turns the two into 0 to 1. It is fitted on labelled rows (some ``CALIBRATION`` of the larger class,
all where there are fewer; a documented bound on what fits the curve, counts have none), each scored by counts of the folds that it
is not in.

Counts. A word counts once for each document that holds it. Counts are those of all labelled rows but fold 0, all four folds. Backoff
counts carry no class and are those of all four folds for every model.

Scale. No text is shuffled. Words add up in each task before they meet. Strings meet in groups by the last ``SHORT`` bytes of their
context, where all strings after each context, and all that contexts of more bytes shorten to, are at hand, so that counts, chances and
ratios of a group are columns of one task. Words that start alike share most strings: a part of some ``WORDS_A_PART`` words sends each of
its strings once, as packed bytes, and gets ratios back, so that what is moved and kept follows different strings and not words times
bytes. A group grows with the different strings after its three bytes (the largest has 1.3 % of all). Chances of strings of ``SHORT``
bytes at most, of which there are 2^24 whatever the corpus holds, go to every worker. Shuffle files go as soon as what they
made is written. The commonest words, ``WORDS_HELD`` at most whatever the corpus holds, go with their ratios to every worker
(under 8 MB), so that no hot word is shuffled; every other word of a document meets its ratio in a join. Which words are held
changes no result. Words are told apart by 64-bit hashes; strings by their bytes.

Defined results. Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased, of any length. Null and empty texts
have no words and get the score of ratio 0. A row may have several labels: the highest counts; null ones do not. Without
labels of both kinds every score is 1 if all are toxic, else 0. Null identifiers have no label. Repeated rows are scored
alike, and each counts. No rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, written, written_side
from .common import batches, column, tidy
from .rolling import PrefixHash, mixed, row_slices, text_bytes

ORDER = 12
# Contexts that share this many last bytes meet in one group; chances of strings no longer than this go to every worker.
SHORT = 3
WORDS_A_PART = 10_000
# Fewer places than parts, so that packs stay long.
PARTS_A_PLACE = 4
DISCOUNT = 0.75
EXCESS = 2.5
CALIBRATION = 2_000
WORDS_HELD = 1 << 18
FLUSH = 1_000_000
BATCH_ROWS = 1 << 16
# Files of a level of short strings that is broadcast; all levels may be so at once.
SIDE_BYTES = 1 << 20
FOLDS = (1, 2, 3, 4)
# Model 0 counts all folds, model f all but fold f.
MODELS = (0, *FOLDS)
CLASSES = ("toxic", "ordinary")
COUNTS = [f"{c}_{f}" for f in FOLDS for c in CLASSES]
MEASURES = ["mean", "excess"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class Words:
    """The words of a buffer of texts: starts, ends, hashes, and each text's offsets among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _INSIDE[data]
        opens = np.zeros(len(data) + 1, bool)
        opens[offsets] = True
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        self.starts = np.flatnonzero(inside & (~before | opens[:-1]))
        self.ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
        self.data = _LOWER[data]
        hashes = PrefixHash(self.data).raw(self.starts, self.ends)
        self.hashes, self.first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.offsets = np.searchsorted(self.starts, offsets)

    def spellings(self) -> pa.Array:
        """The bytes of each different word."""
        start, size = self.starts[self.first], self.ends[self.first] - self.starts[self.first]
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.Array.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[at]))]
        )

    def in_texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, word and number of times of each different pair, by text."""
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        pairs, times = np.unique(text * max(len(self.hashes), 1) + self.which, return_counts=True)
        return *np.divmod(pairs, max(len(self.hashes), 1)), times


def _sliced(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    for a, b in row_slices(np.diff(offsets)):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts, of any class and of each, every word is, by task."""
    held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def summed() -> Iterator[pa.RecordBatch]:
        found, first, back = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        spelled = pa.concat_arrays([h[1] for h in held]).take(pa.array(first)).cast(pa.binary())
        columns = (np.concatenate([h[2][:, i] for h in held]) for i in range(len(COUNTS) + 1))
        sums = [pa.array(np.bincount(back, weights=c, minlength=len(found)).astype(np.int64)) for c in columns]
        whole = pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), spelled, *sums], ["word", "spelling", "texts", *COUNTS])
        # A batch is held by the worker and by Spark at once.
        for at in range(0, len(found), BATCH_ROWS):
            yield whole.slice(at, BATCH_ROWS)

    for batch in batches(source):
        data, offsets = text_bytes(batch.column(0))
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, words in _sliced(data, offsets):
            text, word, _ = words.in_texts()
            n, kinds = len(words.hashes), len(COUNTS) + 1
            counts = np.bincount(word * kinds + kind[a:b][text] + 1, minlength=n * kinds).reshape(n, kinds)
            counts[:, 0] = counts.sum(axis=1)
            held.append((words.hashes, words.spellings(), counts.astype(np.int32)))
        if sum(len(x[0]) for x in held) >= FLUSH:
            yield from summed()
            held.clear()
    if held:
        yield from summed()


def _last(string: Column, size: Column) -> Column:
    return F.substring(string, F.octet_length(string) - size + 1, size)


def _grams(spelling: Column, order: int) -> Column:
    """Each byte of a word and its end, after the bytes before it: ``order`` bytes, fewer near the word's start."""
    marked = F.concat(F.lit(b" "), spelling, F.lit(b" "))
    return F.transform(
        F.sequence(F.lit(2), F.octet_length(marked)),
        lambda end: F.substring(marked, F.greatest(end - (order - 1), F.lit(1)), F.least(end, F.lit(order))),
    )


def _context(gram: Column) -> Column:
    return F.substring(gram, F.lit(1), F.octet_length(gram) - 1)


def short_chances(grams: DataFrame) -> DataFrame:
    """tail, chance of strings of ``SHORT`` bytes at most: of the last byte after those before it, by Kneser-Ney counts without class.

    ``grams``: the different strings of ``SHORT`` + 1 bytes, or fewer from a word's start.
    """
    size = F.octet_length("gram")
    longer, kinds = None, {}
    for n in range(SHORT, 0, -1):
        # Strings that shorten to n bytes: those of the level above, and words' first bytes that are as long.
        own = grams.filter(size == n + 1).select("gram")
        from_above = own if longer is None else longer.select("gram").unionByName(own)
        longer = written(
            from_above.groupBy(_last(F.col("gram"), F.lit(n)).alias("gram")).agg(F.count(F.lit(1)).alias("kinds")), f"strings-{n}"
        )
        kinds[n] = longer
    below, found = None, None
    for n in range(1, SHORT + 1):
        after = Window.partitionBy(_context(F.col("gram")))
        level = kinds[n].select("gram", "kinds", F.sum("kinds").over(after).alias("all"), F.count(F.lit(1)).over(after).alias("nexts"))
        if below is not None:
            level = level.withColumn("tail", _last(F.col("gram"), F.lit(n - 1))).join(below, "tail")
        less = F.lit(1 / 256) if below is None else F.col("chance")
        own = (F.greatest(F.col("kinds") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("nexts") * less) / F.col("all")
        below = written_side(level.select(F.col("gram").alias("tail"), own.alias("chance")), f"chances-{n}", SIDE_BYTES)
        found = below if found is None else found.unionByName(below)
    return found


def _strings(spellings: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The strings that end at each byte of each word and at its end, and the words' numbers.

    A string is ``ORDER`` bytes here: its context from the nearest byte to the farthest, zeros where the word starts before, and the last byte.
    """
    data, offsets = text_bytes(spellings)
    size = np.diff(offsets)
    first = offsets[:-1] + 2 * np.arange(len(size))
    marked = np.full(len(data) + 2 * len(size), 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size + 1)
    marked[np.arange(len(data)) + 2 * np.repeat(np.arange(len(size)), size) + 1] = data
    end = np.arange(len(word)) + word + 1
    codes = np.zeros((len(word), ORDER), np.uint8)
    for j in range(ORDER - 1):
        at = end - 1 - j
        codes[:, j] = np.where(at >= first[word], marked[np.maximum(at, 0)], 0)
    codes[:, -1] = marked[end]
    return codes, word


def _ends(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Where strings meet: a number below ``buckets`` by the last ``SHORT`` bytes of the context."""
    end = codes[:, :SHORT].astype(np.uint64) @ (np.uint64(256) ** np.arange(SHORT, dtype=np.uint64))
    return (mixed(end) % np.uint64(buckets)).astype(np.int64)


def _distinct(codes: np.ndarray, buckets: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different strings by place and bytes, their places, and each string's number among them."""
    place = _ends(codes, buckets)
    near, far = codes[:, :8].copy().view(">u8").ravel(), codes[:, 8:].copy().view(">u4").ravel()
    order = np.lexsort((far, near, place))
    by = [x[order] for x in (place, near, far)]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in by], axis=0)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return codes[order[new]], by[0][new], which


def _summed(values: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` with the same number added up."""
    out = np.zeros((n, values.shape[1]), np.int64)
    np.add.at(out, which, values)
    return out


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of ``values`` as one binary value for each run of them."""
    ends = np.append(starts, len(values)) * (values.itemsize * (values.size // max(len(values), 1)))
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _packs(table: pa.Table, buckets: int) -> pa.Table:
    """Different strings of a group of words, with counts if the words have any: one row for each place."""
    codes, word = _strings(table["spelling"])
    found, place, which = _distinct(codes, buckets)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    out = {"place": pa.array(place[starts])}
    for c in ("model", "part"):
        if c in table.column_names:
            out[c] = pa.array(np.full(len(starts), table[c][0].as_py(), np.int32))
    out["strings"] = _packed(found, starts)
    if COUNTS[0] in table.column_names:
        counts = np.column_stack([table[c].to_numpy() for c in COUNTS])
        out["counts"] = _packed(_summed(counts[word], which, len(found)), starts)
    return pa.table(out)


def _with_chances(table: pa.Table, short: tuple[np.ndarray, np.ndarray], buckets: int) -> pa.Table:
    """All counted strings of a place, their counts, and the shared chance of each one's last byte after the context less its farthest byte."""
    packed = _unpacked(table["strings"], "u1", ORDER)
    codes, _, which = _distinct(packed)
    counts = _summed(_unpacked(table["counts"], "<i8", len(COUNTS)), which, len(codes))
    near, last = codes[:, :-1], codes[:, -1].astype(np.int64)
    size = (near != 0).sum(axis=1)
    # Numbers of contexts cut to each length; cut ones are neighbours, since nearest bytes come first.
    node = np.zeros(near.shape, np.int64)
    node[1:] = np.cumsum(np.logical_or.accumulate(near[1:] != near[:-1], axis=1), axis=0)
    ends = [np.where(size > j + 1, near[:, j], 0).astype(np.int64) for j in range(SHORT - 1)]
    chance = short[1][np.searchsorted(short[0], sum(x << (8 * (j + 1)) for j, x in enumerate(ends)) + last)]
    for n in range(SHORT + 1, ORDER):
        rows = np.flatnonzero(size >= n)
        # One row for each string of n + 1 bytes; those of n bytes are counted by how many of them end so.
        longer = rows[np.unique(node[rows, n - 1] * 256 + last[rows], return_index=True)[1]]
        string, one, kinds = np.unique(node[longer, n - 2] * 256 + last[longer], return_index=True, return_counts=True)
        _, context = np.unique(string // 256, return_inverse=True)
        whole, nexts = np.bincount(context, kinds)[context], np.bincount(context)[context]
        own = (np.maximum(kinds - DISCOUNT, 0) + DISCOUNT * nexts * chance[longer[one]]) / whole
        chance[rows] = own[np.searchsorted(string, node[rows, n - 2] * 256 + last[rows])]
    start = np.zeros(1, np.int64)
    return pa.table(
        {
            "place": table["place"][:1], "buckets": pa.array([buckets], pa.int32()),
            "strings": _packed(codes, start), "counts": _packed(counts, start), "chances": _packed(chance, start),
        }
    )


def spelling_model(words: DataFrame) -> DataFrame:
    """place, buckets, strings, counts, chances: a row for each place, with the counted strings that meet there.

    ``words``: spelling and ``COUNTS``. Contexts with the same last bytes meet, so a place holds all strings after each of its contexts.
    """
    buckets = 1 + words.count() // (WORDS_A_PART * PARTS_A_PLACE)
    counted = words.filter(sum(F.col(c) for c in COUNTS) > 0)
    grams = counted.select(F.explode(_grams(F.col("spelling"), SHORT + 1)).alias("gram")).distinct()
    found = short_chances(written(grams, "short-strings")).toArrow()
    tails, chances = found["tail"].to_pylist(), found["chance"].to_numpy()
    # The last byte is lowest, then the context from its nearest byte.
    keys = np.array([int.from_bytes(t[-2::-1], "little") << 8 | t[-1] for t in tails], np.int64)
    order = np.argsort(keys)
    short = words.sparkSession.sparkContext.broadcast((keys[order], chances[order]))
    packs = (
        counted.select(_part(buckets), "spelling", *COUNTS)
        .groupBy("part")
        .applyInArrow(lambda t: _packs(t.drop_columns("part"), buckets), "place long, strings binary, counts binary")
    )
    return written(
        packs.groupBy("place").applyInArrow(
            lambda t: _with_chances(t, short.value, buckets), "place long, buckets int, strings binary, counts binary, chances binary"
        ),
        "spelling-model",
    )


def _part(buckets: int) -> Column:
    """Words that start alike are counted and asked together, so that their strings are named once."""
    return F.pmod(F.xxhash64(F.substring("spelling", 1, 4)), F.lit(buckets * PARTS_A_PLACE)).cast("int").alias("part")


def _ratios(counts: np.ndarray, chance: np.ndarray, context: np.ndarray, model: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratios by a model: of each counted string's last byte, and after each context of a byte that no class holds there."""
    seen, unseen = [], []
    for i in range(len(CLASSES)):
        n = sum(counts[:, k * len(CLASSES) + i] for k, f in enumerate(FOLDS) if f != model)
        whole, nexts = np.bincount(context, n), np.bincount(context, n > 0)
        left = np.where(whole > 0, DISCOUNT * nexts / np.maximum(whole, 1), 1.0)
        seen.append(np.maximum(n - DISCOUNT, 0) / np.maximum(whole, 1)[context] + left[context] * chance)
        unseen.append(left)
    return np.log(seen[0] / seen[1]), np.log(unseen[0] / unseen[1])


def _answered(held: pa.Table, asked: pa.Table) -> pa.Table:
    """The ratios of the strings of each pack that asks a place."""
    names = ["model", "part", "place"]
    codes = _unpacked(held["strings"], "u1", ORDER)
    counts, chance = _unpacked(held["counts"], "<i8", len(COUNTS)), _unpacked(held["chances"], "<f8", 1)[:, 0]
    string, context = _text(codes), _text(codes[:, :-1])
    contexts, number = np.unique(context, return_inverse=True)
    out = []
    for m in asked["model"].unique().to_pylist() if len(codes) else []:
        known, other = _ratios(counts, chance, number, m)
        packs = asked.filter(pc.equal(asked["model"], m))
        sought = _unpacked(packs["strings"], "u1", ORDER)
        at = np.minimum(np.searchsorted(string, _text(sought)), len(string) - 1)
        after = np.minimum(np.searchsorted(contexts, _text(sought[:, :-1])), len(contexts) - 1)
        met = np.where(contexts[after] == _text(sought[:, :-1]), other[after], 0.0)
        ratio = np.where(string[at] == _text(sought), known[at], met)
        sizes = pc.binary_length(packs["strings"]).to_numpy() // ORDER
        out.append(packs.select(names).append_column("ratios", _packed(ratio, np.cumsum(sizes) - sizes)))
    # Places without counted strings have no ratios: all are 0.
    return pa.concat_tables(out) if out else asked.select(names).append_column("ratios", asked["strings"]).slice(0, 0)


def _text(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(f"S{codes.shape[1]}").ravel()


def _added(words: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The sum of each word's ratios."""
    codes, word = _strings(words["spelling"])
    found, place, which = _distinct(codes, buckets)
    ratio = np.zeros(len(found))
    answers = answers.sort_by("place")
    told = np.isin(place, answers["place"].to_numpy())
    ratio[told] = _unpacked(answers["ratios"], "<f8", 1)[:, 0]
    sums = np.bincount(word, ratio[which], minlength=words.num_rows)
    return words.select(["word", "model"]).append_column("ratio", pa.array(sums))


def word_ratios(words: DataFrame, model: DataFrame) -> DataFrame:
    """word, model, ratio: the log-likelihood ratio of each word by one of ``MODELS``; 0, or no row, for those never met in a model.

    ``words``: word, model, spelling. Strings of words that start alike go to their places once, and their ratios come back.
    """
    schema = "word long, model int, ratio double"
    first = model.select("buckets").first()
    if first is None:
        return words.sparkSession.createDataFrame([], schema)
    buckets = first["buckets"]
    asked = words.select(_part(buckets), F.col("model").cast("int").alias("model"), "word", "spelling").groupBy("part", "model")
    packs = asked.applyInArrow(lambda t: _packs(t, buckets), "place long, model int, part int, strings binary")
    answers = (
        model.groupBy("place").cogroup(packs.groupBy("place")).applyInArrow(_answered, "model int, part int, place long, ratios binary")
    )
    return asked.cogroup(answers.groupBy("part", "model")).applyInArrow(lambda t, r: _added(t, r, buckets), schema)


def commonest(words: DataFrame, most: int) -> DataFrame:
    """The words in most texts, ``most`` of them at most: as many whole levels of commonness as fit."""
    level = F.floor(F.log2("texts") * 16)
    sizes = words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, held = None, 0
    for row in sizes:
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return words.filter(F.lit(False) if least is None else level >= least)


def _judged(common) -> Callable:
    """For each text: its words, the sums over those whose ratio is held, and the others with their numbers."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = common.value
        for batch in batches(source):
            data, offsets = text_bytes(batch.column(0))
            whole = batch.column(2).to_numpy(zero_copy_only=False) > 0
            for a, b, words in _sliced(data, offsets):
                text, word, times = words.in_texts()
                at = np.searchsorted(hashes, words.hashes)
                at[at == len(hashes)] = 0
                known = hashes[at] == words.hashes if len(hashes) else np.zeros(len(words.hashes), bool)
                ratios = np.where(known, ratio[at], 0.0) if len(hashes) else np.zeros(len(words.hashes))
                # Rows that fit the curve ask other models, whose ratios are not held.
                open_ = ~known[word] | whole[a:b][text]
                value = np.where(open_, 0.0, ratios[word])
                sums = [np.bincount(text, weights=v * times, minlength=b - a) for v in (value, np.maximum(value - EXCESS, 0))]
                ends = np.concatenate([[0], np.cumsum(np.bincount(text[open_], minlength=b - a))]).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                    for x in (words.hashes[word[open_]].view(np.int64), times[open_].astype(np.int64))
                ]
                kept = [batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.diff(words.offsets).astype(np.int64)), *[pa.array(s) for s in sums], *lists],
                    [*batch.schema.names[1:], "n_words", *MEASURES, "words", "times"],
                )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights and intercept of a lightly penalised logistic curve, by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pull = np.eye(z.shape[1]) * 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 5; null stays null."""
    return F.crc32(doc_id.cast("string")) % 5


def _learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """doc_id, fold, label of labelled rows outside fold 0, and the model that rows which fit the curve are scored by, else null."""
    given = (
        labels.select(column(id_col).cast("long").alias("doc_id"), column(label_col).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & (fold(F.col("doc_id")) > 0))
        .groupBy("doc_id")
        .agg(F.max((F.col("label") == 1).cast("int")).alias("label"))
    )
    given = written(given.withColumn("fold", fold(F.col("doc_id")).cast("int")), "labelled")
    most = max([r["count"] for r in given.groupBy("label").count().collect()], default=1)
    # One share for both labels, so that the sample keeps their proportion.
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    return written_side(given.withColumn("fits", F.when(chance < CALIBRATION / most, F.col("fold"))), "learnable")


def measures(docs: DataFrame, given: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text and any others) without text, with model 0, n_words and ``MEASURES``; and rows that fit the curve with theirs."""
    others = [c for c in docs.columns if c != "text"]
    texts = docs.join(given, "doc_id", "left")
    kind = F.coalesce((F.col("fold") - 1) * 2 + (1 - F.col("label")), F.lit(-1)).cast("long")
    words = written(
        texts.select("text", kind.alias("kind"))
        .mapInArrow(tidy(_count_words), "word long, spelling binary, texts long, " + ", ".join(f"{c} long" for c in COUNTS))
        .groupBy("word", "spelling")
        .agg(*[F.sum(c).alias(c) for c in ("texts", *COUNTS)]),
        "words",
    )
    release(docs.sparkSession)
    model = spelling_model(words)
    release(docs.sparkSession)
    ratios = written(word_ratios(words.withColumn("model", F.lit(0)), model), "word-ratios")
    release(docs.sparkSession)
    held = commonest(words, WORDS_HELD).join(ratios, "word", "left")
    table = held.select("word", F.coalesce("ratio", F.lit(0.0)).alias("ratio")).toArrow()
    hashes, ratio = table["word"].to_numpy().view(np.uint64), table["ratio"].to_numpy()
    order = np.argsort(hashes)
    common = docs.sparkSession.sparkContext.broadcast((hashes[order], ratio[order]))
    asked = F.explode(F.when(F.col("fits").isNotNull(), F.array(F.lit(0), "fits")).otherwise(F.array(F.lit(0))))
    rows = texts.select("text", asked.alias("model"), *[column(c) for c in others]).select(
        "text", "doc_id", F.col("model").cast("int").alias("model"), *[column(c) for c in others if c != "doc_id"]
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    schema += ", n_words long, mean double, excess double, words array<long>, times array<long>"
    found = written(rows.mapInArrow(tidy(_judged(common)), schema).withColumn("place", F.monotonically_increasing_id()), "judged")
    pairs = found.select("place", "model", F.explode(F.arrays_zip("words", "times")).alias("at"))
    pairs = pairs.select("place", "model", F.col("at.words").alias("word"), F.col("at.times").alias("times"))
    # Words of rows that fit the curve, by the model that leaves their fold out.
    fitting = pairs.filter("model > 0").select("word", "model").distinct().join(words.select("word", "spelling"), "word")
    fitting = written(fitting, "fitting-words")
    ratios = ratios.unionByName(written(word_ratios(fitting, model), "fitting-ratios"))
    release(docs.sparkSession)
    sums = (
        pairs.join(ratios, ["word", "model"])
        .groupBy("place")
        .agg(
            F.sum(F.col("ratio") * F.col("times")).alias("more_mean"),
            F.sum(F.greatest(F.col("ratio") - EXCESS, F.lit(0.0)) * F.col("times")).alias("more_excess"),
        )
    )
    size = F.greatest("n_words", F.lit(1))
    return (
        found.drop("words", "times")
        .join(sums, "place", "left")
        .select(
            *[column(c) for c in others], "model", "n_words",
            *[((F.col(m) + F.coalesce(f"more_{m}", F.lit(0.0))) / size).alias(m) for m in MEASURES],
        )
    )


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, held_out, score, predicted, ``MEASURES``, n_words: one row per row of ``docs``; and row, a copy of ``row_col``.

    Labels of fold 0 are never read. Words are counted on folds 1 to 4; the curve is fitted on rows scored without their own fold.
    """
    extra = [] if row_col is None else [column(row_col).alias("row")]
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"), *extra)
    given = _learnable(labels, label_id_col, label_col)
    found = written(measures(texts, given), "measures")
    fitting = found.filter("model > 0").join(given.select("doc_id", "label"), "doc_id").select(*MEASURES, "label").toArrow()
    y = fitting["label"].to_numpy().astype(float)
    if len(np.unique(y)) == 2:
        *weights, start = _logistic(np.column_stack([fitting[m].to_numpy() for m in MEASURES]), y)
        line = F.lit(float(start))
        for m, w in zip(MEASURES, weights, strict=True):
            line = line + F.col(m) * float(w)
        score = 1 / (1 + F.exp(-line))
    else:
        score = F.lit(float(len(y) > 0 and y[0] == 1))
    return found.filter("model = 0").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        *MEASURES,
        "n_words",
        *([] if row_col is None else ["row"]),
    )
