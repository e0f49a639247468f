"""Near duplicates: fast similarity sketches, banding, exact verification, components.

Method. A document's set is its distinct shingles of ``SHINGLE`` words. Its sketch has ``COORDINATES`` values. In round
i every shingle is thrown into a hashed bin with a hashed value above those of all earlier rounds, and a bin keeps its
least value; round COORDINATES + j throws all into bin j, so every coordinate fills, after few rounds for most sets. Two
coordinates agree with a probability of the sets' Jaccard similarity, concentrated as with independent hashes. ``BANDS``
bands of four coordinates make buckets; a pair of similarity 0.8 shares none with a probability of 5e-8.

Links are found without all pairs of a bucket. Documents of equal sets are one class from the start. In each bucket
every member is compared with one leader, the member whose buckets hold most others (the text the others were copied
from, where there is one). Components follow. A count of what other components hold of each set shows which sets can be linked to
another component at all. Only pairs of such sets in one bucket whose members are still in different components are then
compared, all of them. Sketches drop pairs that agree in fewer than ``LEAST`` coordinates (of pairs of similarity 0.8, one in
a million), and sizes and distances from a common leader those that cannot reach the threshold; whatever is left is compared on
full sets.

Defined results. Words are runs of anything but white space, A-Z lower-cased. With fewer words than a shingle the whole
sequence is one; null and empty texts, or those without words, have the empty set and are linked with nothing. A null
identifier takes no part and is kept. Repeated rows have equal sets; of equal identifiers every row has kept true where one
has. No rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import batches, column, keyed, texts, tidy
from .components import components
from .rolling import PrefixHash, mixed, row_slices, text_bytes

SHINGLE = 5
COORDINATES, BANDS = 128, 32
LEAST = 80
SIEVES = 2
BLOCK = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text and ascending in each, and each text's offsets among them."""
    inside = ~_BLANK[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | opens[:-1]))
    ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
    words = mixed(PrefixHash(_LOWER[data]).raw(starts, ends))
    reach = np.searchsorted(starts, offsets)
    n = np.diff(reach)
    text = np.repeat(np.arange(len(n)), n)
    # A shingle at each word that has enough words after it, or at the first word of a short text.
    full = np.arange(len(words)) + size <= reach[1:][text]
    at = np.flatnonzero(full | ((np.arange(len(words)) == reach[:-1][text]) & (n[text] < size)))
    length = np.minimum(n[text[at]], size)
    value = length.astype(np.uint64)
    for k in range(size):
        held = np.minimum(at + k, max(len(words) - 1, 0))
        value = np.where(k < length, mixed(value * np.uint64(_STEP) + words[held]), value)
    of = text[at]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[fresh], np.searchsorted(of[fresh], np.arange(len(n) + 1))


def similarity_sketches(values: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` values for each set; ``t`` is a power of two up to 128."""
    n = np.diff(offsets)
    out = np.full(len(n) * t, np.uint64(2**64 - 1))
    empty = np.uint64(2**64 - 1)
    of = np.repeat(np.arange(len(n)), n)
    open_sets = np.flatnonzero(n > 0)
    for i in range(2 * t):
        if i:
            done = (out.reshape(-1, t)[open_sets] != empty).all(axis=1)
            if done.any():
                open_sets = open_sets[~done]
                going = np.zeros(len(n), bool)
                going[open_sets] = True
                held = going[of]
                values, of = values[held], of[held]
        if not len(open_sets):
            break
        h = mixed(values + np.uint64(_STEP * (i + 1) % (1 << 64)))
        bins = (h & np.uint64(t - 1)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, of * t + bins, np.uint64(i) << np.uint64(56) | h >> np.uint64(8))
    return out.reshape(-1, t)


def _sketched(size: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_slices(np.diff(offsets)):
                values, reach = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                sketch = similarity_sketches(values, reach)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values + np.uint64(salt)))])
                    sums.append((total[reach[1:]] - total[reach[:-1]]).view(np.int64))
                rows = sketch.reshape(b - a, BANDS, COORDINATES // BANDS)
                keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (b - a, 1))
                for k in range(rows.shape[2]):
                    keys = mixed(keys * np.uint64(_STEP) + rows[:, :, k])
                short = mixed(sketch).astype(np.uint8).view(np.int8).ravel()  # a byte of each coordinate
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array(np.diff(reach)),
                        *map(pa.array, sums),
                        pa.ListArray.from_arrays(
                            np.arange(0, short.size + 1, COORDINATES, dtype=np.int32), pa.array(short)
                        ),
                        pa.ListArray.from_arrays(
                            np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64))
                        ),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "bands"],
                )

    return run


def _agreeing(a: Column, b: Column) -> Column:
    """In how many coordinates two sketches agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _verified(size: int, percent: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            a, b = batch.column(0), batch.column(1)
            _, first, back = np.unique(a.to_numpy(), return_index=True, return_inverse=True)
            left = shingle_sets(*text_bytes(batch.column(2).take(pa.array(first))), size)
            right = shingle_sets(*text_bytes(batch.column(3)), size)
            linked, distance = np.zeros(len(a), bool), np.zeros(len(a))
            for i, j in enumerate(back.tolist()):
                x = left[0][left[1][j] : left[1][j + 1]]
                y = right[0][right[1][i] : right[1][i + 1]]
                same = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - same
                linked[i], distance[i] = 100 * same >= percent * union, 1 - same / union
            yield pa.RecordBatch.from_arrays([a, b, pa.array(distance), pa.array(linked)], ["a", "b", "distance", "linked"])

    return run


def _relabelled(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """key, rep, component after links between reps are taken in."""
    of = labelled.select("rep", "component").distinct()
    between = (
        links.join(of.toDF("a", "part_a"), "a")
        .join(of.toDF("b", "part_b"), "b")
        .select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        .filter("a != b")
    )
    joined = components(between)
    rest = [c for c in labelled.columns if c not in ("key", "rep", "component")]
    return labelled.join(joined.toDF("component", "wider"), "component", "left").select(
        "key", "rep", F.coalesce("wider", "component").alias("component"), *rest
    )


def _reach(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether two sets that have ``common`` elements in common at most can be linked."""
    return 100 * common >= percent * (n_a + n_b - common)


def _shingle_rows(size: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in row_slices(np.diff(offsets)):
                values, reach = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[a:b], np.diff(reach))), pa.array(values.view(np.int64))], ["rep", "shingle"]
                )

    return run


def _able(labelled: DataFrame, held: DataFrame, sizes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The open rows that can have a link to another component at all, with n_shingles, common, target and in_target.

    ``common`` counts a set's shingles that another component also holds. Of a link's two sets the common part is no more than
    that, so a set whose rest is too large, even beside the smallest set of its bucket, has none: most copies changed too much
    go here, by one count each and without any pair. What goes supports nothing, so the count is repeated ``SIEVES`` times.
    ``in_target`` counts those that the component it meets most, ``target``, holds.
    """
    of = labelled.select("rep", "component").distinct()
    rows = (
        held.withColumnRenamed("doc_id", "rep").join(of, "rep", "left_semi")
        .select("rep", "text").mapInArrow(tidy(_shingle_rows(shingle)), "rep long, shingle long").join(of, "rep")
    )
    rows = written(rows, "shingles")
    for _ in range(SIEVES):
        common = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        rows = written(rows.join(common.filter("low != high").select("shingle"), "shingle"), "common")
        counted = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("common"))
        described = labelled.select("key", "rep", "component").join(counted.join(sizes, "rep"), "rep")
        least = described.groupBy("key").agg(F.min("n_shingles").alias("least"))
        able = described.join(least, "key").filter(_reach(F.col("common"), F.col("n_shingles"), F.col("least"), percent))
        labelled = _open(able.select("key", "rep", "component", "n_shingles", "common"))
        rows = rows.join(labelled.select("rep").distinct(), "rep", "left_semi")
    rows = written(rows, "common")
    target = (
        labelled.join(_largest(labelled).select("key", F.col("largest").alias("target")), "key")
        .filter("component != target")
        .groupBy("rep", "target")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("rep")
        .agg(F.max(F.struct("n", "target")).alias("top"))
        .select("rep", "top.target")
    )
    target = written(target, "targets")
    holders = rows.select(F.col("component").alias("target"), "shingle").distinct()
    inside = (
        rows.select("rep", "shingle").join(target, "rep").join(holders, ["target", "shingle"])
        .groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    )
    bounds = target.join(inside, "rep", "left").select("rep", "target", F.coalesce("n", F.lit(0)).alias("in_target"))
    return labelled.join(bounds, "rep", "left")


def _open(labelled: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    labelled = written(labelled, "labelled")
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return written(labelled.join(several.filter("low != high").select("key"), "key"), "open")


def _largest(labelled: DataFrame) -> DataFrame:
    """key, largest: the component that most rows of each bucket belong to."""
    return (
        labelled.groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("top"))
        .select("key", F.col("top.component").alias("largest"))
    )


_LEFT = ["key", "u", "v", "block", "rep", "component", "n_shingles", "common", "target", "in_target", "leader", "distance", "sketch", "bands"]


def _pairs_left(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of each bucket that no count, distance or sketch rules out, each pair in its first bucket alone.

    A bucket's rows are dealt to blocks of about ``BLOCK``, and two blocks meet in a task of their own, so a large bucket is spread
    over many tasks. Missing counts are filled in so that they rule nothing out; a row that has no leader is its own.
    """
    sizes = written(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, "key").withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    filled = dealt.withColumns(
        {
            "u": F.least("block", "other"),
            "v": F.greatest("block", "other"),
            "target": F.coalesce("target", "component"),
            "in_target": F.coalesce("in_target", F.lit(0).cast("long")),
            "leader": F.coalesce("leader", "rep"),
            "distance": F.coalesce("distance", F.lit(0.0)),
        }
    )
    meeting = filled.select(*_LEFT).repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")
    return meeting.mapInArrow(tidy(_met(percent)), "a long, b long")


def _met(percent: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches(source):
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                unit = tuple(keys[a].tolist())
                if unit != now and held:
                    yield _compared(held, percent)
                    held = []
                now = unit
                held.append(batch.slice(a, b - a))
        if held:
            yield _compared(held, percent)

    return run


def _compared(held: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """Pairs of two blocks of a bucket, or of one with itself."""
    rows = pa.Table.from_batches(held).combine_chunks()
    plain = {c: rows.column(c).to_numpy() for c in _LEFT[:-2]}
    sketch, bands = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(rows), -1) for c in ("sketch", "bands"))
    key, u, v = (plain[c][0] for c in ("key", "u", "v"))
    left, right = np.flatnonzero(plain["block"] == u), np.flatnonzero(plain["block"] == v)
    x, y = ({c: values[at] for c, values in plain.items()} for at in (left, right))
    x = {c: values[:, None] for c, values in x.items()}
    most = np.iinfo(np.int64).max
    common = np.minimum(
        np.minimum(x["common"], y["common"]),
        np.minimum(
            np.where(x["target"] == y["component"], x["in_target"], most), np.where(y["target"] == x["component"], y["in_target"], most)
        ),
    )
    fit = 100 * common >= percent * (x["n_shingles"] + y["n_shingles"] - common)
    fit &= x["component"] != y["component"]
    # The distance of sets is a metric: two that lie apart as seen from one leader lie apart.
    fit &= (x["leader"] != y["leader"]) | (np.abs(x["distance"] - y["distance"]) <= 1 - percent / 100 + 1e-9)
    if u == v:
        fit &= x["rep"] < y["rep"]
    i, j = np.nonzero(fit)
    i, j = left[i], right[j]
    alike = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        at = slice(a, a + (1 << 16))
        alike[at] = (sketch[i[at]] == sketch[j[at]]).sum(axis=1) >= LEAST
    i, j = i[alike], j[alike]
    first = np.where(bands[i] == bands[j], bands[i], most).min(axis=1, initial=most) == key
    a, b = plain["rep"][i[first]], plain["rep"][j[first]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``percent`` is the similarity from which documents are linked; bands and ``LEAST`` are made for 80 or more.
    """
    if percent < 80:
        raise ValueError("the bands find similarities of 80 percent or more")
    whole = texts(docs, id_col, text_col)
    rows = written(
        whole.mapInArrow(
            tidy(_sketched(shingle)),
            "doc_id long, n_shingles long, set_a long, set_b long, sketch array<tinyint>, bands array<long>",
        ),
        "sketches",
    )
    sets = ["n_shingles", "set_a", "set_b"]
    able = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = written(
        able.groupBy(*sets).agg(
            F.min("doc_id").alias("rep"), F.min_by("sketch", "doc_id").alias("sketch"), F.min_by("bands", "doc_id").alias("bands")
        ),
        "classes",
    )
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = written(keyed.join(shared, "key"), "members")
    reach = members.groupBy("rep").agg(F.sum("held").alias("reach"))
    leaders = members.join(reach, "rep").groupBy("key").agg(F.max(F.struct("reach", (-F.col("rep")).alias("id"))).alias("most"))
    leaders = written(leaders.select("key", (-F.col("most.id")).alias("leader")), "leaders")
    sketches = classes.select("rep", "n_shingles", "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        """a, b, agree of those pairs whose sizes and sketches allow a link."""
        joined = pairs.join(sketches.toDF("a", "n_a", "sketch_a"), "a").join(sketches.toDF("b", "n_b", "sketch_b"), "b")
        fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        return (
            joined.filter(fit)
            .select("a", "b", _agreeing(F.col("sketch_a"), F.col("sketch_b")).alias("agree"))
            .filter(F.col("agree") >= LEAST)
        )

    first = likely(
        members.join(leaders, "key")
        .filter("rep != leader")
        .select(F.col("leader").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )
    # Each member's likeliest leader; the others come back below unless that settles them.
    first = written(
        first.groupBy("b").agg(F.max(F.struct("agree", (-F.col("a")).alias("id"))).alias("best")).select(
            (-F.col("best.id")).alias("a"), "b"
        ),
        "pairs",
    )
    involved = members.select("rep").distinct()
    held = written(whole.join(involved, F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(held.toDF("b", "text_b"), "b")
            .join(held.toDF("a", "text_a"), "a")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(tidy(_verified(shingle, percent)), "a long, b long, distance double, linked boolean")
        )

    judged = written(verified(first), "verified")
    links = judged.filter("linked").select("a", "b")
    tried = written(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "tried")
    labelled = _open(_relabelled(members.select("key", "rep", F.col("rep").alias("component")), links))
    labelled = _able(labelled, held, sketches.select("rep", "n_shingles"), shingle, percent)
    # What is left is compared in full: every pair of a bucket that is not known to be connected, in its first bucket.
    led = judged.select(F.col("b").alias("rep"), F.col("a").alias("leader"), "distance")
    rows_left = written(labelled.join(classes.select("rep", "bands", "sketch"), "rep").join(led, "rep", "left"), "open")
    across = _pairs_left(rows_left, percent)
    rest = written(across.join(tried, ["a", "b"], "left_anti"), "pairs")
    # Written: components read their links more than once, and each pair is to be compared once.
    across = written(verified(rest).filter("linked").select("a", "b"), "links")
    final = written(components(links.union(across)), "components")
    named = written(
        classes.join(final, classes["rep"] == final["node"], "left").select(
            *sets, F.coalesce("component", "rep").alias("component")
        ),
        "named",
    )
    key = [F.col(c) for c in sets]
    placed = rows.select("doc_id", *key).join(named, sets, "left")
    component = F.when(
        (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")
    ).otherwise(F.col("doc_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns: of each group the one of the smallest identifier, those of none last."""
    rows, key = keyed(docs)
    # Rows are grouped by numbers of their own, so that equal or missing identifiers are told apart.
    number = F.xxhash64(key)
    numbered = rows.select(number.alias("number"), column(text_col).alias("text"))
    groups = near_groups(numbered, id_col="number", text_col="text", **options).select("doc_id", "component_id")
    own = column(id_col).cast("long")
    order = F.struct(own.isNull().alias("none"), own.alias("id"), F.col(key).alias("row"))
    kept = (
        rows.select(number.alias("doc_id"), order.alias("order"))
        .join(groups, "doc_id")
        .groupBy("component_id")
        .agg(F.min("order").alias("first"))
        .select(F.col("first.row").alias(key))
    )
    return rows.join(kept, key, "left_semi").select(*[column(c) for c in docs.columns])
