"""Fingerprints against a plain evaluation of the same bins, and their likeness against exact similarity."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import minhash_fingerprint as fp
from faultline.llm.common import apply_settings
from faultline.llm.ranges import splitters
from faultline.llm.registry import QUERIES
from faultline.llm.rolling import PrefixHash, mixed


def shingles(text):
    data = text.encode()
    return {data[i : i + fp.SHINGLE] for i in range(max(1, len(data) - fp.SHINGLE + 1))} if data else set()


def plain(text):
    """Bins as a table, filled one at a time."""
    own = {}
    for s in shingles(text):
        raw = np.frombuffer(s, np.uint8)
        h = int(mixed(PrefixHash(raw).raw(np.array([0]), np.array([len(s)])))[0])
        own[h >> 55] = min(own.get(h >> 55, 1 << 64), h & ((1 << 55) - 1))
    if not own:
        return ""
    digits = []
    for j in range(fp.BINS):
        at, attempt = j, 0
        while at not in own:
            attempt += 1
            at = int(mixed(np.array([j + attempt * fp.BINS], np.uint64))[0]) % fp.BINS
        digits.append(f"{int(mixed(np.array([own[at] ^ (j << 55)], np.uint64))[0]) & 15:x}")
    return "".join(digits)


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def next_to(rows, order):
    rows = sorted(rows, key=order)
    return [(i, text, rows[(at + 1) % len(rows)][1]) for at, (i, text) in enumerate(rows)]


def edited(text, then):
    cut = len(text) // 4
    return text[: len(text) - cut] + then[:cut]


def check(got, expected, sample=None):
    """``expected``: (doc_id, text, next text), one for each row."""
    assert len(got) == len(expected)
    held = {}
    for r in got:
        held.setdefault((r.doc_id, r.edited_sha256), []).append(r)
    for at, (i, text, then) in enumerate(expected):
        changed = edited(text, then)
        r = held[(i, hashlib.sha256(changed.encode()).hexdigest())].pop()
        assert r.n_chars == len(text)
        if sample is None or at % sample == 0:
            assert r.fingerprint == plain(text) and r.edited_fingerprint == plain(changed)
        for near, exact in ((r.near_edited, similarity(text, changed)), (r.near_next, similarity(text, then))):
            assert 0 <= near <= 1 and abs(near - exact) < (0.14 if len(shingles(text)) > 300 else 0.6)
            assert near == 1.0 or exact < 1


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["lo", "rem", "ip", "sum", "do", "lor", "é", "漢字", "😀"]
    made = [(0, None), (1, ""), (2, "a"), (3, "short"), (4, "x" * 70_000), (5, "ab" * 9), (6, "exactly 10"), (2**62, "last"), (-5, "first of all")]
    for i in range(10, 90):
        made.append((i, " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.choice([5, 40, 400, 3000])))))
    made.append((40.5, made[30][1]))
    return [(int(i), t) for i, t in made if i != 40.5] + [(90, made[30][1]), (91, made[30][1])]


SCHEMA = "doc_id long, text string, none string, id string, mix int, file string, at int, range int, guard int, row_key int, row_key_ int"


def frame(spark, rows, files=3):
    apply_settings(spark)
    return spark.createDataFrame([(*r, "n", "i", 1, "f", 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(files)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_beside_next(spark, rows, parts):
    got = fp.beside_next(frame(spark, rows), parts=parts).collect()
    check(got, next_to([(i, t or "") for i, t in rows], lambda r: r[0]), sample=1 if parts == 5 else 9)


def test_equal_and_missing_identifiers(spark):
    rows = [(None, "no name"), (None, "no name"), (None, None), (7, "twice " * 30), (7, "twice " * 30), (7, "once " * 30), (8, "end")]
    got = sorted(fp.beside_next(frame(spark, rows), parts=4).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [7, 7, 7, 8, None, None, None]
    texts = [t or "" for _, t in rows]
    possible = {hashlib.sha256(edited(a, b).encode()).hexdigest() for a in texts for b in texts}
    assert {r.edited_sha256 for r in got} <= possible
    assert sorted(r.n_chars for r in got) == sorted(map(len, texts))
    assert len({r.fingerprint for r in got}) == 5


def test_few_rows(spark):
    assert fp.beside_next(frame(spark, [(1, "x")]).filter("false"), parts=3).collect() == []
    (r,) = fp.beside_next(frame(spark, [(1, "the only document " * 20)]), parts=3).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(edited(*["the only document " * 20] * 2).encode()).hexdigest()
    assert fp.fingerprints(frame(spark, [(1, "x")]).filter("false")).collect() == []


def test_likeness_of_columns(spark, rows):
    marks = fp.fingerprints(frame(spark, rows))
    assert {r.doc_id: r.fingerprint for r in marks.collect()} == {i: plain(t or "") for i, t in rows}
    got = fp.beside_next(frame(spark, rows)).withColumn("again", fp.likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
    assert all(abs(r.again - r.near_edited) < 1e-12 for r in got.collect())


def test_estimates_have_no_bias():
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95):
        for _ in range(40):
            a = rng.integers(0, 256, 3000, np.uint8)
            b = np.concatenate([a[: int(3000 * share)], rng.integers(0, 256, 3000 - int(3000 * share), np.uint8)])
            low = fp.low_bits(fp.least_values(np.concatenate([a, b]), np.array([0, 3000, 6000])))
            filled = np.ones(1, bool)

            sets = [{x[i : i + fp.SHINGLE].tobytes() for i in range(3000 - fp.SHINGLE + 1)} for x in (a, b)]
            exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            errors.append(fp.likenesses(low[:1], low[1:], filled, filled)[0] - exact)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_splitters_cut_evenly(spark):
    keys = spark.range(10_000).select((F.col("id") % 100).alias("a"), "id")
    cuts = splitters(keys, F.xxhash64("id"), 10)
    assert cuts[0] == (0, 0) and len(cuts) == 10
    assert all(6 <= b[0] - a[0] <= 14 for a, b in zip(cuts, cuts[1:], strict=False))
    assert splitters(keys.filter("false"), F.xxhash64("id"), 10) == []


def test_query_over_the_tables(spark, sf_dir):
    got = QUERIES["op13_fingerprints"](spark, sf_dir).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(got, next_to([(i, t or "") for i, t in docs], lambda r: r[0]), sample=40)
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.97
