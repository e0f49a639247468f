"""Periodic runs against a search of all stretches, with odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import periodic_runs as runs
from faultline.llm.common import apply_settings
from faultline.llm.registry import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def every_run(words, min_length=6, exponent=4):
    """All stretches of all periods, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(min_length, exponent * q):
                found.setdefault((start, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abc"), max_size=60), max_size=4),
    st.sampled_from([(6, 4), (2, 2), (5, 3), (1, 2), (9, 2)]),
)
def test_runs_of_small_alphabets(documents, limits):
    assert runs.runs_of(documents, *limits) == [every_run(d, *limits) for d in documents]


def test_runs_within_runs():
    rng = random.Random(5)
    documents = []
    for _ in range(60):
        words = []
        while len(words) < 400:
            unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
            unit = unit * rng.randint(1, 6) if rng.random() < 0.4 else unit
            words += unit * rng.randint(1, 9) + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
        documents.append(words)
    documents += [["a"] * 3000, ["a", "b"] * 1500, [str(i) for i in range(500)], []]
    assert runs.runs_of(documents) == [every_run(d) for d in documents]


def edited(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = edited(doc_id, text)
    found = every_run(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    made = [(None, "x " * 30), (None, None), (1, None), (2, ""), (3, " \n\t\x0b "), (4, "a a a a a"), (5, "a\ta\na a\x0ca  a"), (5, "a\ta\na a\x0ca  a")]
    made += [(6, "           "), (7, "é 漢 é 漢 é 漢 é 漢 z"), (8, "word " * 20_000), (9, "y" * 50_000)]
    for i in range(10, 250):
        made.append((i, " ".join(rng.choice(["la", "le", "lo", "Li"]) for _ in range(rng.randint(0, 150)))))
    return made


def test_query_equals_all_stretches(spark, rows):
    apply_settings(spark)
    schema = "doc_id long, text string, words string, runs string, h string, a int, p int, g int, left int"
    docs = spark.createDataFrame([(*r, "w", "r", "h", 1, 2, 3, 4) for r in rows], schema).repartition(3)
    got = runs.run_digests(runs.periodic_runs(runs.with_planted_period(docs))).select(*COLUMNS).collect()
    order = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in got), key=order) == sorted((expected(*r) for r in rows), key=order)
    assert sum(r.n_runs > 0 for r in got) > 20
    none = runs.run_digests(runs.periodic_runs(runs.with_planted_period(docs.filter("false"))))
    assert none.columns == COLUMNS and none.collect() == []


def test_query_over_the_tables(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_runs"](spark, sf_dir).select(*COLUMNS).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        assert got[doc_id] == expected(doc_id, text)
