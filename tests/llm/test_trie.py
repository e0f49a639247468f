"""The prefix trie against plain sets of conversations, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.llm import prefix_trie as trie
from faultline.llm.common import apply_settings
from faultline.llm.registry import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def conversations(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in held.items()}


def rebuilt(held):
    out = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = held.get(c - c % 20, [])[:h] + turns[h:]
    return out


def nodes(held):
    """All nodes by their beginnings."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    own = {v: (len(m) - 1) * len(WORD.findall(v[-1][1])) if v else 0 for v, m in members.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for v in members:
        if v:
            children[v[:-1]] += 1
    for v in members:
        for d in range(len(v) + 1):
            saved[v[:d]] += own[v]
            leaves[v[:d]] += not children.get(v)
    return sorted(
        (
            min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), children.get(v, 0), leaves[v], saved[v],
            hashlib.sha256(",".join(map(str, sorted(ends.get(v, [])))).encode()).hexdigest(),
        )
        for v, m in members.items()
    )


def told(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, path string, words int, range int, skeleton int, mark string"


def frame(spark, rows, files=3):
    apply_settings(spark)
    return spark.createDataFrame([(*r, "p", 1, 2, 3, "m") for r in rows], SCHEMA).repartition(files)


def grown(n, seed, length=9):
    """Conversations that share beginnings, many of them alike."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        turns = [("user", "hello there")] if kind < 0.8 else []
        if kind < 0.35:
            turns += [("assistant", "the very same"), ("user", "conversation\tof many")]
        else:
            turns += [(rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randint(0, 3))) for _ in range(rng.randint(0, length))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(turns)]
    return rows


ODD = [
    (None, 0, "user", "nobody"), (1000, None, "user", "first"), (1000, 0, None, None), (1000, 1, "a", ""), (1001, 5, "user", "tie b"),
    (1001, 5, "user", "tie a"), (1001, 5, "user", "tie a"), (1002, 0, "u", "x"), (1002, 0, "u", "x"), (-7, 0, "user", "hello there"),
    (2000, 0, "user", "z" * 40_000), *[(2001, t, "user", "long") for t in range(300)], *[(2002, t, "user", "long") for t in range(290)],
    (3, 0, "a:b", "c"), (4, 0, "a", "b:c"),
]


@pytest.mark.parametrize(("parts", "most"), [(1, 1 << 18), (7, 1 << 18), (40, 12), (40, 1)])
def test_trie_equals_plain_sets(spark, parts, most):
    rows = grown(160, 1) + ODD
    got = trie.prefix_trie(trie.paths(frame(spark, rows)), parts=parts, most=most)
    # Turns that tie are taken by digest: there is no order of texts to hold them to.
    held = conversations(rows)
    flat = [(c, t, role, text) for c, turns in held.items() for t, (role, text) in enumerate(turns)]
    again = trie.prefix_trie(trie.paths(frame(spark, flat)), parts=3)
    expected = nodes(held)
    assert told(again) == expected
    tied = {1001}
    assert [r for r in told(got) if r[0] not in tied] == [r for r in expected if r[0] not in tied]
    assert len(told(got)) == len(expected)


def test_shared_openings_and_conversations_without_turns(spark):
    # Some conversations from 30 to 39 lose their only turn where their checksum asks for openings of a conversation that is not there.
    rows = [(c, 0, "user", f"only turn {c % 3}") for c in range(30, 80)] + grown(15, 5)
    held = rebuilt(conversations(rows))
    assert any(not turns for turns in held.values())
    known = trie.paths(frame(spark, rows))
    assert told(trie.prefix_trie(trie.with_shared_openings(known), parts=6)) == nodes(held)


def test_no_conversations(spark):
    none = frame(spark, ODD).filter("false")
    assert trie.prefix_trie(trie.with_shared_openings(trie.paths(none))).collect() == []


def test_chunks_of_identifiers(spark):
    """A conversation that most others equal is cut into ranges, and its digest is that of all identifiers in order."""
    rows = [(c, 0, "user", "same") for c in range(9000)] + grown(50, 8)[:100]
    rows = [(c + 9000 * (text != "same"), t, role, text) for c, t, role, text in rows]
    got = told(trie.prefix_trie(trie.paths(frame(spark, rows)), parts=5))
    assert got == nodes(conversations(rows))


def test_skeleton_has_a_bound():
    cuts = [("".join(f"{c:0>32}" for c in path), i) for i, path in enumerate(["abc", "abd", "ax", "b", "abc"])]
    whole = trie.Skeleton(cuts)
    assert len(whole.ways) == 7 and whole.cuts == sorted(cuts)
    assert all(p < node for node, p in enumerate(whole.parent))
    small = trie.Skeleton(cuts, 4)
    assert len(small.ways) == 3 and {len(path) for path, _ in small.cuts} == {32}
    assert all(node < 3 for ways in small.ways for node in ways.values())


def test_query_over_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, sf_dir)
    assert told(got) == nodes(rebuilt(conversations(rows)))
    assert got.filter(F.col("parent_conv_id").isNull()).count() == 1
