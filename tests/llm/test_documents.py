"""Operators on documents against plain evaluations, with odd rows: null, empty, long, tied, repeated, clashing columns."""

import hashlib
import json
import os
import re
import string
import struct
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from faultline.llm import byte_bpe, common, exact_dedup, near_dedup, packing, suffix_dedup, token_counts  # noqa: E402
from faultline.llm.common import apply_settings  # noqa: E402
from faultline.llm.suffix_sort import shared_prefixes, suffix_array  # noqa: E402

# Names that the operators use inside.
SCHEMA = "doc_id long, text string, norm string, row long, key long, id string, place int, rep long, carried int, n_chars long"
PASSAGE = " ".join(f"w{i * 7919 % 1000}" for i in range(60))


def _texts():
    rng = np.random.default_rng(3)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(n))

    base = prose(120)
    words = base.split()
    near = [" ".join(words[:i] + ["XX"] + words[i + 1 :]) for i in (5, 40, 77)]
    far = " ".join(words[:60]) + " " + prose(60)
    return [
        (7, base), (3, base.upper().replace("É", "é")), (5, "  " + base.replace(" ", "\n\t ")), (9, base), *zip((11, 12, 13), near, strict=True),
        (20, far), (21, None), (22, ""), (23, " \n\t"), (24, "one"), (25, "One"), (26, "two words"), (27, "İ ß ẞ 'll x's 3.14 漢字 😀👍🏽"),
        (30, PASSAGE + prose(10)), (31, prose(10) + PASSAGE), (32, PASSAGE + " " + PASSAGE), (33, "a" * 500), (34, "ab" * 400 + "é" * 90),
        (None, base), (None, None), (None, "no identifier"), (40, "same row twice " + prose(30)), (40, "same row twice " + prose(30)),
        (41, prose(4000)), (42, "x" * 30_000), (43, " " * 5000 + "y"),
    ]


TEXTS = _texts()
TEXTS[-4] = TEXTS[-5]  # a row that is there twice


@pytest.fixture(scope="module")
def docs(spark):
    apply_settings(spark)
    rows = [(i, t, "n", 1, 2, "x", 3, 4, 5, None) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.filter("false")


def _order(i):
    return (i is None, i or 0)


# --- exact copies ----------------------------------------------------------------------


def test_exact_groups(docs, none):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), _order(i), i))
    expected = []
    for norm, rows in groups.items():
        keep = min(rows)[2]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        expected += [(i, keep, len(rows), digest) for _, _, i in rows]
    got = exact_dedup.exact_groups(docs).collect()
    key = lambda r: (_order(r[0]), str(r))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(expected, key=key)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_copies_of_a_hot_text(spark):
    """Dealt to several places, whose heads are compared in full once more; other texts stay in one."""
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same").otherwise(F.col("id").cast("string")).alias("text"))
    runs = exact_dedup.content_runs(hot, most=500)
    heads = runs.filter("head and norm is not null").collect()
    assert len(heads) == 8 and {r.norm for r in heads} == {"thesame"}
    got = exact_dedup.exact_groups(hot, most=500)
    same = got.filter(F.col("doc_id") % 3 > 0).agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.count_if("kept"))
    assert tuple(same.first()) == (1, 1, 4000, 1)
    assert got.filter((F.col("doc_id") % 3 == 0) & F.col("kept") & (F.col("group_size") == 1)).count() == 2000


@pytest.mark.parametrize("most", [2, 1000])
def test_no_digest_decides_what_is_equal(spark, monkeypatch, most):
    """Though every text had the same hashes, only equal texts are one group."""
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(70)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *_: F.lit("forged"))
    monkeypatch.setattr(exact_dedup, "HEAD", 2)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(F.col("norm")).cast("long") if c == ("norm",) else F.hash(*c).cast("long"))
    got = exact_dedup.exact_groups(docs, most=most).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(i, i % 7, 10, i < 7) for i in range(70)]
    assert {r.text_sha256 for r in got} == {"forged"}


# --- coding ----------------------------------------------------------------------------


def test_byte_bpe_equals_the_library_and_round_trips(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    codec = byte_bpe.codec(path, public_tokenizers.PATTERN)
    expected = sorted(
        (_order(i), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode())
        for i, t in TEXTS
        for ids in [codec.encoding.encode_ordinary(t or "")]
    )
    assert sorted((_order(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in coded.collect()) == expected
    row = byte_bpe.coding_digests(coded).filter("doc_id = 24").first()
    assert row.n_tokens == len(codec.encoding.encode_ordinary("one"))
    assert row.decoded_sha256 == hashlib.sha256(b"one").hexdigest()
    assert byte_bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_safe_pieces_change_no_id():
    codec = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = "".join(rng.choice(list("aé1_'.% \n\t\u00a0\u2003漢s"), 400))
        pieces = list(byte_bpe.safe_pieces(text, int(rng.integers(1, 40))))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in codec.encoding.encode_ordinary(p)] == codec.encoding.encode_ordinary(text)


# --- token counts ----------------------------------------------------------------------


def _greedy(word, vocabulary, longest):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def test_longest_match_equals_greedy_matching():
    rng = np.random.default_rng(2)
    for _ in range(150):
        vocabulary = {"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(rng.integers(1, 15))}
        automaton = token_counts.LongestMatch(vocabulary)
        for _ in range(25):
            word = "".join(rng.choice(list("abcd"), rng.integers(1, 14), p=[0.4, 0.3, 0.25, 0.05]))
            assert automaton.length(word) == _greedy(word, vocabulary, 6), (vocabulary, word)


def test_token_counts(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(token_counts.sentencepiece_vocabulary(path))
    longest = max(map(len, pieces))
    expected = []
    for i, t in TEXTS:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        counts = [_greedy("\u2581" + w, pieces, longest) for w in words]
        expected.append((_order(i), len(words), sum(max(c, 1) for c in counts), counts.count(0)))
    counted = token_counts.token_counts(docs, lambda: token_counts.sentencepiece_vocabulary(path), "\u2581")
    assert sorted((_order(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in counted.collect()) == sorted(expected)
    assert token_counts.token_counts(none, lambda: ["a"]).count() == 0


# --- packing ---------------------------------------------------------------------------


def _expected_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in TEXTS]


def test_packing_keeps_every_id_once_in_full_windows(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path, pool_tokens=4000).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    steps = defaultdict(int)
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        total = sum(p.length for p in parts)
        assert total == parts[0].window <= 4096 and total & (total - 1) == 0
        assert len({p.step_group for p in parts}) == 1
        steps[parts[0].step_group] += total
    assert min(steps.values()) > 0
    found = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        found[p.doc_id, p.doc_tokens].append((p.start, bytes(p.ids)))
    for i, ids in _expected_ids():
        if i is not None and i != 40:
            own = sorted(found[i, len(ids)])
            assert b"".join(b for _, b in own) == struct.pack(f"<{len(ids)}I", *ids)
            assert [a for a, _ in own] == [sum(len(b) // 4 for _, b in own[:k]) for k in range(len(own))]
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in _expected_ids())
    row = packing.piece_digests(packing.pack(docs.filter("doc_id = 24"), path)).orderBy("start").first()
    assert row.length == 2 and row.ids_crc32 == zlib.crc32(struct.pack("<2I", *dict(_expected_ids())[24]))
    assert packing.pack(none, path).count() == 0


def test_case_is_folded_only_where_no_id_changes():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = ["<|ENDOFTEXT|>", "x<|StartOfText|>Y", "<|endoftext|>", "J\u030c", "aH\u0331 T\u0308", "Hello HELLO hello", "A<b|C> B|d", "É İ ẞ", "\u212a", ""]
    words = packing.WordTokens(path, 2)
    got = words.encode(pa.array(odd))
    assert [x.tolist() for x in got] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in odd]
    assert words.known["HELLO"] == words.known["hello"]


def test_word_memory_is_bounded():
    words = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), 2, most=30)
    plain = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), 2)
    for k in range(20):
        column = pa.array([f"word{k} common {k + j} Common" for j in range(12)])
        for a, b in zip(words.encode(column), plain.encode(column), strict=True):
            assert a.tolist() == b.tolist()
        assert len(words.known) <= 30 + 26


# --- repeated strings ------------------------------------------------------------------


def test_suffix_array_by_grouping():
    rng = np.random.default_rng(4)
    for _ in range(400):
        symbols = np.append(rng.integers(2, 2 + rng.integers(1, 5), rng.integers(0, 60)), 0)
        text = symbols.tolist()
        order = suffix_array(symbols)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        shared = shared_prefixes(symbols, np.array(order), 1)
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert shared[k] == next((d for d, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _removed(rows, length):
    """Plain evaluation: rows of one identifier and text are one document."""
    seen, out = {}, {}
    marks = sorted({(i, t or "") for i, t in rows}, key=lambda x: (_order(x[0]), x[1]))
    for i, t in marks:
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen.setdefault(data[p : p + length], (i, t, p)) != (i, t, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i, t] = (len(data), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), kept)
    return out


@pytest.mark.parametrize("length, anchor", [(100, 32), (40, 12)])
def test_repeats_equal_a_plain_evaluation(docs, length, anchor):
    # Texts without an identifier have no order among themselves that a plain evaluation could know.
    rows = [(i, t) for i, t in TEXTS if i is not None]
    expected = _removed(rows, length)
    got = suffix_dedup.without_repeats(docs.filter("doc_id is not null"), length, anchor).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        (i, *expected[i, t or ""]) for i, t in rows
    )


def test_repeats_over_several_partitions_and_flushes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    shared = ["".join(rng.choice(list("ab c"), 150)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = ["".join(rng.choice(list(string.ascii_lowercase), 30)) + shared[rng.integers(6)][rng.integers(60) :] for _ in range(3)]
        rows.append((i, "".join(parts)))
    expected = _removed(rows, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = suffix_dedup.without_repeats(df, 60, 20).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == {i: v for (i, _), v in expected.items()}
    assert sum(r.n_removed for r in got) > 10_000


def test_texts_without_identifier_are_told_apart(spark):
    """As many as share bits of a short mark: each loses what repeats inside it and nothing else."""
    rng = np.random.default_rng(12)
    draw = lambda n: "".join(rng.choice(list(string.ascii_lowercase), n))
    rows = []
    for k in range(2000):
        block = draw(120 + k % 50)
        rows.append((None, block + draw(10 + k % 200) + block if k % 2 else block + draw(20)))
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    expected = sorted(v for row in rows for v in _removed([row], 100).values())
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expected


def test_texts_are_cut_and_other_columns_stay(spark, docs, none):
    got = suffix_dedup.with_kept_text(docs)
    assert got.columns == docs.columns and got.count() == len(TEXTS)
    rows = {r.doc_id: r for r in got.filter("doc_id is not null").collect()}
    assert rows[21].text is None and rows[21].id == "x" and rows[21].place == 3
    assert len(rows[9].text) < 100 and rows[9].n_chars == len(rows[9].text) and rows[3].n_chars is None
    assert suffix_dedup.without_repeats(none).count() == suffix_dedup.with_kept_text(none).count() == 0
    # Characters cut in half go.
    tail = string.ascii_letters + string.digits + string.ascii_letters[:37]
    odd = spark.createDataFrame([(1, "ĩ" + tail), (2, "x é" + tail)], "doc_id long, text string")  # both end in 0xa9
    assert [r.text for r in suffix_dedup.with_kept_text(odd).orderBy("doc_id").collect()] == ["ĩ" + tail, "x "]


def test_shuffles_of_written_repeats_leave_no_files(spark):
    def files() -> set[str]:
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}

    docs = spark.createDataFrame([(i, PASSAGE + f" {i % 7} " + PASSAGE[i:]) for i in range(300)], "doc_id long, text string")
    before = files()
    got = suffix_dedup.without_repeats(docs.repartition(4, "doc_id"))
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert got.count() == got.filter("n_removed > 0").count() == 300


def test_tasks_give_back_memory_and_drop_what_others_kept():
    def resident() -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def run(source):
        for batch in source:
            rows = [bytes(100_000) for _ in range(2_000)]
            pins.append(bytes(100_000))  # keeps the C library from handing back what lies below it
            yield batch
            rows.clear()

    pins, rows = [], pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    held = common.worker_memory()
    held["words"] = 1
    assert list(common.tidy(run, keeps=True)(iter([rows]))) == [rows] and held == {"words": 1}
    before = resident()
    assert list(common.tidy(run)(iter([rows, rows]))) == [rows, rows] and not held
    assert resident() < before + 50


# --- near copies -----------------------------------------------------------------------


def _shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def _components(rows, size):
    sets = [(i, _shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_equal_a_plain_evaluation(docs, none, size):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    got = near_dedup.near_groups(docs, size).collect()
    assert len(got) == len(TEXTS)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == _components(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.near_groups(none, size).count() == 0


def test_near_copies_that_only_their_source_links(spark):
    """Copies at 0.87 of their source and under 0.8 of one another; a chain; a source with a large identifier."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list(string.ascii_lowercase), 7))
    source = [word() for _ in range(300)]
    rows = [(900, " ".join(source))]
    for i in range(60):
        own = list(source)
        for p in rng.choice(290, 4, replace=False):
            own[p] = word()
        rows.append((i, " ".join(own)))
    chain = [word() for _ in range(200)]
    for i in range(100, 112):
        rows.append((i, " ".join(chain)))
        chain = chain[12:] + [word() for _ in range(12)]
    rows += [(i, " ".join(word() for _ in range(150))) for i in range(200, 260)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows, 4)


def test_joined_words_have_their_own_ids(sf_dir):
    import duckdb

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()
    words = sorted({w for (t,) in texts for w in re.findall("[^\x20\x09-\x0d]+", t or "")})
    words += ["a.", "a..!", "x's", "don't.", "é.", "ab1.", "<|endoftext|>.", "A,", "...", "z;z", "İ.", "it's,", "a" * 300 + "?", "ÉTÉ", "Straße.", "ÿÖ!", "naïve,", "µm", "a\u00a8"]
    rng = np.random.default_rng(1)
    held = packing.WordTokens(path, 2, most=5000)  # is thrown away several times
    for _ in range(3):
        some = [words[i] for i in rng.integers(0, len(words), 4000)] + words[-19:]
        (ids,) = held.encode(pa.array([" ".join(some)]))
        assert ids.tolist() == held.tokenizer.encode(" ".join(some), add_special_tokens=False).ids + [2]


def test_words_are_kept_from_task_to_task(spark, docs):
    made = spark.sparkContext.accumulator(0)
    path = public_tokenizers.path("word_bpe_49k.json")

    def tasks(_, source):
        from faultline.llm import packing

        held = packing.word_tokens(path, 2)
        made.add(getattr(held, "tasks", 0) == 0)
        held.tasks = getattr(held, "tasks", 0) + 1
        return source

    spark.sparkContext.parallelize(range(64), 64).mapPartitionsWithIndex(tasks).count()
    assert 1 <= made.value <= 8


def test_each_pair_is_compared_once(spark, monkeypatch):
    counted, handed = spark.sparkContext.accumulator(0), []
    verified, written = near_dedup._verified, near_dedup.written

    def counting(*options):
        run = verified(*options)

        def counted_run(source):
            for batch in run(source):
                counted.add(batch.num_rows)
                yield batch

        return counted_run

    def kept(df, label):
        df = written(df, label)
        if label == "pairs":
            handed.append(df.count())
        return df

    monkeypatch.setattr(near_dedup, "_verified", counting)
    monkeypatch.setattr(near_dedup, "written", kept)
    rng = np.random.default_rng(12)
    source = [f"s{i}" for i in range(400)]
    rows = []
    for i in range(80):  # copies of one text, half of them too far from it, with words in common
        own = list(source)
        for p in rng.choice(400, 6 if i % 2 else 14, replace=False):
            own[p] = f"c{p}" if rng.random() < 0.7 else f"r{rng.integers(1 << 40)}"
        rows.append((i, " ".join(own)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows, 4)
    assert len(handed) == 2 and handed[1] > 0 and counted.value == sum(handed)


def test_sketches_fill_and_estimate_similarity():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [values[:1], values[:3], values[:1000], values[250:1250], values[2000:2000], values[2000:4000]]
    reach = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketch = near_dedup.similarity_sketches(np.concatenate(sets), reach)
    full = np.uint64(2**64 - 1)
    assert (sketch[[0, 1, 2, 3, 5]] != full).all() and (sketch[4] == full).all()
    assert abs((sketch[2] == sketch[3]).mean() - 0.6) < 0.15
    alone = near_dedup.similarity_sketches(values[:1000], np.array([0, 1000]))
    assert (alone[0] == sketch[2]).all()


def test_tokenizer_files_are_the_stated_kind():
    assert json.load(open(public_tokenizers.path("word_bpe_49k.json")))["model"]["end_of_word_suffix"] == "</w>"
