"""Chances and ratios of spellings against a plain recursion over strings."""

import math
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

pytest.importorskip("faultline.llm")

from faultline.llm import toxicity  # noqa: E402
from faultline.llm.common import apply_settings  # noqa: E402
from faultline.session import release, written  # noqa: E402

TEXTS = [
    ("Calm words, calm days.", 1, 0),
    ("awfully awful words", 1, 1),
    ("awful internationalization; awfulness", 2, 1),
    ("internationalised INTERNATIONALIZATION nations", 2, 0),
    ("awe and awnings", 3, 0),
    ("awful", 3, 1),
    ("états généraux 我们喜欢日子", 4, 0),
    ("日子 awful", 4, 1),
    ("x" * 300 + " plain", 4, 0),
]


def _strings(word: bytes) -> list[bytes]:
    marked = b" " + word + b" "
    return [marked[max(0, end - toxicity.ORDER) : end] for end in range(2, len(marked) + 1)]


def _words(text: str) -> set[bytes]:
    out = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in text.encode())
    return set(out.split())


class Plain:
    def __init__(self):
        self.counts = {(y, f): Counter() for y in (0, 1) for f in toxicity.FOLDS}
        for text, f, y in TEXTS:
            for word in _words(text):
                self.counts[y, f].update(_strings(word))
        top = set().union(*self.counts.values())
        self.nexts, longer = defaultdict(dict), set()
        for n in range(toxicity.ORDER - 1, 0, -1):
            longer = longer | {s for s in top if len(s) == n + 1}
            kinds = Counter(s[1:] for s in longer)
            for s, k in kinds.items():
                self.nexts[s[:-1]][s[-1]] = k
            longer = set(kinds)

    def shared(self, s: bytes) -> float:
        after = self.nexts[s[:-1]]
        less = self.shared(s[1:]) if len(s) > 1 else 1 / 256
        return (max(after[s[-1]] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * less) / sum(after.values())

    def ratio(self, word: bytes, model: int) -> float:
        total = 0.0
        for s in _strings(word):
            seen = any(c[s] for c in self.counts.values())
            chance = {}
            for y in (0, 1):
                after = Counter()
                for f in toxicity.FOLDS:
                    if f != model:
                        after.update({t: n for t, n in self.counts[y, f].items() if t[:-1] == s[:-1]})
                whole, less = sum(after.values()), self.shared(s[1:]) if seen else 1.0
                left = toxicity.DISCOUNT * len(after) / whole if whole else 1.0
                chance[y] = (max(after[s] - toxicity.DISCOUNT, 0) / whole if whole else 0.0) + left * less
            total += math.log(chance[1] / chance[0])
        return total


def test_ratios_equal_a_plain_recursion(spark):
    apply_settings(spark)
    rows = [(text, (f - 1) * 2 + (1 - y)) for text, f, y in TEXTS] + [("unseen awkward 我们 x", -1), ("", -1)]
    schema = "word long, spelling binary, texts long, " + ", ".join(f"{c} long" for c in toxicity.COUNTS)
    counted = spark.createDataFrame(rows, "text string, kind long").repartition(3).mapInArrow(toxicity._count_words, schema)
    words = counted.groupBy("word", "spelling").agg(*[toxicity.F.sum(c).alias(c) for c in ("texts", *toxicity.COUNTS)]).cache()
    assert {bytes(r.spelling): r.texts for r in words.collect()} == dict(Counter(w for text, _ in rows for w in _words(text)))
    model, plain = toxicity.spelling_model(words), Plain()
    asked = words.crossJoin(spark.createDataFrame([(m,) for m in toxicity.MODELS], "model int"))
    got = {(r.word, r.model): r.ratio for r in toxicity.word_ratios(asked, model).collect()}
    for row in words.collect():
        for m in toxicity.MODELS:
            assert got.get((row.word, m), 0.0) == pytest.approx(plain.ratio(bytes(row.spelling), m), abs=1e-9), (row.spelling, m)


def test_endings_of_long_words_count(spark):
    apply_settings(spark)
    bad = "internationalabsolutelyelse"
    texts = [(i, f"internationalization of {bad if i % 2 else 'nations'} {i}") for i in range(200)]
    asked = [(900, f"internationalization of {bad} twice"), (901, "internationalization of nations twice")]
    docs = spark.createDataFrame([*texts, *asked], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert score[900] > 0.5 > score[901]


@pytest.mark.parametrize("held", [0, 3, 1 << 18])
def test_words_held_by_workers_change_nothing(spark, monkeypatch, held):
    apply_settings(spark)
    docs = spark.createDataFrame(
        [(i % 70, f"{'vile' if i % 3 == 0 else 'mild'} text of part {i % 7}") for i in range(120)] + [(None, "vile"), (None, None)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "WORDS_HELD", held)
    rows = sorted((str(r.doc_id), r.n_words, round(r.score, 9), round(r.mean, 9)) for r in toxicity.toxicity(docs, labels).collect())
    monkeypatch.setattr(toxicity, "WORDS_HELD", 1)
    assert len(rows) == 122
    again = sorted((str(r.doc_id), r.n_words, round(r.score, 9), round(r.mean, 9)) for r in toxicity.toxicity(docs, labels).collect())
    assert rows == again


def test_parts_and_places_change_no_ratio(spark, monkeypatch):
    apply_settings(spark)
    monkeypatch.setattr(toxicity, "WORDS_A_PART", 1)
    spelled = sorted(set().union(*[_words(text) for text, _, _ in TEXTS]) | {b"unseen", b"awfulest", "我们们".encode()})
    rows = []
    for i, word in enumerate(spelled):
        counts = [sum(word in _words(t) and (f, y) == (g, c) for t, f, y in TEXTS) for g in toxicity.FOLDS for c in (1, 0)]
        rows.append((i, bytearray(word), 1, *counts))
    schema = "word long, spelling binary, texts long, " + ", ".join(f"{c} long" for c in toxicity.COUNTS)
    words = spark.createDataFrame(rows, schema).cache()
    model, plain = toxicity.spelling_model(words), Plain()
    assert model.count() > 3 and model.select("place").distinct().count() == model.count()
    asked = words.crossJoin(spark.createDataFrame([(m,) for m in toxicity.MODELS], "model int"))
    got = {(r.word, r.model): r.ratio for r in toxicity.word_ratios(asked, model).collect()}
    assert len(got) == len(spelled) * len(toxicity.MODELS)
    for (i, m), ratio in got.items():
        assert ratio == pytest.approx(plain.ratio(spelled[i], m), abs=1e-9), (spelled[i], m)


def test_words_that_start_alike_send_their_strings_once():
    spelled = [b"internationalise" + bytes([97 + i % 26, 97 + i // 26]) for i in range(200)]
    packs = toxicity._packs(pa.table({"part": [0] * 200, "model": [0] * 200, "spelling": pa.array(spelled, pa.binary())}), 5)
    sent = sum(len(x) for x in packs["strings"].to_pylist()) // toxicity.ORDER
    assert sent == len(set().union(*[_strings(w) for w in spelled])) < 500 < sum(len(w) + 1 for w in spelled)


def test_shuffle_files_go_when_their_table_is_written(spark):
    def files() -> set[str]:
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}

    before = files()
    counted = written(spark.range(5_000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    made = files() - before
    assert made
    for _ in range(40):
        release(spark)
        if not made & files():
            break
        time.sleep(0.25)
    assert not made & files() and counted.count() == 7


def test_counted_words_leave_a_task_in_small_batches():
    text = " ".join(f"w{i}" for i in range(150_000))
    rows = pa.RecordBatch.from_arrays([pa.array([text, "w7 w7"]), pa.array([0, 3])], ["text", "kind"])
    batches = list(toxicity._count_words(iter([rows])))
    assert max(b.num_rows for b in batches) <= 1 << 16 and sum(b.num_rows for b in batches) == 150_000
    held = {r["spelling"]: r for b in batches for r in b.to_pylist()}
    assert held[b"w7"]["texts"] == 2 and [held[b"w7"][c] for c in toxicity.COUNTS] == [1, 0, 0, 1, 0, 0, 0, 0]
    assert held[b"w8"]["texts"] == 1 and sum(r["texts"] for r in held.values()) == 150_001
