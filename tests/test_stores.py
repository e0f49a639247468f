"""Answers, snapshots and lines that are kept in stores."""

import os

import pytest
from pyspark.sql import functions as F

from faultline.operators import retrieval
from faultline.operators.answers import answered, stored_answers
from faultline.operators.scoring import chat_over
from faultline.sources import snapshots


def counting(spark, fails=lambda text, no: False):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        seen = {}

        def chat(system, user, temperature, max_tokens):
            calls.add(1)
            seen[user] = seen.get(user, 0) + 1
            if fails(user, seen[user]):
                raise OSError("down")
            return f"{system}|{user}|{temperature}|{max_tokens}", "m", {"n": len(user)}

        return chat

    return factory, calls


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, user_text string").repartition(3)


def test_answers_are_asked_once_and_kept(spark, tmp_path):
    store = f"{tmp_path}/answers"
    factory, calls = counting(spark)
    texts = ["a", "b", "a", "a", None, "c"] * 20
    first = {r.id: r for r in answered(asked(spark, texts), store, factory, "sys", 0.1, 9, ("<", ">")).collect()}
    assert calls.value == 3 and stored_answers(spark, store).count() == 3
    assert {i: r.content for i, r in first.items()} == {i: t and f"sys|<{t}>|0.1|9" for i, t in enumerate(texts)}
    again = {r.id: r for r in answered(asked(spark, texts + ["d"]), store, factory, "sys", 0.1, 9, ("<", ">")).collect()}
    assert calls.value == 4 and all(again[i].content == r.content for i, r in first.items())
    assert again[0].elapsed_ms == 0 and again[0].usage == {"n": 3} and again[4].usage == {}
    # Another setting is another question.
    answered(asked(spark, ["a"]), store, factory, "sys", 0.2, 9, ("<", ">")).collect()
    answered(asked(spark, ["a"]), store, factory, "other", 0.1, 9, ("<", ">")).collect()
    assert calls.value == 6
    assert answered(asked(spark, texts).filter("false"), store, factory, "sys", 0.1, 9).collect() == [] and calls.value == 6


def test_failed_answers_are_not_kept(spark, tmp_path):
    store = f"{tmp_path}/answers"
    factory, calls = counting(spark, lambda text, no: "bad" in text)
    got = {r.id: r for r in answered(asked(spark, ["good", "bad"]), store, factory, "s", 0.0, 1).collect()}
    assert (got[0].error, got[1].error, got[1].content) == (None, "down", None)
    answered(asked(spark, ["good", "bad"]), store, factory, "s", 0.0, 1).collect()
    assert calls.value == 3 and stored_answers(spark, store).count() == 1


@pytest.mark.parametrize("at_once", [1, 8])
def test_calls_are_tried_again(spark, at_once):
    factory, calls = counting(spark, lambda text, no: no < 3)
    rows = asked(spark, [f"t{i}" for i in range(20)] + [None]).coalesce(2)
    got = chat_over(rows, factory, "s", 0.0, 1, at_once=at_once, tries=3, wait_seconds=0.001).collect()
    assert calls.value == 60 and all((r.content is None) == (r.id == 20) and r.error is None for r in got)
    few = chat_over(rows, factory, "s", 0.0, 1, at_once=at_once, tries=2, wait_seconds=0.001).collect()
    assert {r.error for r in few if r.id < 20} == {"down"}
    assert {r.id: r.content.split("|")[1] for r in got if r.id < 20} == {i: f"t{i}" for i in range(20)}


def files(spark, ref, texts, sha=""):
    return spark.createDataFrame([(ref, p, t, sha) for p, t in texts.items()], "ref string, file_path string, text string, commit_sha string")


def test_refs_share_their_texts(spark, tmp_path):
    store = str(tmp_path)
    first = {f"f{i}": f"text {i % 7}\n" for i in range(20)}
    assert snapshots.store_refs(files(spark, "a", first, "sha-a"), store) == 7
    written = {os.path.join(d, n) for d, _, names in os.walk(f"{store}/blobs") for n in names}
    assert snapshots.store_refs(files(spark, "b", first, "sha-b"), store) == 0
    second = first | {"f3": "changed", "new": "text 0\n"}
    assert snapshots.store_refs(files(spark, "c", second), store) == 1
    assert written <= {os.path.join(d, n) for d, _, names in os.walk(f"{store}/blobs") for n in names}
    got = {(r.ref, r.file_path): (r.text, r.commit_sha) for r in snapshots.stored_files(spark, store).collect()}
    assert got == {(ref, p): (t, sha) for ref, held, sha in (("a", first, "sha-a"), ("b", first, "sha-b"), ("c", second, "")) for p, t in held.items()}
    # A ref that is stored again takes the place of what it had; others stay.
    assert snapshots.store_refs(files(spark, "b", {"only": "here"}), store) == 1
    assert [(r.file_path, r.text) for r in snapshots.stored_files(spark, store, "b").collect()] == [("only", "here")]
    assert snapshots.stored_files(spark, store, "a", "c").count() == 41


@pytest.mark.parametrize(("block", "context"), [(4, 3), (64, 3), (3, 10), (1, 2)])
def test_windows_from_blocks_equal_windows_from_files(spark, tmp_path, block, context):
    store = str(tmp_path)
    texts = {f"f{n}": "\n".join(f"line {n} {i}" for i in range(n)) for n in (0, 1, 3, 4, 5, 64, 65, 200)} | {"gap": "\n\na\n\n"}
    code = files(spark, "HEAD", texts, "s")
    snapshots.store_refs(code, store)
    snapshots.store_blocks(spark, store, block)
    snapshots.store_blocks(spark, store, block)  # nothing is cut twice
    places = [(i, "HEAD", p, c) for i, (p, c) in enumerate((p, c) for p in [*texts, "none"] for c in (1, 2, 4, 5, 63, 64, 65, 66, 199, 900))]
    requests = spark.createDataFrame(places, "log_id long, ref string, file_path string, center int")
    keys = ["ref", "file_path", "center", "commit_sha", "start_line", "end_line", "content"]
    plain = retrieval.cut_snippets(requests, code, context).select(*keys).collect()
    held = snapshots.stored_blocks(spark, store)
    got = retrieval.cut_stored_snippets(requests, snapshots.file_lengths(spark, store), held, context, block)
    assert sorted(got.select(*keys).collect()) == sorted(plain) and len(plain) == 90


def test_a_window_reads_two_blocks_of_a_large_file(spark, tmp_path):
    store = str(tmp_path)
    big = spark.range(1).select(
        F.lit("HEAD").alias("ref"), F.lit("big").alias("file_path"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("text"),
        F.lit("").alias("commit_sha"),
    )
    snapshots.store_refs(big, store)
    snapshots.store_blocks(spark, store)
    requests = spark.createDataFrame([(1, "HEAD", "big", 50_000)], "log_id long, ref string, file_path string, center int")
    held = snapshots.stored_blocks(spark, store)
    assert held.count() == -(-100_000 // 64) and held.agg(F.max(F.size("lines"))).first()[0] == 64
    joined = held.filter(F.col("block").isin((49_960 - 1) // 64, (50_040 - 1) // 64))
    assert joined.count() == 2  # the window's blocks, and all of it comes from them
    assert retrieval.cut_stored_snippets(requests, snapshots.file_lengths(spark, store), joined).first().window[80] == "line 50040"
    got = retrieval.cut_stored_snippets(requests, snapshots.file_lengths(spark, store), held).first()
    assert (got.start_line, got.end_line, len(got.window)) == (49_960, 50_040, 81) and got.window[40] == "line 50000"
