"""Urls, chats, toxicity, neighbours and the pipeline against plain evaluations."""

import hashlib
import math
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import database, difference
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from faultline.llm import chat, nearest, toxicity, url_filter  # noqa: E402
from faultline.llm.common import apply_settings  # noqa: E402
from faultline.llm.components import components  # noqa: E402
from faultline.llm.registry import BAD_HOST_WORDS, QUERIES, URL_RULES  # noqa: E402
from faultline.llm.sql import SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    found, _ = difference(spark, database(sf_dir), QUERIES[name], SQL[name], sf_dir)
    assert found is None, found


# --- urls ------------------------------------------------------------------------------

URLS = [
    "http://a.com/x", "HTTP://WWW.Example.COM/en/1?a=1&b=2#f", "https://example.com/en/", "https://m.example.com/en/x", "https://example.com/en",
    "http://x.net/es/1", "http://net/fr/", "http://x.net", "no scheme", "", None, "://", "http://?q", "http://#", "x://y://z.com/p", "http://a.com?x/",
    "http://notcom/", "http://é.NET/es/", "http://h" + "o" * 40_000 + "st.org/en/", "http://a.com/x",
]


def _parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return lower, re.match("[^?#]*", rest[len(host) :])[0]


def _rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules_and_trees(spark):
    rows = [(i, u, "clash", 1.0) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, prediction double")
    bad = [f"http://{w}-{k}x.example.org/en/{k}" for w in BAD_HOST_WORDS for k in range(30)]
    good = [f"http://{w}{k % 9}.example.org/en/{k}" for w in ("alpha", "beta", "gamma") for k in range(120)]
    given = spark.createDataFrame([(u,) for u in [*bad, *good, None]], "url string")
    model = url_filter.UrlModel(url_filter.seed_labels(given, BAD_HOST_WORDS))
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, model, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = _parts(url)
        rule = _rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.text if rule else None), url
        assert got[i].verdict == (rule.verdict if rule else "block" if got[i].prediction else "allow")
    fresh = spark.createDataFrame(
        [(0, "http://bets-777q.example.org/en/9"), (1, "http://delta4.example.org/en/7")], "page_id long, url string"
    )
    assert [r.verdict for r in url_filter.url_verdicts(fresh, model, URL_RULES).orderBy("page_id").collect()] == ["block", "allow"]
    assert url_filter.url_verdicts(pages.filter("false"), model, URL_RULES).count() == 0


def test_labels_of_one_kind_or_none(spark):
    pages = spark.createDataFrame([(1, "http://x.org/"), (2, None)], "page_id long, url string")
    for labels, verdict in (([], "allow"), ([("http://a.b", 1)], "block"), ([("http://a.b", 0), (None, 1)], "allow")):
        model = url_filter.UrlModel(spark.createDataFrame(labels, "url string, label int"))
        assert {r.verdict for r in url_filter.url_verdicts(pages, model, []).collect()} == {verdict}


def test_a_cut_sample_keeps_balance_and_statistics(spark, monkeypatch):
    """The larger label is cut: both weigh alike in what the trees see, and suffixes are counted on all rows."""
    seen = []

    class Kept(url_filter.GBTClassifier):
        def fit(self, data):
            seen.extend(data.select("label", "weight").collect())
            return super().fit(data)

    monkeypatch.setattr(url_filter, "GBTClassifier", Kept)
    bad = [(f"http://spam-{k}x.example.org/en/{k}", 1) for k in range(50)]
    good = [(f"http://alpha{k}.example.com/en/{k}", 0) for k in range(3000)] + [("http://alpha0.example.com/en/0", 0)] * 500
    model = url_filter.UrlModel(spark.createDataFrame([*bad, *good], "url string, label int"), sample=400)
    weights = {y: [r.weight for r in seen if r.label == y] for y in (0.0, 1.0)}
    assert len(weights[1.0]) == 50 and 250 < len(weights[0.0]) < 550
    assert sum(weights[1.0]) == pytest.approx(sum(weights[0.0]))
    counts = {r.suffix: r.suffix_count for r in model.suffixes.collect()}
    assert counts == {"org": pytest.approx(math.log1p(50)), "com": pytest.approx(math.log1p(3500))}


def test_held_out_urls_of_the_tables(spark, sf_dir):
    apply_settings(spark)
    pages = spark.read.parquet(os.path.join(sf_dir.replace("sf0.001", "sf0.01"), "pages.parquet")).select("page_id", "url")
    held = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    model = url_filter.UrlModel(url_filter.seed_labels(pages.filter(~held), BAD_HOST_WORDS))
    test = url_filter.url_verdicts(pages.filter(held), model, []).join(
        pages.select("page_id", url_filter.url_parts(F.col("url"))[0].alias("own")), "page_id"
    )
    bad = F.arrays_overlap(F.split("own", "[.-]"), F.array(*map(F.lit, BAD_HOST_WORDS))).cast("int")
    right = test.agg(F.avg((bad == F.col("prediction")).cast("int"))).first()[0]
    assert right >= 0.95


# --- chats -----------------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a </s>[INST] \\ \\\\ <<SYS>> [ROLE]x[/ROLE] [END] <"), (2, 1, "assistant", "second"), (2, 0, "user", None),
    (3, 0, "tool[/ROLE]", "t[END]"), (3, 1, None, "no role"), (4, 0, "system", ""), (4, 1, "user", "[\\"), (4, 2, "assistant", "<\\s>\\"),
    (5, 0, "user", "same"), (5, 0, "user", "same"), (6, None, "user", "null turn"), (None, 0, "assistant", "null id"), (7, 0, "user", "x" * 50_000 + "<"),
    (7, 1, "assistant", "漢字é\n\n"), (8, 0, "assistant", "first"), (9, 0, "user", "q"),
]


def test_chats_are_read_back_from_their_text(spark):
    rows = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, turns string, loss int")
    chats = chat.format_chats(rows)
    held = defaultdict(list)
    for c, n, role, text in TURNS:
        held[c].append((-1 if n is None else n, role or "", text or ""))
    got = {r.conv_id: r for r in chat.chat_digests(chats).collect()}
    texts = {r.conv_id: r.f for r in chats.select("conv_id", chat.formatted_text(F.col("segments")).alias("f")).collect()}
    assert set(got) == set(held)
    for c, turns in held.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        row = got[c]
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == len(texts[c])
        roles = [r for _, r, _ in turns]
        assert row.valid == (re.fullmatch("(system )?(user assistant )+", " ".join(roles) + " ") is not None)
    failed = {r.conv_id: r.failed_at for r in chats.collect()}
    assert failed[1] is None and failed[5] == 1 and failed[8] == 0 and failed[3] == 0
    assert chat.format_chats(rows.filter("false")).count() == 0


def test_templates_must_be_readable():
    with pytest.raises(ValueError):
        chat.Template(roles={"a": chat.Role("[X]", "[Y]"), "b": chat.Role("[X]", "[Z]")}, follows={}, ends=())
    with pytest.raises(ValueError):
        chat.Template(roles={"a": chat.Role("[\\X]", "[Y]")}, follows={}, ends=())


# --- toxicity --------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    got = QUERIES["op3_toxicity"](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    test = got[got.held_out].merge(labels, on="doc_id")
    toxic, rank = test.toxic == 1, test.score.rank()
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.94
    assert (test.predicted[toxic]).mean() > 0.85 and test.predicted[~toxic].mean() < 0.01


def test_labels_of_the_held_out_fold_are_not_read(spark):
    apply_settings(spark)
    words = ["calm", "kind", "bright", "awful"]
    rows = [(i, f"{words[i % 3]} {words[3] if i % 4 == 0 else words[(i + 1) % 3]} text {i}", 0.5) for i in range(300)]
    rows += [(1000, None, 0.1), (1001, "", 0.1), (None, "awful", 0.1), (5, rows[5][1], 0.5), (1002, "awful " * 20_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = [(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (3, None), (4, 0)]
    plain = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = spark.createDataFrame(
        [(i, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels],
        "doc_id long, toxic int",
    )
    first, second = (
        sorted((str(r.doc_id), r.n_words, round(r.score, 9)) for r in toxicity.toxicity(docs, x).collect()) for x in (plain, turned)
    )
    assert first == second and len(first) == len(rows)
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, plain).collect()}
    assert score[1002] > 0.5 > score[1001] == score[1000]
    assert toxicity.toxicity(docs.filter("false"), plain).count() == 0
    none = toxicity.toxicity(docs, plain.filter("false"))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.0, 0)}


# --- neighbours ------------------------------------------------------------------------


def _brute(rows, k, asked):
    own = {}
    for i, v in rows:
        good = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8
        if good and (i not in own or v < own[i]):
            own[i] = v
    out = {}
    for q in filter(asked, own):
        near = []
        for i, v in own.items():
            if i != q:
                a, b = (x / np.abs(x).max() for x in (np.array(own[q]), np.array(v)))
                near.append((-float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), i))
        out[q] = sorted((round(s, 9), i) for s, i in near)[:k]
    return out


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    apply_settings(spark)
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(200)]
    hot = [float(x) for x in rng.standard_normal(8)]
    rows += [(i, hot) for i in range(300, 400)]  # one vector a hundred times: ties go to the smaller identifier
    rows += [(500, None), (510, [0.0] * 8), (520, [math.nan] + [1.0] * 7), (530, [math.inf] + [1.0] * 7), (540, [1.0]), (None, hot), (0, rows[0][1])]
    rows += [(600 + 10 * n, [x * scale for x in rows[7][1]]) for n, scale in enumerate((1e200, 1e-200, 1e-310, 1e307))]  # extreme, but finite
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, ids int").repartition(4)
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(-r.score, 9), r.vec_id))
        assert r.rank == len(got[r.query_id])
    expected = _brute(rows, 5, lambda i: i % 10 == 0)
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in v}) for q, v in expected.items())
    assert hits >= 0.9 * 5 * len(expected)
    assert all(got[q] == expected[q] for q in expected if 300 <= q < 400)
    few = nearest.nearest(df.filter("vec_id in (10, 20, 30)"), F.col("vec_id") == 10).collect()
    assert sorted(r.vec_id for r in few) == [20, 30]
    assert nearest.nearest(df.filter("false"), F.lit(True)).count() == 0


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    index = nearest.MultiIndex(codes)
    for radius in (0, 3, 7, 8, 20, 27, 31, 64):
        for code in codes[:12]:
            expected = np.flatnonzero(nearest.hamming(codes, code) <= radius)
            assert index.within(code, radius).tolist() == expected.tolist()


def test_recall_on_the_table(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.array(table.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = QUERIES["op10_nearest"](spark, folder).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for i in np.flatnonzero(table.vec_id % 50 == 0):
        score = x @ x[i]
        score[i] = -2
        hits.append(len(set(table.vec_id[np.argsort(-score)[:5]]) & got[table.vec_id[i]]))
    assert sum(hits) / (5 * len(hits)) >= 0.9


# --- components and the pipeline -------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 7), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[339] == got[7] == 5 and got[901] == 900
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_judges_rows_without_or_with_equal_identifiers(spark, sf_dir):
    """The table twice, and once more without identifiers: nothing toxic stays, and one row of each text does."""
    once = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nameless = once.withColumn("doc_id", F.lit(None).cast("long"))
    docs = once.union(once).union(nameless)
    calm = corpus_pipeline.drop_toxic(spark, docs, sf_dir).cache()
    toxic = {r.doc_id for r in QUERIES["op3_toxicity"](spark, sf_dir).filter("predicted = 1").collect()}
    bad = {r.text for r in once.collect() if r.doc_id in toxic}
    assert bad and not bad & {r.text for r in calm.collect()}
    squeezed = lambda text: re.sub("[\x20\x09-\x0d]", "", text)
    exact = corpus_pipeline.drop_copies(spark, calm, sf_dir).collect()
    assert len(exact) == len({squeezed(r.text) for r in exact}) == len({squeezed(r.text) for r in calm.collect()})
    near = corpus_pipeline.drop_near_copies(spark, calm, sf_dir).collect()
    expected = corpus_pipeline.drop_near_copies(spark, calm.filter("doc_id is not null").dropDuplicates(["doc_id"]), sf_dir).collect()
    assert sorted(r.doc_id for r in near if r.text.split()) == sorted(r.doc_id for r in expected if r.text.split())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.schema, [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.schema.simpleString() == columns.simpleString()
        seen.append({r.doc_id: r.text for r in docs.collect()})
    raw, calm, exact, near, cut = seen
    predicted = {r.doc_id: r.predicted for r in QUERIES["op3_toxicity"](spark, sf_dir).collect()}
    assert calm == {i: t for i, t in raw.items() if not predicted[i]}
    squeezed = defaultdict(list)
    for i, t in calm.items():
        squeezed[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), i))
    assert set(exact) == {min(rows)[1] for rows in squeezed.values()}
    from test_documents import _components, _removed

    assert set(near) == {i for i, _, c in _components(sorted(exact.items()), 5) if i == c}
    expected = _removed(sorted(near.items()), 100)
    assert cut == {i: expected[i, t][3].decode("utf-8", "ignore") for i, t in near.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(cut)
    again = corpus_pipeline.run(spark, sf_dir)
    assert sum(p.length for p in pieces) == again.agg(F.sum("length")).first()[0]
