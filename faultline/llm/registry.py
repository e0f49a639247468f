"""The queries of these operators over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    chat,
    exact_dedup,
    minhash_fingerprint,
    near_dedup,
    nearest,
    packing,
    periodic_runs,
    prefix_trie,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from .common import apply_settings, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_settings(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return run


# Words that name bad hosts: the seed from which urls are labelled.
BAD_HOST_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


@_query
def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.UrlModel(url_filter.seed_labels(pages, BAD_HOST_WORDS))
    return url_filter.url_verdicts(pages, model, URL_RULES)


@_query
def op2_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], rows.schema)
    return chat.chat_digests(chat.format_chats(rows.unionByName(extra)))


@_query
def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_minhash(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=4)


@_query
def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removal_digests(suffix_dedup.without_repeats(table(spark, sf_dir, "documents")))


@_query
def op6_packing(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), path))


@_query
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query
def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    coded = byte_bpe.encode_decode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return byte_bpe.coding_digests(coded)


@_query
def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), lambda: token_counts.sentencepiece_vocabulary(path), mark="\u2581"
    )


@_query
def op10_nearest(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op11_prefix_trie(spark, sf_dir):
    known = prefix_trie.paths(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_openings(known))


@_query
def op12_runs(spark, sf_dir):
    docs = periodic_runs.with_planted_period(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


@_query
def op13_fingerprints(spark, sf_dir):
    return minhash_fingerprint.beside_next(table(spark, sf_dir, "documents"))
