"""URL filtering: host and path rules first, then gradient-boosted trees on lexical features.

Method. A url gives a host (after the first ``://``, A-Z lower-cased) and a path. Rules name a host and
the start of a path; the longest rule that fits decides. Where none fits, boosted trees decide from
lexical features: lengths, depths, digit ratio, character entropy, counts of parameters, hyphens and other
signs, the longest label, and statistics of the host's last label among the labelled urls (how many, and
the share of bad ones, pulled to the overall share). The trees are fitted on a sample of about ``SAMPLE`` different
labelled urls of each label at most, chosen by a hash of the url and weighted by their rows so that both labels count alike
in the sample; everything else covers all rows.
All of it is native expressions and the JVM's tree library.

Defined results. A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
its features. Rows come out one for one, repeated ones too. Labels other than 1 count as good, null
labels and null urls are not learnt from. With labels of one kind only, every url gets that kind; with none,
all are allowed. Other columns are not looked at.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written, written_side
from .common import column

SAMPLE = 20_000
SMOOTHING = 20.0
SIGNS = string.ascii_lowercase + string.digits


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    full = F.coalesce(url, F.lit(""))
    at = F.instr(full, "://")
    rest = F.when(at > 0, full.substr(at + 3, F.length(full))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    full = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(full, r"\?([^#]*)", 1)
    size = F.greatest(F.length(host), F.lit(1)).cast("double")
    entropy = F.lit(0.0)
    for sign in SIGNS:
        share = _count(host, sign) / size
        entropy = entropy - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    numbers = {
        "url_length": F.length(full),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": _count(host, "."),
        "path_depth": _count(path, "/"),
        "digit_ratio": F.length(F.regexp_replace(full, "[^0-9]+", "")) / F.greatest(F.length(full), F.lit(1)),
        "host_entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(1 + _count(query, "&")),
        "query_length": F.length(query),
        "hyphens": _count(host, "-"),
        "other_signs": F.length(F.regexp_replace(host, "[a-z0-9.-]+", "")),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
        "vowel_ratio": F.length(F.regexp_replace(host, "[^aeiou]+", "")) / size,
        "fragment": F.instr(full, "#"),
    }
    return {name: value.cast("double") for name, value in numbers.items()}


def _described(urls: DataFrame) -> DataFrame:
    """The rows of ``urls`` (with ``url``) and their host, path, suffix and features."""
    host, path = url_parts(F.col("url"))
    parted = urls.withColumns({"host": host, "path": path})
    return parted.withColumns(
        {"suffix": F.substring_index("host", ".", -1)} | lexical_features(F.col("url"), F.col("host"), F.col("path"))
    )


FEATURES = [
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_entropy", "parameters",
    "query_length", "hyphens", "other_signs", "longest_label", "vowel_ratio", "fragment", "suffix_count", "suffix_share",
]


class UrlModel:
    """Trees and suffix statistics; ``judged`` adds ``prediction`` (1.0 is bad)."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE, trees: int = 12, depth: int = 4, seed: int = 7):
        rows = labelled.select(
            column("url").alias("url"), F.when(column("label") == 1, 1.0).otherwise(0.0).alias("label"),
            column("label").alias("given"),
        ).filter("url is not null and given is not null").drop("given")
        found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("url", 0.02).alias("urls"))
        sizes = found.collect()
        counts = {r.label: r["rows"] for r in sizes}
        self.constant = None if len(counts) == 2 else max(counts, default=0.0)
        if self.constant is not None:
            return
        chance = F.pmod(F.xxhash64("url"), F.lit(1_000_000)) / 1e6
        # Of few urls all are taken, whatever the estimate of their number says.
        part = {r.label: 1.0 if r.urls <= 0.9 * sample else sample / r.urls for r in sizes}
        share = F.when(F.col("label") == 1.0, part[1.0]).otherwise(part[0.0])
        distinct = rows.filter(chance < share).groupBy("url", "label").agg(F.count(F.lit(1)).alias("copies"))
        chosen = written(_described(distinct), "labelled-urls")
        overall = counts[1.0] / sum(counts.values())
        self.overall = overall
        suffix = F.substring_index(url_parts(F.col("url"))[0], ".", -1)
        self.suffixes = written_side(
            rows.groupBy(suffix.alias("suffix")).agg(
                F.log1p(F.count(F.lit(1))).alias("suffix_count"),
                ((F.sum("label") + SMOOTHING * overall) / (F.count(F.lit(1)) + SMOOTHING)).alias("suffix_share"),
            ),
            "suffixes",
        )
        taken = {r.label: r.copies for r in chosen.groupBy("label").agg(F.sum("copies").alias("copies")).collect()}
        each = {label: 0.5 * sum(taken.values()) / n for label, n in taken.items()}
        data = self._assembled(chosen).withColumn(
            "weight", F.col("copies") * F.when(F.col("label") == 1.0, each.get(1.0, 0.0)).otherwise(each.get(0.0, 0.0))
        )
        self.trees = GBTClassifier(
            labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3,
            checkpointInterval=-1, seed=seed,
        ).fit(data.select("label", "weight", "features"))

    def _assembled(self, described: DataFrame) -> DataFrame:
        joined = described.join(self.suffixes, "suffix", "left").fillna(
            {"suffix_count": 0.0, "suffix_share": self.overall}
        )
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined)

    def judged(self, urls: DataFrame) -> DataFrame:
        described = _described(urls)
        if self.constant is not None:
            return described.withColumn("prediction", F.lit(self.constant))
        return self.trees.transform(self._assembled(described))


def url_verdicts(
    pages: DataFrame, model: UrlModel, rules: list[Rule], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), prediction (what the trees say)."""
    urls = pages.select(column(id_col).alias("page_id"), column(url_col).alias("url"))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return model.judged(urls).withColumn("fit", fit).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", by_method).alias("verdict"), F.col("prediction").cast("int").alias("prediction"),
    )


def seed_labels(urls: DataFrame, words: tuple[str, ...], url_col: str = "url") -> DataFrame:
    """url and label: 1 if a part of the host, between dots and hyphens, is one of ``words``."""
    host, _ = url_parts(column(url_col))
    parts = F.split(host, "[.-]")
    return urls.select(
        column(url_col).alias("url"), F.arrays_overlap(parts, F.array(*map(F.lit, words))).cast("int").alias("label")
    )
