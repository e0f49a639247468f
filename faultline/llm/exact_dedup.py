"""Exact duplicates by sorting contents: sampled splitters, external sort, neighbours compared in full.

Method. Texts lose their white space. Rows are range-partitioned by what they say (the first ``HEAD`` characters, then a hash of the
whole, so that the sampled splitters stay small however long texts are). Inside a partition Spark's external sort puts equal
texts side by side, longest original and smallest identifier first; each text is compared in full with its neighbour, and the first of a
run of equal ones is its head, which names the run. Rows of a key that more than ``RUN`` rows share are dealt to several
places of the order, so that no task gets them all; the heads that they leave, one for ``RUN`` rows or so, are sorted and
compared in full once more. Groups come from these comparisons alone: the digest is told, and decides nothing.

Defined results. A null text is an empty one, and all empty ones are equal. A null identifier comes after all others. Of repeated rows
(same text, same identifier) one is kept. No rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written, written_side
from .common import WHITE_SPACE, column, keyed

HEAD = 32
RUN = 10_000


def _with_runs(rows: DataFrame, *place: str) -> DataFrame:
    """Add head (whether a row is the first of a run of equal texts) and run (the head's ``row``), place by place."""
    order = Window.partitionBy(*place).orderBy("norm", F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last(), "row")
    marked = rows.withColumn("head", F.coalesce(F.col("norm") != F.lag("norm").over(order), F.lit(True)))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("run", F.last(F.when(F.col("head"), F.col("row")), ignorenulls=True).over(so_far))


def content_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = RUN, row_col: str | None = None
) -> DataFrame:
    """doc_id, row (``row_col``, or a number), n_chars, text_sha256, opening, mix, head, run; and norm, of heads that meet others again."""
    row: Column = F.monotonically_increasing_id() if row_col is None else column(row_col)
    text = F.coalesce(column(text_col), F.lit(""))
    rows = (
        docs.select(column(id_col).cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))
        .withColumns({"n_chars": F.length("text"), "norm": F.regexp_replace("text", WHITE_SPACE + "+", "")})
        .withColumns({"opening": F.substring("norm", 1, HEAD), "mix": F.xxhash64("norm")})
    )
    shared = rows.groupBy("mix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    places = shared.select("mix", F.ceil(F.col("n") / most).alias("places"))  # a row for more than ``most`` rows
    dealt = rows.drop("text").join(written_side(places, "shared"), "mix", "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("places")), F.lit(0)))
    ranged = dealt.repartitionByRange("opening", "mix", "salt")
    return _with_runs(ranged, "opening", "mix", "salt").select(
        "doc_id",
        "row",
        "n_chars",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        "opening",
        "mix",
        "head",
        "run",
        F.when(F.col("head") & F.col("places").isNotNull(), F.col("norm")).alias("norm"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = RUN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    return _groups(content_runs(docs, id_col, text_col, most)).drop("row")


def _groups(runs: DataFrame) -> DataFrame:
    rows = written(runs, "content-runs")
    again = rows.filter("norm is not null").select("doc_id", "row", "n_chars", "norm", "opening", "mix")
    met = _with_runs(again, "opening", "mix").select("row", F.col("run").alias("leader"))
    heads = rows.filter("head").select("row", F.col("doc_id").alias("id")).join(met, "row", "left")
    heads = heads.select("row", "id", F.coalesce("leader", "row").alias("leader"))
    sizes = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    of_run = heads.join(sizes, F.col("row") == F.col("run")).drop("run")
    first = F.max(F.when(F.col("row") == F.col("leader"), F.col("id")))
    groups = of_run.groupBy("leader").agg(first.alias("keep_id"), F.sum("n").alias("group_size"))
    named = of_run.select(F.col("row").alias("run"), "leader").join(groups, "leader")
    # Written, so that both sides of the join are plain exchanges, of which adaptive execution splits a long run's rows.
    named = written(named, "groups")
    return rows.join(named, "run").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("leader")).alias("kept"), "text_sha256", "row"
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with all their columns."""
    rows, key = keyed(docs)
    kept = _groups(content_runs(rows, id_col, text_col, row_col=key)).filter("kept").select(F.col("row").alias(key))
    return rows.join(kept, key, "left_semi").select(*[column(c) for c in docs.columns])
