"""Instruction-tuning tables: column names, chat form, length limit, split, labels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.severity import is_valid
from ..functions.text import strip
from ..session import written
from .scoring import strict_verdict


def sft_rows(records: DataFrame) -> DataFrame:
    """instruction/input/output under the trainer's names."""
    kept = [c for c in records.columns if c not in ("instruction", "input", "output")]
    return records.select(
        *kept,
        F.col("instruction").alias("prompt"),
        F.col("input").alias("query"),
        F.col("output").alias("response"),
    )


def user_message(prompt: Column, query: Column) -> Column:
    return F.concat(prompt, F.lit("\n\n"), query)


def sft_chat(rows: DataFrame) -> DataFrame:
    """Rows as (role, content) messages; the user's is instruction, blank line, input."""
    return rows.withColumn(
        "messages",
        F.array(
            F.struct(F.lit("user").alias("role"), user_message(F.col("prompt"), F.col("query")).alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")),
        ),
    )


def token_estimate(rows: DataFrame) -> Column:
    """Words of a row, standing in for the external tokenizer's count."""
    text = F.concat_ws(" ", "prompt", "query", "response")
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))


def within_cutoff(rows: DataFrame, cutoff: int = 2048) -> DataFrame:
    """Mark the rows that the trainer would cut at ``cutoff``; none is dropped."""
    return rows.withColumn("tokens", token_estimate(rows)).withColumn("over_cutoff", F.col("tokens") > cutoff)


def capped(rows: DataFrame, max_samples: int | None, *order: str) -> DataFrame:
    """The trainer's ``max_samples``: the first rows in a fixed order (all for None), which equal rows share.

    Only the order's columns and a hash of the row are sorted, by range partitions; partitions are counted, the last key
    that stays is read from the one that the count ends in, and the rows are filtered by it where they are. However many
    rows stay, no task gathers them.
    """
    if max_samples is None:
        return rows
    if max_samples <= 0:
        return rows.limit(0)
    key = [*[F.col(c) for c in order], F.xxhash64(*rows.columns)]
    names = [f"k{i}" for i in range(len(key))]
    keys = rows.select(*[k.alias(n) for k, n in zip(key, names, strict=True)])
    at = F.monotonically_increasing_id()
    placed = keys.repartitionByRange(*names).sortWithinPartitions(*names)
    placed = written(placed.withColumns({"part": F.spark_partition_id(), "at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "keys")
    left = max_samples
    for part, n in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        if left <= n:
            break
        left -= n
    else:
        return rows
    last = placed.filter((F.col("part") == part) & (F.col("at") == left - 1)).select(F.struct(*names)).first()[0]
    own, bound = F.struct(*key), F.struct(*[F.lit(v).cast(t) for v, (_, t) in zip(last, keys.dtypes, strict=True)])
    # Rows that equal the last one in everything: as many as the count asks for.
    tied = placed.filter((F.col("part") == part) & (F.col("at") < left) & (F.struct(*names) == bound)).count()
    return rows.filter(own < bound).union(rows.filter(own == bound).limit(tied))


def with_split(rows: DataFrame, val_size: float, *key: str) -> DataFrame:
    """'validation' for about ``val_size`` of the rows by a hash of their key, else 'train'."""
    digest = F.md5(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key]))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000
    return rows.withColumn(
        "split", F.when(share < round(val_size * 1000), F.lit("validation")).otherwise(F.lit("train"))
    )


def label_distribution(rows: DataFrame, column: str = "response") -> DataFrame:
    """Severity labels in the JSON of ``column``, counted; other texts count as UNKNOWN."""
    label = strict_verdict(strip(F.col(column)))["severity"]
    severity = F.when(is_valid(label), label).otherwise(F.lit("UNKNOWN"))
    counted = rows.select(severity.alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(r[0],) for r in V.SEVERITIES], "severity string")
    return every.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))
