"""Plain grouping by fingerprint, group frequency and group context."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.fingerprint import keyed
from .windows import with_representatives

_WIDE = "decimal(38,0)"


def fingerprint_groups(logs: DataFrame) -> DataFrame:
    """One row per fingerprint: count, first_seen, last_seen and the first log's id.

    Only fixed-width aggregates, so the grouping is a hash aggregate that
    combines before its shuffle; a hot fingerprint arrives as one row per task.
    The earliest (ts, log_id) is one decimal, time in the high digits.
    """
    rows = keyed(logs)
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast(_WIDE)
    # Ids are moved up to be non-negative below the time.
    place = micros * F.lit(Decimal(2**64)) + (F.col("log_id").cast(_WIDE) + F.lit(Decimal(2**63)))
    grouped = rows.select(
        "fingerprint", F.col("ts").cast("timestamp").alias("ts"), place.cast(_WIDE).alias("place")
    ).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min("place").alias("place"),
    )
    low = F.pmod("place", F.lit(Decimal(2**64))) - F.lit(Decimal(2**63))
    return grouped.withColumn("log_id", low.cast("long")).drop("place")


def dedup_groups(logs: DataFrame) -> DataFrame:
    """Groups with the text, service and error type of their first log."""
    return with_representatives(fingerprint_groups(logs), logs)


def ungrouped(logs: DataFrame) -> DataFrame:
    """Every log as a group of its own; the error type stays blank."""
    rows = keyed(logs)
    ts = F.col("ts").cast("timestamp")
    return rows.select(
        "fingerprint",
        F.lit(1).cast("long").alias("count"),
        ts.alias("first_seen"),
        ts.alias("last_seen"),
        "log_id",
        F.col("raw_log").alias("representative_log"),
        "service_name",
        F.lit("").alias("error_type"),
    )


def seconds_between(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(1e6)


def frequency_per_minute() -> Column:
    """Logs per minute over the group's span, taken as one second at least."""
    span = F.greatest(seconds_between(F.col("first_seen"), F.col("last_seen")), F.lit(1.0))
    return F.col("count") / span * F.lit(60.0)


def group_context() -> Column:
    """Text of a group for the model: the log, and how often it came."""
    note = F.format_string(
        V.GROUP_CONTEXT_FORMAT,
        seconds_between(F.col("first_seen"), F.col("last_seen")).cast("long"),
        F.col("count"),
        F.bround(frequency_per_minute(), 0).cast("long"),
    )
    log = F.col("representative_log")
    return F.when(F.col("count") > 1, F.concat(log, F.lit("\n"), note)).otherwise(log)
