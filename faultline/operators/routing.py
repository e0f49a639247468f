"""Routing of triage results and the tables that leave the system."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.severity import emoji
from ..functions.text import blank_as
from ..session import written
from .dedup import frequency_per_minute

ROUTE_SCHEMA = "severity string, handler string, seq int"
DeliverFactory = Callable[[], Callable[[str, str], bool]]


def default_routes(spark: SparkSession) -> DataFrame:
    """Audit for P0 to P3, the archive of ignored logs for P3, nothing for UNKNOWN."""
    rows = [(s, "audit", 1) for s in V.VALID_SEVERITIES] + [("P3_IGNORE", "ignored_archive", 2)]
    return spark.createDataFrame(rows, ROUTE_SCHEMA)


def route(results: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """One row per (result, handler of its severity), in ``seq`` order per result."""
    if routes is None:  # five rows; how to join a caller's table is left to Spark
        routes = F.broadcast(default_routes(results.sparkSession))
    return results.join(routes, "severity")


def _utc(ts: Column | str) -> Column:
    zoned = F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), "UTC")
    return F.date_format(zoned, V.UTC_FORMAT)


def audit_records(results: DataFrame, now: Column | None = None) -> DataFrame:
    """Audit lines: time, the eight result fields and a preview of the log."""
    return results.select(
        _utc(F.current_timestamp() if now is None else now).alias("ts"),
        "severity",
        "reason",
        "action",
        "source",
        F.col("service_name").alias("service"),
        "count",
        F.bround(frequency_per_minute(), 1).alias("frequency"),
        "fingerprint",
        F.substring("representative_log", 1, V.AUDIT_PREVIEW_CHARS).alias("raw_log_preview"),
    )


def ignored_documents(results: DataFrame, now: Column | None = None) -> DataFrame:
    """Index documents of the ignored logs."""
    return results.filter(F.col("severity") == "P3_IGNORE").select(
        _utc(F.current_timestamp() if now is None else now).alias("@timestamp"),
        F.lit(True).alias("ai_ignored"),
        F.col("severity").alias("ai_severity"),
        F.col("reason").alias("ai_reason"),
        F.col("service_name").alias("service"),
        "fingerprint",
        "count",
        F.substring("representative_log", 1, V.IGNORED_PREVIEW_CHARS).alias("raw_log"),
    )


# --- message bodies -----------------------------------------------------------------


def notification_body() -> Column:
    text = F.format_string(
        V.NOTIFY_TEXT_FORMAT,
        F.col("severity"),
        blank_as(F.col("service_name"), "unknown"),
        F.col("reason"),
        F.col("action"),
        F.col("count"),
    )
    return F.struct(text.alias("text"), F.col("severity").alias("severity"))


def markdown_body() -> Column:
    text = F.format_string(
        V.MARKDOWN_TEXT_FORMAT,
        emoji(F.col("severity")),
        F.col("severity"),
        F.col("service_name"),
        F.col("reason"),
        F.col("action"),
        F.col("count"),
        F.col("source"),
    )
    title = F.format_string(V.MARKDOWN_TITLE_FORMAT, F.col("severity"))
    return F.struct(
        F.lit("markdown").alias("msgtype"), F.struct(title.alias("title"), text.alias("text")).alias("markdown")
    )


def attachment_body() -> Column:
    severity = F.col("severity")
    colors = F.create_map(*[F.lit(v) for pair in V.ATTACHMENT_COLORS.items() for v in pair])
    title = F.format_string(V.ATTACHMENT_TITLE_FORMAT, emoji(severity), severity, F.col("service_name"))
    return F.struct(
        F.array(
            F.struct(
                F.coalesce(colors[severity], F.lit(V.ATTACHMENT_DEFAULT_COLOR)).alias("color"),
                title.alias("title"),
                F.format_string(V.ATTACHMENT_TEXT_FORMAT, F.col("reason"), F.col("action")).alias("text"),
                F.format_string(V.ATTACHMENT_FOOTER_FORMAT, F.col("count"), F.col("source")).alias("footer"),
            )
        ).alias("attachments")
    )


BODIES = {"notification": notification_body, "markdown": markdown_body, "attachment": attachment_body}


def outbox(routed: DataFrame, bodies: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Add the JSON body that each row's handler sends; others have none.

    ``bodies`` maps a handler to an expression over the result columns, so a
    caller's own handler is one more entry.
    """
    body = F.lit(None).cast("string")
    for handler, build in (bodies or BODIES).items():
        body = F.when(F.col("handler") == handler, F.to_json(build())).otherwise(body)
    return routed.withColumn("body", body)


def deliver(rows: DataFrame, deliver_factory: DeliverFactory) -> DataFrame:
    """Send each outbox row and add whether that worked; a failure stops nothing.

    Outcomes are written as they come and read back, so that reading them again sends nothing again. A task that
    Spark repeats after a loss may send its rows once more.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deliver_one = deliver_factory()

        def worked(handler, body):
            try:
                return bool(deliver_one(handler, body))
            except Exception:
                return False

        for batch in batches:
            sent = [worked(h, b) for h, b in zip(batch["handler"], batch["body"])]
            yield batch.assign(sent=sent)

    return written(rows.mapInPandas(send, f"{fields}, sent boolean"), "deliveries")


# --- sinks --------------------------------------------------------------------------


def write_audit(results: DataFrame, path: str, mode: str = "append", now: Column | None = None) -> None:
    """Audit records as JSON lines."""
    audit_records(results, now).write.mode(mode).json(path)


def write_ignored(results: DataFrame, path: str, mode: str = "append", now: Column | None = None) -> None:
    """Audit records of ignored logs as JSON lines, kept apart."""
    audit_records(results.filter(F.col("severity") == "P3_IGNORE"), now).write.mode(mode).json(path)


def report_texts(reports: DataFrame, label: Column) -> DataFrame:
    return reports.select(
        "log_id", F.concat(F.format_string(V.REPORT_TITLE_FORMAT, label), F.col("markdown")).alias("value")
    )


def write_reports(reports: DataFrame, path: str, label: Column, mode: str = "append") -> None:
    """One titled Markdown report per row."""
    report_texts(reports, label).write.mode(mode).parquet(path)
