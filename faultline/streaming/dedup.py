"""Dedup and triage of log streams, and storm counts per clock window.

The windows left open by a micro-batch are kept as a table and precede the logs
of the next one. Each micro-batch thus runs the same distributed sweep as a log
table, so that a hot fingerprint is split here too, and in-order input gives the
same groups however it is cut into batches. Every batch writes folders of its own
number, emitted groups apart from open windows; a batch that is run again writes
the same folders again. Open windows are kept for two batches, then deleted.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import fixed_values as V
from ..functions.fingerprint import keyed
from ..operators.routing import audit_records, ignored_documents, outbox, route
from ..operators.rules import with_rule
from ..operators.scoring import ChatFactory, classify
from ..operators.windows import anchored_windows, with_representatives

GROUP_SCHEMA = (
    "log_id long, fingerprint string, kind string, count long, first_seen timestamp, last_seen timestamp, "
    "representative_log string, service_name string, error_type string"
)


def batch_folder(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch_id={batch_id}"


def _state(root: str, batch_id: int, state: str) -> str:
    return f"{batch_folder(f'{root}/groups', batch_id)}/state={state}"


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_state(spark: SparkSession, root: str, batch_id: int, state: str) -> DataFrame:
    """Groups of one state that a batch has left; a batch that never ran is an error, one without such groups is not."""
    path = _state(root, batch_id, state)
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        path = f"{batch_folder(f'{root}/groups', batch_id)}/_SUCCESS"
        if not files.exists(_folder(spark, path)[0]):
            raise FileNotFoundError(f"batch {batch_id} has left nothing in {root}")
        return spark.createDataFrame([], GROUP_SCHEMA)
    return spark.read.schema(GROUP_SCHEMA).parquet(path)


def _newest(batch: DataFrame, carried: DataFrame | None) -> int:
    """Newest log time so far, in microseconds: one number from one column."""
    micros = [batch.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]]
    if carried is not None:
        micros.append(carried.agg(F.max(F.unix_micros("last_seen"))).first()[0])
    return max([m for m in micros if m is not None], default=0)


def dedup_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    window_seconds: float = V.WINDOW_SECONDS,
    threshold: int = V.STORM_THRESHOLD,
    close_idle: bool = False,
    delay_seconds: float = 0,
) -> DataFrame:
    """Groups that one micro-batch emits; keeps the open windows for the next.

    With ``close_idle``, windows that are past their span at the newest log time
    less ``delay_seconds`` are emitted as EXPIRED and forgotten, and the next log
    of their fingerprint is NEW.
    """
    spark = batch.sparkSession
    carried = None
    if batch_id > 0:  # fails where the batch before has left nothing: its windows would be lost
        carried = _read_state(spark, root, batch_id - 1, "open")
    groups = anchored_windows(batch, window_seconds, threshold, eager=close_idle, carried=carried)
    # The error type is left to the join's few rows unless the table has it.
    columns = [c for c in ("log_id", "raw_log", "service_name", "error_type") if c in batch.columns]
    texts = batch.select(*columns)
    if carried is not None:
        texts = texts.unionByName(carried.withColumnRenamed("representative_log", "raw_log").select(*columns))
    told = with_representatives(groups, texts)
    if close_idle:
        age = F.lit(_newest(batch, carried)) - F.lit(int(delay_seconds * 1e6)) - F.unix_micros("first_seen")
        idle = (F.col("kind") == "FLUSH") & (age > int(window_seconds * 1e6))
        told = told.withColumn("kind", F.when(idle, F.lit("EXPIRED")).otherwise(F.col("kind")))
    columns = [part.split()[0] for part in GROUP_SCHEMA.split(", ")]
    here = batch_folder(f"{root}/groups", batch_id)
    state = F.when(F.col("kind") == "FLUSH", "open").otherwise("closed").alias("state")
    told.select(*columns, state).write.mode("overwrite").partitionBy("state").parquet(here)
    if batch_id > 1:  # the batch before this one may have to be read again, older ones may not
        folder, files = _folder(spark, _state(root, batch_id - 2, "open"))
        files.delete(folder, True)
    return _read_state(spark, root, batch_id, "closed")


def stream_dedup(
    stream: DataFrame, root: str, then: Callable[[DataFrame, int], None] | None = None, **options
) -> DataStreamWriter:
    """Writer of a dedup stream below ``root``; ``then(groups, batch_id)`` takes what is emitted."""

    def step(batch: DataFrame, batch_id: int) -> None:
        emitted = dedup_batch(batch, batch_id, root, **options)
        if then is not None:
            then(emitted, batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")


def emitted_groups(spark: SparkSession, root: str, flush: bool = False) -> DataFrame:
    """All groups a stream has emitted; with ``flush`` also the windows still open at its end."""
    groups = spark.read.schema(GROUP_SCHEMA + ", batch_id long, state string").parquet(f"{root}/groups")
    closed = groups.filter("state = 'closed'").drop("state")
    if not flush:
        return closed
    # Open windows are those of the newest batch; of the one before, which is still there, they are outdated.
    folder, files = _folder(spark, f"{root.rstrip('/')}/groups")
    newest = max(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder) if "=" in s.getPath().getName())
    last = _read_state(spark, root, newest, "open").withColumn("batch_id", F.lit(newest).cast("long"))
    return closed.unionByName(last)


def stream_triage(
    stream: DataFrame,
    root: str,
    chat_factory: ChatFactory | None = None,
    rules: list[tuple] | None = None,
    routes: DataFrame | None = None,
    **options,
) -> DataStreamWriter:
    """Dedup, rules, model and outboxes on a stream; results, audit, ignored and outbox tables."""
    return stream_dedup(stream, root, triage_writer(root, chat_factory, rules, routes), **options)


def triage_writer(
    root: str, chat_factory: ChatFactory | None = None, rules: list[tuple] | None = None, routes: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """What takes a batch's groups and writes its results, audit, ignored and outbox tables below ``root``."""

    def then(emitted: DataFrame, batch_id: int) -> None:
        results = classify(with_rule(emitted, rules=rules), chat_factory)
        results_at = batch_folder(f"{root}/results", batch_id)
        results.write.mode("overwrite").parquet(results_at)
        # Written once, so that a model is not asked again for every table below.
        told = emitted.sparkSession.read.schema(results.schema).parquet(results_at)
        audit_records(told).write.mode("overwrite").json(batch_folder(f"{root}/audit", batch_id))
        ignored_documents(told).write.mode("overwrite").json(batch_folder(f"{root}/ignored", batch_id))
        outbox(route(told, routes)).write.mode("overwrite").parquet(batch_folder(f"{root}/outbox", batch_id))

    return then


def storm_counts(logs: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Logs per clock window and fingerprint, for a stream or a table.

    Clock windows only resemble the anchored ones. On a stream, logs later than
    ``delay`` are dropped; the count combines before its shuffle.
    """
    timed = keyed(logs).select(F.col("ts").cast("timestamp").alias("ts"), "fingerprint")
    if logs.isStreaming:
        timed = timed.withWatermark("ts", delay)
    counted = timed.groupBy(F.window("ts", window), "fingerprint").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "fingerprint", "count"
    )
