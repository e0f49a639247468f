"""Late logs of a stream, kept beside those on time.

The watermark of a micro-batch is the newest log time of all batches before it, less a delay; a log at or before it is late. Each
batch is written once, split in two, and what it is counted by comes from that write (observed metrics), so neither the watermark nor
the counts cost another reading. A batch that runs again finds the same watermark and writes the same folders.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .dedup import batch_folder

_COUNTS = "batch_id long, watermark long, newest long, on_time long, late long"


def _counts_folder(root: str, batch_id: int) -> str:
    return batch_folder(f"{root}/watermarks", batch_id)


def split_late(batch: DataFrame, batch_id: int, root: str, delay_seconds: float = 600) -> DataFrame:
    """Write a micro-batch below ``root``, late logs apart, and give back those on time.

    The first batch has no watermark. A log without time is on time. Fails where the batch before has left nothing.
    """
    spark = batch.sparkSession
    newest = None
    if batch_id > 0:
        (newest,) = spark.read.schema(_COUNTS).parquet(_counts_folder(root, batch_id - 1)).select("newest").first()
    watermark = None if newest is None else newest - int(delay_seconds * 1_000_000)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    late = F.lit(False) if watermark is None else F.coalesce(micros <= watermark, F.lit(False))
    seen = Observation()
    split = batch.withColumn("late", late).observe(
        seen, F.max(micros).alias("newest"), F.count(F.lit(1)).alias("logs"), F.count_if(F.col("late")).alias("late")
    )
    at = batch_folder(f"{root}/logs", batch_id)
    split.write.mode("overwrite").partitionBy("late").parquet(at)
    found = seen.get
    newest = max((x for x in (newest, found["newest"]) if x is not None), default=None)
    counts = (batch_id, watermark, newest, found["logs"] - found["late"], found["late"])
    spark.createDataFrame([counts], _COUNTS).coalesce(1).write.mode("overwrite").parquet(_counts_folder(root, batch_id))
    told = spark.read.schema(split.schema).parquet(at)
    return told.filter(~F.col("late")).drop("late")


def stream_split_late(
    stream: DataFrame, root: str, then: Callable[[DataFrame, int], None] | None = None, delay_seconds: float = 600
) -> DataStreamWriter:
    """Writer of a stream's logs below ``root``; ``then(logs, batch_id)`` takes those on time."""

    def step(batch: DataFrame, batch_id: int) -> None:
        on_time = split_late(batch, batch_id, root, delay_seconds)
        if then is not None:
            then(on_time, batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")


def stored_logs(spark: SparkSession, root: str, late: bool | None = None) -> DataFrame:
    """Logs that a stream has stored, with batch_id and late; all, or late ones, or those on time."""
    logs = spark.read.parquet(f"{root}/logs")
    logs = logs.withColumn("late", F.col("late").cast("boolean"))  # told as text by the folders' names
    return logs if late is None else logs.filter(F.col("late") == late)


def late_counts(spark: SparkSession, root: str) -> DataFrame:
    """batch_id, watermark and newest (microseconds), on_time, late: a row for each batch."""
    names = [part.split()[0] for part in _COUNTS.split(", ")]
    return spark.read.schema(_COUNTS).parquet(f"{root}/watermarks").select(*names)
