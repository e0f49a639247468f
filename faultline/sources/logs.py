"""Log sources: line files, whole-incident files and streams."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import rstrip
from ..session import listed_in_few_tasks, small_files_together, written, written_side

LOG_SCHEMA = "log_id long, ts timestamp, service_name string, raw_log string"


def _file_time() -> Column:
    return F.col("_metadata.file_modification_time")


def read_log_lines(spark: SparkSession, path: str, service_name: str = "") -> DataFrame:
    """One record per non-empty line; bad bytes are replaced.

    Lines carry no time of their own, so ``ts`` is the file's and ``log_id``
    follows the order of reading. Write the table once before several jobs
    have to agree on ``log_id``.
    """
    lines = spark.read.text(path)
    return (
        lines.select(
            F.monotonically_increasing_id().alias("log_id"),
            _file_time().alias("ts"),
            F.lit(service_name).alias("service_name"),
            rstrip(F.make_valid_utf8("value")).alias("raw_log"),
        )
        .filter(F.col("raw_log") != "")
    )


def read_numbered_lines(spark: SparkSession, path: str, service_name: str = "") -> DataFrame:
    """``read_log_lines`` with file_path and line_no, and a ``log_id`` that is the same however files are split.

    Lines are numbered from 1 in each file, empty ones included; ``log_id`` counts from 0 through all files in the order of their
    paths. A first pass reads no text: it counts the lines of each block of a file, and sums of these counts tell where a
    block begins. The second pass adds that to a line's place in its block, so no text is shuffled or sorted.
    """
    block = ["file_path", "block"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        # Lines of a block stand next to one another in their partition.
        F.monotonically_increasing_id().alias("at"),
        _file_time().alias("ts"),
        "value",
    )
    blocks = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    blocks = written(blocks, "blocks")
    of_file = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file_path").agg(F.sum("n").alias("lines"))
    so_far = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("file_path", F.coalesce(F.sum("lines").over(so_far), F.lit(0)).alias("before"))
    placed = blocks.withColumn("shift", F.coalesce(F.sum("n").over(of_file), F.lit(0)) - F.col("first"))
    placed = written_side(placed.join(files, "file_path").select(*block, "shift", "before"), "blocks")
    line = F.col("at") + F.col("shift")
    return (
        lines.join(placed, block)
        .select(
            (F.col("before") + line).alias("log_id"),
            "ts",
            F.lit(service_name).alias("service_name"),
            rstrip(F.make_valid_utf8("value")).alias("raw_log"),
            "file_path",
            (line + 1).alias("line_no"),
        )
        .filter(F.col("raw_log") != "")
    )


def read_incident_files(spark: SparkSession, path: str, service_name: str = "", plain: bool = False, **options) -> DataFrame:
    """One record per file, stack trace lines kept together.

    With ``recursiveFileLookup`` among the reader's ``options``, no columns are made of the names of a great many folders. With
    ``plain`` files are read as they are, whatever their names end with; else a codec is looked for anew for each file, which takes
    longer than to read a small one.
    """
    with listed_in_few_tasks(spark):
        reader = spark.read.options(**options)
        files = reader.format("binaryFile").load(path) if plain else reader.text(path, wholetext=True)
    return small_files_together(files).select(
        F.monotonically_increasing_id().alias("log_id"),
        _file_time().alias("ts"),
        F.lit(service_name).alias("service_name"),
        F.make_valid_utf8(F.col("content").cast("string") if plain else F.col("value")).alias("raw_log"),
    )


def read_log_stream(
    spark: SparkSession,
    path: str | None = None,
    format: str = "parquet",
    schema: str | StructType = LOG_SCHEMA,
    **options,
) -> DataFrame:
    """Unbounded log records from a file source, or from Kafka by its options."""
    reader = spark.readStream.format(format).options(**options)
    if format == "kafka":
        return logs_from_messages(reader.load(), schema)
    reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def logs_from_messages(messages: DataFrame, schema: str | StructType = LOG_SCHEMA) -> DataFrame:
    """Messages with a JSON ``value`` as log records."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("log")).select("log.*")
