"""Reading, settings and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

WHITE_SPACE = r"[\x20\x09-\x0D]"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Whole texts cross to Python; a batch ends at whichever comes first.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def apply_settings(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; a null text is empty."""
    return docs.select(
        column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text")
    )


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells rows apart and stays the same whenever they are read, and its name.

    The key is a row's file and position; what is no plain table of files is written first.
    """
    if not docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        docs = written(docs, "rows")
    name = "row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.select(*[column(c) for c in docs.columns], key.alias(name)), name


def worker_memory() -> dict:
    """What a Python worker keeps from task to task. The library's functions travel by value, so globals of its modules do not last."""
    name = "faultline_worker_memory"
    return vars(sys.modules.setdefault(name, types.ModuleType(name))).setdefault("held", {})


def give_back() -> None:
    """Hand what is free in this process to the system; else the allocators of Arrow and of the C library keep most of a task's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim is not None:
        trim(0)


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """A task's function that leaves its worker small, since workers stay for the tasks and operators that follow.

    Only with ``keeps`` does the worker's memory outlast the task; any other task drops what an earlier operator kept.
    """

    def whole(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            worker_memory().clear()
        yield from run(source)
        give_back()

    return whole


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch for batch in source if batch.num_rows)
