"""Severity attributes as expressions and as a small table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V


def severity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.SEVERITIES, "severity string, level int, emoji string, label_cn string")


def _pick(severity: Column, position: int) -> Column:
    pairs = [F.lit(v) for row in V.SEVERITIES for v in (row[0], row[position])]
    return F.create_map(*pairs)[severity]


def level(severity: Column) -> Column:
    return _pick(severity, 1)


def emoji(severity: Column) -> Column:
    return _pick(severity, 2)


def is_valid(severity: Column) -> Column:
    return F.coalesce(severity.isin(V.VALID_SEVERITIES), F.lit(False))


def with_severity_attributes(results: DataFrame) -> DataFrame:
    """Join level, emoji and label; the table has five rows."""
    return results.join(F.broadcast(severity_table(results.sparkSession)), "severity", "left")
