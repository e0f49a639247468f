"""Run statistics over triage results."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V


def _zero_filled(results: DataFrame, column: str, values: list[str]) -> DataFrame:
    all_values = results.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counted = results.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return all_values.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def by_severity(results: DataFrame) -> DataFrame:
    return _zero_filled(results, "severity", [row[0] for row in V.SEVERITIES])


def by_source(results: DataFrame) -> DataFrame:
    return _zero_filled(results, "source", V.SOURCES)


def run_totals(results: DataFrame) -> DataFrame:
    """Total, rule hits and rate, model calls and their mean time; fallbacks are no calls."""
    of_model = F.col("source") == "llm"
    counted = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("source") == "rule").alias("rule_hits"),
        F.count_if(of_model).alias("model_calls"),
        F.coalesce(F.avg(F.when(of_model, F.col("elapsed_ms"))), F.lit(0.0)).alias("mean_model_ms"),
    )
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("rule_hits") / F.col("total"))
    return counted.withColumn("rule_hit_rate", rate)


# --- while results are written ----------------------------------------------------------


@dataclass(frozen=True)
class RunStatistics:
    """The tables above, from metrics that one write of the results has observed."""

    spark: SparkSession
    metrics: dict

    def by_severity(self) -> DataFrame:
        rows = [(row[0], self.metrics[f"severity {row[0]}"]) for row in V.SEVERITIES]
        return self.spark.createDataFrame(rows, "severity string, n long")

    def by_source(self) -> DataFrame:
        return self.spark.createDataFrame([(s, self.metrics[f"source {s}"]) for s in V.SOURCES], "source string, n long")

    def run_totals(self) -> DataFrame:
        total, rules, calls = (self.metrics[k] for k in ("total", "source rule", "source llm"))
        mean = self.metrics["model ms"] / calls if calls else 0.0
        rate = rules / total if total else 0.0
        names = "total long, rule_hits long, model_calls long, mean_model_ms double, rule_hit_rate double"
        return self.spark.createDataFrame([(total, rules, calls, mean, rate)], names)


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """``results`` that count themselves while they are written, and where the metrics will be."""
    seen = Observation()
    of_model = F.when(F.col("source") == "llm", F.col("elapsed_ms"))
    told = results.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == row[0]).alias(f"severity {row[0]}") for row in V.SEVERITIES],
        *[F.count_if(F.col("source") == s).alias(f"source {s}") for s in V.SOURCES],
        F.coalesce(F.sum(of_model), F.lit(0.0)).cast("double").alias("model ms"),
    )
    return told, seen


def write_with_stats(results: DataFrame, path: str, mode: str = "errorifexists") -> RunStatistics:
    """Write results as parquet; their statistics come from that one job."""
    told, seen = observed(results)
    told.write.mode(mode).parquet(path)
    return RunStatistics(results.sparkSession, seen.get)
