"""Instruction-tuning datasets: a JSON array of instruction/input/output records."""

from pyspark.sql import DataFrame, SparkSession

SFT_SCHEMA = "instruction string, input string, output string"


def read_sft_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SFT_SCHEMA).option("multiLine", True).json(path)
