"""Model answers kept over runs: equal prompts are asked once, and what was answered is not asked again.

An answer is stored under a digest of all that it depends on: system text, temperature, length limit, frame and the prompt's own
text. Asked rows meet the store by that digest; what it lacks is made distinct (this combines before its shuffle), asked, and
appended. Failed calls are told to this run and not stored, so the next run asks again.
"""

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .scoring import ChatFactory, chat_over

_ANSWER = "key string, content string, model string, usage map<string,bigint>, elapsed_ms double"


def prompt_key(text: Column, system: str, temperature: float, max_tokens: int, frame: tuple[str, str] = ("", "")) -> Column:
    setting = hashlib.sha256(json.dumps([system, float(temperature), max_tokens, *frame]).encode()).hexdigest()
    return F.sha2(F.concat_ws("\n", F.lit(setting), text), 256)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """key, content, model, usage, elapsed_ms; one answer for each key, though two runs may have asked at the same time."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _ANSWER)
    return spark.read.schema(_ANSWER).parquet(store).dropDuplicates(["key"])


def answered(
    rows: DataFrame,
    store: str,
    chat_factory: ChatFactory,
    system: str,
    temperature: float,
    max_tokens: int,
    frame: tuple[str, str] = ("", ""),
    **options,
) -> DataFrame:
    """``scoring.chat_over`` by way of the store: rows (id..., user_text) with content, model, usage, error and elapsed_ms.

    ``elapsed_ms`` is 0 for answers that were there. Rows without ``user_text`` pass without a call.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "user_text"]
    key = F.when(F.col("user_text").isNotNull(), prompt_key(F.col("user_text"), system, temperature, max_tokens, frame))
    keyed = written(rows.withColumn("key", key), "asked")
    known = stored_answers(spark, store)
    missing = (
        keyed.filter(F.col("key").isNotNull())
        .join(known.select("key"), "key", "left_anti")
        .groupBy("key")
        .agg(F.min("user_text").alias("user_text"))
    )
    told = written(chat_over(missing, chat_factory, system, temperature, max_tokens, frame, **options), "answers")
    answers = known.withColumns({"error": F.lit(None).cast("string"), "elapsed_ms": F.lit(0.0)}).unionByName(told)
    result = keyed.drop("user_text").join(written(answers.join(keyed.select("key").distinct(), "key"), "answers"), "key", "left")
    told.filter(F.col("error").isNull()).select(*[p.split()[0] for p in _ANSWER.split(", ")]).write.mode("append").parquet(store)
    of_none = {"model": F.lit(""), "usage": F.create_map().cast("map<string,bigint>"), "elapsed_ms": F.lit(0.0)}
    return result.select(*names, "content", *[F.coalesce(c, v).alias(c) for c, v in of_none.items()], "error").select(
        *names, "content", "model", "usage", "error", "elapsed_ms"
    )
