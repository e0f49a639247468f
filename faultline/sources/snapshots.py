"""Code snapshots stored by content, and lines stored in blocks.

``store_refs`` keeps each text once, under its digest, and for each ref a table of (file_path, digest). A ref that changes few
files writes few texts. ``store_blocks`` keeps the lines of each text in blocks, so that a window round a line reads the
blocks that it touches, not the file.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_lines

BLOCK_LINES = 64

_BLOBS = "digest string, text string, shard string"
_FILES = "file_path string, digest string, commit_sha string, ref string"
_LENGTHS = "digest string, total_lines int"
_LINES = "digest string, block int, lines array<string>, shard string"


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _shard():
    return F.substring("digest", 1, 1).alias("shard")


def store_refs(files: DataFrame, store: str) -> int:
    """Add the files (ref, file_path, text, commit_sha) of some refs, in place of what these refs had; how many texts were new."""
    spark = files.sparkSession
    digest = F.sha2(F.col("text"), 256).alias("digest")
    tables = files.select("file_path", digest, "commit_sha", "ref")
    tables.write.mode("overwrite").partitionBy("ref").option("partitionOverwriteMode", "dynamic").parquet(f"{store}/refs")
    known = _held(spark, f"{store}/blobs", _BLOBS).select("digest")
    fresh = files.select(digest, "text").join(known, "digest", "left_anti").groupBy("digest").agg(F.min("text").alias("text"))
    before = known.count()
    fresh.select("digest", "text", _shard()).write.mode("append").partitionBy("shard").parquet(f"{store}/blobs")
    return _held(spark, f"{store}/blobs", _BLOBS).count() - before


def refs_table(spark: SparkSession, store: str) -> DataFrame:
    """file_path, digest, commit_sha, ref."""
    return _held(spark, f"{store}/refs", _FILES)


def stored_files(spark: SparkSession, store: str, *refs: str) -> DataFrame:
    """Code files (ref, file_path, text, commit_sha) of some refs, or of all."""
    files = refs_table(spark, store)
    if refs:
        files = files.filter(F.col("ref").isin(*refs))
    blobs = _held(spark, f"{store}/blobs", _BLOBS).select("digest", "text")
    return files.join(blobs, "digest").select("ref", "file_path", "text", "commit_sha")


def store_blocks(spark: SparkSession, store: str, block_lines: int = BLOCK_LINES) -> None:
    """Cut the stored texts that are not cut yet into blocks of lines; a text is split once, whatever refs hold it."""
    done = _held(spark, f"{store}/lengths", _LENGTHS).select("digest")
    texts = _held(spark, f"{store}/blobs", _BLOBS).join(done, "digest", "left_anti")
    lines = texts.select("digest", split_lines(F.col("text")).alias("all")).withColumn("total_lines", F.size("all"))
    starts = F.sequence(F.lit(0), F.floor((F.col("total_lines") - 1) / block_lines).cast("int"))
    blocks = F.when(F.col("total_lines") > 0, F.transform(starts, lambda b: F.slice("all", b * block_lines + 1, block_lines)))
    cut = lines.select("digest", F.posexplode(blocks).alias("block", "lines"))
    cut.select("digest", "block", "lines", _shard()).write.mode("append").partitionBy("shard").parquet(f"{store}/blocks")
    # Last, so that a text counts as cut only once its blocks are there.
    lines.select("digest", "total_lines").write.mode("append").parquet(f"{store}/lengths")


def stored_blocks(spark: SparkSession, store: str) -> DataFrame:
    """digest, block (from 0), lines; a run that broke off may have left blocks twice, of which one is read."""
    return _held(spark, f"{store}/blocks", _LINES).select("digest", "block", "lines").dropDuplicates(["digest", "block"])


def file_lengths(spark: SparkSession, store: str) -> DataFrame:
    """ref, file_path, digest, commit_sha, total_lines of files whose texts are cut."""
    lengths = _held(spark, f"{store}/lengths", _LENGTHS).dropDuplicates(["digest"])
    return refs_table(spark, store).join(lengths, "digest")
