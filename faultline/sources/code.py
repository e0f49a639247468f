"""Source-code snapshots.

``code_files(ref, file_path, text, commit_sha)`` holds one row per file; a window
round a line is cut out of the text once the file is found, with no join per
line. Any table of this shape can serve as the place code is looked up.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_lines


def read_snapshot(
    spark: SparkSession, root: str, ref: str = "HEAD", commit_sha: str = "", pattern: str = "*"
) -> DataFrame:
    """Checked-out files below ``root`` as code files of one ref."""
    texts = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
    )
    # From the last match on, so that any scheme or mount in front is dropped.
    inside = F.element_at(F.split(F.col("_metadata.file_path"), f"\\Q{root.rstrip('/')}/\\E", 2), -1)
    return texts.select(
        F.lit(ref).alias("ref"),
        F.url_decode(inside).alias("file_path"),
        F.make_valid_utf8("value").alias("text"),
        F.lit(commit_sha).alias("commit_sha"),
    )


def code_lines(files: DataFrame) -> DataFrame:
    """One row per line: (ref, file_path, line_no, text)."""
    lines = split_lines(F.col("text"))
    return files.select("ref", "file_path", F.posexplode_outer(lines).alias("at", "text")).filter("at >= 0").select(
        "ref", "file_path", (F.col("at") + 1).alias("line_no"), "text"
    )
