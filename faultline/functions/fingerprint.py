"""Fingerprint of a log text: error type, file location, normalised text, key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .patterns import BLANK_RUN, WORD, spark_pattern
from .text import first_group


def normalized(text: Column) -> Column:
    for pattern in V.NOISE_PATTERNS:
        text = F.regexp_replace(text, spark_pattern(pattern), V.NOISE_MARK)
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


def _holds(text: Column, *pieces: str) -> Column:
    held = F.lit(False)
    for piece in pieces:
        held = held | text.contains(piece)
    return held


def error_type(text: Column) -> Column:
    """First error name, else the panic or runtime error of a Go program, else ''.

    A plain search for the fixed endings spares most texts the pattern. A hit
    starts where its run of name characters starts; saying so spares the search
    a restart at every character of the run. The second pattern needs no try:
    whatever it hits, the first has hit already.
    """
    named, _, panic = V.ERROR_TYPE_PATTERNS
    name = F.regexp_extract(text, rf"(?<![.${WORD[1:-1]}])" + spark_pattern(named), 1)
    name = F.when(_holds(text, "Exception", "Error", "Throwable"), name)
    go = F.when(_holds(text, "panic:", "runtime error:"), first_group(text, panic))
    return F.coalesce(F.nullif(name, F.lit("")), go, F.lit(""))


def file_location(text: Column) -> Column:
    pattern = rf"(?<![/.{WORD[1:-1]}-])" + spark_pattern(V.FILE_LOCATION_PATTERN)
    name = F.substring_index(F.regexp_extract(text, pattern, 1), "/", -1)
    line = F.regexp_extract(text, pattern, 2)
    found = F.concat_ws(":", name, F.nullif(line, F.lit("")))
    return F.when(_holds(text, ".java", ".py", ".go", ".js", ".ts"), found).otherwise("")


def fingerprint_key(error: Column, location: Column, norm: Column) -> Column:
    return (
        F.when((error != "") & (location != ""), F.concat(error, F.lit("@"), location))
        .when(error != "", F.concat(error, F.lit(":"), F.substring(norm, 1, V.TYPED_KEY_CHARS)))
        .otherwise(F.substring(norm, 1, V.PLAIN_KEY_CHARS))
    )


def fingerprint_of(key: Column) -> Column:
    return F.substring(F.md5(key), 1, V.FINGERPRINT_CHARS)


def with_fingerprint(logs: DataFrame) -> DataFrame:
    """Add ``fingerprint`` and ``error_type`` to a log table; a missing text counts as ''."""
    text = F.coalesce("raw_log", F.lit(""))
    found = logs.withColumns({"error_type": error_type(text), "file_location": file_location(text)})
    key = fingerprint_key(F.col("error_type"), F.col("file_location"), normalized(text))
    return found.withColumn("fingerprint", fingerprint_of(key)).drop("file_location")


def keyed(logs: DataFrame) -> DataFrame:
    """Logs with their fingerprint, computed only where the table lacks it."""
    return logs if "fingerprint" in logs.columns else with_fingerprint(logs)
