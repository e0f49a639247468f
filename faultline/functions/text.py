"""Text expressions shared by the operators."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import BLANK_CHARS, LINE_BREAK, spark_pattern


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, in which a costly ``value`` is named often and computed once: it is the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK_CHARS))


def split_lines(text: Column) -> Column:
    """Lines of a text on any Unicode line break; no empty piece after the last break."""

    def without_last_blank(parts):
        return F.slice(parts, 1, F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))

    # As the one element of an array, so that the text is split once.
    return F.get(F.transform(F.array(F.split(text, LINE_BREAK, -1)), without_last_blank), F.lit(0))


def first_group(text: Column, pattern: str, group: int = 1, **flags) -> Column:
    """Captured group of the first hit, '' when there is none."""
    return F.regexp_extract(text, spark_pattern(pattern, **flags), group)


def hits(text: Column, pattern: str, **flags) -> Column:
    return text.rlike(spark_pattern(pattern, **flags))


def blank_as(text: Column, other: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(other)).otherwise(text)
