"""First-match rules for large rule sets, through an index of what their patterns require.

Most patterns hold strings that every hit must contain. A rule is filed under the rarest three characters of such a string,
by how many different texts hold them. Texts meet the index on their three-character pieces, a candidate must hold the whole
string, and only then its pattern runs. So the patterns that run on a text follow what the text says, not the size of the rule set.

Each different text is judged once. Pieces and counts are narrow rows that combine before their shuffle; the index is broadcast
while its files are small, else shuffled on its rare pieces. Rules whose patterns require nothing are tried on every text, in one
expression, as ``rules.with_rule`` does with all rules.
"""

import re
import re._parser as regex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.patterns import spark_pattern
from ..session import written, written_side
from .rules import rule_position, rules_from_table

PIECE = 3
_ASCII = range(32, 127)
_INDEX = "priority int, literal string, pattern string, exclusion string"


def folded(text: Column) -> Column:
    """Text in which letters that a pattern takes for alike, whatever their case, are written alike."""
    plain = F.octet_length(text) == F.length(text)
    # Spelled out, since Spark takes the lower case of the upper case for the lower case alone.
    return F.when(plain, F.lower(text)).otherwise(F.translate(F.lower(text), "\u03c2\u017f\u0131\u0307", "\u03c3si"))


def required_strings(pattern: str) -> list[str]:
    """Strings in lower case, one of which every hit contains; none where the pattern gives no such list.

    Only plain ASCII runs of ``PIECE`` characters or more count, and a pattern that cannot be read requires nothing.
    """
    try:
        found = _required(regex.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []
    return found if found and min(map(len, found)) >= PIECE else []


def _required(items) -> list[str]:
    """The best list of a sequence: the one whose shortest string is longest."""
    lists: list[list[str]] = []
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            lists.append([run])
        run = ""

    def inside(items) -> None:
        nonlocal run
        if all(op is regex.LITERAL and value in _ASCII for op, value in items):
            run += "".join(chr(value).lower() for _, value in items)
            return
        flush()
        if found := _required(items):
            lists.append(found)

    for op, value in items:
        if op is regex.LITERAL and value in _ASCII:
            run += chr(value).lower()
        elif op is regex.AT:
            continue  # takes no characters
        elif op is regex.SUBPATTERN:
            inside(list(value[-1]))
        elif op in (regex.MAX_REPEAT, regex.MIN_REPEAT, regex.POSSESSIVE_REPEAT) and value[0] >= 1:
            flush()
            if found := _required(value[2]):
                lists.append(found)
        elif op is regex.BRANCH:
            flush()
            branches = [_required(branch) for branch in value[1]]
            if all(branches):
                lists.append(sorted({s for branch in branches for s in branch}))
        elif op is regex.ATOMIC_GROUP:
            inside(list(value))
        else:
            flush()
    flush()
    return max(lists, key=lambda found: (min(map(len, found)), -len(found)), default=[])


def _filed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rules in parts:
        rows = [
            (
                rule.priority,
                literal,
                spark_pattern(rule.pattern, ignore_case=True),
                spark_pattern(rule.exclusion, ignore_case=True) if rule.exclusion else None,
            )
            for rule in rules.itertuples()
            for literal in required_strings(rule.pattern) or [None]
        ]
        yield pd.DataFrame(rows, columns=[part.split()[0] for part in _INDEX.split(", ")])


def pieces(text: Column) -> Column:
    """The different three-character pieces of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1)))


def rule_index(rules: DataFrame) -> DataFrame:
    """priority, literal, pattern, exclusion: a row for each string that a rule may be found by; null for rules without any."""
    return rules.select("priority", "pattern", "exclusion").mapInPandas(_filed, _INDEX)


def candidates(texts: DataFrame, index: DataFrame) -> DataFrame:
    """key, text, priority, pattern, exclusion: the patterns to run on each of ``texts(key, text)``, which are all different."""
    filed = written(index.filter("literal is not null"), "rule-index")
    of_text = texts.select("key", F.explode(pieces(folded(F.col("text")))).alias("piece"))
    of_rule = filed.select("priority", "literal", F.explode(pieces(F.col("literal"))).alias("piece"))
    wanted = written_side(of_rule.select("piece").distinct(), "pieces")
    counts = of_text.join(wanted, "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    # A piece that no text holds rules its string out, so it is the rarest.
    rarest = of_rule.join(counts, "piece", "left").groupBy("priority", "literal").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("rarest")
    )
    used = rarest.filter("rarest.texts > 0").select("priority", "literal", F.col("rarest.piece").alias("piece"))
    met = of_text.join(written_side(used, "rare-pieces"), "piece").select("key", "priority", "literal").distinct()
    held = written_side(filed, "rule-index")
    found = (
        met.join(texts, "key")
        .filter(F.contains(folded(F.col("text")), F.col("literal")))
        .select("key", "text", "priority")
        .distinct()
    )
    return found.join(held.select("priority", "pattern", "exclusion").distinct(), "priority")


def with_indexed_rule(rows: DataFrame, rules: DataFrame, text: str = "representative_log") -> DataFrame:
    """``rules.with_rule`` for a rule table of any size, whose priorities are unique; texts may repeat, null ones hit nothing."""
    taken = rules.select("priority", "name", "severity", "reason", "action")
    index = written(rule_index(rules), "rule-index")
    key = F.when(F.col(text).isNotNull(), F.sha2(F.col(text), 256))
    texts = rows.filter(F.col(text).isNotNull()).groupBy(key.alias("key")).agg(F.min(text).alias("text"))
    texts = written(texts, "texts")
    runs = candidates(texts, index).filter(
        F.rlike("text", F.col("pattern")) & ~F.coalesce(F.rlike("text", F.col("exclusion")), F.lit(False))
    )
    winners = runs.select("key", "priority")
    always = index.filter("literal is null").select("priority")
    anywhere = rules_from_table(rules.join(always, "priority", "left_semi"))
    if anywhere:
        numbers = F.array(*[F.lit(r[0]) for r in anywhere])
        tried = texts.select("key", F.get(numbers, rule_position(F.col("text"), anywhere)).alias("priority"))
        winners = winners.union(tried.filter("priority is not null"))
    winners = winners.groupBy("key").agg(F.min("priority").alias("priority")).join(taken, "priority")
    won = winners.select(
        F.col("key").alias("text_key"),
        F.col("name").alias("rule_name"),
        "severity",
        F.format_string(V.RULE_REASON_FORMAT, "name", "reason").alias("reason"),
        "action",
    )
    joined = rows.withColumn("text_key", key).join(written_side(won, "winners"), "text_key", "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], "rule_name", "severity", "reason", "action")
