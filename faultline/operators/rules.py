"""Ordered severity rules: the first rule that hits, and is not excluded, wins."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import hits

RULE_SCHEMA = (
    "priority int, name string, severity string, pattern string, exclusion string, "
    "reason string, action string"
)
CHUNK = 50


def standard_rules() -> list[tuple]:
    return [(i, *rule) for i, rule in enumerate(V.RULES)]


def rule_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(standard_rules() if rules is None else rules, RULE_SCHEMA)


def rules_from_table(table: DataFrame) -> list[tuple]:
    """Rules of a configuration table, in order; they become expressions, so they are read to the driver."""
    names = [part.split()[0] for part in RULE_SCHEMA.split(", ")]
    return [tuple(row) for row in table.select(*names).orderBy("priority").collect()]


def rule_position(text: Column, rules: list[tuple], plain: Column | None = None) -> Column:
    """Position in ``rules`` of the first hit, null for none; later rules are not tried.

    Rules stand in chunks, so that neither depth nor size of an expression grows with the rule set. ``plain`` is the folded text:
    where it is given, a pattern runs only on texts that hold one of the strings that its every hit holds.
    """
    from .rule_index import required_strings  # which itself takes this function

    chunks = [F.lit(None).cast("int")]
    for start in range(0, len(rules), CHUNK):
        position = F
        for at, (_, _, _, pattern, exclusion, _, _) in enumerate(rules[start : start + CHUNK], start):
            hit = hits(text, pattern, ignore_case=True)
            needed = [] if plain is None else [plain.contains(s) for s in required_strings(pattern)]
            if needed:
                hit = reduce(or_, needed) & hit
            if exclusion:
                hit = hit & ~hits(text, exclusion, ignore_case=True)
            position = position.when(hit, F.lit(at))
        chunks.insert(-1, position)
    return F.coalesce(*chunks)


def with_rule(
    rows: DataFrame, text: str = "representative_log", rules: list[tuple] | DataFrame | None = None
) -> DataFrame:
    """Add rule_name, severity, reason and action; all null where no rule hits."""
    if isinstance(rules, DataFrame):
        rules = rules_from_table(rules)
    rules = standard_rules() if rules is None else rules
    from .rule_index import folded  # which itself takes functions of this module

    # A column of its own, so that a text is folded once for all rules.
    rows = rows.withColumn("rule_text", folded(F.col(text)))

    def value(position: int) -> Column:
        values = F.array(*[F.lit(r[position]) for r in rules]) if rules else F.array().cast("array<string>")
        return F.get(values, F.col("rule_position"))

    return (
        rows.withColumn("rule_position", rule_position(F.col(text), rules, F.col("rule_text")))
        .withColumns(
            {
                "rule_name": value(1),
                "severity": value(2),
                "reason": F.format_string(V.RULE_REASON_FORMAT, value(1), value(5)),
                "action": value(6),
            }
        )
        .withColumn("reason", F.when(F.col("rule_name").isNotNull(), F.col("reason")))
        .drop("rule_position", "rule_text")
    )


def rule_stats(table: DataFrame) -> DataFrame:
    """Number of rules in all and per level."""
    levels = ["P0_CRITICAL", "P1_HIGH", "P3_IGNORE"]
    return table.agg(
        F.count(F.lit(1)).alias("total_rules"),
        *[F.count_if(F.col("severity") == s).alias(f"{s[:2].lower()}_rules") for s in levels],
    )


def rule_scan(logs: DataFrame, rules: list[tuple] | DataFrame | None = None) -> DataFrame:
    """Rules over every single log, with a short preview of those that none hits."""
    preview = F.regexp_replace(F.substring("raw_log", 1, V.MISS_PREVIEW_CHARS), "\n", " ")
    return with_rule(logs, "raw_log", rules).withColumn(
        "preview", F.when(F.col("rule_name").isNull(), F.concat(preview, F.lit("...")))
    )


def rule_hit_rate(scan: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a scan; the rate of no logs is 0."""
    counted = scan.agg(
        F.count_if(F.col("rule_name").isNotNull()).alias("hits"),
        F.count_if(F.col("rule_name").isNull()).alias("misses"),
    )
    total = F.col("hits") + F.col("misses")
    return counted.withColumn("hit_rate", F.when(total == 0, 0.0).otherwise(F.col("hits") / total))
