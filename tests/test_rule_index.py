"""Large rule sets through the index, against every pattern on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultline import fixed_values as V
from faultline.operators import rule_index, rules


@pytest.mark.parametrize(
    ("pattern", "strings"),
    [
        ("panic:", ["panic:"]),
        (r"\bOutOfMemory\b.*heap space", ["outofmemory"]),
        ("(foo|barbar)baz+", ["barbar", "foo"]),
        ("(?:disk )full", ["disk full"]),
        ("a?bcd(ef){2,}", ["bcd"]),
        (r"\d+|xyz", []),
        ("ab", []),
        ("[abc]def?", []),
        ("x{3}yz1", ["yz1"]),
        ("(unclosed", []),
        ("straße über", ["stra"]),
        ("^connection (refused|reset by peer)$", ["connection "]),
    ],
)
def test_strings_that_hits_contain(pattern, strings):
    assert rule_index.required_strings(pattern) == strings


def test_standard_rules_require_their_strings():
    rng = random.Random(1)
    for name, _, pattern, *_ in V.RULES:
        strings = rule_index.required_strings(pattern)
        assert strings, name
        assert all(re.search(pattern, "".join(rng.choice("xyz \n") for _ in range(50)), re.I) is None for _ in range(20))


def first_hit(text, table):
    for _, name, _, pattern, exclusion, *_ in table:
        if text is not None and re.search(pattern, text, re.I) and not (exclusion and re.search(exclusion, text, re.I)):
            return name
    return None


def many_rules(n):
    table = []
    for i in range(n):
        pattern = [
            rf"module-{i} failed with code \d+",
            rf"(timeout|refusal) of unit{i}\b",
            rf"Error{i % 977}x.*shard {i}",
            rf"host-{i}\.example(\.com)? unreachable",
        ][i % 4]
        table.append((i + 1, f"rule{i}", "P1_HIGH", pattern, f"shard {i} ok" if i % 4 == 2 else None, "why", "do"))
    return table


def test_twenty_thousand_rules(spark):
    table = [(0, "digits", "P2_WARNING", r"#\d\d", "#13", "why", "do"), *many_rules(20_000)]
    rng = random.Random(6)
    texts = [None, "", "#13 module-40 failed with code 1", "#14 module-40 failed with code 1", "ERROR13x on ſhard 13 here", "Error13x shard 13 shard 13 ok"]
    for _ in range(300):
        i = rng.randrange(20_000)
        texts.append(
            rng.choice(["MODULE-{} failed with code 5", "refusal of unit{}", "Error{} x", "HOST-{}.example unreachable", "nothing {}", "unit{}x timeout of"]).format(i)
        )
    texts += texts[:50]
    logs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "log_id long, raw_log string, key string").repartition(4)
    indexed = rule_index.with_indexed_rule(logs, rules.rule_table(spark, table), "raw_log")
    assert indexed.columns == ["log_id", "raw_log", "key", "rule_name", "severity", "reason", "action"]
    got = {r.log_id: r.rule_name for r in indexed.collect()}
    assert len(got) == len(texts)
    # Every pattern, but for those whose required strings a text lacks in any case.
    by_text, strings = {}, [(r, rule_index.required_strings(r[3])) for r in table]
    for t in set(texts) - {None}:
        low = t.lower().replace("ſ", "s")
        by_text[t] = first_hit(t, [r for r, held in strings if not held or any(x in low for x in held)])
    assert got == {i: by_text.get(t) for i, t in enumerate(texts)}
    assert sum(v is not None for v in got.values()) > 40
    different = spark.createDataFrame([(t, t) for t in set(texts) - {None}], "key string, text string")
    ran = rule_index.candidates(different, rule_index.rule_index(rules.rule_table(spark, table))).groupBy("key").count()
    assert ran.agg(F.max("count")).first()[0] < 0.01 * len(table)


def test_small_sets_agree_with_plain_rules(spark):
    texts = ["panic: x", "Googlebot aborted", "kube /healthz", "upstream 500", None, "OUTOFMEMORYERROR: java heap space", "İnternal panic:"]
    logs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "log_id long, raw_log string")
    plain = rules.with_rule(logs, "raw_log").collect()
    assert sorted(rule_index.with_indexed_rule(logs, rules.rule_table(spark), "raw_log").collect()) == sorted(plain)
    none = rules.rule_table(spark, [])
    assert {r.rule_name for r in rule_index.with_indexed_rule(logs, none, "raw_log").collect()} == {None}
    assert rule_index.with_indexed_rule(logs.filter("false"), rules.rule_table(spark), "raw_log").count() == 0
