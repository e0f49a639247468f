import json
import re

from pyspark.sql import functions as F

from faultline import fixed_values as V
from faultline.operators import dedup, rules, scoring
from faultline.plans.triage import triage

ANSWERS = [
    '```json\n{"severity": "P0_CRITICAL", "reason": "r", "action": "a"}\n```',
    'text ```\n {"severity": "P3_IGNORE"}\n``` more ```json\n{"severity": "P0_CRITICAL"}\n```',
    'so: {"reason": "x", "severity": "P1_HIGH"} end',
    '  {"severity": "P2_WARNING", "more": {"a": 1}}\n',
    '```json\n{"severity": "P2_WARNING", "more": {"a": {"b": "}"}}}\n```',
    '```json\n{"severity": broken}\n``` {"severity": "P0_CRITICAL"}',
    '{"severity": "P9"}', '{"severity": "UNKNOWN"}', '{"reason": "none"}', '{"severity": ["P0_CRITICAL"]}',
    '{"severity": 1}', "not json", "", "[1, 2]", '["P0_CRITICAL"]', '"P0_CRITICAL"', "null",
    "{'severity': 'P1_HIGH'}", '{"severity": "p1_high"}', '{"severity": "P1_HIGH", "more": {}} tail',
    '{"severity": "P1_HIGH", "reason": null}', '{"severity":"P1_HIGH","reason":"中文 \\u00e9 \\"q\\""}',
]


def expected(answer):
    fenced = re.search(V.FENCED_JSON, answer, re.S)
    bare = re.search(V.BARE_JSON, answer, re.S)
    text = fenced.group(1) if fenced else bare.group(0) if bare else answer.strip()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    if not isinstance(found, dict) or not isinstance(found.get("severity"), str):
        return None
    if found["severity"] not in V.VALID_SEVERITIES:
        return None
    return found["severity"], found.get("reason") or "", found.get("action") or ""


def test_verdicts(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, content string")
    got = {r.i: r.v for r in rows.select("i", scoring.parsed_verdict(F.col("content")).alias("v")).collect()}
    for i, answer in enumerate(ANSWERS):
        assert (tuple(got[i]) if got[i] else None) == expected(answer), answer


def test_nothing_may_stand_behind_the_object(spark):
    odd = ['{"severity": "P0_CRITICAL", "more": {"a": 1}} and {}', '{"severity": "P0_CRITICAL", "more": {"a": 1}},{"end": 1}',
           '{"severity": "P0_CRITICAL", "m": {}}{"severity": "P1_HIGH", "m": {}}', '{"severity": "P0_CRITICAL", "m": {}} ]', '{"severity": "P0_CRITICAL", "m": {}}']
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, content string")
    got = {r.i: r.v for r in rows.select("i", scoring.parsed_verdict(F.col("content")).alias("v")).collect()}
    assert [tuple(got[i]) if got[i] else None for i in range(len(odd))] == [expected(a) for a in odd]


def test_a_model_is_asked_once_for_each_miss(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory():
        def chat(system, user, temperature, max_tokens):
            with open(log, "a") as out:
                out.write("call\n")
            return ANSWERS[0], "m", {"n": None, "k": 2.5}

        return chat

    results = scoring.classify(rules.with_rule(groups(spark, ["panic: x", "odd", "odder"])), factory)
    assert results.count() == 3 and results.filter("source = 'llm'").count() == 2 and results.filter("source = 'rule'").count() == 1
    assert len(open(log).readlines()) == 2


def groups(spark, texts, count=1):
    rows = [(i, f"{i:012x}", t, "svc", "", count, 100.0, 107.9) for i, t in enumerate(texts)]
    df = spark.createDataFrame(
        rows,
        "log_id long, fingerprint string, representative_log string, service_name string, error_type string, "
        "count long, a double, b double",
    )
    return df.select("*", F.timestamp_seconds("a").alias("first_seen"), F.timestamp_seconds("b").alias("last_seen")).drop("a", "b")


def test_context_and_prompt(spark):
    one = groups(spark, ["boom"]).select(dedup.group_context()).first()[0]
    assert one == "boom"
    many = groups(spark, ["boom"], 5).select(dedup.group_context()).first()[0]
    assert many == f"boom\n[聚合信息] 该错误在过去 7s 内出现 5 次（{5 / 7.9 * 60:.0f}次/分钟）"
    long = scoring.with_triage_prompt(groups(spark, ["字" * 1600], 9)).first()
    assert long.system_prompt == V.TRIAGE_SYSTEM
    assert long.user_prompt.endswith("```\n" + "字" * 1500 + "\n...[日志截断]\n```")
    assert long.user_prompt.startswith("【示例 1】\n输入日志：\n```\n2024-01-15 03:22:18 ERROR [payment-service]")
    assert long.user_prompt.count("【示例") == 8 and '```json\n{\n  "severity": "P0_CRITICAL",\n' in long.user_prompt


def test_rates_are_per_minute_of_at_least_a_second(spark):
    df = groups(spark, ["x"], 4).withColumn("last_seen", F.col("first_seen"))
    assert df.select(dedup.frequency_per_minute()).first()[0] == 240.0


def test_only_misses_are_asked_and_failures_fall_back(spark):
    texts = ["panic: x", "slow thing", "explode", "odd thing"]

    def factory():
        def chat(system, user, temperature, max_tokens):
            assert "panic: x\n```" not in user and (temperature, max_tokens) == (0.05, 512)
            if user.endswith("explode\n```"):
                raise OSError("no route")
            if "odd" in user:
                return "??", "m1", {}
            return '{"severity": "P2_WARNING", "reason": "slow", "action": "wait"}', "m1", {"prompt_tokens": 3}

        return chat

    results = scoring.classify(rules.with_rule(groups(spark, texts)), factory)
    got = {r.representative_log: r for r in results.collect()}
    assert got["panic: x"].source == "rule" and got["panic: x"].severity == "P0_CRITICAL" and got["panic: x"].model == ""
    assert (got["slow thing"].severity, got["slow thing"].source, got["slow thing"].model) == ("P2_WARNING", "llm", "m1")
    bad = got["explode"]
    assert (bad.severity, bad.source, bad.raw_output) == ("P1_HIGH", "default", "[LLM 调用失败] no route")
    assert bad.reason == "LLM 输出解析失败，降级为 P1_HIGH（需人工确认）" and bad.action == "请人工查看原始日志"
    assert got["odd thing"].source == "default" and got["odd thing"].raw_output == "??"


def test_stored_responses_and_no_model(spark):
    ruled = rules.with_rule(groups(spark, ["panic: x", "slow", "lost"]))
    stored = spark.createDataFrame([(f"{1:012x}", ANSWERS[0])], "fingerprint string, content string")
    got = {r.representative_log: r.source for r in scoring.classify(ruled, responses=stored).collect()}
    assert got == {"panic: x": "rule", "slow": "llm", "lost": "default"}
    assert scoring.classify(ruled).filter("source = 'default'").count() == 2


def test_triage_counts_new_logs_twice(spark):
    """A lone log is reported when it opens a window and when the window is flushed."""
    logs = spark.createDataFrame(
        [(i, f"unlike {'abc'[i]}", "svc", float(i)) for i in range(3)], "log_id long, raw_log string, service_name string, s double"
    ).withColumn("ts", F.timestamp_seconds("s"))
    assert triage(logs).count() == 6
    assert triage(logs, use_aggregation=False).count() == 3
    off = triage(logs.withColumn("raw_log", F.lit("panic: x")), use_rules=False, use_aggregation=False)
    assert {r.source for r in off.collect()} == {"default"}


def test_result_record(spark):
    results = scoring.classify(rules.with_rule(groups(spark, ["panic: x"], 3)))
    record = scoring.result_record(results).first().asDict()
    assert list(record) == ["severity", "reason", "action", "source", "service", "count", "frequency", "fingerprint"]
    assert record["frequency"] == round(3 / 7.9 * 60, 1)
