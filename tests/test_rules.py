import re

from pyspark.sql import functions as F

from faultline import fixed_values as V
from faultline.operators import rules

LOGS = [
    ("2024-03-01 01:02:03 ERROR [pay] goroutine 12 panic: boom\n    handler.go:8", "go_panic"),
    ("ERROR [o] HikariPool-3 - Connection is not available, timed out", "db_connection_exhausted"),
    ("ERROR [o] HikariPool-3 - Connection is not available, backoff", None),
    ("ERROR [g] upstream stock timeout after 5000ms", "repeated_5xx"),
    ("ERROR [r] report failed for tenant_id=1: slow", None),
    ("ERROR [user-service] err: record not found", None),
    ("ERROR [x] err: record not found", "record_not_found"),
    ("ERROR [f] S3 GetObject timeout (1/3). Retrying... SUCCESS", "s3_transient_timeout"),
    ("ERROR [a] ExpiredJwtException: JWT expired", "jwt_expired"),
    ("ERROR [l] No space left on device (ENOSPC)", "disk_full"),
    ("HTTP 503 health check", None),
    ("Node a condition changed: Ready -> NotReady", "k8s_node_not_ready"),
    ("Node a\n condition changed: NotReady", None),
    ("Node a\r condition changed: NotReady", "k8s_node_not_ready"),
    ("KILLED PROCESS 9, dıſk quota exceeded", "process_killed"),
    ("diſk quota exceeded", "disk_full"),
    ("goroutine १२ [running]", "go_panic"),
]


def expected(text):
    for name, _, pattern, exclusion, _, _ in V.RULES:
        if re.search(pattern, text, re.I) and not (exclusion and re.search(exclusion, text, re.I)):
            return name


def frame(spark):
    return spark.createDataFrame([(i, t, "svc") for i, (t, _) in enumerate(LOGS)], "log_id int, raw_log string, service_name string")


def test_rules_and_exclusions(spark):
    got = [r.rule_name for r in rules.rule_scan(frame(spark)).orderBy("log_id").collect()]
    assert got == [expected(t) for t, _ in LOGS] == [name for _, name in LOGS]


def test_rule_table_agrees_with_built_in_rules(spark):
    table = rules.rule_table(spark).orderBy(F.rand(3))
    a = rules.rule_scan(frame(spark)).collect()
    assert sorted(rules.rule_scan(frame(spark), table).collect()) == sorted(a)


def test_rule_sets_of_any_size(spark):
    many = [(i, f"r{i}", "P2_WARNING", f"nothing like this {i}", None, "x", "y") for i in range(1500)]
    last = [(9000 + i, *rule) for i, rule in enumerate(V.RULES)]
    a = rules.rule_scan(frame(spark)).select("log_id", "rule_name", "severity", "reason").collect()
    table = rules.rule_table(spark, many + last)
    b = rules.rule_scan(frame(spark), table).select("log_id", "rule_name", "severity", "reason").collect()
    assert sorted(a) == sorted(b)


def test_stats_and_rates(spark):
    assert rules.rule_stats(rules.rule_table(spark)).first().asDict() == {
        "total_rules": 16, "p0_rules": 7, "p1_rules": 3, "p3_rules": 6,
    }
    none = rules.rule_hit_rate(rules.rule_scan(frame(spark).limit(0))).first()
    assert (none.hits, none.misses, none.hit_rate) == (0, 0, 0.0)
    assert rules.rule_hit_rate(rules.rule_scan(frame(spark), [])).first().hits == 0


def test_reason_and_preview(spark):
    rows = {r.log_id: r for r in rules.rule_scan(frame(spark)).collect()}
    assert rows[9].reason.startswith("[规则:disk_full] ") and rows[9].preview is None
    assert rows[12].preview == "Node a  condition changed: NotReady..." and rows[12].reason is None
