import json

from pyspark.sql import functions as F
from test_scoring import groups

from faultline.operators import routing, rules, scoring, stats
from faultline.functions.severity import with_severity_attributes

def now():
    return F.lit("2024-03-04 05:06:07").cast("timestamp")
TEXTS = ["panic: x", "ERROR deadlock detected", "odd", "curl/7 fetched " + "z" * 600]


def results(spark):
    return scoring.classify(rules.with_rule(groups(spark, TEXTS, 2)))


def test_default_routes(spark):
    rows = routing.route(results(spark)).select("severity", "handler").collect()
    assert sorted(map(tuple, rows)) == [
        ("P0_CRITICAL", "audit"), ("P1_HIGH", "audit"), ("P1_HIGH", "audit"), ("P3_IGNORE", "audit"), ("P3_IGNORE", "ignored_archive"),
    ]
    unknown = results(spark).withColumn("severity", F.lit("UNKNOWN"))
    assert routing.route(unknown).count() == 0


def test_route_tables_of_any_size(spark):
    routes = spark.range(20_000).select(F.lit("P3_IGNORE").alias("severity"), F.concat(F.lit("h"), "id").alias("handler"), F.col("id").cast("int").alias("seq"))
    assert routing.route(results(spark), routes).count() == 20_000


def test_outcomes_are_sent_once(spark, tmp_path):
    log = str(tmp_path / "sent")

    def sender():
        def send(handler, body):
            with open(log, "a") as out:
                out.write(handler + "\n")
            return True

        return send

    boxed = routing.outbox(results(spark).withColumn("handler", F.lit("markdown")))
    sent = routing.deliver(boxed, sender)
    assert sent.count() == sent.filter("sent").count() == 4
    assert len(open(log).readlines()) == 4


def test_audit_and_ignored_files(spark, tmp_path):
    audit, ignored = str(tmp_path / "audit"), str(tmp_path / "audit_p3_ignored")
    for _ in range(2):
        routing.write_audit(results(spark), audit, now=now())
    routing.write_ignored(results(spark), ignored, now=now())
    rows = spark.read.json(audit).collect()
    assert len(rows) == 8 and {r.ts for r in rows} == {"2024-03-04T05:06:07Z"}
    assert max(len(r.raw_log_preview) for r in rows) == 300
    assert {r.severity for r in spark.read.json(ignored).collect()} == {"P3_IGNORE"}


def test_documents_hold_more_of_the_log(spark):
    row = routing.ignored_documents(results(spark), now()).first().asDict()
    assert row["@timestamp"] == "2024-03-04T05:06:07Z" and row["ai_ignored"] is True and len(row["raw_log"]) == 500


def test_bodies(spark):
    df = results(spark).filter("severity = 'P0_CRITICAL'")
    boxed = routing.outbox(df.withColumn("handler", F.explode(F.array(*[F.lit(h) for h in [*routing.BODIES, "other"]]))))
    body = {r.handler: r.body and json.loads(r.body) for r in boxed.collect()}
    reason = df.first().reason
    assert body["notification"]["severity"] == "P0_CRITICAL"
    assert body["notification"]["text"].startswith(f"🚨 [P0_CRITICAL] svc\n原因: {reason}\n操作: ")
    assert body["markdown"]["markdown"]["title"] == "P0_CRITICAL 告警" and body["markdown"]["msgtype"] == "markdown"
    assert body["markdown"]["markdown"]["text"].endswith("> 出现次数: 2  来源: rule")
    attachment = body["attachment"]["attachments"][0]
    assert attachment["color"] == "#FF0000" and attachment["title"] == "🔴 P0_CRITICAL — svc"
    assert attachment["footer"] == "次数: 2 | 来源: rule" and body["other"] is None
    nameless = df.withColumn("service_name", F.lit("")).select(routing.notification_body()["text"]).first()[0]
    assert nameless.startswith("🚨 [P0_CRITICAL] unknown\n")
    grey = df.withColumn("severity", F.lit("UNKNOWN")).select(routing.attachment_body()["attachments"][0]["color"])
    assert grey.first()[0] == "#888888"


def test_own_handler_and_delivery(spark):
    routes = spark.createDataFrame([("P0_CRITICAL", "pager", 1), ("P3_IGNORE", "pager", 1)], routing.ROUTE_SCHEMA)
    own = {"pager": lambda: F.struct(F.col("fingerprint").alias("dedup_key"), F.col("severity"))}
    boxed = routing.outbox(routing.route(results(spark), routes), own)

    def factory():
        def send(handler, body):
            if "P3" in body:
                raise OSError("down")
            return handler == "pager"

        return send

    assert {r.severity: r.sent for r in routing.deliver(boxed, factory).collect()} == {"P0_CRITICAL": True, "P3_IGNORE": False}


def test_stats(spark):
    of = stats.by_severity(results(spark))
    assert {r.severity: r.n for r in of.collect()} == {"P0_CRITICAL": 1, "P1_HIGH": 2, "P2_WARNING": 0, "P3_IGNORE": 1, "UNKNOWN": 0}
    assert {r.source: r.n for r in stats.by_source(results(spark)).collect()} == {"rule": 3, "llm": 0, "default": 1}
    totals = stats.run_totals(results(spark)).first()
    assert (totals.total, totals.rule_hits, totals.rule_hit_rate, totals.model_calls, totals.mean_model_ms) == (4, 3, 0.75, 0, 0.0)
    none = stats.run_totals(results(spark).limit(0)).first()
    assert (none.total, none.rule_hit_rate, none.mean_model_ms) == (0, 0.0, 0.0)


def test_severity_attributes(spark):
    rows = with_severity_attributes(results(spark)).orderBy("level").collect()
    assert [(r.level, r.label_cn) for r in rows] == [(0, "紧急"), (1, "高危"), (1, "高危"), (3, "忽略")]
