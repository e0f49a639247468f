"""Views of the given tables in the shapes that the operators take."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERVICES = ["payment-service", "order-service", "report-service", "file-service", "config-service"]
LEVELS = {"error": "ERROR", "purchase": "CRITICAL", "view": "WARN", "click": "INFO", "signup": "FATAL"}

# One text per event_id % 24. {head} is time, level and service; {m} {d} {d2} {n} {n2}
# {user} {event} {ts} {long} vary with the event.
LOG_TEXTS = [
    "{head}controller crashed\npanic: assignment to entry in nil map\n\ngoroutine 47 [running]:\n"
    "github.com/acme/op/pkg/ctl.Handle(...)\n    /srv/src/op/pkg/ctl/h{d}.go:{n} +0x2a4\n"
    "runtime/debug.Stack(...)\n    /usr/local/go/src/runtime/debug/stack.go:24",
    "{head}Unhandled exception\njava.lang.NullPointerException: x is null\n"
    "    at com.acme.svc.Doc{d}.run(Doc{d}.java:{n})\n    at com.acme.svc.Doc{d}.call(Doc{d}.java:{n2})\n"
    "    at com.acme.svc.Doc{d2}.serve(Doc{d2}.java:{n})\n"
    "    at sun.reflect.Native.invoke0(Native Method){long}",
    "{head}ETL stage failed\nTraceback (most recent call last):\n"
    '  File "app/mod{d}.py", line {n}, in normalize_field\n    value = record["x"]\n'
    '  File "app/runner.py", line 89, in run_stage\nKeyError: \'x\'',
    "{head}call failed\nTypeError: Cannot read properties of null\n    at handle (/app/src/h{d}.js:{n}:12)\n"
    "    at /app/src/loop.js:7:3\n    at next (/app/node_modules/x/y.js:1:2)",
    "{head}HikariPool-1 - Connection is not available, timed out after 30001ms",
    "{head}HikariPool-1 - Connection is not available, retrying{long}",
    "{head}upstream inventory timeout after 5000ms",
    "{head}GET /health HTTP 503 from probe",
    "{head}GET /healthz 200 kube",
    "{head}err: record not found, requested_id=cfg_{user}",
    "{head}write failed: No space left on device (ENOSPC) at 10.0.0.{m}:9000",
    "{head}java.lang.OutOfMemoryError: Java heap space",
    "{head}S3 GetObject timeout (attempt 1/3). Retrying... SUCCESS on attempt 2",
    "{head}ExpiredJwtException: JWT expired at {ts}",
    "{head}Deadlock found when trying to get lock; batch_{event}",
    "{head}Circuit breaker 'inventory' is OPEN",
    "{head}Googlebot fetch /p/{user} aborted",
    "{head}validation error: field qty",
    "{head}StockCheckException: SKU 'sku-{user}00012345' stock insufficient",
    "{head}slow report for tenant {user} id 6ba7b810-9dad-11d1-80b4-00c04fd430c8 trace 4bf92f3577b34da6a3ce929d0e0e4736 "
    "since 2024-01-02T03:04:05.678+08:00",
    "{head}Killed process 4242 (java)",
    "{head}Node ip-10-0-1-45 condition changed: Ready -> NotReady",
    "{head}certificate has expired for host a{m}",
    "worker idle after 128450 items, request_id=ab{event}",
]


def _filled(text: str, fields: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(
        *[fields[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p]
    )


def log_view(events: DataFrame, documents: int = 200) -> DataFrame:
    """Events as logs: (log_id, ts, service_name, raw_log).

    Traces name five of the ``documents`` for every 24 events, one after another in steps of a prime, so all of them where there are
    events enough; lines go up to 120, low ones being commoner, since most documents are short. Some texts are long.
    """
    event, user = F.col("event_id"), F.col("user_id")
    round_ = F.floor(event / 24)
    n = 1 + round_ % (1 + round_ * 17 % 120)
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    service = F.get(F.array(*[F.lit(s) for s in SERVICES]), (user % 5).cast("int"))
    level = F.create_map(*[F.lit(v) for pair in LEVELS.items() for v in pair])[F.col("event_type")]
    fields = {
        "m": user % 7,
        "d": (round_ * 5 + event % 24) * 7919 % documents,
        "d2": (round_ * 5 + 4) * 7919 % documents,
        "long": F.when(user % 7 == 0, F.repeat(F.lit(" and so on"), 400)).otherwise(""),
        "n": n,
        "n2": n + 2,
        "user": user,
        "event": event,
        "ts": ts,
        "head": F.concat(ts, F.lit(" "), level, F.lit(" ["), service, F.lit("] ")),
    }
    text = F.lit(None).cast("string")
    for at in reversed(range(len(LOG_TEXTS))):
        text = F.when(event % 24 == at, _filled(LOG_TEXTS[at], fields)).otherwise(text)
    return events.select(
        event.alias("log_id"), F.col("ts").cast("timestamp").alias("ts"), service.alias("service_name"), text.alias("raw_log")
    )


CODE_PATHS = [("Doc", ".java"), ("app/mod", ".py"), ("srv/src/op/pkg/ctl/h", ".go"), ("app/src/h", ".js")]


def code_view(documents: DataFrame) -> DataFrame:
    """Each document as a Java, Python, Go and JavaScript file of ref HEAD."""
    doc = F.col("doc_id").cast("string")
    paths = F.array(*[F.concat(F.lit(a), doc, F.lit(b)) for a, b in CODE_PATHS])
    return documents.select(
        F.lit("HEAD").alias("ref"), F.explode(paths).alias("file_path"), "text", F.lit("").alias("commit_sha")
    )


def sft_view(conversations: DataFrame) -> DataFrame:
    """A user turn with the assistant's next turn; instruction is the system text or ''. One pass over each conversation."""
    whole = Window.partitionBy("conv_id")
    turns = whole.orderBy("turn")
    after = F.lead(F.struct("turn", "role", "text")).over(turns)
    system = F.max(F.when(F.col("role") == "system", F.col("text"))).over(whole)
    seen = conversations.select("conv_id", "turn", "role", "text").withColumns({"after": after, "system": system})
    return seen.filter("role = 'user' and after.role = 'assistant' and after.turn = turn + 1").select(
        "conv_id",
        "turn",
        F.coalesce("system", F.lit("")).alias("instruction"),
        F.col("text").alias("input"),
        F.col("after.text").alias("output"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
