"""Named queries over the given tables, one per operator family."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import error_type, file_location, normalized, with_fingerprint
from ..functions.severity import with_severity_attributes
from ..operators import dedup, prompts, retrieval, routing, rule_index, rules, scoring, stacktrace, stats, tuning, windows
from ..session import SETTINGS, fresh_path, shared_folder, spread, write_texts, written
from ..sources import snapshots
from ..sources.code import code_lines, read_snapshot
from ..sources.logs import read_incident_files, read_log_lines, read_log_stream, read_numbered_lines
from ..sources.sft import read_sft_json
from ..sources.views import code_view, log_view, read_table, sft_view
from ..streaming import dedup as streams
from ..streaming import late, timers
from .rca import parsed_once, prompts_for
from .stub_model import ANSWERS, stub_model
from .triage import triage

Query = Callable[[SparkSession, str], DataFrame]

# Events lie minutes apart; with these all kinds of groups come about.
WINDOW, STORM = 259_200, 3
CONTEXT, BUDGET = 3, 420
NOW = "2024-01-29 00:00:00"
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type"]

QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return _plain(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables hold them."""
    return df.select(
        *[F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(read_table(spark, sf_dir, "events").select(*EVENT_COLUMNS))
    return log_view(events, read_table(spark, sf_dir, "documents").count())


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_view(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_groups(_logs(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classify(rules.with_rule(_groups(spark, sf_dir)), stub_model)


def _windows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return windows.anchored_windows(_logs(spark, sf_dir), WINDOW, STORM, **options)


# --- sources and fingerprints -----------------------------------------------------


@_query
def log_records(spark, sf_dir):
    return _logs(spark, sf_dir)


@_query
def log_lines(spark, sf_dir):
    path = fresh_path(spark, "lines")
    _logs(spark, sf_dir).select("raw_log").write.text(path)
    return read_log_lines(spark, path, "app").select("service_name", "raw_log")


@_query
def numbered_lines(spark, sf_dir):
    """Lines of several files under numbers that do not hang on how files are split."""
    path = fresh_path(spark, "numbered")
    logs = _logs(spark, sf_dir).select("log_id", "raw_log")
    logs.repartitionByRange(FILES, "log_id").sortWithinPartitions("log_id").select("raw_log").write.text(path)
    return read_numbered_lines(spark, path).select("log_id", "raw_log")


@_query
def incident_files(spark, sf_dir):
    """Files of fifty logs each, read whole and taken apart."""
    path = fresh_path(spark, "incidents")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("log_id", "raw_log"))), lambda r: r["raw_log"])
    logs = _logs(spark, sf_dir).groupBy(F.floor(F.col("log_id") / 50).alias("incident")).agg(F.array_join(texts, "\n").alias("value"))
    write_texts(logs, path, "incident")
    files = read_incident_files(spark, path, plain=True, recursiveFileLookup=True)
    parsed = stacktrace.parse_logs(files.withColumn("incident", _folder_number("incident")))
    return parsed.select("incident", "language", "error_type", "error_message", F.length("raw_log").alias("chars"))


def _folder_number(name):
    return F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=(\\d+)/", 1).cast("long")


@_query
def normalized_logs(spark, sf_dir):
    text = F.col("raw_log")
    return _logs(spark, sf_dir).select(
        "log_id",
        normalized(text).alias("normalized"),
        error_type(text).alias("error_type"),
        file_location(text).alias("file_location"),
    )


@_query
def fingerprints(spark, sf_dir):
    return with_fingerprint(_logs(spark, sf_dir)).select("log_id", "fingerprint", "error_type")


# --- grouping ---------------------------------------------------------------------


@_query
def dedup_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@_query
def group_frequency(spark, sf_dir):
    groups = dedup.fingerprint_groups(_logs(spark, sf_dir))
    return groups.select("fingerprint", "count", dedup.frequency_per_minute().alias("per_minute"))


@_query
def group_context(spark, sf_dir):
    return _groups(spark, sf_dir).select("fingerprint", dedup.group_context().alias("context"))


@_query
def ungrouped_logs(spark, sf_dir):
    return dedup.ungrouped(_logs(spark, sf_dir))


@_query
def anchored_windows(spark, sf_dir):
    return windows.with_representatives(_windows(spark, sf_dir), _logs(spark, sf_dir))


@_query
def eager_windows(spark, sf_dir):
    return _windows(spark, sf_dir, eager=True)


@_query
def storm_groups(spark, sf_dir):
    return windows.storm_groups(_windows(spark, sf_dir))


@_query
def open_windows(spark, sf_dir):
    return windows.open_windows(_windows(spark, sf_dir)).agg(F.count(F.lit(1)).alias("open_windows"))


@_query
def expired_windows(spark, sf_dir):
    return windows.expired_at(_windows(spark, sf_dir), F.lit(NOW).cast("timestamp"), WINDOW)


# --- rules ------------------------------------------------------------------------


@_query
def rule_triage(spark, sf_dir):
    return rules.with_rule(_groups(spark, sf_dir)).select("fingerprint", "rule_name", "severity", "reason", "action")


@_query
def rule_table_triage(spark, sf_dir):
    own = [
        (2, "any_connection", "P1_HIGH", r"connection|upstream", None, "net", "check"),
        (1, "java_trouble", "P2_WARNING", r"java\.lang\.\w+(Error|Exception)", r"heap", "jvm", "look"),
        (3, "noise", "P3_IGNORE", r"bot|health", r"503", "noise", "none"),
    ]
    table = rules.rule_table(spark, own)
    return rules.rule_scan(_logs(spark, sf_dir), table).select("log_id", "rule_name", "severity", "reason", "preview")


@_query
def rule_scan(spark, sf_dir):
    return rules.rule_scan(_logs(spark, sf_dir)).select("log_id", "service_name", "rule_name", "severity", "preview")


@_query
def rule_hit_rate(spark, sf_dir):
    return rules.rule_hit_rate(rules.rule_scan(_logs(spark, sf_dir)))


@_query
def rule_stats(spark, sf_dir):
    """Totals of the rules that hit any log."""
    hit = rules.rule_scan(_logs(spark, sf_dir)).select(F.coalesce("rule_name", F.lit("")).alias("name")).distinct()
    return rules.rule_stats(rules.rule_table(spark).join(hit, "name", "left_semi"))


@_query
def rule_set_stats(spark, sf_dir):
    """Totals of the whole rule set, how many of its rules hit any log, and the logs they hit."""
    table = rules.rule_table(spark)
    name = F.coalesce("rule_name", F.lit("")).alias("name")
    hit = rules.rule_scan(_logs(spark, sf_dir)).groupBy(name).agg(F.count(F.lit(1)).alias("n")).join(table, "name", "left_semi")
    used = hit.agg(F.count(F.lit(1)).alias("rules_hit"), F.coalesce(F.sum("n"), F.lit(0)).alias("logs_hit"))
    return rules.rule_stats(table).join(used)  # one row each


@_query
def indexed_rules(spark, sf_dir):
    """The standard rules over every log, through the index of what their patterns require."""
    ruled = rule_index.with_indexed_rule(_logs(spark, sf_dir), rules.rule_table(spark), "raw_log")
    return ruled.select("log_id", "rule_name", "severity", "reason", "action")


@_query
def rule_usage(spark, sf_dir):
    """Rules per level, how many of them hit any log, and the logs they hit."""
    table = rules.rule_table(spark).select("name", "severity")
    # A key that cannot be null, so that the join puts no condition on the rules below it.
    name = F.coalesce("rule_name", F.lit("")).alias("rule_name")
    hit = rules.rule_scan(_logs(spark, sf_dir)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    used = table.join(hit, F.col("name") == F.col("rule_name"), "left")
    return used.groupBy("severity").agg(
        F.count(F.lit(1)).alias("rules"),
        F.count("n").alias("rules_hit"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("logs"),
    )


# --- model ------------------------------------------------------------------------


@_query
def triage_prompts(spark, sf_dir):
    return scoring.with_triage_prompt(_groups(spark, sf_dir)).select("fingerprint", "system_prompt", "user_prompt")


@_query
def parsed_verdicts(spark, sf_dir):
    asked = _groups(spark, sf_dir).select("fingerprint", scoring.prompt_log().alias("user_text"))
    told = scoring.chat_over(asked, stub_model, "", 0.0, 1, scoring.prompt_frame())
    return scoring.with_verdict(told).select("fingerprint", "severity", "reason", "action", "source", "raw_output")


@_query
def triage_results(spark, sf_dir):
    results = triage(_logs(spark, sf_dir), stub_model, window_seconds=WINDOW, threshold=STORM)
    return results.drop("elapsed_ms", "representative_log")


@_query
def stored_responses(spark, sf_dir):
    """Triage by answers kept in a table instead of calls."""
    ruled = rules.with_rule(_groups(spark, sf_dir))
    digit = F.conv(F.substring("fingerprint", 1, 1), 16, 10).cast("int")
    answers = F.array(*[F.lit(a) for a in ANSWERS])
    stored = written(ruled.select("fingerprint", F.get(answers, digit % len(ANSWERS)).alias("content")), "responses")
    return scoring.classify(ruled, responses=stored).select("fingerprint", "severity", "reason", "source")


@_query
def kept_answers(spark, sf_dir):
    """Triage by answers that an earlier run has stored, and how many the later run had to ask for."""
    store = fresh_path(spark, "answer-store")
    ruled = rules.with_rule(_groups(spark, sf_dir))
    written(scoring.classify(ruled, stub_model, answer_store=store), "first-run")
    before = spark.read.parquet(store).count()
    again = written(scoring.classify(ruled, stub_model, answer_store=store), "second-run")
    asked = spark.read.parquet(store).count() - before
    return again.select("fingerprint", "severity", "reason", "source", F.lit(asked).cast("long").alias("asked_again"))


@_query
def ungrouped_triage(spark, sf_dir):
    results = triage(_logs(spark, sf_dir), use_aggregation=False)
    return results.select("log_id", "fingerprint", "severity", "source", "count")


@_query
def result_records(spark, sf_dir):
    return scoring.result_record(_results(spark, sf_dir))


@_query
def severity_attributes(spark, sf_dir):
    return with_severity_attributes(_results(spark, sf_dir).select("fingerprint", "severity"))


# --- statistics and routing -------------------------------------------------------


@_query
def severity_stats(spark, sf_dir):
    return stats.by_severity(_results(spark, sf_dir))


@_query
def source_stats(spark, sf_dir):
    return stats.by_source(_results(spark, sf_dir))


@_query
def run_totals(spark, sf_dir):
    timed = _results(spark, sf_dir).withColumn(
        "elapsed_ms", F.when(F.col("source") == "llm", F.length("raw_output").cast("double")).otherwise(F.col("elapsed_ms"))
    )
    return stats.run_totals(timed)


@_query
def observed_stats(spark, sf_dir):
    """The statistics above, from metrics observed while results are written."""
    timed = _results(spark, sf_dir).withColumn(
        "elapsed_ms", F.when(F.col("source") == "llm", F.length("raw_output").cast("double")).otherwise(F.col("elapsed_ms"))
    )
    run = stats.write_with_stats(timed, fresh_path(spark, "results"))
    totals = run.run_totals()
    names = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in totals.columns])
    severity = F.concat(F.lit("severity "), "severity").alias("metric")
    source = F.concat(F.lit("source "), "source").alias("metric")
    value = F.col("n").cast("double").alias("value")
    counts = run.by_severity().select(severity, value).union(run.by_source().select(source, value))
    return counts.union(totals.select(F.inline(names)))


@_query
def routed_alerts(spark, sf_dir):
    return routing.route(_results(spark, sf_dir)).select("fingerprint", "severity", "handler", "seq")


@_query
def audit_records(spark, sf_dir):
    return routing.audit_records(_results(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@_query
def audit_files(spark, sf_dir):
    path = fresh_path(spark, "audit")
    results = _results(spark, sf_dir)
    routing.write_audit(results, path, now=F.lit(NOW).cast("timestamp"))
    return spark.read.json(path).groupBy("severity", "source").agg(F.count(F.lit(1)).alias("n"))


@_query
def ignored_archive(spark, sf_dir):
    path = fresh_path(spark, "ignored")
    routing.write_ignored(_results(spark, sf_dir), path, now=F.lit(NOW).cast("timestamp"))
    return spark.read.json(path).select("fingerprint", "severity", "raw_log_preview")


@_query
def ignored_documents(spark, sf_dir):
    documents = routing.ignored_documents(_results(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return documents.withColumnRenamed("@timestamp", "at")


def _body(spark, sf_dir, build, *paths):
    body = _results(spark, sf_dir).select("fingerprint", build().alias("body"))
    return body.select("fingerprint", *[F.col(f"body.{p}").alias(n) for p, n in paths])


@_query
def notify_bodies(spark, sf_dir):
    return _body(spark, sf_dir, routing.notification_body, ("text", "text"), ("severity", "severity"))


@_query
def markdown_bodies(spark, sf_dir):
    paths = [("msgtype", "msgtype"), ("markdown.title", "title"), ("markdown.text", "text")]
    return _body(spark, sf_dir, routing.markdown_body, *paths)


@_query
def attachment_bodies(spark, sf_dir):
    body = _results(spark, sf_dir).select("fingerprint", routing.attachment_body().alias("body"))
    return body.select("fingerprint", F.inline("body.attachments"))


@_query
def delivery_outcomes(spark, sf_dir):
    """Two handlers per result; one of them refuses ignored logs, by failing."""
    results = _results(spark, sf_dir)
    routes = spark.createDataFrame(
        [(s, h, i) for s in ("P0_CRITICAL", "P1_HIGH", "P2_WARNING", "P3_IGNORE") for i, h in enumerate(("notification", "markdown"))],
        routing.ROUTE_SCHEMA,
    )
    boxed = routing.outbox(routing.route(results, routes)).select("fingerprint", "severity", "handler", "seq", "body")

    def sender():
        def send(handler, body):
            if handler == "markdown" and "P3_IGNORE" in body:
                raise OSError("refused")
            return True

        return send

    return routing.deliver(boxed, sender).drop("body")


# --- stack traces -----------------------------------------------------------------


def _parsed(spark, sf_dir):
    return stacktrace.parse_logs(_logs(spark, sf_dir))


@_query
def log_headers(spark, sf_dir):
    return _parsed(spark, sf_dir).select("log_id", "severity", "service")


@_query
def log_language(spark, sf_dir):
    return _logs(spark, sf_dir).select("log_id", stacktrace.log_language(F.col("raw_log")).alias("language"))


def _frames(spark, sf_dir, language):
    return stacktrace.frame_table(_parsed(spark, sf_dir)).filter(F.col("language") == language)


@_query
def java_frames(spark, sf_dir):
    return _frames(spark, sf_dir, "java")


@_query
def python_frames(spark, sf_dir):
    return _frames(spark, sf_dir, "python")


@_query
def go_frames(spark, sf_dir):
    return _frames(spark, sf_dir, "go")


@_query
def node_frames(spark, sf_dir):
    return _frames(spark, sf_dir, "node")


@_query
def trace_errors(spark, sf_dir):
    return _parsed(spark, sf_dir).select("log_id", "language", "error_type", "error_message")


@_query
def trace_files(spark, sf_dir):
    files = stacktrace.unique_files(F.col("frames"))
    return _parsed(spark, sf_dir).select(
        "log_id",
        F.size(files).alias("files"),
        F.array_join(files, ",").alias("paths"),
        stacktrace.top_frame(F.col("frames"))["file_path"].alias("top_file"),
    )


@_query
def parsed_summary(spark, sf_dir):
    return _parsed(spark, sf_dir).select("log_id", stacktrace.summary_text().alias("summary"))


# --- retrieval and root cause -----------------------------------------------------


@_query
def source_lines(spark, sf_dir):
    return code_lines(_code(spark, sf_dir))


@_query
def file_requests(spark, sf_dir):
    requests = retrieval.file_requests(parsed_once(_logs(spark, sf_dir)), max_files=2)
    failing = F.array_join(F.transform("highlight_lines", lambda n: n.cast("string")), ",")
    return requests.withColumn("highlight_lines", failing)


def _found(spark, sf_dir):
    requests = retrieval.file_requests(parsed_once(_logs(spark, sf_dir)))
    return requests, retrieval.snippets(requests, retrieval.cut_snippets(requests, _code(spark, sf_dir), CONTEXT))


@_query
def snippets(spark, sf_dir):
    return _found(spark, sf_dir)[1].select(
        "log_id", "pos", "file_path", "start_line", "end_line", "content", "marked_content", "commit_sha"
    )


@_query
def snippet_markdown(spark, sf_dir):
    return _found(spark, sf_dir)[1].select("log_id", "pos", retrieval.snippet_markdown().alias("markdown"))


@_query
def retrieval_coverage(spark, sf_dir):
    return retrieval.retrieval_coverage(*_found(spark, sf_dir))


def _stored_logs(spark, sf_dir):
    """The logs as a table: the view spells every text out wherever it is used."""
    return written(_logs(spark, sf_dir), "logs")


def _prompts(spark, sf_dir, **options):
    return prompts_for(_stored_logs(spark, sf_dir), _code(spark, sf_dir), context_lines=CONTEXT, **options)


@_query
def rca_prompts(spark, sf_dir):
    return _prompts(spark, sf_dir).select("log_id", "user_prompt", "prompt_chars", "found_files")


@_query
def rca_prompts_tight(spark, sf_dir):
    """Under a budget that most logs' code exceeds."""
    return _prompts(spark, sf_dir, budget=BUDGET).select("log_id", "user_prompt", "prompt_chars", "found_files")


def _refs(spark, sf_dir):
    """Documents with an even id also at ref v1, one line longer, with a commit."""
    code = _code(spark, sf_dir)
    old = code_view(read_table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", "text"))
    return code.unionByName(old.withColumns({"ref": F.lit("v1"), "commit_sha": F.lit("0a1b2c3"), "text": F.concat(F.lit("v1\n"), "text")}))


def _logs_with_refs(spark, sf_dir):
    logs = _stored_logs(spark, sf_dir)
    return logs.withColumn("ref", F.when(F.col("log_id") % 3 == 0, "HEAD").when(F.col("log_id") % 3 == 1, ""))


@_query
def snippets_by_ref(spark, sf_dir):
    """Default ref v1, a third of the logs with HEAD of their own; files that v1 lacks come from the working tree."""
    requests = retrieval.file_requests(parsed_once(_logs_with_refs(spark, sf_dir)), default_ref="v1")
    tree = _code(spark, sf_dir).select("file_path", F.concat(F.lit("tree\n"), "text").alias("text"))
    found = retrieval.snippets(requests, retrieval.cut_snippets(requests, _refs(spark, sf_dir), CONTEXT, tree))
    return found.select("log_id", "pos", "ref", "file_path", "start_line", "end_line", "content", "commit_sha")


@_query
def block_snippets(spark, sf_dir):
    """Snippets from lines stored in blocks of eight."""
    store, lines = fresh_path(spark, "blocks"), 8
    snapshots.store_refs(_code(spark, sf_dir), store)
    snapshots.store_blocks(spark, store, lines)
    requests = retrieval.file_requests(parsed_once(_stored_logs(spark, sf_dir)))
    cut = retrieval.cut_stored_snippets(
        requests, snapshots.file_lengths(spark, store), snapshots.stored_blocks(spark, store), CONTEXT, lines
    )
    return retrieval.snippets(requests, cut).select(
        "log_id", "pos", "file_path", "start_line", "end_line", "content", "marked_content", "commit_sha"
    )


@_query
def snapshot_store(spark, sf_dir):
    """Two refs stored by content, the second with every third document changed, and how many texts each ref added."""
    store = fresh_path(spark, "snapshots")
    code = _code(spark, sf_dir)
    doc = F.regexp_extract("file_path", r"(\d+)\.\w+$", 1).cast("long")
    changed = code.withColumns(
        {"ref": F.lit("v2"), "commit_sha": F.lit("beef002"), "text": F.when(doc % 3 == 0, F.concat("text", F.lit("\nv2"))).otherwise(F.col("text"))}
    )
    added = {"HEAD": snapshots.store_refs(code, store), "v2": snapshots.store_refs(changed, store)}
    new = F.create_map(*[F.lit(v) for pair in added.items() for v in pair])
    files = snapshots.stored_files(spark, store)
    return files.select("ref", "file_path", "commit_sha", F.md5("text").alias("digest"), new[F.col("ref")].cast("long").alias("texts_added"))


@_query
def report_refs(spark, sf_dir):
    prompts_of_refs = prompts_for(
        _logs_with_refs(spark, sf_dir), _refs(spark, sf_dir), context_lines=CONTEXT, default_ref="v1"
    )
    return prompts.rca_reports(prompts_of_refs, stub_model).select("log_id", "git_ref", "found_files")


@_query
def rca_reports(spark, sf_dir):
    return prompts.rca_reports(_prompts(spark, sf_dir), stub_model).drop("elapsed_seconds", "usage")


@_query
def token_usage(spark, sf_dir):
    used = prompts.with_token_usage(prompts.rca_reports(_prompts(spark, sf_dir), stub_model))
    return used.select("log_id", "prompt_tokens", "completion_tokens")


@_query
def report_texts(spark, sf_dir):
    reports = prompts.completed(prompts.rca_reports(_prompts(spark, sf_dir), stub_model))
    return routing.report_texts(reports, F.col("log_id").cast("string"))


@_query
def snapshot_files(spark, sf_dir):
    """Ten documents a file, checked out for two refs of which the older lacks every other file."""
    held = []
    documents = read_table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("bundle"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda r: r["text"])
    bundles = written(documents.agg(F.array_join(texts, "\n").alias("value")), "bundles")
    old = bundles.filter("bundle % 2 = 0").withColumn("value", F.concat(F.lit("v1\n"), "value"))
    for ref, commit, files in (("HEAD", "c0ffee1", bundles), ("v1", "0a1b2c3", old)):
        root = fresh_path(spark, f"snapshot-{ref}")
        write_texts(files, root, "bundle")
        held.append(read_snapshot(spark, root, ref, commit, "*.txt"))
    bundle = F.regexp_extract("file_path", r"^bundle=(\d+)/", 1).cast("long").alias("bundle")
    files = held[0].unionByName(held[1])
    return files.select("ref", "commit_sha", bundle, F.length("text").alias("chars"), F.md5("text").alias("digest"))


# --- tuning tables ----------------------------------------------------------------


def _sft(spark, sf_dir):
    return tuning.sft_rows(sft_view(read_table(spark, sf_dir, "conversations")))


@_query
def sft_rows(spark, sf_dir):
    return _sft(spark, sf_dir)


@_query
def sft_chat(spark, sf_dir):
    chat = tuning.sft_chat(_sft(spark, sf_dir))
    return chat.select("conv_id", "turn", F.posexplode("messages").alias("pos", "message")).select(
        "conv_id", "turn", "pos", "message.role", "message.content"
    )


@_query
def sft_cutoff(spark, sf_dir):
    return tuning.within_cutoff(_sft(spark, sf_dir), 100).select("conv_id", "turn", "tokens", "over_cutoff")


@_query
def sft_sample(spark, sf_dir):
    return tuning.capped(_sft(spark, sf_dir), 100, "conv_id", "turn")


@_query
def sft_sample_half(spark, sf_dir):
    rows = _sft(spark, sf_dir)
    return tuning.capped(rows, rows.count() // 2, "conv_id", "turn")


@_query
def sft_json_rows(spark, sf_dir):
    """Datasets of JSON arrays, twenty conversations each, read back and renamed."""
    path = fresh_path(spark, "datasets")
    records = F.sort_array(F.collect_list(F.struct("conv_id", "turn", "instruction", "input", "output")))
    kept = F.transform(records, lambda r: F.struct(*[r[c].alias(c) for c in ("instruction", "input", "output")]))
    rows = sft_view(read_table(spark, sf_dir, "conversations"))
    rows = rows.groupBy(F.floor(F.col("conv_id") / 20).alias("part")).agg(F.to_json(kept).alias("value"))
    rows.write.partitionBy("part").text(path)
    return tuning.sft_rows(read_sft_json(spark, path)).select("prompt", "query", "response")


@_query
def sft_split(spark, sf_dir):
    return tuning.with_split(_sft(spark, sf_dir), 0.1, "conv_id", "turn").select("conv_id", "turn", "split")


@_query
def label_distribution(spark, sf_dir):
    """Labels of the verdicts that the triage run would turn into tuning rows."""
    results = _results(spark, sf_dir)
    return tuning.label_distribution(results.select(F.col("raw_output").alias("response")))


# --- streams ----------------------------------------------------------------------


PARTS, FILES = 5, 4
LATE_SECONDS = 86_400


def _stream(spark, sf_dir):
    """The events as files in the order of their times; each micro-batch takes one part of them."""
    path = fresh_path(spark, "events")
    events = read_table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = [None, *events.agg(F.percentile_approx("micros", F.array(*map(F.lit, shares)), 1000)).first()[0], None]
    for low, high in zip(cuts, cuts[1:]):
        part = events if low is None else events.filter(F.col("micros") >= low)
        part = part if high is None else part.filter(F.col("micros") < high)
        part.drop("micros").repartition(FILES).write.mode("append").parquet(path)
    return _log_stream(spark, sf_dir, path)


def _log_stream(spark, sf_dir, path):
    """The logs of event files, a part of them a micro-batch; a part has few files, so every core gets a share of its narrow rows."""
    schema = read_table(spark, sf_dir, "events").schema
    stream = read_log_stream(spark, path, schema=schema, maxFilesPerTrigger=FILES).select(*EVENT_COLUMNS)
    return log_view(stream.repartition(spark.sparkContext.defaultParallelism), read_table(spark, sf_dir, "documents").count())


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@_query
def stream_dedup(spark, sf_dir):
    root = fresh_path(spark, "stream-dedup")
    _run(streams.stream_dedup(_stream(spark, sf_dir), root, window_seconds=WINDOW, threshold=STORM))
    return streams.emitted_groups(spark, root, flush=True).drop("batch_id")


@_query
def stream_triage(spark, sf_dir):
    root = fresh_path(spark, "stream-triage")
    _run(streams.stream_triage(_stream(spark, sf_dir), root, stub_model, window_seconds=WINDOW, threshold=STORM))
    return spark.read.parquet(f"{root}/outbox").select("log_id", "kind", "severity", "handler", "source")


@_query
def stream_window_counts(spark, sf_dir):
    root = fresh_path(spark, "stream-counts")
    shared_folder(spark)
    counts = streams.storm_counts(_stream(spark, sf_dir), "1 day", "1 day")

    def keep(changed, batch_id):
        changed.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(keep)
    _run(writer.option("checkpointLocation", f"{root}/checkpoint"))
    # The last count told of each window, those still open at the end included.
    told = spark.read.parquet(f"{root}/out").groupBy("window_start", "window_end", "fingerprint")
    return told.agg(F.max_by("count", "batch_id").alias("count"))


@_query
def window_counts(spark, sf_dir):
    return streams.storm_counts(_logs(spark, sf_dir), "1 day")


@_query
def stream_timer_dedup(spark, sf_dir):
    """Windows closed by timers, and those that the state holds at the end."""
    root = fresh_path(spark, "stream-timers")
    shared_folder(spark)
    told = timers.timer_dedup(_stream(spark, sf_dir), WINDOW, STORM, "0 seconds").writeStream.format("parquet")
    _run(told.option("path", f"{root}/groups").option("checkpointLocation", f"{root}/checkpoint"))
    emitted = spark.read.parquet(f"{root}/groups")
    return emitted.unionByName(timers.open_windows(spark, f"{root}/checkpoint"))


@_query
def stream_timer_triage(spark, sf_dir):
    """Triage of what timers close, then of the windows left open."""
    root = fresh_path(spark, "stream-timer-triage")
    shared_folder(spark)
    logs = _logs(spark, sf_dir)
    options = dict(window_seconds=WINDOW, threshold=STORM, delay="0 seconds")
    _run(timers.timer_triage(_stream(spark, sf_dir), logs, root, stub_model, **options))
    timers.triage_open(spark, logs, root, stub_model)
    return spark.read.parquet(f"{root}/outbox").select("log_id", "kind", "severity", "handler", "source")


def _late_stream(spark, sf_dir):
    """The events in parts of equal time, one in ten of them a part too late."""
    path = fresh_path(spark, "late-events")
    events = read_table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = events.agg(F.min("micros"), F.max("micros")).first()
    part = F.floor((F.col("micros") - low) * PARTS / (high - low + 1)) + (F.col("event_id") % 10 == 0).cast("int")
    events = events.withColumn("part", F.least(part, F.lit(PARTS - 1)))
    for no in range(PARTS):
        events.filter(F.col("part") == no).drop("micros", "part").repartition(FILES).write.mode("append").parquet(path)
    return _log_stream(spark, sf_dir, path)


@_query
def stream_late_logs(spark, sf_dir):
    """Every log with its micro-batch, late or not, and the batch's counts."""
    root = fresh_path(spark, "stream-late")
    shared_folder(spark)
    _run(late.stream_split_late(_late_stream(spark, sf_dir), root, delay_seconds=LATE_SECONDS))
    stored = late.stored_logs(spark, root).select("log_id", F.col("batch_id").cast("long").alias("batch_id"), F.col("late").alias("is_late"))
    counts = late.late_counts(spark, root).select("batch_id", "on_time", "late")
    return stored.join(F.broadcast(counts), "batch_id")  # a row for each batch
