"""Root-cause analysis end to end: logs, frames, snippets, prompts, reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators.prompts import rca_prompts, rca_reports
from ..operators.retrieval import cut_snippets, file_requests, snippets
from ..operators.scoring import ChatFactory
from ..operators.stacktrace import log_language, parse_headers, parse_logs
from ..session import written


def parsed_once(logs: DataFrame) -> DataFrame:
    """Parsed logs without their texts, written once.

    Requests, snippets and prompts all start from the frames; taking the texts
    apart is the costly part and must not be repeated for each of them.
    """
    return written(parse_logs(logs).drop("raw_log"), "parsed")


def prompts_for(
    logs: DataFrame,
    code_files: DataFrame,
    max_files: int = V.MAX_FILES,
    context_lines: int = V.CONTEXT_LINES,
    budget: int = V.CODE_BUDGET_CHARS,
    default_ref: str = "HEAD",
    working_tree: DataFrame | None = None,
) -> DataFrame:
    """The dry run: everything up to the prompts."""
    parsed = parsed_once(logs)
    # A log's own ref comes first; requests and reports name the same one.
    own_ref = F.nullif(F.col("ref"), F.lit("")) if "ref" in parsed.columns else F.lit(None)
    parsed = parsed.withColumn("ref", F.coalesce(own_ref, F.lit(default_ref)))
    requests = file_requests(parsed, max_files, default_ref)
    found = snippets(requests, cut_snippets(requests, code_files, context_lines, working_tree))
    # Only logs in a known language can have frames; the others' prompts come from the scan, and their texts stay where they are.
    known = log_language(F.col("raw_log")) != "unknown"
    texts = logs.filter(known).select("log_id", "raw_log")
    framed = rca_prompts(parsed.filter("language != 'unknown'").join(texts, "log_id"), found, budget)
    others = parse_headers(logs.filter(~known)).withColumn("ref", F.coalesce(own_ref, F.lit(default_ref)))
    return framed.unionByName(rca_prompts(others, None, budget))


def analyse(
    logs: DataFrame, code_files: DataFrame, chat_factory: ChatFactory, parts: int | None = None, **options
) -> DataFrame:
    return rca_reports(prompts_for(logs, code_files, **options), chat_factory, parts)
