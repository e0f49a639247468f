"""Root-cause prompts within their budgets, and the reports made from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import written
from .scoring import ChatFactory, chat_over
from .stacktrace import summary_text


def log_section() -> Column:
    raw = F.col("raw_log")
    kept = F.when(
        F.length(raw) > V.RAW_LOG_LIMIT,
        F.concat(F.substring(raw, 1, V.RAW_LOG_KEPT), F.lit(V.RAW_LOG_CUT_MARK)),
    ).otherwise(raw)
    return F.concat(
        F.lit(V.LOG_SECTION_HEAD), summary_text(), F.lit(V.LOG_SECTION_RAW), kept, F.lit(V.LOG_SECTION_TAIL)
    )


def code_section(pieces: Column, budget: int = V.CODE_BUDGET_CHARS) -> Column:
    """Code blocks of a log up to the budget; '' when it has none.

    ``pieces`` is array<struct<pos, file_path, language, marked_content>>. Blocks
    are kept while their running length fits; from the first that does not, the
    rest is only counted. At most ``max_files`` pieces, so this stays in the row.
    """

    def block(piece, at):
        return F.concat(
            F.format_string(V.CODE_BLOCK_FORMAT, at + 1, piece["file_path"]),
            F.lit("```"),
            piece["language"],
            F.lit("\n"),
            piece["marked_content"],
            F.lit("\n```"),
        )

    blocks = F.transform(F.array_sort(pieces), block)
    empty = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full")
    )

    def take(state, text):
        fits = ~state["full"] & (state["used"] + F.length(text) <= budget)
        return F.struct(
            F.when(fits, F.concat(state["kept"], F.array(text))).otherwise(state["kept"]).alias("kept"),
            F.when(fits, state["used"] + F.length(text)).otherwise(state["used"]).alias("used"),
            (~fits).alias("full"),
        )

    def section(state):
        dropped = F.size(pieces) - F.size(state["kept"])
        note = F.when(dropped > 0, F.array(F.format_string(V.CODE_DROPPED_FORMAT, dropped))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(F.array(F.lit(V.CODE_SECTION_HEAD)), state["kept"], note), "\n")

    return F.when(F.size(pieces) > 0, F.aggregate(blocks, empty, take, section)).otherwise("")


def rca_prompts(parsed: DataFrame, found: DataFrame | None, budget: int = V.CODE_BUDGET_CHARS) -> DataFrame:
    """Add system_prompt, user_prompt, prompt_chars and found_files to parsed logs; ``found`` None: logs without snippets.

    A log has at most ``max_files`` snippets, so a group here is small by itself.
    """
    none = F.array().cast("array<struct<pos:int,file_path:string,language:string,marked_content:string>>")
    if found is None:
        joined = parsed.withColumn("pieces", none)
    else:
        per_log = found.groupBy("log_id").agg(
            F.collect_list(F.struct("pos", "file_path", "language", "marked_content")).alias("pieces")
        )
        joined = parsed.join(per_log, "log_id", "left").withColumn("pieces", F.coalesce("pieces", none))
    code = code_section(F.col("pieces"), budget)
    user = F.concat_ws("\n\n", log_section(), F.nullif(code, F.lit("")), F.lit(V.RCA_TASK))
    return (
        joined.withColumns({"user_prompt": user, "system_prompt": F.lit(V.RCA_SYSTEM)})
        .withColumn("prompt_chars", F.length("system_prompt") + F.length("user_prompt"))
        .withColumn("found_files", F.size("pieces"))
        .drop("pieces")
    )


def rca_reports(prompts: DataFrame, chat_factory: ChatFactory, parts: int | None = None) -> DataFrame:
    """Model reports; a failed call leaves a row with status 'failed' and its error."""
    ref = F.col("ref") if "ref" in prompts.columns else F.lit("HEAD")
    asked = prompts.select("log_id", ref.alias("git_ref"), "error_type", "found_files", F.col("user_prompt").alias("user_text"))
    # Written once: reading the reports again asks no model again.
    told = written(chat_over(asked, chat_factory, V.RCA_SYSTEM, V.RCA_TEMPERATURE, V.RCA_MAX_TOKENS, parts=parts), "reports")
    failed = F.col("error").isNotNull()
    return told.select(
        "log_id",
        "git_ref",
        "error_type",
        "found_files",
        F.col("content").alias("markdown"),
        "model",
        "usage",
        (F.col("elapsed_ms") / 1000).alias("elapsed_seconds"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        "error",
    )


def completed(reports: DataFrame) -> DataFrame:
    return reports.filter("status = 'ok'")


def with_token_usage(reports: DataFrame) -> DataFrame:
    """Token counts under one name each, whichever name the model used."""
    usage = F.col("usage")
    return reports.withColumns(
        {
            "prompt_tokens": F.coalesce(usage["prompt_tokens"], usage["prompt_eval_count"]),
            "completion_tokens": F.coalesce(usage["completion_tokens"], usage["eval_count"]),
        }
    )
