"""Model classification of the groups that no rule settles.

A model is given as a factory: called once per task, it returns
``chat(system, user, temperature, max_tokens) -> (content, model, usage)``.
"""

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.patterns import spark_pattern
from ..functions.severity import is_valid
from ..functions.text import once, strip
from ..session import written
from .dedup import frequency_per_minute, group_context

ChatFactory = Callable[[], Callable[[str, str, float, int], tuple[str, str, dict]]]

_FIELDS = "severity:string,reason:string,action:string"


# --- prompts ----------------------------------------------------------------------


def prompt_frame() -> tuple[str, str]:
    """What stands before and after the log text of a prompt; the same for all."""
    return V.TRIAGE_EXAMPLE_BLOCK + V.TRIAGE_QUESTION_HEAD, V.TRIAGE_QUESTION_TAIL


def prompt_log(max_chars: int = V.TRIAGE_LOG_LIMIT) -> Column:
    text = group_context()
    return F.when(
        F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(V.TRIAGE_CUT_MARK))
    ).otherwise(text)


def with_triage_prompt(groups: DataFrame) -> DataFrame:
    head, tail = prompt_frame()
    return groups.withColumns(
        {
            "system_prompt": F.lit(V.TRIAGE_SYSTEM),
            "user_prompt": F.concat(F.lit(head), prompt_log(), F.lit(tail)),
        }
    )


# --- calls ------------------------------------------------------------------------


def chat_over(
    rows: DataFrame,
    chat_factory: ChatFactory,
    system: str,
    temperature: float,
    max_tokens: int,
    frame: tuple[str, str] = ("", ""),
    parts: int | None = None,
    at_once: int = 1,
    tries: int = 1,
    wait_seconds: float = 1.0,
) -> DataFrame:
    """Call a model once per row of (id..., user_text) and add its answer.

    ``frame`` is put round ``user_text`` inside the task, so that a constant part
    of the prompt does not travel with every row. Rows without ``user_text`` pass
    without a call. A failed call gives a null content and the error's text.
    ``parts`` sets how many tasks call at a time, ``at_once`` how many calls each of them has under way. A call that fails
    is tried again, ``tries`` times in all, after a wait that doubles.
    """
    keys = [f for f in rows.schema.fields if f.name != "user_text"]
    names = [k.name for k in keys]
    fields = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in keys)
    schema = f"{fields}, content string, model string, usage map<string,bigint>, error string, elapsed_ms double"
    head, tail = frame

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = None

        def answer(text):
            if text is None:
                return None, "", {}, None, 0.0
            began = time.perf_counter()
            for left in reversed(range(tries)):
                try:
                    content, model, usage = chat(system, head + text + tail, temperature, max_tokens)
                    usage = {k: int(v) for k, v in (usage or {}).items() if v is not None}
                    told = (content, model, usage, None)
                    break
                except Exception as error:  # one bad call must not end the job
                    told = (None, "", {}, str(error))
                    if left:
                        time.sleep(wait_seconds * 2 ** (tries - 1 - left))
            return (*told, (time.perf_counter() - began) * 1000)

        for batch in batches:
            if chat is None:
                chat = chat_factory()
            if at_once > 1:
                with ThreadPoolExecutor(at_once) as calls:
                    answers = list(calls.map(answer, batch["user_text"]))
            else:
                answers = [answer(text) for text in batch["user_text"]]
            told = pd.DataFrame(
                answers, columns=["content", "model", "usage", "error", "elapsed_ms"], index=batch.index
            )
            yield pd.concat([batch[names], told], axis=1)

    spread = rows.repartition(parts) if parts else rows
    return spread.mapInPandas(call, schema)


# --- answers ----------------------------------------------------------------------


def verdict_text(content: Column) -> Column:
    """Part of an answer that should be JSON: fenced, else a bare object, else all of it."""
    fenced = F.regexp_extract(content, spark_pattern(V.FENCED_JSON, dot_all=True), 1)
    bare = F.regexp_extract(content, spark_pattern(V.BARE_JSON, dot_all=True), 0)
    found = [once(part, lambda text: F.nullif(text, F.lit(""))) for part in (fenced, bare)]
    return F.coalesce(*found, strip(content))


def strict_verdict(text: Column) -> Column:
    """(severity, reason, action) of a text that is one JSON object and nothing else; else null.

    A JSON reader stops after the first value. Put into an array before an end mark, a text with
    anything behind its object shows as an array of another length, or as none.
    """

    def read(text: Column) -> Column:
        array = F.concat(F.lit("["), text, F.lit(',{"end":1}]'))
        told = F.from_json(array, f"array<struct<{_FIELDS},end:int>>", {"allowSingleQuotes": "false"})
        return F.when(text.startswith("{"), once(told, first_of_two))

    def first_of_two(told: Column) -> Column:
        return F.when((F.size(told) == 2) & (F.get(told, F.lit(1))["end"] == 1), F.get(told, F.lit(0)))

    return once(text, read)


def parsed_verdict(content: Column) -> Column:
    """(severity, reason, action), or null where the answer is no valid verdict."""

    def checked(verdict: Column) -> Column:
        return F.when(
            is_valid(verdict["severity"]),
            F.struct(
                verdict["severity"].alias("severity"),
                F.coalesce(verdict["reason"], F.lit("")).alias("reason"),
                F.coalesce(verdict["action"], F.lit("")).alias("action"),
            ),
        )

    return once(strict_verdict(verdict_text(content)), checked)


def with_verdict(scored: DataFrame, fallback: str = V.FALLBACK_SEVERITY) -> DataFrame:
    """Add severity, reason, action and source; failed or bad answers take the fallback."""
    kept = scored.withColumn("verdict", parsed_verdict(F.col("content")))
    v = F.col("verdict")
    return kept.withColumns(
        {
            "severity": F.coalesce(v["severity"], F.lit(fallback)),
            "reason": F.coalesce(v["reason"], F.lit(V.FALLBACK_REASON_FORMAT % fallback)),
            "action": F.coalesce(v["action"], F.lit(V.FALLBACK_ACTION)),
            "source": F.when(v.isNotNull(), F.lit("llm")).otherwise(F.lit("default")),
            "raw_output": F.coalesce(F.col("content"), F.format_string(V.CALL_FAILED_FORMAT, F.col("error"))),
        }
    ).drop("verdict", "content", "error")


# --- results ----------------------------------------------------------------------

RESULT_COLUMNS = [
    "fingerprint",
    "kind",
    "log_id",
    "representative_log",
    "service_name",
    "severity",
    "reason",
    "action",
    "source",
    "count",
    "first_seen",
    "last_seen",
    "model",
    "raw_output",
    "elapsed_ms",
]


def classify(
    ruled: DataFrame,
    chat_factory: ChatFactory | None = None,
    responses: DataFrame | None = None,
    fallback: str = V.FALLBACK_SEVERITY,
    parts: int | None = None,
    answer_store: str | None = None,
) -> DataFrame:
    """Groups with their rule columns to triage results.

    Rows with a severity are settled by rule; only the others reach the model, or
    meet stored ``responses(fingerprint, content)``, unique by fingerprint. With
    neither, they take the fallback. ``answer_store`` names a folder that keeps the model's answers over runs.
    """
    if "kind" not in ruled.columns:
        ruled = ruled.withColumn("kind", F.lit("GROUP"))
    keys = [c for c in RESULT_COLUMNS if c in ruled.columns]
    kept = ruled.select(*keys, *[F.col(c).alias(f"rule_{c}") for c in ("severity", "reason", "action")]).drop(
        "severity", "reason", "action"
    )
    by_rule = F.col("rule_severity").isNotNull()
    if chat_factory is not None:
        # Groups and answers are written once: the model is asked once for each miss, however many sinks read
        # the results, and only keys and texts of misses travel to it.
        kept = written(kept.withColumn("ask_id", F.monotonically_increasing_id()), "ruled")
        asked = kept.filter(~by_rule).select("ask_id", prompt_log().alias("user_text"))
        setting = (chat_factory, V.TRIAGE_SYSTEM, V.TRIAGE_TEMPERATURE, V.TRIAGE_MAX_TOKENS, prompt_frame())
        if answer_store is None:
            told = chat_over(asked, *setting, parts)
        else:
            from .answers import answered  # which itself calls the model by way of this module

            told = answered(asked, answer_store, *setting, parts=parts)
        told = written(told, "answers")
        settled = kept.filter(by_rule).withColumns(
            {"content": F.lit(None).cast("string"), "model": F.lit(""), "error": F.lit(None).cast("string"), "elapsed_ms": F.lit(0.0)}
        )
        misses = kept.filter(~by_rule).join(told, "ask_id")
        scored = settled.unionByName(misses.select(*settled.columns)).drop("ask_id")
    else:
        if responses is not None:
            kept = kept.join(responses.select("fingerprint", "content"), "fingerprint", "left")
        else:
            kept = kept.withColumn("content", F.lit(None).cast("string"))
        scored = kept.withColumns(
            {"model": F.lit(""), "error": F.lit("no response"), "elapsed_ms": F.lit(0.0)}
        )
    judged = with_verdict(scored, fallback)
    of_rule = {
        "severity": F.coalesce("rule_severity", "severity"),
        "reason": F.coalesce("rule_reason", "reason"),
        "action": F.coalesce("rule_action", "action"),
        "source": F.when(by_rule, F.lit("rule")).otherwise(F.col("source")),
        "raw_output": F.when(by_rule, F.lit("")).otherwise(F.col("raw_output")),
    }
    return judged.withColumns(of_rule).select(*RESULT_COLUMNS)


def result_record(results: DataFrame) -> DataFrame:
    """The eight reported fields of a result."""
    return results.select(
        "severity",
        "reason",
        "action",
        "source",
        F.col("service_name").alias("service"),
        "count",
        F.bround(frequency_per_minute(), 1).alias("frequency"),
        "fingerprint",
    )
