"""Stack traces of log texts: header, language, error and frames.

A trace is no longer than its log, so it is taken apart inside the row with
array expressions; no step of this module shuffles.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import blank_as, first_group, hits, rstrip, split_lines, strip

FRAMES = (
    "array<struct<language:string,file_path:string,line_number:int,function_name:string,"
    "class_name:string,raw:string>>"
)


def log_header(text: Column) -> Column:
    """(severity, service_name) of the first ``LEVEL [service]``; ERROR and '' without one."""
    level = first_group(text, V.HEADER_PATTERN, 1, ignore_case=True)
    service = first_group(text, V.HEADER_PATTERN, 2, ignore_case=True)
    return F.struct(
        F.coalesce(F.nullif(F.upper(level), F.lit("")), F.lit("ERROR")).alias("severity"),
        service.alias("service_name"),
    )


# Pieces of which a trace line of the language must hold one.
_TRACE_PIECES = {"java": [".java:"], "python": ['.py"'], "go": [".go:"], "node": [".js:", ".ts:", ".mjs:"]}


def log_language(text: Column) -> Column:
    """Language of the first pattern that hits; a plain search spares most texts the patterns."""
    language = None
    for name, pattern in V.LANGUAGE_PATTERNS:
        hit = _holds_any(text, _TRACE_PIECES[name]) & hits(text, pattern, multiline=True)
        language = F.when(hit, F.lit(name)) if language is None else language.when(hit, F.lit(name))
    return language.otherwise("unknown")


def _frame(language: str, path: Column, line: Column, function: Column, cls: Column, raw: Column) -> Column:
    return F.struct(
        F.lit(language).alias("language"),
        path.alias("file_path"),
        line.cast("int").alias("line_number"),
        function.alias("function_name"),
        cls.alias("class_name"),
        rstrip(raw).alias("raw"),
    )


def _holds_any(path: Column, pieces: list[str]) -> Column:
    held = F.lit(False)
    for piece in pieces:
        held = held | path.contains(piece)
    return held


def _first_hit(lines: Column, pattern: str) -> Column:
    """Place, counted from 1, of the first line that the pattern fits once stripped; 0 for none."""
    return F.array_position(F.transform(lines, lambda l: hits(l["bare"], pattern)), True).cast("int")


def _java_path(cls: Column) -> Column:
    parts = F.split(cls, r"\.")
    # Class names start with a capital letter or hold the inner-class mark.
    named = F.filter(parts, lambda p: p.rlike(r"^[\p{Lu}\p{Lt}]") | p.contains("$"))
    kept = F.when(F.size(named) > 0, named).otherwise(parts)
    return F.concat(F.array_join(kept, "/"), F.lit(".java"))


def java_frames(lines: Column, error_at: Column) -> Column:
    def frame(l):
        line = l["line"]
        cls = first_group(line, V.JAVA_FRAME, 1)
        number, method = first_group(line, V.JAVA_FRAME, 4), first_group(line, V.JAVA_FRAME, 2)
        return _frame("java", _java_path(cls), number, method, cls, line)

    # The line of the error itself is never a frame.
    kept = F.filter(lines, lambda l, at: hits(l["line"], V.JAVA_FRAME) & (at + 1 != error_at))
    return F.transform(kept, frame)


def python_frames(lines: Column, error_at: Column) -> Column:
    def frame(l):
        path, number, function = (first_group(l["line"], V.PYTHON_FRAME, g) for g in (1, 2, 3))
        return _frame("python", path, number, function, F.lit(""), l["line"])

    return F.transform(F.filter(lines, lambda l: hits(l["line"], V.PYTHON_FRAME)), frame)


def go_frames(lines: Column, error_at: Column) -> Column:
    """Frames pair a file line with the function line that comes before it.

    Of the lines that name a function or a file, a file line counts when the one
    before it names a function. (A panic line can be neither.)
    """
    named = F.transform(
        lines, lambda l: F.struct(l["line"].alias("line"), first_group(l["bare"], V.GO_FUNCTION).alias("function"))
    )
    marked = F.transform(
        named,
        lambda m: F.struct(
            m["line"].alias("line"),
            m["function"].alias("function"),
            F.when(m["function"] == "", first_group(m["line"], V.GO_FILE)).otherwise("").alias("path"),
        ),
    )
    kept = F.filter(marked, lambda m: (m["function"] != "") | (m["path"] != ""))
    owners = F.concat(F.array(F.lit("")), F.transform(kept, lambda m: m["function"]))
    paired = F.zip_with(
        kept,
        F.slice(owners, 1, F.size(kept)),
        lambda m, owner: F.struct(
            m["line"].alias("line"), F.ltrim(m["path"], F.lit("/")).alias("path"), owner.alias("owner")
        ),
    )
    own = F.filter(
        paired, lambda p: (p["path"] != "") & (p["owner"] != "") & ~_holds_any(p["path"], V.GO_SKIPPED)
    )

    def frame(p):
        function = F.element_at(F.split(p["owner"], r"\.", -1), -1)
        return _frame("go", p["path"], first_group(p["line"], V.GO_FILE, 2), function, p["owner"], p["line"])

    return F.transform(own, frame)


def node_frames(lines: Column, error_at: Column) -> Column:
    def path(l, at):
        named = first_group(l["line"], V.NODE_NAMED_FRAME, 2)
        return F.struct(
            l["line"].alias("line"),
            F.when(at + 1 == error_at, F.lit("")).otherwise(named).alias("named"),
            F.when(at + 1 == error_at, F.lit(""))
            .when(named == "", first_group(l["line"], V.NODE_PLAIN_FRAME))
            .otherwise(named)
            .alias("path"),
        )

    def frame(p):
        line, is_named = p["line"], p["named"] != ""
        number = F.when(is_named, first_group(line, V.NODE_NAMED_FRAME, 3)).otherwise(
            first_group(line, V.NODE_PLAIN_FRAME, 2)
        )
        function = F.when(is_named, strip(first_group(line, V.NODE_NAMED_FRAME, 1))).otherwise(V.NODE_ANONYMOUS)
        return _frame("node", F.ltrim(p["path"], F.lit("/")), number, function, F.lit(""), line)

    kept = F.filter(
        F.transform(lines, path), lambda p: (p["path"] != "") & ~_holds_any(p["path"], V.NODE_SKIPPED)
    )
    return F.transform(kept, frame)


FRAME_RULES = {"java": java_frames, "python": python_frames, "go": go_frames, "node": node_frames}
ERROR_PATTERNS = {"java": V.JAVA_ERROR, "python": V.PYTHON_ERROR, "node": V.NODE_ERROR}


def _error_place(language: Column, lines: Column) -> Column:
    """Place of the line that tells the error: the first that fits, for Go the last panic."""
    panics = F.transform(lines, lambda l: l["bare"].startswith(V.GO_PANIC))
    from_end = F.array_position(F.reverse(panics), True).cast("int")
    last_panic = F.when(from_end > 0, F.size(lines) - from_end + 1).otherwise(0)
    place = F.when(language == "go", last_panic)
    for name, pattern in ERROR_PATTERNS.items():
        place = place.when(language == name, _first_hit(lines, pattern))
    return place.otherwise(0)


def _error_part(language: Column, bare: Column, group: int) -> Column:
    of_go = [F.lit("panic"), strip(F.substr(bare, F.lit(len(V.GO_PANIC) + 1)))][group - 1]
    part = F.when(bare.isNull(), F.lit("")).when(language == "go", of_go)
    for name, pattern in ERROR_PATTERNS.items():
        part = part.when(language == name, strip(first_group(bare, pattern, group)))
    return part.otherwise("")


def parse_logs(logs: DataFrame) -> DataFrame:
    """Add severity, service (from the header), language, error_type, error_message, frames."""
    text, language = F.col("raw_log"), F.col("language")
    lines, error_at, bare = F.col("lines"), F.col("error_at"), F.col("error_line")
    nothing = F.array().cast("array<struct<line:string,bare:string>>")
    split = F.transform(split_lines(text), lambda l: F.struct(l.alias("line"), strip(l).alias("bare")))
    frames = None
    for name, rule in FRAME_RULES.items():
        found = rule(lines, error_at).cast(FRAMES)
        frames = F.when(language == name, found) if frames is None else frames.when(language == name, found)
    return (
        # Step by step: what a later step uses twice must not be computed twice.
        logs.withColumns({"header": log_header(text), "language": log_language(text)})
        .withColumn("lines", F.when(language != "unknown", split).otherwise(nothing))
        .withColumn("error_at", _error_place(language, lines))
        .withColumn("error_line", F.when(error_at > 0, F.get(lines, error_at - 1)["bare"]))
        .select(
            *logs.columns,
            F.col("header.severity").alias("severity"),
            F.col("header.service_name").alias("service"),
            "language",
            _error_part(language, bare, 1).alias("error_type"),
            _error_part(language, bare, 2).alias("error_message"),
            frames.otherwise(F.array().cast(FRAMES)).alias("frames"),
        )
    )


def parse_headers(logs: DataFrame) -> DataFrame:
    """``parse_logs`` for logs in no known language: they have a header at most."""
    blank = F.lit("")
    return logs.withColumn("header", log_header(F.col("raw_log"))).select(
        *logs.columns,
        F.col("header.severity").alias("severity"),
        F.col("header.service_name").alias("service"),
        F.lit("unknown").alias("language"),
        blank.alias("error_type"),
        blank.alias("error_message"),
        F.array().cast(FRAMES).alias("frames"),
    )


def frame_table(parsed: DataFrame) -> DataFrame:
    """One row per frame: (log_id, pos, language, file_path, ...)."""
    # The inner form of explode would compute the frames twice, once for a filter.
    frames = parsed.select("log_id", F.posexplode_outer("frames").alias("pos", "frame"))
    return frames.filter(F.col("pos").isNotNull()).select("log_id", "pos", "frame.*")


def unique_files(frames: Column) -> Column:
    """Distinct paths in the order of first appearance."""
    return F.array_distinct(F.transform(frames, lambda f: f["file_path"]))


def top_frame(frames: Column) -> Column:
    return F.get(frames, F.lit(0))


def summary_text() -> Column:
    """Four lines about a parsed log, and a fifth for its first frame."""
    top = top_frame(F.col("frames"))
    lines = [
        F.concat(F.lit(V.SUMMARY_SERVICE), blank_as(F.col("service"), V.UNKNOWN_TEXT)),
        F.concat(F.lit(V.SUMMARY_LEVEL), F.col("severity")),
        F.concat(F.lit(V.SUMMARY_ERROR), blank_as(F.col("error_type"), V.UNKNOWN_TEXT), F.lit(": "), F.col("error_message")),
        F.concat(F.lit(V.SUMMARY_FILES), F.size(unique_files(F.col("frames"))).cast("string")),
        F.when(
            top.isNotNull(),
            F.concat(
                F.lit(V.SUMMARY_TOP),
                top["file_path"],
                F.lit(":"),
                top["line_number"].cast("string"),
                F.lit(" in "),
                top["function_name"],
                F.lit("()"),
            ),
        ),
    ]
    return F.concat_ws("\n", *lines)
