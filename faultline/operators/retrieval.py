"""Source context of stack traces: requested files, snippets, their text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import split_lines
from ..session import written_side
from ..sources.snapshots import BLOCK_LINES
from .stacktrace import unique_files

_PLACE = ["ref", "file_path", "center"]


def file_requests(
    parsed: DataFrame, max_files: int = V.MAX_FILES, default_ref: str = "HEAD"
) -> DataFrame:
    """The first files of each log: (log_id, pos, ref, file_path, language, highlight_lines, center).

    A log's own ``ref`` comes before the default. Failing lines are distinct and
    sorted; the window's centre is the first of them.
    """
    frames = F.col("frames")
    own_ref = F.nullif(F.col("ref"), F.lit("")) if "ref" in parsed.columns else F.lit(None)

    def request(path):
        of_file = F.filter(frames, lambda f: f["file_path"] == path)
        return F.struct(
            path.alias("file_path"),
            F.get(of_file, F.lit(0))["language"].alias("language"),
            F.array_sort(F.array_distinct(F.transform(of_file, lambda f: f["line_number"]))).alias("highlight_lines"),
        )

    files = F.slice(unique_files(frames), 1, max_files)
    return (
        # A condition on the frames themselves would compute them once more in a
        # filter below, and so would the inner form of explode.
        parsed.filter(F.col("language") != "unknown")
        .select(
            "log_id",
            F.coalesce(own_ref, F.lit(default_ref)).alias("ref"),
            F.posexplode_outer(F.transform(files, request)).alias("pos", "request"),
        )
        .filter(F.col("pos").isNotNull())
        .select("log_id", "pos", "ref", "request.*")
        .withColumn("center", F.get("highlight_lines", F.lit(0)))
    )


def _numbered(line: Column, number: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), F.greatest(F.lit(6), F.length(number.cast("string"))), " "), F.lit(" | "), line)


def cut_snippets(
    requests: DataFrame,
    code_files: DataFrame,
    context_lines: int = V.CONTEXT_LINES,
    working_tree: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct (ref, file, centre) whose file exists, with its lines.

    What a window holds depends on its centre alone, so requests are made distinct by it (this combines before its
    shuffle), each file meets one row with all its centres and is split once, however many logs ask with however many
    sets of failing lines. ``working_tree(file_path, text)`` serves files that a ref lacks.
    """
    centers = requests.select(*_PLACE).distinct().groupBy("ref", "file_path").agg(F.collect_list("center").alias("centers"))
    files = code_files.select("ref", "file_path", "text", "commit_sha")
    if working_tree is None:
        found = written_side(centers, "requests").join(files, ["ref", "file_path"]).withColumn("copies", F.lit(1))
    else:
        found = _found_or_in_tree(centers, files, working_tree.select("file_path", "text"))
    lines = F.col("lines")

    def window(center):
        start = F.greatest(F.lit(1), center - context_lines)
        end = F.least(F.size(lines), center + context_lines)
        # Past the end of the file the window is empty, and the snippet still counts.
        held = F.slice(lines, start, F.greatest(F.lit(0), end - start + 1))
        return F.struct(center.alias("center"), start.alias("start_line"), end.alias("end_line"), held.alias("window"))

    return (
        found.select("ref", "file_path", "commit_sha", "centers", "copies", split_lines(F.col("text")).alias("lines"))
        .select("ref", "file_path", "commit_sha", F.inline(F.flatten(F.array_repeat(F.transform("centers", window), F.col("copies")))))
        .withColumn(
            "content",
            F.array_join(F.transform("window", lambda line, at: _numbered(line, F.col("start_line") + at)), "\n"),
        )
    )


def _found_or_in_tree(centers: DataFrame, files: DataFrame, tree: DataFrame) -> DataFrame:
    """Files asked for with their texts, those that a ref lacks from ``tree``; ``copies``: how many of the tree's rows a row stands for.

    What is lacking is found by names alone. So a text is shuffled once at most, and the tree's meet only the requests that need them.
    """
    place = ["ref", "file_path"]
    refs = files.groupBy("ref").agg(F.max("commit_sha").alias("ref_sha"))
    in_tree = tree.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("n"))
    asked = centers.join(in_tree, "file_path", "left").join(F.broadcast(refs), "ref", "left")  # a row for each ref
    asked = asked.withColumn("copies", F.coalesce("n", F.lit(1))).drop("n")
    asked = written_side(asked, "requests")
    sha = F.coalesce("commit_sha", "ref_sha", F.lit("")).alias("commit_sha")
    columns = [*place, "centers", "text", sha, "copies"]
    named = files.select(*place, "commit_sha", F.col("text").isNotNull().alias("held"))
    lacking = asked.join(named, place, "left").filter(~F.coalesce("held", F.lit(False))).withColumn("copies", F.lit(1))
    from_tree = written_side(lacking, "lacking").join(tree.filter(F.col("text").isNotNull()), "file_path")
    return asked.join(files.filter(F.col("text").isNotNull()), place).select(*columns).unionByName(from_tree.select(*columns))


def cut_stored_snippets(
    requests: DataFrame,
    files: DataFrame,
    blocks: DataFrame,
    context_lines: int = V.CONTEXT_LINES,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """``cut_snippets`` from lines stored in blocks: a window reads the blocks that it touches, two where it is no longer than one.

    ``files`` and ``blocks`` as ``sources.snapshots`` gives them. Existence and length come from ``files``; then an equi-join by
    (digest, block) fetches lines, so a file of any size is neither read nor split whole.
    """
    place = ["ref", "file_path", "commit_sha", "center", "start_line", "end_line"]
    asked = requests.select(*_PLACE).distinct().join(files, ["ref", "file_path"])
    asked = asked.withColumns(
        {
            "start_line": F.greatest(F.lit(1), F.col("center") - context_lines),
            "end_line": F.least("total_lines", F.col("center") + context_lines),
        }
    )
    block = lambda line: F.floor((line - 1) / block_lines).cast("int")
    reach = F.when(
        F.col("end_line") >= F.col("start_line"), F.sequence(block(F.col("start_line")), block(F.col("end_line")))
    )
    # Past the end of the file the window is empty, and the snippet still counts.
    touched = asked.select(*place, "digest", F.explode_outer(reach).alias("block"))
    first = F.greatest(F.lit(1), F.col("start_line") - F.col("block") * block_lines)
    last = F.least(F.size("lines"), F.col("end_line") - F.col("block") * block_lines)
    pieces = touched.join(blocks, ["digest", "block"], "left").select(
        *place, F.when(F.col("lines").isNotNull(), F.struct("block", F.slice("lines", first, last - first + 1).alias("held"))).alias("piece")
    )
    joined = pieces.groupBy(*place).agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    window = F.flatten(F.transform("pieces", lambda p: p["held"]))
    return joined.select(*place, window.alias("window")).withColumn(
        "content", F.array_join(F.transform("window", lambda line, at: _numbered(line, F.col("start_line") + at)), "\n")
    )


def snippets(requests: DataFrame, cut: DataFrame) -> DataFrame:
    """Snippets per log, failing lines marked; requests of missing files fall away.

    ``cut`` is unique on the join key, so a request that a third of all logs make
    is a hot key on one side only, which adaptive execution splits.
    """

    def marked(line, at):
        number = F.col("start_line") + at
        mark = F.when(F.array_contains("highlight_lines", number), V.FAILING_LINE_MARK).otherwise(V.OTHER_LINE_MARK)
        return F.concat(mark, _numbered(line, number))

    joined = requests.join(cut, _PLACE)
    return joined.withColumn("marked_content", F.array_join(F.transform("window", marked), "\n")).drop("window")


def snippet_markdown() -> Column:
    """Heading with path, range and failing lines, then the fenced code."""
    failing = F.array_join(F.transform("highlight_lines", lambda n: n.cast("string")), ", ")
    return F.concat(
        F.lit(V.SNIPPET_FILE),
        F.col("file_path"),
        F.lit(V.SNIPPET_LINES),
        F.col("start_line").cast("string"),
        F.lit("–"),
        F.col("end_line").cast("string"),
        F.when(F.size("highlight_lines") > 0, F.concat(F.lit(V.SNIPPET_FAILING), failing)).otherwise(""),
        F.lit("\n```"),
        F.col("language"),
        F.lit("\n"),
        F.col("content"),
        F.lit("\n```"),
    )


def retrieval_coverage(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Files found and asked for, per log with a stack trace."""
    asked = requests.select("log_id", F.lit(1).alias("asked"), F.lit(0).alias("found"))
    got = found.select("log_id", F.lit(0).alias("asked"), F.lit(1).alias("found"))
    return (
        asked.unionByName(got)
        .groupBy("log_id")
        .agg(F.sum("found").alias("found_files"), F.sum("asked").alias("requested_files"))
        .withColumn("coverage", F.col("found_files") / F.col("requested_files"))
    )
