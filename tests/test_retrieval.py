from pyspark.sql import functions as F

from faultline import fixed_values as V
from faultline.operators import prompts, retrieval, routing
from faultline.operators.stacktrace import parse_logs
from faultline.plans.rca import analyse, prompts_for
from faultline.sources.code import code_lines

TRACE = "\n".join(
    ["ERROR [etl] failed", "Traceback:"]
    + [f'  File "f{i}.py", line {n}, in go' for i, n in [(0, 9), (0, 3), (0, 9), (1, 2), (2, 50), (3, 1), (4, 1), (5, 1)]]
    + ["KeyError: 'x'"]
)


def logs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "log_id int, raw_log string")


def code(spark, n_files=6, ref="HEAD"):
    rows = [(ref, f"f{i}.py", "\n".join(f"line {i}.{n} | x" for n in range(1, 13)) + "\n", "abc1234") for i in range(n_files) if i != 3]
    return spark.createDataFrame(rows, "ref string, file_path string, text string, commit_sha string")


def found(spark, *texts, files=None, **options):
    requests = retrieval.file_requests(parse_logs(logs(spark, *texts)), **options)
    files = code(spark) if files is None else files
    return requests, retrieval.snippets(requests, retrieval.cut_snippets(requests, files, 2))


def test_requests_take_the_first_files(spark):
    requests, _ = found(spark, TRACE)
    rows = requests.orderBy("pos").collect()
    assert [(r.file_path, r.highlight_lines, r.center) for r in rows] == [
        ("f0.py", [3, 9], 3), ("f1.py", [2], 2), ("f2.py", [50], 50), ("f3.py", [1], 1), ("f4.py", [1], 1),
    ]
    assert found(spark, "plain text")[0].count() == 0


def test_snippets(spark):
    _, cut = found(spark, TRACE)
    rows = {r.file_path: r for r in cut.withColumn("md", retrieval.snippet_markdown()).collect()}
    assert set(rows) == {"f0.py", "f1.py", "f2.py", "f4.py"}  # f3 is missing, f5 beyond the limit
    first = rows["f0.py"]
    assert (first.start_line, first.end_line, first.commit_sha) == (1, 5, "abc1234")
    assert first.content == "\n".join(f"{n:>6} | line 0.{n} | x" for n in range(1, 6))
    assert first.marked_content.split("\n")[2] == ">>>      3 | line 0.3 | x"
    assert first.marked_content.split("\n")[1] == "         2 | line 0.2 | x"
    assert first.md == f"**文件**: `f0.py`  **行**: 1–5  **报错行**: 3, 9\n```python\n{first.content}\n```"
    past = rows["f2.py"]
    assert (past.start_line, past.end_line, past.content, past.marked_content) == (48, 12, "", "")


def test_own_ref_and_working_tree(spark):
    both = code(spark, 1, "v1").unionByName(code(spark, 2, "v2").filter("file_path = 'f1.py'"))
    parsed = parse_logs(logs(spark, TRACE, TRACE).withColumn("ref", F.when(F.col("log_id") == 0, "v1")))
    requests = retrieval.file_requests(parsed, 2, "v2")
    cut = retrieval.snippets(requests, retrieval.cut_snippets(requests, both, 2)).collect()
    assert sorted((r.log_id, r.ref, r.file_path) for r in cut) == [(0, "v1", "f0.py"), (1, "v2", "f1.py")]
    tree = code(spark).select("file_path", "text")
    more = retrieval.snippets(requests, retrieval.cut_snippets(requests, both, 2, working_tree=tree)).collect()
    assert len(more) == 4 and {r.commit_sha for r in more} == {"abc1234"}


def test_one_cut_per_centre_whatever_lines_fail(spark):
    rows = [(i, 0, "HEAD", "f0.py", "python", [5, 6 + i], 5) for i in range(2000)]
    requests = spark.createDataFrame(
        rows, "log_id long, pos int, ref string, file_path string, language string, highlight_lines array<int>, center int"
    )
    cut = retrieval.cut_snippets(requests, code(spark), 2)
    assert cut.count() == 1
    got = retrieval.snippets(requests, cut).filter("log_id < 2").orderBy("log_id").collect()
    assert [r.marked_content.count(">>> ") for r in got] == [2, 2] and got[0].marked_content != got[1].marked_content


def test_reports_name_the_resolved_ref(spark):
    def factory():
        return lambda system, user, temperature, max_tokens: ("r", "m", {})

    own = logs(spark, TRACE, "no trace", "other").withColumn("ref", F.when(F.col("log_id") == 1, "v2").when(F.col("log_id") == 2, ""))
    reports = analyse(own, code(spark), factory, default_ref="main")
    assert {r.log_id: r.git_ref for r in reports.collect()} == {0: "main", 1: "v2", 2: "main"}


def test_coverage(spark):
    row = retrieval.retrieval_coverage(*found(spark, TRACE)).first()
    assert (row.found_files, row.requested_files, row.coverage) == (4, 5, 0.8)


def section(spark, budget):
    _, cut = found(spark, TRACE)
    return prompts.rca_prompts(parse_logs(logs(spark, TRACE, "no trace")), cut, budget).orderBy("log_id").collect()


def test_budget_keeps_a_prefix(spark):
    whole = section(spark, 12000)
    text = whole[0].user_prompt
    assert whole[0].found_files == 4 and "省略" not in text
    heads = [f"### 片段 {i}: `{p}`\n```python\n" for i, p in enumerate(["f0.py", "f1.py", "f2.py", "f4.py"], 1)]
    assert all(h in text for h in heads)
    body = text.split(V.CODE_SECTION_HEAD + "\n")[1].split("\n\n" + V.RCA_TASK)[0]
    sizes, at = [], 0
    for h, nxt in zip(heads, [*heads[1:], None]):
        end = body.index("\n" + nxt, at) if nxt else len(body)
        sizes.append(end - at)
        at = end + 1
    for kept in range(5):
        text = section(spark, sum(sizes[:kept]))[0].user_prompt
        assert text.count("### 片段") == kept
        assert ("*（剩余 %d 个文件因 Token 限制省略）*" % (4 - kept) in text) == (kept < 4)
    assert "相关源代码片段" not in whole[1].user_prompt and whole[1].found_files == 0


def test_long_logs_are_cut(spark):
    long = prompts_for(logs(spark, "字" * 3001, "字" * 3000), code(spark)).orderBy("log_id").collect()
    assert "字" * 2800 + "\n... [日志截断，已保留关键部分]\n```" in long[0].user_prompt and "字" * 2801 not in long[0].user_prompt
    assert "字" * 3000 + "\n```" in long[1].user_prompt
    assert long[1].prompt_chars == len(V.RCA_SYSTEM) + len(long[1].user_prompt)


def test_reports_keep_failures_apart(spark, tmp_path):
    def factory():
        def chat(system, user, temperature, max_tokens):
            assert system.startswith("你是一名资深的软件工程师") and (temperature, max_tokens) == (0.1, 2048)
            if "no trace" in user:
                raise TimeoutError("slow")
            return "## report", "m", {"prompt_eval_count": 7, "completion_tokens": 5}

        return chat

    reports = analyse(logs(spark, TRACE, "no trace"), code(spark), factory)
    rows = {r.log_id: r for r in prompts.with_token_usage(reports).collect()}
    assert (rows[0].status, rows[0].markdown, rows[0].found_files) == ("ok", "## report", 4)
    assert (rows[0].prompt_tokens, rows[0].completion_tokens) == (7, 5)
    assert (rows[1].status, rows[1].error, rows[1].prompt_tokens) == ("failed", "slow", None)
    assert prompts.completed(reports).count() == 1
    for _ in range(2):
        routing.write_reports(prompts.completed(reports), str(tmp_path), F.lit("nightly"))
    assert {r.value for r in spark.read.parquet(str(tmp_path)).collect()} == {"# 根因分析报告：nightly\n\n## report"}


def test_code_lines(spark):
    rows = code_lines(code(spark, 1)).orderBy("line_no").collect()
    assert len(rows) == 12 and rows[0].text == "line 0.1 | x" and rows[-1].line_no == 12
