from pyspark.sql import functions as F

from faultline.operators import stacktrace as S

JAVA = """2024-02-01 10:00:00 error [pay-svc] Unhandled exception
java.lang.IllegalStateException: card is "gone" 
    at com.acme.pay.Processor.check(Processor.java:87)
    at com.acme.pay.Processor.batch(Processor.java:52)
    at com.acme.web.Outer.Inner.submit(Outer.java:134)
\tat com.acme.web.Outer$Nested.run(Outer.java:9)
    at com.acme.lower.run(lower.java:4)
    at sun.reflect.Native.invoke0(Native Method)
Caused by: java.io.IOException: late
内存: 72%"""
PYTHON = """2024-02-01 10:00:00 ERROR [etl] stage failed
Traceback (most recent call last):
  File "etl/transform.py", line 203, in normalize
    value = record["x"]
  File "etl/transform.py", line 178, in batch
    run()
  File "etl/run.py", line 89, in <module>
    main()
KeyError: 'profile'
ValueError: second"""
GO = """2024-02-01 10:00:00 CRITICAL [k8s] recovered
panic: first
panic: assignment to entry in nil map

goroutine 47 [running]:
runtime/debug.Stack(...)
    /usr/local/go/src/runtime/debug/stack.go:24
github.com/acme/op/ctl.(*Hook).handle(...)
    /home/go/src/op/ctl/hook.go:128 +0x2a4
    /home/go/src/op/ctl/orphan.go:1
main.run(0x1, 0x2)
some other line
    /home/go/src/op/main.go:67 +0x1b8"""
NODE = """WARN [web] call failed
TypeError: Cannot read: null
    at Object.<anonymous> (/app/src/handler.js:34:12)
    at /app/src/loop.js:7:3
    at async next (/app/node_modules/x/y.js:1:2)
    at tick (internal/process/task_queues.js:95:5)
RangeError: other"""
PLAIN = "nothing to see"


def parse(spark, *texts):
    logs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "log_id int, raw_log string")
    return S.parse_logs(logs)


def one(spark, text):
    return parse(spark, text).withColumn("summary", S.summary_text()).first()


def spots(row):
    return [(f.file_path, f.line_number, f.function_name) for f in row.frames]


def test_java(spark):
    row = one(spark, JAVA)
    assert (row.language, row.severity, row.service) == ("java", "ERROR", "pay-svc")
    assert (row.error_type, row.error_message) == ("java.lang.IllegalStateException", 'card is "gone"')
    assert spots(row) == [
        ("Processor.java", 87, "check"), ("Processor.java", 52, "batch"), ("Outer/Inner.java", 134, "submit"),
        ("Outer$Nested.java", 9, "run"), ("com/acme/lower.java", 4, "run"),
    ]
    assert row.frames[0].class_name == "com.acme.pay.Processor"
    assert row.frames[3].raw == "\tat com.acme.web.Outer$Nested.run(Outer.java:9)"


def test_python(spark):
    row = one(spark, PYTHON)
    assert (row.language, row.error_type, row.error_message) == ("python", "KeyError", "'profile'")
    assert spots(row) == [("etl/transform.py", 203, "normalize"), ("etl/transform.py", 178, "batch"), ("etl/run.py", 89, "<module>")]
    assert row.summary == (
        "服务: etl\n级别: ERROR\n错误: KeyError: 'profile'\n涉及文件数: 2\n最顶层报错: etl/transform.py:203 in normalize()"
    )


def test_go(spark):
    row = one(spark, GO)
    assert (row.language, row.severity, row.error_type) == ("go", "CRITICAL", "panic")
    assert row.error_message == "assignment to entry in nil map"
    assert spots(row) == [("home/go/src/op/ctl/hook.go", 128, ""), ("home/go/src/op/main.go", 67, "run")]
    assert row.frames[0].class_name == "github.com/acme/op/ctl."


def test_node(spark):
    row = one(spark, NODE)
    assert (row.language, row.error_type, row.error_message) == ("node", "TypeError", "Cannot read: null")
    assert spots(row) == [("app/src/handler.js", 34, "Object.<anonymous>"), ("app/src/loop.js", 7, "<anonymous>")]


def test_plain_text_and_blanks(spark):
    row = one(spark, PLAIN)
    assert (row.language, row.severity, row.service, row.error_type, row.frames) == ("unknown", "ERROR", "", "", [])
    assert row.summary == "服务: 未知\n级别: ERROR\n错误: 未知: \n涉及文件数: 0"


def test_error_on_the_header_line_is_not_found(spark):
    text = "ERROR [a] java.lang.OutOfMemoryError: heap\n    at a.B.c(B.java:3)"
    assert one(spark, text).error_type == ""


def test_windows_line_ends_and_other_breaks(spark):
    assert len(one(spark, JAVA.replace("\n", "\r\n")).frames) == 5
    # The language is told by a line that a newline leads in; then any break ends a line.
    head, frames = JAVA.split("    at ", 1)
    for brk in ("\r", "\x0b", "\x1e", "\x85", "\u2028"):
        assert len(one(spark, head + "    at " + frames.replace("\n", brk)).frames) == 5


def test_frame_table_and_files(spark):
    parsed = parse(spark, JAVA, PLAIN, PYTHON)
    frames = S.frame_table(parsed).orderBy("log_id", "pos").collect()
    assert [(f.log_id, f.pos) for f in frames] == [(0, i) for i in range(5)] + [(2, i) for i in range(3)]
    files = parsed.select("log_id", S.unique_files(F.col("frames")).alias("f")).orderBy("log_id").collect()
    assert files[0].f == ["Processor.java", "Outer/Inner.java", "Outer$Nested.java", "com/acme/lower.java"]
    assert files[1].f == [] and files[2].f == ["etl/transform.py", "etl/run.py"]
