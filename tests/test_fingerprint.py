"""Fingerprints against Python's own regular expressions, on hostile texts."""

import hashlib
import re

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline import fixed_values as V
from faultline.functions.fingerprint import error_type, file_location, normalized, with_fingerprint

PIECES = [
    "2024-01-15 03:22:18", "2024-01-15T03:22:18.123+08:00", "2024-01-15T03:22:18Z", "10.0.0.1", "10.0.0.1:8080",
    "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "deadbeefdeadbeefdeadbeef", '"id12345"', '"a1234b"', "12345", "1234",
    "出现128450条", "x12345", "batch_2024_a", "batch_é1", "request_id= 77", "request_id:abc", "²12345", "१२३४५",
    "java.lang.NullPointerException", "Error:", "KeyError:", "MyError", "a.b$C.FooThrowable", "panic:", "panic: x",
    "runtime error: index out of range, y", "src/a/b.py:12", "com.google.x", "x.json:5", "App.java:99", "é/ñ.go:7",
    'File "app/mod.py", line 3', "áError", "tab\there", " ", " ", "\x1c", "\r\n", "\n", "  ", "ErrorError",
    "Exception", "..Exception", "/.py", "-.ts:1",
]


def expected(text):
    error = next((m.group(1) for p in V.ERROR_TYPE_PATTERNS if (m := re.search(p, text))), "")
    spot = re.search(V.FILE_LOCATION_PATTERN, text)
    place = ""
    if spot:
        place = spot.group(1).rsplit("/", 1)[-1] + (f":{spot.group(2)}" if spot.group(2) else "")
    plain = text
    for pattern in V.NOISE_PATTERNS:
        plain = re.sub(pattern, V.NOISE_MARK, plain)
    plain = re.sub(r"\s+", " ", plain).strip()
    if error and place:
        key = f"{error}@{place}"
    else:
        key = f"{error}:{plain[:80]}" if error else plain[:120]
    return error, place, plain, hashlib.md5(key.encode()).hexdigest()[:12]


def actual(spark, texts):
    text = F.col("raw_log")
    logs = spark.createDataFrame(list(enumerate(texts)), "log_id int, raw_log string")
    rows = with_fingerprint(logs).select(
        "log_id", error_type(text).alias("e"), file_location(text).alias("f"), normalized(text).alias("n"), "fingerprint"
    )
    return [tuple(r)[1:] for r in sorted(rows.collect())]


texts = st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=9).map("".join) | st.lists(
    st.sampled_from(PIECES), max_size=9
).map(" ".join)


@settings(max_examples=10, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(texts.filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t)), min_size=60, max_size=120))
def test_random_texts(spark, batch):
    for text, got in zip(batch, actual(spark, batch)):
        assert got == expected(text), ascii(text)


def test_known_quirks(spark):
    cases = {
        "see com.google.common": "com.go",
        "read x.json now": "x.js",
        'File "app/mod.py", line 3': "mod.py",
        "at App.java:99 and b.py:1": "App.java:99",
    }
    assert [row[1] for row in actual(spark, list(cases))] == list(cases.values())
