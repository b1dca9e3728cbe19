import json

import pytest
from conftest import plan_of, utc
from pyspark.sql import functions as F

from tidelog.functions.attributes import plain_number
from tidelog.functions.patterns import search_pattern
from tidelog.functions.times import bucket_start, iso_micros
from tidelog.operators.filters import PATTERN, LogFilter

DOCS = [
    {"k": "3"},
    {"k": 3},
    {"k": "3.0"},
    {"k": 3.5},
    {"k": True},
    {"k": "true"},
    {"k": None},
    {"k": {"k": 3}},
    {"k": [3]},
    {"other": 3},
    {"k.x": "dot", "k": {"x": "path"}},
    {"it's": "q1", 'say "hi"': "q2", "": "empty", "a'b\"c": "both"},
    {"k": ""},
    {"k": "ünï\n\"x\""},
]
TEXTS = [json.dumps(d) for d in DOCS] + [
    '{"k":3.000}',
    '{"k":3e0}',
    '{"k":12345678901234567890}',
    '{"k":12345678901234567891}',
    '{"k":1e-30}',
    '{"k":0}',
    '{"k":-0.0}',
    "not json",
    '{"\\u006b":"esc"}',
    '{"k":"\\u0065sc"}',
    '{"k": "e\\/sc"}',
]


def matching(spark, attrs, stored):
    frame = spark.createDataFrame(list(enumerate([*TEXTS, None])), "id INT, attributes STRING")
    if stored:
        frame = frame.withColumn("attributes", F.try_parse_json("attributes"))
    return [r["id"] for r in LogFilter(attrs=attrs).apply(frame).orderBy("id").collect()]


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize(
    "attrs, ids",
    [
        ({"k": "3"}, [0, 1, 14, 15]),
        ({"k": "3.0"}, [1, 2, 14, 15]),
        ({"k": "003"}, [1, 14, 15]),
        ({"k": "+3"}, []),
        ({"k": "3e0"}, []),
        ({"k": "3.5"}, [3]),
        ({"k": "true"}, [4, 5]),
        ({"k": "True"}, []),
        ({"k": "null"}, []),
        ({"k": ""}, [12]),
        ({"k": 'ünï\n"x"'}, [13]),
        ({"k.x": "dot"}, [10]),
        ({"k": "path"}, []),
        ({"it's": "q1"}, [11]),
        ({'say "hi"': "q2"}, [11]),
        ({"": "empty"}, [11]),
        ({"a'b\"c": "both"}, [11]),
        ({"k": "12345678901234567890"}, [16]),
        ({"k": "0"}, [19, 20]),
        ({"k": "-0.00"}, [19, 20]),
        ({"k": "9" * 400}, []),
        ({"it's": "q1", "": "empty"}, [11]),
        ({"it's": "q1", "k": "3"}, []),
        # escapes in the text
        ({"k": "esc"}, [22, 23]),
        ({"k": "e/sc"}, [24]),
    ],
)
def test_attribute_equality(spark, attrs, ids, stored):
    assert matching(spark, attrs, stored) == ids


@pytest.mark.parametrize(
    "token, text",
    [("007", "7"), ("3.10", "3.1"), ("-0", "0"), ("0.50", "0.5"), ("-00.5", "-0.5"), ("100", "100"), ("1" + "0" * 40, "1" + "0" * 40)],
)
def test_plain_number(token, text):
    assert plain_number(token) == text


MESSAGES = ["50% off", "50 percent", "a_b", "axb", "a\\b", "ab", "ends with a%", "ends with a\\", "PAYMENT Declined", "line\nbreak"]


@pytest.mark.parametrize(
    "q, mode, found",
    [
        ("50%", "contains", ["50% off"]),
        ("50%", PATTERN, ["50% off", "50 percent"]),
        ("a_b", "contains", ["a_b"]),
        ("a_b", PATTERN, ["a_b", "axb", "a\\b"]),
        (r"a\_b", PATTERN, ["a_b"]),
        (r"a\b", "contains", ["a\\b"]),
        (r"a\b", PATTERN, ["ab"]),
        ("a\\\\b", PATTERN, ["a\\b"]),
        ("with a\\", PATTERN, ["ends with a%"]),
        ("with a\\", "contains", ["ends with a\\"]),
        ("payment dec", "contains", ["PAYMENT Declined"]),
        ("PAY%DEC", PATTERN, ["PAYMENT Declined"]),
        ("line%break", PATTERN, ["line\nbreak"]),
        ("", "contains", MESSAGES),
    ],
)
def test_message_search(spark, q, mode, found):
    frame = spark.createDataFrame([(m,) for m in MESSAGES], "message STRING")
    rows = LogFilter(q=q, q_mode=mode).apply(frame).collect()
    assert sorted(r["message"] for r in rows) == sorted(found)


def test_search_pattern_never_ends_in_an_escape():
    assert search_pattern("a\\") == "%a\\%"
    assert search_pattern(r"\d\%") == r"%d\%%"


def test_unknown_mode_is_an_error(spark):
    with pytest.raises(ValueError):
        LogFilter(q="x", q_mode="regex").apply(spark.createDataFrame([("m",)], "message STRING"))


def test_empty_service_and_level_are_no_conditions(spark):
    frame = spark.createDataFrame([("a", "info")], "service STRING, level STRING")
    assert LogFilter(service="", level=None, q="").conditions(frame) == []


def test_buckets_floor_also_before_1970(spark):
    times = ["1969-12-31 23:59:30", "1970-01-01 00:04:59.999999", "2024-02-29 23:57:05.5"]
    frame = spark.sql("SELECT explode(array(%s)) AS t" % ", ".join(f"TIMESTAMP '{t}'" for t in times))
    starts = {b: [r[0] for r in frame.select(iso_micros(bucket_start(F.col("t"), b))).collect()] for b in ("1m", "5m", "1h", "1d")}
    assert [s[:16] for s in starts["1m"]] == ["1969-12-31T23:59", "1970-01-01T00:04", "2024-02-29T23:57"]
    assert [s[:16] for s in starts["5m"]] == ["1969-12-31T23:55", "1970-01-01T00:00", "2024-02-29T23:55"]
    assert [s[:16] for s in starts["1h"]] == ["1969-12-31T23:00", "1970-01-01T00:00", "2024-02-29T23:00"]
    assert [s[:16] for s in starts["1d"]] == ["1969-12-31T00:00", "1970-01-01T00:00", "2024-02-29T00:00"]
    with pytest.raises(ValueError):
        bucket_start(F.col("t"), "2h")


def test_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT TIMESTAMP '2024-01-05 10:00:00' AS timestamp, 1L AS id, DATE '2024-01-05' AS log_date").write.partitionBy(
        "log_date"
    ).parquet(path)
    where = LogFilter(since=utc("2024-01-05 00:00:00"), until=utc("2024-01-06 00:00:00"))
    plan = plan_of(where.apply(spark.read.parquet(path)))
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan
