"""Rules, their order, and the edge cases of single entries and bodies."""

import json
from datetime import timedelta

import pytest
from conftest import NOW, utc
from pyspark.sql import functions as F

from tidelog.functions import validation as V
from tidelog.operators import ingest

GOOD = {"timestamp": "2026-07-20T11:00:00Z", "level": "info", "service": "auth", "message": "m"}


def entry(**changes):
    made = {**GOOD, **changes}
    return json.dumps({k: v for k, v in made.items() if v is not ...}, ensure_ascii=False)


CASES = [
    (entry(), None),
    ("null", V.BAD_TIMESTAMP),
    ("7", V.BAD_TIMESTAMP),
    ('"text"', V.BAD_TIMESTAMP),
    ("[1]", V.BAD_TIMESTAMP),
    ("{}", V.BAD_TIMESTAMP),
    (entry(timestamp=...), V.BAD_TIMESTAMP),
    (entry(timestamp=None), V.BAD_TIMESTAMP),
    (entry(timestamp=1), V.BAD_TIMESTAMP),
    (entry(timestamp=True), V.BAD_TIMESTAMP),
    (entry(timestamp=["2026-07-20T11:00:00Z"]), V.BAD_TIMESTAMP),
    (entry(timestamp="2026-07-20T11:00:00"), V.BAD_TIMESTAMP),
    (entry(timestamp="2026-07-20 11:00:00Z"), V.BAD_TIMESTAMP),
    (entry(timestamp="2026-07-20"), V.BAD_TIMESTAMP),
    (entry(timestamp="2026-07-20T11:00:00z"), V.BAD_TIMESTAMP),
    (entry(timestamp="2026-07-20T11:00:00Z\n"), V.BAD_TIMESTAMP),
    (entry(timestamp="2026-07-20T11:00:00.Z"), V.BAD_TIMESTAMP),
    (entry(timestamp="2026-07-20T11:00:00+0530"), V.BAD_TIMESTAMP),
    (entry(timestamp="2026-07-20T11:00:00+05:30"), None),
    (entry(timestamp="2026-07-20T11:00:00.1234567Z"), None),
    # 24 characters with the punctuation in place get past the shape test
    (entry(timestamp="2026-07-20T11:00:01.12xZ"), V.BAD_DATE),
    (entry(timestamp="abcd-ef-ghTij:kl:mn.opqZ"), V.BAD_DATE),
    (entry(timestamp="2026-13-01T00:00:00Z"), V.BAD_DATE),
    (entry(timestamp="2026-02-30T00:00:00Z"), V.BAD_DATE),
    (entry(timestamp="2026-07-20T11:00:60Z"), V.BAD_DATE),
    (entry(timestamp="2026-07-20T11:00:00+19:00"), V.BAD_DATE),
    (entry(timestamp="2026-07-20T11:00:00+99:99"), V.BAD_DATE),
    (entry(timestamp="2026-07-19T24:00:00Z"), None),
    (entry(timestamp="2026-07-19T24:00:00.000+02:00"), None),
    (entry(timestamp="2026-07-19T24:00:01Z"), V.BAD_DATE),
    (entry(timestamp="2026-07-19T24:01:00Z"), V.BAD_DATE),
    (entry(timestamp="1969-12-31T23:59:59.999Z"), None),
    # exactly five minutes ahead is accepted, also with a fraction below the millisecond
    (entry(timestamp="2026-07-20T12:05:00Z"), None),
    (entry(timestamp="2026-07-20T12:05:00.000999Z"), None),
    (entry(timestamp="2026-07-20T12:05:00.001Z"), V.IN_FUTURE),
    (entry(timestamp="2026-07-20T14:05:00.001+02:00"), V.IN_FUTURE),
    (entry(timestamp="2026-07-20T13:00:00Z", level="x"), V.IN_FUTURE),
    (entry(level="critical", service=""), V.BAD_LEVEL),
    (entry(level="INFO"), V.BAD_LEVEL),
    (entry(level=...), V.BAD_LEVEL),
    (entry(level=None), V.BAD_LEVEL),
    (entry(level=["info"]), V.BAD_LEVEL),
    (entry(service="", message=""), V.BAD_SERVICE),
    (entry(service=7), V.BAD_SERVICE),
    (entry(service=None), V.BAD_SERVICE),
    (entry(service={"a": 1}), V.BAD_SERVICE),
    (entry(service="  "), None),
    (entry(service="s" * 300), None),
    (entry(message=""), V.BAD_MESSAGE),
    (entry(message=False), V.BAD_MESSAGE),
    (entry(message=..., attributes=[1]), V.BAD_MESSAGE),
    (entry(message=" "), None),
    (entry(attributes=None), None),
    (entry(attributes={}), None),
    (entry(attributes={"a": "x", "b": 1, "c": 1.5, "d": True}), None),
    (entry(attributes={"a: VOID, b": 1, "": 2, "OBJECT<": "ARRAY"}), None),
    (entry(attributes=[1]), V.BAD_ATTRIBUTES),
    (entry(attributes="text"), V.BAD_ATTRIBUTES),
    (entry(attributes=1), V.BAD_ATTRIBUTES),
    (entry(attributes=False), V.BAD_ATTRIBUTES),
    (entry(attributes={"a": None}), V.BAD_ATTRIBUTE_VALUE),
    (entry(attributes={"a": 1, "b": {"c": 1}}), V.BAD_ATTRIBUTE_VALUE),
    (entry(attributes={"a": []}), V.BAD_ATTRIBUTE_VALUE),
    (entry(extra={"deep": [1]}), None),
]


def judged(spark, entries, **options):
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "n INT, entry STRING")
    parsed = frame.withColumn("entry", F.try_parse_json("entry"))
    rows = ingest.validate_entries(parsed, NOW, **options).orderBy("n")
    return rows.withColumn("attributes", F.to_json("attributes")).drop("entry").collect()


def test_reasons(spark):
    found = [r["reason"] for r in judged(spark, [e for e, _ in CASES])]
    wrong = [(e, want, got) for (e, want), got in zip(CASES, found) if want != got]
    assert not wrong


def test_report_judges_like_the_rows(spark):
    body = '{"logs":[' + ",".join(e for e, _ in CASES) + "]}"
    opened = ingest.open_envelopes(spark.createDataFrame([("b", body)], "batch_key STRING, body STRING"))
    report = ingest.envelope_report(opened, NOW).first()
    wanted = [(i, reason) for i, (_, reason) in enumerate(CASES) if reason]
    assert [(r["index"], r["reason"]) for r in report["rejected"]] == wanted
    assert (report["status"], report["accepted"]) == ("ok", len(CASES) - len(wanted))


def test_stored_values(spark):
    rows = judged(
        spark,
        [
            entry(timestamp="2026-07-20T11:00:00.1234567+05:30"),
            entry(timestamp="2026-02-28T24:00:00Z", attributes=None),
            '{"timestamp":"2026-07-20T11:00:00Z","level":"warn","level":"error","service":"a","message":"m",'
            '"attributes":{"n":12345678901234567890,"z":3.10,"k":1,"k":2}}',
        ],
    )
    assert rows[0]["timestamp"].replace(tzinfo=NOW.tzinfo) == utc("2026-07-20 05:30:00.123456")
    assert rows[1]["timestamp"].replace(tzinfo=NOW.tzinfo) == utc("2026-03-01 00:00:00")
    assert [r["attributes"] for r in rows[:2]] == ["{}", "{}"]
    # the last of repeated keys counts; numbers keep all their digits
    assert rows[2]["level"] == "error"
    assert rows[2]["attributes"] == '{"k":2,"n":12345678901234567890,"z":3.1}'


def test_service_length_rule(spark):
    rows = judged(spark, [entry(service="s" * 256), entry(service="s" * 255)], max_service_len=255)
    assert [r["reason"] for r in rows] == [V.SERVICE_TOO_LONG.format(limit=255), None]


@pytest.mark.parametrize(
    "body, problem",
    [
        ("", V.BODY_SHAPE),
        (None, V.BODY_SHAPE),
        ("{not-json", V.BODY_NOT_JSON),
        ("   ", V.BODY_NOT_JSON),
        ('{"logs":[]} trailing', V.BODY_NOT_JSON),
        ('{"logs":[]},{"logs":[]}', V.BODY_NOT_JSON),
        ('{"logs":[]}] [', V.BODY_NOT_JSON),
        ('{"logs":[1]', V.BODY_NOT_JSON),
        ("null", V.BODY_SHAPE),
        ("[]", V.BODY_SHAPE),
        ('{"nope":true}', V.BODY_SHAPE),
        ('{"logs":{"a":1}}', V.BODY_SHAPE),
        ('{"logs":null}', V.BODY_SHAPE),
        ('{"logs":[]}', None),
        (' {"logs" : [ ] , "more": 1} ', None),
        ('{"logs":[' + " " * V.MAX_BODY_BYTES + "]}", V.BODY_TOO_LARGE),
        ('{"logs":[]}' + " " * (V.MAX_BODY_BYTES - 11), None),
        ('{"logs":["' + "é" * (V.MAX_BODY_BYTES // 2) + '"]}', V.BODY_TOO_LARGE),
    ],
)
def test_bodies(spark, body, problem):
    opened = ingest.open_envelopes(spark.createDataFrame([("b", body)], "batch_key STRING, body STRING"))
    report = ingest.envelope_report(opened, NOW).first()
    assert report["error"] == problem
    assert report["status"] == ("refused" if problem else "rejected")
    assert (report["accepted"], report["rejected"]) == (0, [])


def test_entries_are_parsed_once_below_a_filter(spark):
    envelopes = spark.createDataFrame([("b", "x")], "batch_key STRING, body STRING")
    validated = ingest.validate_entries(ingest.explode_entries(ingest.open_envelopes(envelopes)), NOW)
    plan = ingest.accepted(validated)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert plan.count("as struct<timestamp:string") == 1


def test_late_by_days_is_fine(spark):
    old = entry(timestamp=(NOW - timedelta(days=400)).strftime("%Y-%m-%dT%H:%M:%SZ"))
    assert judged(spark, [old])[0]["reason"] is None
