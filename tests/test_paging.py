import base64
import json
from datetime import timedelta

from conftest import plan_of, utc
from pyspark.sql import functions as F

from tidelog.functions.cursors import Cursor, cursor_fields, cursor_token
from tidelog.operators import listing
from tidelog.operators.filters import LogFilter
from tidelog.operators.positions import with_positions


def crowded(spark, n=1003):
    """A third of the rows share one timestamp."""
    at = F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise((F.col("id") * 7919) % 100)
    return spark.range(n).select(
        "id",
        F.timestamp_seconds(F.lit(1_700_000_000) + at).alias("timestamp"),
        F.lit("info").alias("level"),
        F.lit("api").alias("service"),
        F.concat(F.lit("m"), "id").alias("message"),
        F.lit(None).cast("string").alias("attributes"),
    )


def brute_force(logs):
    rows = [(r["timestamp"], r["id"]) for r in logs.select("timestamp", "id").collect()]
    return sorted(rows, reverse=True)


def test_pages_join_to_the_whole_result(spark):
    logs = crowded(spark, 403)
    seen, token = [], None
    while True:
        cursor = Cursor.decode(token) if token else None
        page = listing.fetch_page(LogFilter(cursor=cursor).apply(logs), 50)
        seen += [int(r["id"]) for r in page.logs]
        token = page.next_cursor
        if token is None:
            break
    assert seen == [i for _, i in brute_force(logs)]


def test_no_cursor_when_the_page_holds_all(spark):
    logs = crowded(spark, 50)
    assert listing.fetch_page(logs, 50).next_cursor is None
    assert listing.fetch_page(logs, 49).next_cursor is not None
    assert listing.next_cursor(logs, 50).first()[0] is None
    assert listing.fetch_page(logs.limit(0), 5) == listing.Page([], None)


def test_entries_are_text(spark):
    entry = listing.fetch_page(crowded(spark, 1), 1).logs[0]
    assert entry == {
        "id": "0",
        "timestamp": "2023-11-14T22:21:40.000000Z",
        "level": "info",
        "service": "api",
        "message": "m0",
        "attributes": "{}",
    }


def test_page_index_against_brute_force(spark):
    logs = crowded(spark)
    rows = brute_force(logs)
    pages = listing.page_index(logs, 100).orderBy("page_no").collect()
    assert [p["page_no"] for p in pages] == list(range(11))
    for page in pages:
        chunk = rows[page["page_no"] * 100 : page["page_no"] * 100 + 100]
        assert page["rows"] == len(chunk)
        assert (page["first_timestamp"], page["first_id"]) == chunk[0]
        assert (page["last_timestamp"], page["last_id"]) == chunk[-1]


def test_positions_spread_a_crowded_key_over_partitions(spark):
    logs = crowded(spark, 20_000).select("timestamp", "id")
    placed = with_positions(logs, ("timestamp", False), ("id", False))
    found = placed.withColumn("part", F.spark_partition_id()).collect()
    order = sorted(found, key=lambda r: r["position"])
    assert [(r["timestamp"], r["id"]) for r in order] == brute_force(logs)
    assert [r["position"] for r in order] == list(range(20_000))
    assert {r["total"] for r in found} == {20_000}


def test_no_full_sort_for_a_page_and_no_single_task_for_the_index(spark):
    logs = crowded(spark)
    assert "TakeOrderedAndProject" in plan_of(listing.newest(logs, 100))
    plan = plan_of(listing.positioned(logs))
    # the only gathering is over one row per partition
    assert plan.count("Exchange SinglePartition") == 1
    assert plan.index("Exchange SinglePartition") < plan.index("partial_count(1)")


def test_export_is_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    logs = crowded(spark)
    listing.ordered(logs).select("timestamp", "id").write.parquet(path)
    files = sorted(str(f) for f in (tmp_path / "out").glob("part-*.parquet"))
    rows = [(r["timestamp"], r["id"]) for f in files for r in spark.read.parquet(f).collect()]
    assert rows == brute_force(logs)


def test_keyset_bound_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    crowded(spark, 10).write.parquet(path)
    cursor = Cursor(utc("2023-11-14 22:15:00"), 5)
    assert "LessThanOrEqual(timestamp" in plan_of(LogFilter(cursor=cursor).apply(spark.read.parquet(path)))


def test_tokens(spark):
    cursor = Cursor(utc("2026-07-20 14:32:01.000123"), 9007199254740993)
    token = cursor.encode()
    assert Cursor.decode(token) == cursor
    assert not set(token) & set("+/=\r\n")
    frame = spark.sql("SELECT TIMESTAMP '2026-07-20 14:32:01.000123' AS t, 9007199254740993 AS id")
    assert frame.select(cursor_token(F.col("t"), F.col("id"))).first()[0] == token


BAD_TOKENS = [
    "not-a-cursor",
    "",
    "e30",  # {}
    "bnVsbA",  # null
    "eyJ0aW1lc3RhbXAiOiIyMDI2LTAxLTAxVDAwOjAwOjAwWiJ9",  # no id
    "eyJ0aW1lc3RhbXAiOiJ4IiwiaWQiOiIxIn0",  # time "x"
    "eyJ0aW1lc3RhbXAiOiIyMDI2LTAxLTAxVDAwOjAwOjAwWiIsImlkIjoxfQ",  # id is a number
    "eyJ0aW1lc3RhbXAiOiIyMDI2LTAxLTAxVDAwOjAwOjAwWiIsImlkIjoiIn0",  # id ""
    "eyJ0aW1lc3RhbXAiOiIyMDI2LTAxLTAxVDAwOjAwOjAwWiIsImlkIjoiMS41In0",  # id "1.5"
    "a",
    "ÿ",
    Cursor(utc("2026-07-20 14:32:01"), 10**19).encode(),
    base64.urlsafe_b64encode(b'{"timestamp":"2026-01-01T00:00:00Z","id":"' + b"9" * 5000 + b'"}').decode(),
    base64.urlsafe_b64encode(b"[" * 100_000).decode(),
]


def test_bad_tokens(spark):
    assert [t for t in BAD_TOKENS if Cursor.decode(t) is not None] == []
    frame = spark.createDataFrame([(t,) for t in BAD_TOKENS], "token STRING")
    rows = frame.select("token", cursor_fields(F.col("token")).alias("c")).filter("c IS NOT NULL").collect()
    assert rows == []


def token_of(stamp, row_id="5"):
    return base64.urlsafe_b64encode(json.dumps({"timestamp": stamp, "id": row_id}).encode()).decode().rstrip("=")


STAMPS = [
    "2026-07-20T14:32:01Z",
    "2026-07-20T14:32:01.123456789Z",
    "2026-07-20T14:32:01+05:30",
    "2026-07-20T14:32:01-17:59",
    "0001-01-01T00:00:00Z",
    "9999-12-31T23:59:59.999999Z",
    "0001-01-01T00:00:00+05:00",
    "9999-12-31T23:59:59-05:00",
    "0000-06-01T00:00:00Z",
    "2026-02-30T00:00:00Z",
    "2026-07-20T24:00:00Z",
    "2026-07-20T14:32:01",
    "2026-07-20T14:32:01+18:30",
    "T12:30:00",
    "2024",
    "2024-01-01",
    "20240101T000000Z",
    "2026-07-20 14:32:01Z",
    "2026-07-20T14:32Z",
    " 2026-07-20T14:32:01Z",
    "2026-07-20T14:32:01Z\n",
    "",
]


def test_both_ways_of_decoding_agree(spark):
    tokens = [token_of(s) for s in STAMPS] + BAD_TOKENS + [token_of(STAMPS[0]) + "=", token_of(STAMPS[0], "-7"), "a b", "%%"]
    frame = spark.createDataFrame([(t,) for t in tokens], "token STRING")
    read = frame.select("token", cursor_fields(F.col("token")).alias("c"))
    rows = read.select("token", F.unix_micros("c.timestamp").alias("micros"), "c.id").collect()
    by_column = {r["token"]: (r["micros"], r["id"]) for r in rows}
    epoch = utc("1970-01-01 00:00:00")
    for token in tokens:
        found = Cursor.decode(token)
        expected = ((found.timestamp - epoch) // timedelta(microseconds=1), found.id) if found else (None, None)
        assert by_column[token] == expected, token
    assert sum(Cursor.decode(token_of(s)) is not None for s in STAMPS) == 6
