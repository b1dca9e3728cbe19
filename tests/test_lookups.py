"""Equality on the stored table: hashes of attributes beside the rows, dictionaries and Bloom filters in the files."""

import json

import pytest
from conftest import NOW
from pyspark.sql import functions as F
from test_log_table import rows_read

from tidelog.functions.attributes import attr_equals
from tidelog.functions.lookups import column_name, could_equal, stored_hash
from tidelog.operators.filters import LogFilter
from tidelog.sources.envelopes import stream_envelopes
from tidelog.sources.log_table import LogTable
from tidelog.streaming.ingest_stream import start_ingest

COUNT = 200_000
SMALL = {"parquet.block.size": str(1 << 20), "parquet.dictionary.page.size": str(32 << 10)}


def requests(spark, count=COUNT):
    return spark.range(0, count, 1, 1).select(
        F.timestamp_micros(F.lit(1_784_332_800_000_000) + F.col("id")).alias("timestamp"),
        F.lit("info").alias("level"),
        F.concat(F.lit("service-"), F.md5(F.col("id").cast("string"))).alias("service"),
        F.lit("m").alias("message"),
        F.try_parse_json(F.concat(F.lit('{"request.id":"r'), F.xxhash64("id"), F.lit('","n":'), F.col("id"), F.lit("}"))).alias(
            "attributes"
        ),
    )


def append_small(spark, table, logs, number=0):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in SMALL.items():
        conf.set(name, value)
    try:
        table.append(logs, "s", number)
    finally:
        for name in SMALL:
            conf.unset(name)


def bloom_filters(spark, path, column):
    """Row groups of the files below a path, and those with a Bloom filter of the column."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = [r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()]
    groups = filtered = 0
    for name in files:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        for block in reader.getFooter().getBlocks():
            groups += 1
            filtered += any(c.getPath().toDotString() == column and c.getBloomFilterOffset() > 0 for c in block.getColumns())
        reader.close()
    return groups, filtered


def test_an_absent_value_reads_no_rows(spark, tmp_path):
    plain, kept = LogTable(spark, str(tmp_path / "plain")), LogTable(spark, str(tmp_path / "kept"), lookups=["request.id", "n"])
    logs = requests(spark)
    for table in (plain, kept):
        append_small(spark, table, logs)
    for column in (column_name("request.id"), column_name("n"), "service"):
        groups, filtered = bloom_filters(spark, f"{tmp_path}/kept/rows", column)
        assert groups == filtered > 3
    absent, there = LogFilter(attrs={"request.id": "r-none"}), logs.limit(70_000).offset(69_999).select(
        F.try_variant_get("attributes", "$['request.id']", "string")
    )
    assert rows_read(plain.rows(absent)) == COUNT
    reader = LogTable(spark, str(tmp_path / "kept"))  # names no attributes
    assert rows_read(reader.rows(absent)) == 0 and reader.rows(absent).count() == 0
    present = LogFilter(attrs={"request.id": there.first()[0], "n": "69999.0"})
    assert reader.rows(present).count() == plain.rows(present).count() == 1
    assert rows_read(reader.rows(present)) < COUNT / 2
    # the hashed service names lie between the least and the greatest of every row group
    assert rows_read(reader.rows(LogFilter(service="service-8"))) < COUNT / 2


def test_hashes_lose_no_match(spark):
    stored = ['"3"', "3", "3.0", "3.50", "3e0", "-0.0", "0", "0.0", "-0e0", "true", '"true"', "null", '""', "[1]", '{"a":1}', "1e400",
              "123456789012345678901234567890", '"é"', '" "', "100", "1e2", "0.1", "1e-1"]
    docs = spark.createDataFrame([(i, f'{{"a.b":{s}}}') for i, s in enumerate(stored)] + [(99, "{}"), (100, None)], "i int, t string")
    docs = docs.select("i", F.try_parse_json("t").alias("doc"))
    hashed = docs.withColumn(column_name("a.b"), stored_hash(F.col("doc"), "a.b"))
    for value in ("3", "3.0", "003.500", "-0", "0.0", "true", "false", "", "é", " ", "100", "1e2", "0.10", "9" * 400,
                  "123456789012345678901234567890.0", "null", "[1]"):
        equal = attr_equals(F.col("doc"), "a.b", value)
        both = hashed.filter(equal).select("i", F.coalesce(could_equal("a.b", value), F.lit(False)).alias("found")).collect()
        assert all(r["found"] for r in both), (value, both)


@pytest.mark.parametrize("compacted", [False, True])
def test_old_and_new_batches_together(spark, tmp_path, compacted):
    path = str(tmp_path / "logs")
    logs = requests(spark, 40)
    LogTable(spark, path).append(logs, "s", 0)
    LogTable(spark, path, lookups=["n"]).append(logs, "s", 1)
    LogTable(spark, path, lookups=["n", "absent"]).append(logs, "s", 2)
    if compacted:
        LogTable(spark, path, lookups=["n"]).compact()
    found = LogTable(spark, path)
    assert found.rows(LogFilter(attrs={"n": "7"})).count() == 3
    assert found.rows(LogFilter(attrs={"n": "7", "absent": "x"})).count() == 0
    assert found.rows(LogFilter(attrs={"n": "7", "request.id": "x"})).count() == 0
    assert len(found.page(LogFilter(attrs={"n": "7"}), 2).logs) == 2
    assert found.rows().count() == 120 and found.audit_content().count() == 0


def test_streams_keep_hashes(spark, tmp_path):
    entries = [{"timestamp": "2026-07-18T10:00:00Z", "level": "info", "service": "a", "message": "m", "attributes": {"k": i}} for i in range(9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text(json.dumps({"logs": [*entries, {"level": 1}]}))
    bodies = stream_envelopes(spark, str(tmp_path / "in"))
    start_ingest(bodies, str(tmp_path / "t"), str(tmp_path / "c"), clock=lambda: NOW, lookups=["k"]).awaitTermination()
    table = LogTable(spark, str(tmp_path / "t"))
    assert table.commits()[0].lookups == ("k",)
    assert [r["attributes"].toPython()["k"] for r in table.rows(LogFilter(attrs={"k": "5"})).collect()] == [5]
    assert table.rejects().count() == 1
