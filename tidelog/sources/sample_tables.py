"""Log views over the ``events`` table.

The SQL text of these views means the same in Spark and in other engines, so that
reference queries can use it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import prepare

LOGS_SQL = """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS timestamp,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'click' THEN 'debug' ELSE 'info' END AS level,
 CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'storefront' WHEN 1 THEN 'identity' WHEN 2 THEN 'ledger' WHEN 3 THEN 'gateway' ELSE 'jobs' END AS service,
 CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'voucher refused' WHEN 1 THEN 'query answered' WHEN 2 THEN 'job queued again'
   WHEN 3 THEN 'lookup without a hit' WHEN 4 THEN 'session opened' ELSE 'shelf counted' END AS message,
 props AS attributes
FROM events
"""

# Many rows share a timestamp here, so that the id decides their order.
LOGS_TIES_SQL = LOGS_SQL.replace(
    "CAST(ts AS TIMESTAMP) AS timestamp", "CAST(date_trunc('day', ts) AS TIMESTAMP) AS timestamp"
)

LOGS_ATTR_SQL = """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS timestamp, user_id,
 '{"account":"' || CAST(user_id AS VARCHAR(20)) || '","dock":"'
 || CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'harbour' WHEN 1 THEN 'lagoon' ELSE 'estuary' END
 || '","attempts":' || CAST(event_id % 5 AS VARCHAR(20))
 || ',"canary":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '"true"' END
 || ',"mixed":' || CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '3' WHEN 1 THEN '"3"' ELSE '3.0' END || '}' AS attributes
FROM events
"""

# Attribute values of every JSON type under one key, by event_id % 8.
LOGS_FLAGS_SQL = """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS timestamp,
 '{"flag":' || CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '"true"' WHEN 3 THEN '"false"'
   WHEN 4 THEN '1' WHEN 5 THEN '"1"' WHEN 6 THEN '"False"' ELSE '1.5' END || ',"other":false}' AS attributes
FROM events
"""

# One entry for every rule, chosen by ``kind`` (0..19): ``t`` is the time as text without a zone,
# ``body`` the other fields of a valid entry, ``props`` its attributes.
ENTRY_CASES_SQL = """
CASE kind
 WHEN 0 THEN 'null'
 WHEN 1 THEN '[1]'
 WHEN 2 THEN '{' || body || '}'
 WHEN 3 THEN '{"timestamp":1,' || body || '}'
 WHEN 4 THEN '{"timestamp":"' || t || '",' || body || '}'
 WHEN 5 THEN '{"timestamp":"2024-13-01T00:00:00Z",' || body || '}'
 WHEN 7 THEN '{"timestamp":"' || t || 'Z","level":"critical","service":"","message":"m"}'
 WHEN 8 THEN '{"timestamp":"' || t || 'Z","service":"auth","message":"m"}'
 WHEN 9 THEN '{"timestamp":"' || t || 'Z","level":"info","service":"","message":"m"}'
 WHEN 10 THEN '{"timestamp":"' || t || 'Z","level":"info","service":7,"message":"m"}'
 WHEN 11 THEN '{"timestamp":"' || t || 'Z","level":"info","service":"auth","message":""}'
 WHEN 12 THEN '{"timestamp":"' || t || 'Z",' || body || ',"attributes":[1]}'
 WHEN 13 THEN '{"timestamp":"' || t || 'Z",' || body || ',"attributes":{"a":{"b":1}}}'
 WHEN 14 THEN '{"timestamp":"' || t || 'Z",' || body || ',"attributes":null}'
 WHEN 15 THEN '{"timestamp":"' || t || 'Z",' || body || '}'
 WHEN 16 THEN '{"timestamp":"' || t || 'Z",' || body || ',"attributes":{"a":null}}'
 ELSE '{"timestamp":"' || t || 'Z",' || body || ',"attributes":' || props || '}'
END
"""

_BODY = "'\"level\":\"info\",\"service\":\"auth\",\"message\":\"m\"'"
_TIME_TEXT = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"

# Every event as one entry of a batch of 100.
RAW_ENTRIES_SQL = f"""
SELECT event_id, CAST(event_id AS BIGINT) DIV 100 AS batch_key, CAST(event_id % 100 AS INT) AS index,
 {ENTRY_CASES_SQL} AS entry
FROM (SELECT event_id, ts, props, CAST(event_id % 20 AS INT) AS kind, {_BODY} AS body, {_TIME_TEXT} AS t FROM events)
"""

# Every event as one envelope with 1 to 4 entries, of which entry i has kind (event_id + 5 i) % 20;
# some envelopes are unreadable, of the wrong shape, empty or over the size limit.
ENVELOPE_BODY_LIMIT = 2048

_ENTRY_I = ENTRY_CASES_SQL.replace("CASE kind", "CASE CAST((event_id + 5 * i) % 20 AS INT)")
_ENTRIES = f"array_join(transform(sequence(0, CAST(event_id % 4 AS INT)), i -> {_ENTRY_I}), ',')"

ENVELOPES_SQL = f"""
SELECT batch_key, event_id,
 CASE CAST(event_id % 50 AS INT)
  WHEN 3 THEN '{{"logs":{{"a":1}}}}'
  WHEN 11 THEN ''
  WHEN 17 THEN '{{"logs":[]}}'
  WHEN 23 THEN '{{"nope":true}}'
  WHEN 29 THEN '{{"logs":[' || entries || ']'
  WHEN 31 THEN '{{"logs":[' || entries || ']}} x'
  WHEN 37 THEN rpad('{{"logs":[]}}', 3000, ' ')
  ELSE '{{"logs":[' || entries || ']}}'
 END AS body
FROM (
 SELECT event_id, CAST(event_id AS STRING) AS batch_key, {_ENTRIES} AS entries
 FROM (SELECT event_id, ts, props, {_BODY} AS body, {_TIME_TEXT} AS t FROM events)
)
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    read_table(spark, sf_dir, "events").createOrReplaceTempView("tidelog_events")
    return spark.sql(sql.replace("FROM events", "FROM tidelog_events"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, LOGS_SQL)


def logs_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, LOGS_TIES_SQL)


def logs_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, LOGS_ATTR_SQL)


def logs_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, LOGS_FLAGS_SQL)


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, RAW_ENTRIES_SQL).withColumn("entry", F.try_parse_json("entry"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, ENVELOPES_SQL)
