import json
import shutil

from conftest import NOW
from pyspark.sql import functions as F

from tidelog.sources.envelopes import read_envelopes, stream_envelopes
from tidelog.sources.log_table import LogTable
from tidelog.streaming.ingest_stream import start_ingest


def write(folder, name, *times):
    entries = [{"timestamp": t, "level": "info", "service": "api", "message": "m"} for t in times]
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"logs": entries}, indent=1))


def drain(spark, folder, table, checkpoint, **options):
    bodies = stream_envelopes(spark, str(folder), **options)
    query = start_ingest(bodies, str(table), str(checkpoint), clock=lambda: NOW)
    query.awaitTermination()
    return query


def test_one_file_is_one_envelope_and_batches_add_up(spark, tmp_path):
    inbox, path, checkpoint = tmp_path / "in", tmp_path / "table", tmp_path / "check"
    for i in range(5):
        write(inbox, f"{i}.json", f"2026-07-18T10:0{i}:00Z", "2026-07-18T10:00:30Z", "bad")
    drain(spark, inbox, path, checkpoint, max_files=2)
    table = LogTable(spark, str(path))
    assert [(c.number, c.accepted, c.rejected) for c in table.commits()] == [(0, 4, 2), (1, 4, 2), (2, 2, 1)]
    # a late row adds to its old minute, equal rows stay apart
    write(inbox, "late.json", "2026-07-18T10:00:00Z", "2020-01-01T00:00:00Z")
    drain(spark, inbox, path, checkpoint)
    found = {str(r["time_bucket"]): r["log_count"] for r in table.rollup().collect()}
    assert found["2026-07-18 10:00:00"] == 7
    assert found["2020-01-01 00:00:00"] == 1
    assert table.rows().count() == 12
    assert table.rejects().select("batch_key").distinct().count() == 5


def test_batch_that_was_stored_but_not_recorded_comes_again_without_effect(spark, tmp_path):
    inbox, path, checkpoint = tmp_path / "in", tmp_path / "table", tmp_path / "check"
    write(inbox, "a.json", "2026-07-18T10:00:00Z")
    drain(spark, inbox, path, checkpoint)
    # the stream lost its record of the finished batch: it runs batch 0 again
    shutil.rmtree(checkpoint / "commits")
    drain(spark, inbox, path, checkpoint)
    table = LogTable(spark, str(path))
    assert table.rows().count() == 1
    assert table.rollup().agg(F.sum("log_count")).first()[0] == 1
    assert len(table.commits()) == 1


def test_lines(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.txt").write_text('{"logs":[]}\n{"logs":[1]}\n\n')
    rows = read_envelopes(spark, str(folder), whole_files=False).collect()
    assert sorted(r["body"] for r in rows) == ["", '{"logs":[1]}', '{"logs":[]}']
    assert len({r["batch_key"] for r in rows}) == 3
    whole = read_envelopes(spark, str(folder)).collect()
    assert len(whole) == 1 and whole[0]["batch_key"].endswith("a.txt")


def test_new_checkpoint_and_second_stream_add_their_rows(spark, tmp_path):
    path = tmp_path / "table"
    for name in ("one", "two"):
        write(tmp_path / f"in-{name}", "a.json", "2026-07-18T10:00:00Z")
        drain(spark, tmp_path / f"in-{name}", path, tmp_path / f"check-{name}")
    drain(spark, tmp_path / "in-one", path, tmp_path / "check-new")
    drain(spark, tmp_path / "in-one", path, tmp_path / "check-new")
    assert LogTable(spark, str(path)).rows().count() == 3
