"""The quoted reader and the ordered stream hold and run bounded portions."""

import pyarrow as pa

from textpairs.plans import q_stream
from textpairs.plans.registry import QUERIES, load_all
from textpairs.sources import quoted as Q

load_all()


def test_runs_of_a_block_come_in_portions():
    n = 3 * Q.RUN_LINES + 5
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * n, "blk": [0] * n, "line": [str(k) for k in range(n)]})
    runs = list(Q._runs(iter([batch])))
    assert max(len(r[3]) for r in runs) <= Q.RUN_LINES
    assert [x for r in runs for x in r[3]] == [str(k) for k in range(n)]


def test_events_of_a_span_are_one_batch(spark, tmp_path, monkeypatch):
    """Files of a span do not follow the splits of the table: it has 12 files, and each span is one micro-batch."""
    seen = []
    run = q_stream.ST.file_stream

    def watch(s, directory, schema, glob, **k):
        files = s.read.format("binaryFile").load(directory).select("path").count()
        seen.append((files, k["files_per_trigger"]))
        return run(s, directory, schema, glob, **k)

    monkeypatch.setattr(q_stream.ST, "file_stream", watch)
    events = spark.range(400).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts",
                                         "id % 3 AS user_id", "'x' AS event_type", "double(id) AS value", "'{}' AS props")
    events.repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.n for r in QUERIES["stream_ema_ordered"](spark, str(tmp_path)).collect()}
    assert sum(got.values()) == 400 - 6 * 24
    (files, trigger), = seen
    assert trigger == 1 and files <= 5
