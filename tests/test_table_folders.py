"""Streams over tables that are a single file or a folder of part files."""

import datetime

import pytest

from textpairs.plans.registry import QUERIES, load_all

load_all()


@pytest.mark.parametrize("parts", [1, 3])
def test_scoring_reads_a_table_of_part_files(spark, tmp_path, parts):
    rows = [(i, f"one two {'e' * i}\nlast line", "en", "web", 10) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["stream_scoring"](spark, str(tmp_path)).collect()
    assert sorted(int(r.doc_id) for r in got) == list(range(9))


def test_counts_and_averages_read_a_table_of_part_files(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(hours=i), i % 2, "click" if i % 3 else "view", float(i), "{}") for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    counts = {r.value: r.n for r in QUERIES["stream_value_counts"](spark, str(tmp_path)).collect()}
    assert counts == {"click": 8, "view": 4}
    got = {r.user_id: (r.ema, r.n) for r in QUERIES["stream_ema"](spark, str(tmp_path)).collect()}
    for user in (0, 1):
        ema = None
        for x in range(user, 12, 2):
            ema = float(x) if ema is None else 0.02 * x + 0.98 * ema
        assert got[user] == (pytest.approx(ema, abs=1e-6), 6)
