"""Event-time order on a stream: late rows inside the delay give the batch EMA."""

import os
import random

import numpy as np
import pandas as pd
import pytest

from textpairs.streaming import ordered as O
from textpairs.streaming import stream as ST


def write_files(folder, batches):
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        at = os.path.join(folder, f"p{i:03d}.parquet")
        pd.DataFrame(rows, columns=["k", "ts", "event_id", "v"]).astype(
            {"k": "int64", "event_id": "int64", "v": "float64"}).assign(
            ts=lambda d: pd.to_datetime(d["ts"], unit="us", utc=True)).to_parquet(at, coerce_timestamps="us")
        os.utime(at, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))


def run(spark, tmp_dir, batches, delay, alpha=0.1):
    src = os.path.join(tmp_dir, "in")
    write_files(src, batches)
    stream = ST.file_stream(spark, src, "k long, ts timestamp, event_id long, v double", "*.parquet")
    sink = O.stream_ema_ordered(stream, "k", "ts", "event_id", "v", os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ck"),
                                alpha=alpha, delay=delay)
    return {r.k: (r.ema, r.n) for r in ST.latest_state(spark, sink, "k", ["ema", "n"]).collect()}


def batch_ema(rows, alpha=0.1):
    out = {}
    for k in {r[0] for r in rows}:
        own = [r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        out[k] = (O.fold(np.array(own), 0.0, 0, alpha)[0], len(own))
    return out


START = 1_704_067_200_000_000  # 2024-01-01 in microseconds
MINUTE = 60_000_000


def test_late_rows_inside_the_delay_take_their_place(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(O, "PORTION", 7)
    rng = random.Random(3)
    rows = [(k, START + rng.randrange(600) * MINUTE // 10, i, float(rng.randrange(100))) for i, k in enumerate(
        rng.choice([1, 1, 1, 2, 3]) for _ in range(300))]
    # arrival up to 9 minutes after the event; ties in time are common
    arriving = sorted(rows, key=lambda r: r[1] + rng.randrange(9) * MINUTE)
    batches = [arriving[i:i + 40] for i in range(0, len(arriving), 40)]
    got = run(spark, tmp_dir, batches, "10 minutes")
    upto = max(r[1] for r in rows) - 10 * MINUTE
    want = batch_ema([r for r in rows if r[1] <= upto])
    assert set(got) == set(want)
    for k in want:
        assert got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0])
    assert sum(n for _, n in got.values()) > 200
    folded_on_arrival = batch_ema([(k, i, 0, v) for i, (k, t, _, v) in enumerate(arriving) if t <= upto])
    assert any(folded_on_arrival[k][0] != pytest.approx(got[k][0]) for k in got)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_dir):
    at = lambda m: START + m * MINUTE
    batches = [[(1, at(0), 0, 10.0), (1, at(1), 1, 20.0)], [(1, at(30), 2, 30.0)], [(1, at(31), 3, 40.0)],
               [(1, at(2), 4, 1000.0), (1, at(29), 5, 50.0)], [(1, at(60), 6, 0.0)]]
    got = run(spark, tmp_dir, batches, "10 minutes", alpha=0.5)
    # event 4 is 29 minutes late; event 5 is 2 minutes late and goes before 2 and 3
    assert got == {1: (batch_ema([(1, 0, 0, 10.0), (1, 1, 0, 20.0), (1, 2, 0, 50.0), (1, 3, 0, 30.0), (1, 4, 0, 40.0)], 0.5)[1][0], 5)}


def test_incomplete_rows_are_left_out(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    ts = pd.to_datetime([START, None, START + MINUTE, START + 100 * MINUTE], unit="us", utc=True)
    pd.DataFrame({"k": [1, 1, 1, 2], "ts": ts, "event_id": [1, 2, 3, 4], "v": [5.0, 6.0, None, 0.0]}).to_parquet(
        os.path.join(src, "p.parquet"), coerce_timestamps="us")
    stream = ST.file_stream(spark, src, "k long, ts timestamp, event_id long, v double", "*.parquet")
    sink = O.stream_ema_ordered(stream, "k", "ts", "event_id", "v", os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ck"))
    assert {r.k: (r.ema, r.n) for r in ST.latest_state(spark, sink, "k", ["ema", "n"]).collect()} == {1: (5.0, 1)}
