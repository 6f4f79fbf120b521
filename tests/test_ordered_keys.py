"""The ordered stream keeps state by groups of keys: many keys cost few worker calls, and each has its own average."""

import os

import pandas as pd
import pytest

from textpairs.streaming import ordered as O
from textpairs.streaming import stream as ST

START, MINUTE = 1_704_067_200_000_000, 60_000_000


def run(spark, tmp_dir, batches, key_type):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for i, rows in enumerate(batches):
        at = os.path.join(src, f"p{i}.parquet")
        k, ts, event_id, v = zip(*rows)
        pd.DataFrame({"k": pd.array(k, dtype="Int64" if key_type == "long" else "object"), "ts": pd.to_datetime(ts, unit="us", utc=True),
                      "event_id": event_id, "v": v}).to_parquet(at, coerce_timestamps="us")
        os.utime(at, (1_700_000_000 + 60 * i,) * 2)
    stream = ST.file_stream(spark, src, f"k {key_type}, ts timestamp, event_id long, v double", "*.parquet")
    sink, ckpt = os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ck")
    O.stream_ema_ordered(stream, "k", "ts", "event_id", "v", sink, ckpt, alpha=0.5, key_type=key_type)
    return {r.k: (r.ema, r.n) for r in ST.latest_state(spark, sink, "k", ["ema", "n"]).collect()}, ckpt


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_keys_share_state(spark, tmp_dir, kind):
    """3,000 keys were 3,000 states with calls of their own; null keys are a key, and a large key keeps its digits."""
    keys = [2**60 + 1 + k for k in range(2999)] if kind == "long" else [f"k{k}" for k in range(2998)] + [""]
    keys = [*keys, None]
    first = [(k, START + 2 * MINUTE, i, 8.0) for i, k in enumerate(keys)]
    late = [(k, START + MINUTE, 5000 + i, 4.0) for i, k in enumerate(keys) if i % 3 == 0 or k is None]
    end = [(keys[0], START + 90 * MINUTE, 9999, 0.0)]
    partitions = spark.conf.get(O.PARTITIONS)
    spark.conf.set(O.PARTITIONS, "64")
    try:
        got, ckpt = run(spark, tmp_dir, [first, late, end], kind)
        assert spark.conf.get(O.PARTITIONS) == "64"
    finally:
        spark.conf.set(O.PARTITIONS, partitions)
    assert got == {k: (6.0, 2) if i % 3 == 0 or k is None else (8.0, 1) for i, k in enumerate(keys)}
    assert len(os.listdir(os.path.join(ckpt, "state", "0"))) <= 2 * spark.sparkContext.defaultParallelism + 1
    states = spark.read.format("statestore").load(ckpt)
    assert 0 < states.count() <= O.BUCKETS + 1
