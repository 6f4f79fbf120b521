"""Running EMA in event-time order (X3): rows wait for the watermark and are folded in order.

``stream_ema`` folds rows as they arrive; here a row that comes late, but
within the watermark delay, takes its place in time.  Rows are held in the
state, with a timeout on the earliest of them; once the watermark has passed it,
all rows up to the watermark are sorted and folded.  What is held is what arrived
within the delay.  Rows behind the watermark are dropped by the engine, so the
result is the batch EMA over all rows that came in time, up to the watermark.

A call of the worker costs about as much for one row as for thousands, so keys
share it: state and timeout are those of one of ``BUCKETS`` groups of keys, dealt
by hash.  Rows are held in blocks of up to ``PORTION`` of them, and the averages
of a group of keys are one block, all as Arrow bytes.

The state is kept in the RocksDB state store, which is set for the query.  A
partition of it is opened and written anew by each micro-batch, so there are no
more than two a core, whatever the session's number of shuffle partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegralType

from textpairs.streaming.stream import batch_writer, run_available_now

PORTION = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups of keys that share state; null keys are a group of their own.
BUCKETS, NO_KEY = 256, -1

#: Blocks of rows, the earliest ``at`` among them, and the averages so far.
STATE = "held array<binary>, least long, folded binary"
ROW = ["key", "at", "tie", "value"]


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(block).read_pandas()


def fold(values: np.ndarray, ema: float, n: int, alpha: float) -> tuple[float, int]:
    for x in values.tolist():
        ema = x if n == 0 else alpha * x + (1.0 - alpha) * ema
        n += 1
    return ema, n


def folded_up(rows: pd.DataFrame, folded: bytes | None, alpha: float) -> tuple[pd.DataFrame, bytes]:
    """Folds rows in order onto the averages so far: ``(key, ema, n)`` of the rows' keys, and the averages of all keys."""
    before = unpacked(folded) if folded else pd.DataFrame({"key": rows["key"][:0], "ema": np.zeros(0), "n": np.zeros(0, np.int64)})
    # the code of a key is its place in the averages; new keys follow
    codes, keys = pd.factorize(pd.concat([before["key"], rows["key"]], ignore_index=True) if len(before) else rows["key"])
    ema, n = (np.concatenate([before[c].to_numpy(), np.zeros(len(keys) - len(before), before[c].dtype)]) for c in ("ema", "n"))
    codes = codes[len(before):]
    at, tie, value = (rows[c].to_numpy() for c in ROW[1:])
    order = np.lexsort((value, tie, at, codes))
    codes, value = codes[order], value[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]):
        k = codes[a]
        ema[k], n[k] = fold(value[a:b], float(ema[k]), int(n[k]), alpha)
    after = pd.DataFrame({"key": keys, "ema": ema, "n": n})
    return after.iloc[codes[starts]], packed(after)


def _ordered_fold(alpha: float):
    """Input rows ``(bucket, key, at, tie, value)``: ``at`` in microseconds; output ``(bucket, key, ema, n)`` of keys whose rows were folded."""
    def blocks(rows: pd.DataFrame) -> list[bytes]:
        return [packed(rows.iloc[k:k + PORTION]) for k in range(0, len(rows), PORTION)]

    def step(bucket, pdfs, state):
        held, least, folded = state.get if state.exists else ([], None, None)
        new = [] if state.hasTimedOut else [pdf[ROW] for pdf in pdfs if len(pdf)]
        watermark = state.getCurrentWatermarkMs()
        first = [int(pdf["at"].min()) for pdf in new]
        least = min([*first, *([] if least is None else [least])], default=None)
        if least is not None and least <= watermark * 1000:
            rows = pd.concat([*(unpacked(b) for b in held), *new], ignore_index=True)
            due = rows["at"].to_numpy() <= watermark * 1000
            done, folded = folded_up(rows[due], folded, alpha)
            rest = rows[~due]
            held, least = blocks(rest), int(rest["at"].min()) if len(rest) else None
            # a worker pads its output with nulls, which makes whole numbers doubles
            yield done.assign(bucket=bucket[0], key=done["key"].astype(str))[["bucket", "key", "ema", "n"]]
        elif new:
            held = [*held, *blocks(pd.concat(new, ignore_index=True))]
        state.update((held, least, folded))
        if least is not None:  # runs out once the watermark is over it: the row is due at its first millisecond that is not before the row
            state.setTimeoutTimestamp(max(-(-least // 1000) - 1, watermark, 1))
    return step


def stream_ema_ordered(stream: DataFrame, key: str, event_time: str, tie: str, value: str, sink: str, checkpoint: str,
                       alpha: float = 0.02, delay: str = "10 minutes", key_type: str = "long") -> str:
    """X3 in event-time order; every micro-batch writes (key, ema, n) of the keys whose rows it folded.

    ``event_time`` is a timestamp, ``tie`` a whole number that orders rows of one
    instant; rows without either, or without a value, are left out.
    """
    spark = stream.sparkSession
    rows = stream.filter(F.col(event_time).isNotNull() & F.col(tie).isNotNull() & F.col(value).isNotNull())
    # a column with nulls would become one of doubles in a worker
    kind, none = ("long", 0) if isinstance(stream.schema[key].dataType, IntegralType) else ("string", "")
    rows = rows.withWatermark(event_time, delay).select(
        F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int").alias("bucket"),
        F.coalesce(F.col(key).cast(kind), F.lit(none)).alias("key"), event_time,
        F.unix_micros(event_time).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    updates = rows.groupBy("bucket").applyInPandasWithState(
        _ordered_fold(alpha), "bucket int, key string, ema double, n long", STATE, "update", GroupStateTimeout.EventTimeTimeout)
    updates = updates.select(F.when(F.col("bucket") != NO_KEY, F.col("key")).cast(key_type).alias(key), "ema", "n")
    before = {k: spark.conf.get(k) for k in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKS_DB)
    spark.conf.set(PARTITIONS, min(int(before[PARTITIONS]), 2 * spark.sparkContext.defaultParallelism))
    try:
        run_available_now(updates.writeStream.outputMode("update").foreachBatch(batch_writer(sink)), checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return sink
