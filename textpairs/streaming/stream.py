"""Structured Streaming forms.

* ``score_stream`` -- requests arrive as files; the stop word is filtered,
  the prompt built, rows scored (any P1 predictor), appended to a sink.
* ``stream_value_counts`` -- running counts of one column; every micro-batch
  writes the values that changed (update mode), ``latest_state`` reads the
  newest count of each.
* ``stream_ema`` -- running EMA per key with ``applyInPandasWithState``.  Rows
  of a key inside one micro-batch are sorted by the order columns before
  folding; rows arriving in a later micro-batch fold on arrival.  With an
  event-time column, a watermark drops what is too late and a key's state goes
  once the watermark has passed its last event by the idle time.

Update sinks are keyed by micro-batch: a batch that is replayed overwrites its
own ``batch_id`` folder.

All sinks and checkpoints live under the session's checkpoint folder.
``run_available_now`` drives a query to completion (``trigger(availableNow)``).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from textpairs.functions.text import nli_prompt, paraphrase_prompt
from textpairs.operators.score import score_batches
from textpairs.session import scratch_path

STOP_WORD = "exit"


def file_stream(spark: SparkSession, directory: str, schema: StructType, file_glob: str,
                fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """A file source over ``directory`` limited to files matching ``file_glob``."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", files_per_trigger)
            .load(directory))


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """A file source over one Parquet table, which is a single file or a folder of part files.

    The last letter stands in brackets: a path with a pattern takes a file as well as a folder.
    """
    folder = re.sub(r"([\\\[\]{}*?^])", r"\\\1", sf_dir.rstrip("/"))
    return (spark.readStream.format("parquet").schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .load(f"{folder}/{name}.parque[t]"))


def run_available_now(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def requests_to_prompts(stream: DataFrame, premise: str | None, hypothesis: str | None = None,
                        task: str = "mnli", dedupe_on: Sequence[str] = (),
                        event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """X1 front half: drop stop-word requests, build the prompt (NLI or paraphrase).

    With ``dedupe_on`` and ``event_time``, repeated requests inside the
    watermark delay are dropped (``dropDuplicatesWithinWatermark``); state is
    bounded by the delay.
    """
    if dedupe_on:
        if event_time is None:
            raise ValueError("de-duplication needs an event-time column for the watermark")
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(dedupe_on))
    if hypothesis is not None:
        keep = (F.col(premise) != STOP_WORD) & (F.col(hypothesis) != STOP_WORD)
        return stream.filter(keep).withColumn("prompt", nli_prompt(premise, hypothesis, task))
    return stream.filter(F.col(premise) != STOP_WORD).withColumn("prompt", paraphrase_prompt(premise))


def score_stream(stream: DataFrame, predictor_factory: Callable, sink: str, checkpoint: str,
                 keep: Sequence[str], out_type: str = "int") -> str:
    """Score a request stream into an append-only Parquet sink."""
    scored = score_batches(stream.select(*keep), predictor_factory, out="prediction", out_type=out_type)
    run_available_now(scored.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)
    return sink


def batch_writer(sink: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: one folder per micro-batch, overwritten when it is replayed."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))
    return write


def stream_value_counts(stream: DataFrame, col: str, sink: str, checkpoint: str) -> str:
    """Running counts of ``col``; each micro-batch writes the values whose count changed."""
    counts = stream.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    run_available_now(counts.writeStream.outputMode("update").foreachBatch(batch_writer(sink)), checkpoint)
    return sink


EMA_STATE = "ema double, n long"


def _ema_fold(alpha: float, order: Sequence[str], value: str, key: str, event_time: str | None, idle_ms: int):
    def fold(key_tuple, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(list(order), kind="mergesort")
        if state.exists:
            ema, n = state.get
        else:
            ema, n = None, 0
        for x in rows[value].astype(float).tolist():
            ema = x if n == 0 else alpha * x + (1.0 - alpha) * ema
            n += 1
        state.update((ema, n))
        if event_time is not None:
            last = int(rows[event_time].max().value // 1_000_000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: [key_tuple[0]], "ema": [ema], "n": [n]})
    return fold


def stream_ema(stream: DataFrame, key: str, order: Sequence[str], value: str, sink: str, checkpoint: str,
               alpha: float = 0.02, key_type: str = "long", event_time: str | None = None,
               delay: str = "10 minutes", idle_ms: int = 3_600_000) -> str:
    """Running EMA per key; every micro-batch writes (key, ema, n) of the keys it changed.

    ``event_time`` bounds the state: rows later than ``delay`` are dropped, and
    a key without an event for ``idle_ms`` of event time is forgotten.  Without
    it the state grows with the number of keys.
    """
    out_schema = f"{key} {key_type}, ema double, n long"
    timeout = GroupStateTimeout.NoTimeout
    if event_time is not None:
        stream, timeout = stream.withWatermark(event_time, delay), GroupStateTimeout.EventTimeTimeout
    updates = stream.groupBy(key).applyInPandasWithState(
        _ema_fold(alpha, order, value, key, event_time, idle_ms), out_schema, EMA_STATE, "update", timeout)
    run_available_now(updates.writeStream.outputMode("update").foreachBatch(batch_writer(sink)), checkpoint)
    return sink


def latest_state(spark: SparkSession, sink: str, key: str, cols: Sequence[str]) -> DataFrame:
    """Final state per key from an update log (the row of the highest batch)."""
    log = spark.read.parquet(sink)
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("batch_id"))
    return log.groupBy(key).agg(best.alias("_s")).select(key, "_s.*")


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch_path(spark, name)
    return os.path.join(base, "sink"), os.path.join(base, "checkpoint")
