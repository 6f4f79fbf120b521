"""Registered queries: streaming forms (X1-X3) and the Python-worker jobs
(Q1, Q3, Q4, P1).  Streaming builders run their stream to completion
(availableNow) and return the sink as a batch DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from textpairs.operators import score as S
from textpairs.operators import tokens as TK
from textpairs.plans import bridge as B
from textpairs.plans.registry import register
from textpairs.session import scratch_path
from textpairs.streaming import stream as ST
from textpairs.streaming.ordered import stream_ema_ordered

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Part files of a table that a micro-batch reads.
FILES_A_BATCH, EVERY_FILE = 64, 1 << 30


#: Fixed values of the stream demo: a linear head over (characters, spaces, letters e) of the prompt.
PROMPT_WEIGHTS = [[1, -6, 0], [0, 1, -2], [-1, 4, 3]]


class PromptModel:
    """Predictor of the stream demo: first argmax of a linear head over counts of the prompt."""

    def __init__(self):
        import numpy as np

        self.w = np.asarray(PROMPT_WEIGHTS, dtype="int64")

    def __call__(self, pdf):
        import numpy as np

        x = np.stack([pdf["prompt"].str.len(), pdf["prompt"].str.count(" "), pdf["prompt"].str.count("e")], 1)
        return (x.astype("int64") @ self.w.T).argmax(axis=1).astype("int32")


def prompt_model():
    return PromptModel()


_PROMPT_LOGITS = ", ".join(
    f"({a} * length(prompt) + {b} * (length(prompt) - length(replace(prompt, ' ', '')))"
    f" + {c} * (length(prompt) - length(replace(prompt, 'e', ''))))" for a, b, c in PROMPT_WEIGHTS)


class LinearHeadModel:
    """P1 predictor: the bridge linear head in numpy, built once per worker."""

    def __init__(self):
        import numpy as np

        self.w = np.asarray(B.head_weights(), dtype="float64")

    def __call__(self, pdf):
        import numpy as np

        x = np.stack([np.asarray(v, dtype="float64") for v in pdf["embedding"]])
        return (x @ self.w.T).argmax(axis=1).astype("int32")


def linear_head_model():
    return LinearHeadModel()


@register("stream_scoring", sql=f"""
    SELECT doc_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS prediction FROM (
        SELECT pairID AS doc_id, [{_PROMPT_LOGITS}] AS l FROM (
            SELECT pairID, 'mnli hypothesis: ' || sentence2 || ' premise: ' || sentence1 AS prompt FROM v_nli
            WHERE sentence1 <> 'exit' AND sentence2 <> 'exit'))""")
def q_stream_scoring(spark, sf_dir):
    src = ST.table_stream(spark, sf_dir, "documents", DOCS_SCHEMA, FILES_A_BATCH)
    lines = src.select("doc_id", F.split("text", "\n").alias("_l"))
    req = lines.select(F.col("doc_id").cast("string").alias("doc_id"),
                       B.head_lines(F.col("_l")).alias("premise"), B.last_line(F.col("_l")).alias("hypothesis"))
    prompts = ST.requests_to_prompts(req, "premise", "hypothesis")
    sink, ckpt = ST.fresh_paths(spark, "stream_scoring")
    ST.score_stream(prompts, prompt_model, sink, ckpt, keep=["doc_id", "prompt"], out_type="int")
    return spark.read.parquet(sink).select("doc_id", F.col("prediction").cast("long").alias("prediction"))


@register("stream_value_counts", sql="""
    SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type""")
def q_stream_value_counts(spark, sf_dir):
    src = ST.table_stream(spark, sf_dir, "events", EVENTS_SCHEMA, FILES_A_BATCH)
    sink, ckpt = ST.fresh_paths(spark, "stream_value_counts")
    ST.stream_value_counts(src, "event_type", sink, ckpt)
    return ST.latest_state(spark, sink, "value", ["n"])


@register("stream_ema", sql="""
    SELECT user_id, round(pow(0.98, step + 1) * x0 + 0.02 * pow(0.98, step) * s, 6) AS ema, step + 1 AS n
    FROM (SELECT user_id, step, first_value(value) OVER w AS x0,
                 sum(value * pow(0.98, -step)) OVER (w ROWS UNBOUNDED PRECEDING) AS s,
                 count(*) OVER (PARTITION BY user_id) AS cnt
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE step = cnt - 1""")
def q_stream_ema(spark, sf_dir):
    # rows are in order within a micro-batch only, and part files of a table are in no order
    src = ST.table_stream(spark, sf_dir, "events", EVENTS_SCHEMA, EVERY_FILE)
    sink, ckpt = ST.fresh_paths(spark, "stream_ema")
    ST.stream_ema(src.select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value",
                  sink, ckpt, alpha=0.02)
    final = ST.latest_state(spark, sink, "user_id", ["ema", "n"])
    return final.select("user_id", F.round("ema", 6).alias("ema"), "n")


#: Arrival of events in the ordered stream: up to a day late, in files of five days; the delay covers both.
LATE_DAYS, FILE_DAYS, DELAY_DAYS = 1, 5, 6

#: Events that a file of the ordered stream holds.
FILE_ROWS = 1_000_000


@register("stream_ema_ordered", sql=f"""
    SELECT user_id, round(pow(0.98, step + 1) * x0 + 0.02 * pow(0.98, step) * s, 6) AS ema, step + 1 AS n
    FROM (SELECT user_id, step, first_value(value) OVER w AS x0,
                 sum(value * pow(0.98, -step)) OVER (w ROWS UNBOUNDED PRECEDING) AS s,
                 count(*) OVER (PARTITION BY user_id) AS cnt
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events
                WHERE epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - {DELAY_DAYS} * 86400000000)
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE step = cnt - 1""")
def q_stream_ema_ordered(spark, sf_dir):
    """Events that arrive up to a day late, in files by arrival; the final state is the batch EMA up to the watermark."""
    events = B.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    late = F.pmod(F.xxhash64("event_id"), F.lit(LATE_DAYS * 86_400_000_000))
    span = FILE_DAYS * 86_400_000_000
    events = events.withColumn("file_no", F.call_function("div", F.unix_micros("ts") + late, F.lit(span)))
    base = scratch_path(spark, "arrivals")
    src, dealt, rows = os.path.join(base, "in"), os.path.join(base, "dealt"), events.drop("file_no").schema
    # the table is read once and dealt by span; a span is read from its own folder and is one micro-batch
    events.filter("file_no is not null").write.partitionBy("file_no").parquet(dealt)
    spans = {r.file_no: r.n for r in events.groupBy("file_no").agg(F.count(F.lit(1)).alias("n")).collect() if r.file_no is not None}
    files = max(-(-max(spans.values(), default=1) // FILE_ROWS), 1)
    for no in sorted(spans):  # one write a file span: the file source reads in order of writing
        span = spark.read.schema(rows).parquet(os.path.join(dealt, f"file_no={no}"))
        span.repartition(files).write.mode("append").parquet(src)
    if not spans:
        spark.createDataFrame([], rows).write.parquet(src)
    stream = ST.file_stream(spark, src, "user_id long, ts timestamp, event_id long, value double", "*.parquet", files_per_trigger=files)
    sink, ckpt = ST.fresh_paths(spark, "stream_ema_ordered")
    stream_ema_ordered(stream, "user_id", "ts", "event_id", "value", sink, ckpt, alpha=0.02, delay=f"{DELAY_DAYS} days")
    final = ST.latest_state(spark, sink, "user_id", ["ema", "n"])
    return final.select("user_id", F.round("ema", 6).alias("ema"), "n")


@register("score_batches", sql="""
    SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS prediction FROM v_logits""")
def q_score_batches(spark, sf_dir):
    emb = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return S.score_batches(emb, linear_head_model, keep=["vec_id", "embedding"]).select("vec_id", "prediction")


@register("tokenise_corpus")
def q_tokenise_corpus(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    t = TK.tokenise_corpus(docs, ["text"])
    return t.select("doc_id", F.size("text_ids").cast("long").alias("n_ids"))


@register("decode_corpus")
def q_decode_corpus(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    t = TK.tokenise_corpus(docs, ["text"]).select("doc_id", "text_ids")
    return TK.decode_corpus(t, "text_ids", out="decoded").select("doc_id", "decoded")


@register("roundtrip_audit")
def q_roundtrip_audit(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("text")
    return TK.roundtrip_audit(docs, "text")
