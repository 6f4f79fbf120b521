"""Quality classifier: naive Bayes support vectors (operator 8).

A text is a set of hashed n-gram indicators: runs of 1 to 4 bytes, words and
word pairs, and one token for its length in words (to a power of two).  Each indicator is scaled by its log-count ratio between the two
classes, vectors are brought to length one, and a linear model with squared
hinge loss is fitted by dual coordinate descent (the two classes weigh alike).
The score is a logistic function of the margin, fitted on rows of the sample
that were set aside, weighted to the class counts of all learnable labels.

The model is fitted on a bounded sample of labelled rows: at most ``per_class``
of each class in the order of a hash of their ids, equal rows once, and at most
``MAX_INDICATORS`` indicators in all, whatever the number of rows of an id and
the length of its texts; rows whose crc32 of the id
modulo ``folds`` is ``held_out`` are never learnt from.  Every document is
scored on its whole text in Arrow batches, without a shuffle; the model is two
arrays of ``2**bits`` numbers, whatever the corpus.

Defined cases: a null text is scored like an empty one (the bias alone); a
label that is neither 0 nor 1 is ignored; repeated labels count once, and an id
labelled both ways counts as 0; without labels of both classes every score is
0.5; repeated rows give repeated results; an empty table gives an empty result.
Inputs of a score are the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from textpairs.llm.stored import stored
from textpairs.llm.words import word_hashes

#: Parameters.
BITS = 18
PER_CLASS = 4000
MAX_INDICATORS = 48_000_000  # of the sample: 12 bytes each in the task that fits
EPOCHS = 10
COST = 10.0
CALIBRATE = 5  # every fifth row of the sample calibrates the score and is not fitted on
SMOOTHING = 1.0
FOLDS = 3
HELD_OUT = 1

_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def held_out(id_col: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % folds == fold, F.lit(False))


def indicators(data: bytes, bits: int = BITS, scratch: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed n-gram numbers of UTF-8 text."""
    shift = np.uint32(32 - bits)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    parts, gram = [], np.zeros(len(b), np.uint32)
    for n in range(4):
        if len(b) <= n:
            break
        gram = (gram[:len(b) - n] if n else gram) * np.uint32(256) + b[n:]
        parts.append(((gram + np.uint32(n)) * np.uint32(_ODD[n]) ^ (gram >> np.uint32(15))) >> shift)
    words = data.split()
    w = word_hashes(words)
    if len(w):
        parts.append((w >> np.uint64(64 - bits)).astype(np.uint32))
        pair = (w[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ w[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        parts.append((pair >> np.uint64(64 - bits)).astype(np.uint32))
    # the document's length in words, to a power of two, stands beside its n-grams as one more token
    parts.append(np.array([xxh3_64_intdigest(b"\x00%d" % len(words).bit_length()) >> (64 - bits)], np.uint32))
    every = np.concatenate(parts).astype(np.int64)
    # the last writer of a number keeps it: distinct values without a sort
    last = np.empty(1 << bits, np.int64) if scratch is None else scratch
    order = np.arange(len(every))
    last[every] = order
    return every[last[every] == order]


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return (a * b).sum()  # short rows: a threaded BLAS call costs more than it saves


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, cost: float = COST,
        smoothing: float = SMOOTHING) -> tuple[np.ndarray, np.ndarray, float]:
    """``(ratio, weight, bias)``: log-count ratios and the model on scaled indicators."""
    size = 1 << bits
    n_good, n_bad = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    # smoothing in proportion to the class, so that an n-gram never seen has ratio 0
    mean = (n_good + n_bad) / 2
    good, bad = np.full(size, smoothing * n_good / mean), np.full(size, smoothing * n_bad / mean)
    for x, y in zip(rows, labels):
        (good if y else bad)[x] += 1
    ratio = np.log(good / n_good) - np.log(bad / n_bad)
    w, bias = np.zeros(size), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    # squared hinge loss: no upper bound on the duals, 1 / (2 C) on the diagonal
    diag = np.where(labels == 1, 1 / (2 * cost * len(labels) / (2 * n_good)), 1 / (2 * cost * len(labels) / (2 * n_bad)))
    alpha = np.zeros(len(rows))
    values = []
    for x in rows:
        v = ratio[x]
        values.append(v / max(np.sqrt(_dot(v, v)), 1e-9))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            x, v, y = rows[i], values[i], sign[i]
            slope = y * (_dot(w[x], v) + bias) - 1 + diag[i] * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            worst = max(worst, abs(slope))
            new = max(alpha[i] - slope / (2 + diag[i]), 0.0)
            step = (new - alpha[i]) * y
            w[x] += step * v  # the numbers of a row are distinct
            bias += step
            alpha[i] = new
        if worst < 1e-3:
            break
    return ratio, w, bias


def margin(x: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    v = ratio[x]
    return float(_dot(w[x], v) / max(np.sqrt(_dot(v, v)), 1e-9) + bias)


def calibrate(m: np.ndarray, labels: np.ndarray, n_bad: int, n_good: int) -> tuple[float, float]:
    """``(a, b)`` of the score 1 / (1 + exp(-(a m + b))): weighted logistic regression by Newton steps."""
    weight = np.where(labels == 1, n_good / max(1, labels.sum()), n_bad / max(1, (1 - labels).sum()))
    weight = weight / weight.sum() * len(m)
    x = np.stack([m, np.ones(len(m))], 1)
    ab = np.array([2.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 1e-2 * (ab - [2.0, 0.0])
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        ab = ab - np.linalg.solve(bend, slope)
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (2.0, 0.0)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from, one per id."""
    known = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("label").alias("label"))


def training_sample(docs: DataFrame, known: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, text, label)`` of the documents of at most ``per_class`` labelled ids of each class."""
    picked = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids: small by its parameter, so the documents are not shuffled
    return docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("doc_id", "text", "label")


def bounded_rows(rows: DataFrame, per_class: int = PER_CLASS, most: int = MAX_INDICATORS) -> DataFrame:
    """At most ``per_class`` rows of each class of ``rows(k, label, x, n)``, with at most ``most`` indicators in all.

    An id may have any number of rows: equal ones count once, and of the rest
    the first by hash are taken, a row that would pass half of ``most`` in its
    class ending it.  What decides is a table of keys and sizes.
    """
    one = stored(rows.groupBy("k", "label", F.xxhash64("x").alias("h")).agg(F.any_value("x").alias("x"), F.any_value("n").alias("n")),
                 "quality-rows")
    taken = []
    for y in (0, 1):
        keys = one.filter(F.col("label") == y).select("k", "h", "n").orderBy(F.xxhash64("k"), "k", "h").limit(per_class).collect()
        room = most // 2
        for r in keys:  # per_class keys at most
            if r["n"] > room and taken and taken[-1][1] == y:
                break
            taken.append((r["k"], y, r["h"]))
            room -= r["n"]
    chosen = rows.sparkSession.createDataFrame(taken, "k string, label int, h long")
    return one.join(F.broadcast(chosen), ["k", "label", "h"]).select("k", "label", "x")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS):
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, label)``; the model, or None without both classes."""
    present = learnable(labels).join(docs.select("doc_id").distinct(), "doc_id")
    counts = {r["label"]: r["n"] for r in present.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = counts.get(0, 0), counts.get(1, 0)
    if not n_bad or not n_good:
        return None
    sample = training_sample(docs, present, per_class).select(
        F.col("doc_id").cast("string").alias("k"), F.col("text").cast("binary").alias("t"),
        F.col("label").cast("int").alias("label"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.empty(1 << bits, np.int64)
        for b in batches:
            found = [np.sort(indicators(x.as_py() or b"", bits, scratch)).astype(np.int32).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary()),
                                              pa.array([len(x) // 4 for x in found], pa.int64())], names=["k", "label", "x", "n"])

    def learn(rows: pa.Table) -> pa.Table:
        # in the order of the ids, without a copy of the indicators
        order = pc.sort_indices(rows, sort_keys=[("k", "ascending"), ("x", "ascending")]).to_numpy()
        y = rows["label"].to_numpy()[order]
        x = [np.frombuffer(rows["x"][i].as_buffer(), np.int32) for i in order.tolist()]
        aside = np.zeros(len(y), bool)
        for c in (0, 1):
            aside[np.flatnonzero(y == c)[::CALIBRATE]] = (y == c).sum() >= 2 * CALIBRATE
        used = np.flatnonzero(~aside)
        ratio, w, bias = fit([x[i] for i in used], y[used], bits)
        if aside.any():
            m = np.array([margin(x[i], ratio, w, bias) for i in np.flatnonzero(aside)])
            a, b = calibrate(m, y[aside], n_bad, n_good)
        else:  # too few rows to set any aside
            a, b = 2.0, 0.0
        return pa.table({"ratio": [ratio.astype(np.float32).tobytes()], "w": [w.astype(np.float32).tobytes()],
                         "bias": [float(bias)], "a": [a], "b": [b]})

    # one task fits the model: 2 * per_class rows and MAX_INDICATORS numbers at most
    used = bounded_rows(sample.mapInArrow(read, "k string, label int, x binary, n long"), per_class)
    fitted = (used.withColumn("one", F.lit(1)).groupBy("one")
              .applyInArrow(lambda rows: learn(rows.select(["k", "label", "x"])),
                            "ratio binary, w binary, bias double, a double, b double"))
    model = fitted.first()
    return (np.frombuffer(model["ratio"], np.float32), np.frombuffer(model["w"], np.float32),
            model["bias"], model["a"], model["b"])


def _scores(texts: pa.Array, model, bits: int, scratch: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    ratio, w, bias, a, b = model
    m = np.array([margin(indicators(x.as_py() or b"", bits, scratch), ratio, w, bias) for x in texts], np.float64)
    return 1 / (1 + np.exp(-np.clip(a * m + b, -50, 50)))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.empty(1 << bits, np.int64)
        for b in batches:
            p = _scores(b.column(1), shared.value, bits, scratch)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double")


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int):
    return train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                 labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label")), per_class)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = score(docs, _labelled(docs, labels, label_col, per_class))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """The documents that the classifier predicts as 1, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(_labelled(docs, labels, label_col, per_class))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.empty(1 << BITS, np.int64)
        for b in batches:
            p = _scores(b.column(at).cast(pa.binary()), shared.value, BITS, scratch)
            yield b.filter(pa.array(p >= 0.5))

    return docs.mapInArrow(run, docs.schema)
