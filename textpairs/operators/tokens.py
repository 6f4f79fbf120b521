"""Tokenisation to id arrays (Q1-Q4) and the vocabulary-table twin (Q2).

Q1/Q3 run a SentencePiece model inside Python workers through
``mapInPandas``: the model file travels with ``SparkContext.addFile`` and is
loaded once per worker process; batches are turned in slices of up to 1,024
rows (the reference's tokenisation batch) and of bounded length, text by text.  Text is tokenised where it lies -- no
shuffle of raw text.  Q2 is the same contract as pure DataFrame work
(explode, join to the vocabulary table, re-collect per row) so downstream
operators have a SQL oracle.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textpairs.operators.lookup import ids_in_order, lookup_words, other_words, packed

# Special ids of the 32k piece model (unk, bos, eos); the
# reserved id range of the vocabulary twin ends below 259.
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2
PAD_ID = 0

#: Where the public 32k piece model lies; another path is given as ``model_path``.
MODEL_PATH = os.environ.get("TEXTPAIRS_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


_PROCESSORS: dict[str, object] = {}


def _processor(ref: str):
    """One SentencePiece processor per worker process and model."""
    sp = _PROCESSORS.get(ref)
    if sp is None:
        import sentencepiece as spm

        path = ref if os.path.isabs(ref) and os.path.exists(ref) else SparkFiles.get(os.path.basename(ref))
        sp = spm.SentencePieceProcessor(model_file=path)
        _PROCESSORS[ref] = sp
    return sp


def ship_model(spark: SparkSession, path: str) -> str:
    """Distribute the model file to every executor; returns the reference to pass to tasks."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def prompt_ids(text: str, model_path: str | None = None, add_eos: bool = True) -> list[int]:
    """Ids of a prompt text (driver side, a few tokens)."""
    path = model_path or MODEL_PATH
    ids = list(_processor(path).encode(text))
    return ids + [EOS_ID] if add_eos else ids


#: Rows, and characters or ids, that a worker turns at once: batches of long texts come out in slices.
SLICE_ROWS, SLICE_ITEMS = 1024, 1 << 20


def _slices(sizes: Sequence[int | None]) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of consecutive rows with up to ``SLICE_ROWS`` rows and ``SLICE_ITEMS`` items (or one row)."""
    start = total = 0
    for k, n in enumerate(sizes):
        n = n or 0
        if k > start and (k - start >= SLICE_ROWS or total + n > SLICE_ITEMS):
            yield start, k - start
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def tokenise_corpus(df: DataFrame, cols: Sequence[str], model_path: str | None = None,
                    add_eos: bool = True, suffix: str = "_ids") -> DataFrame:
    """Q1: ``<col>_ids array<int>`` for each text column, end token appended,
    no truncation.  A null text gives a null array."""
    spark = df.sparkSession
    path = model_path or MODEL_PATH
    ref = ship_model(spark, path)
    cols = list(cols)
    fields = list(df.schema.fields) + [StructField(c + suffix, ArrayType(IntegerType()), True) for c in cols]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = _processor(ref)

        def ids_of(text: str | None) -> np.ndarray | None:
            if not isinstance(text, str):
                return None
            ids = sp.encode(text)
            return np.array(ids + [EOS_ID] if add_eos else ids, np.int32)

        for pdf in batches:
            sizes = [sum(len(t) for t in row if isinstance(t, str)) for row in zip(*(pdf[c] for c in cols))]
            for at, n in _slices(sizes):
                part = pdf.iloc[at:at + n].copy()
                for c in cols:
                    part[c + suffix] = pd.Series([ids_of(t) for t in part[c]], index=part.index, dtype=object)
                yield part

    return df.mapInPandas(run, StructType(fields))


def decode_corpus(df: DataFrame, col: str, model_path: str | None = None, out: str | None = None) -> DataFrame:
    """Q3: id arrays back to text; control ids (unk/bos/eos) are skipped."""
    spark = df.sparkSession
    path = model_path or MODEL_PATH
    ref = ship_model(spark, path)
    out = out or f"{col}_text"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = _processor(ref)
        control = np.array([i for i in range(sp.vocab_size()) if sp.is_control(i)], np.int64)

        def text_of(ids: np.ndarray | None) -> str | None:
            return None if ids is None else sp.decode(ids[~np.isin(ids, control)].tolist())

        for pdf in batches:
            for at, n in _slices([0 if v is None else len(v) for v in pdf[col]]):
                part = pdf.iloc[at:at + n].copy()
                part[out] = pd.Series([text_of(v) for v in part[col]], index=part.index, dtype=object)
                yield part

    return df.mapInPandas(run, StructType(list(df.schema.fields) + [StructField(out, StringType(), True)]))


def tokenise_vocab(df: DataFrame, keys: Sequence[str], cols: Sequence[str], vocab: DataFrame,
                   add_eos: bool = True, unk: int = UNK_ID, eos: int = EOS_ID,
                   suffix: str = "_ids", carry: Sequence[str] = ()) -> DataFrame:
    """Q2: split on single spaces, look each word up in ``vocab(word, id)``
    (unknown -> unk), append the end token; one array per text column.

    Words are exploded for all columns together.  Frequent words (low ids) meet
    the vocabulary in a broadcast join, the others in a shuffled one, and the
    ids are re-collected per key, position and id in one long.  A null text gives a
    null array; every input key is kept.  ``carry`` columns (small, functionally
    dependent on the keys, e.g. a label) ride through the regroup, so no join
    back to the input is needed.
    """
    keys, cols, carry = list(keys), list(cols), list(carry)
    # one pass over the input: the text columns are stacked by an explode of an
    # array of (column number, text) structs, not by a union of re-reads
    stacked = df.select(*keys, *carry, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_tp_c"), F.col(c).alias("_tp_t")) for i, c in enumerate(cols)])))
    # a null text explodes to one (null, null) marker row, so every key survives
    words = stacked.select(
        *keys, *carry, "_tp_c", F.posexplode_outer(F.split(F.col("_tp_t"), " ")).alias("_tp_p", "word"))
    v = vocab.select("word", "id", F.col("id").alias("_tp_id"))
    j = lookup_words(words, v, other_words(v, v).select("word", "_tp_id"), "_tp_id")
    entry = packed(F.col("_tp_p"), F.coalesce(F.col("_tp_id"), F.lit(unk)))
    of_column = [F.col("_tp_c") == i for i in range(len(cols))]
    g = j.groupBy(*keys, *carry).agg(
        *[F.collect_list(F.when(mine, entry)).alias(f"_tp_e{i}") for i, mine in enumerate(of_column)],
        *[F.bool_or(mine & F.col("_tp_p").isNull()).alias(f"_tp_n{i}") for i, mine in enumerate(of_column)])
    tail = F.array(F.lit(eos)) if add_eos else F.array().cast("array<int>")
    return g.select(*keys, *carry, *[
        F.when(~F.col(f"_tp_n{i}"), F.concat(ids_in_order(F.col(f"_tp_e{i}")), tail)).cast("array<int>").alias(c + suffix)
        for i, c in enumerate(cols)])


def roundtrip_audit(df: DataFrame, text: str, model_path: str | None = None) -> DataFrame:
    """Q4: share of rows whose decode(encode(text)) equals text ignoring spaces."""
    from textpairs.functions.text import equal_ignoring_space

    enc = tokenise_corpus(df.select(text), [text], model_path)
    dec = decode_corpus(enc, f"{text}_ids", model_path, out="_tp_back")
    same = equal_ignoring_space(text, "_tp_back")
    return dec.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("same"),
                   F.avg(same.cast("double")).alias("share_same"))
