"""Scoring (P1-P4, W10) and user functions.

P2/P3 are JVM-only array expressions (weights are a small literal matrix).
P1 runs an arbitrary predictor in Python workers with ``mapInPandas``: the
factory is called once per worker process, batches arrive as Arrow record
batches (1,024 rows by default).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.functions.arrays import argmax


def linear_head(df: DataFrame, vec: str, weights: Sequence[Sequence[float]], out: str = "logits") -> DataFrame:
    """logits = W . x without bias, one double per class (array order)."""
    rows = []
    for w in weights:
        lit = F.array(*[F.lit(float(v)) for v in w])
        rows.append(F.aggregate(F.zip_with(F.col(vec), lit, lambda x, y: x.cast("double") * y),
                                F.lit(0.0).cast("double"), lambda a, v: a + v))
    return df.withColumn(out, F.array(*rows))


def predict(df: DataFrame, logits: str = "logits", out: str = "prediction") -> DataFrame:
    """Q13 applied: class = first argmax of the logits."""
    return df.withColumn(out, argmax(logits))


def predictions_table(df: DataFrame, id_col: str, logits: str = "logits") -> DataFrame:
    """``(id string, prediction int)``; unlabelled input is fine."""
    return predict(df, logits).select(F.col(id_col).cast("string").alias("id"), "prediction")


def evaluate(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Confusion counts plus overall accuracy (%) from one aggregate.

    The accuracy is taken over the confusion table (at most classes^2 rows).
    """
    conf = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).over(everything)
    return conf.withColumn("accuracy", hits * 100.0 / F.sum("n").over(everything))


def top_candidates(df: DataFrame, key: str, candidate: str, score: str, n: int,
                   name: str = "cand_rank") -> DataFrame:
    """The n best-scored candidates per input (ties: smaller candidate).

    The window is per input (a bounded candidate list); Spark plans a
    WindowGroupLimit so only n rows per input survive the sort.
    """
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(candidate).asc())
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long")).filter(F.col(name) < n)


_PREDICTORS: dict[str, object] = {}


def worker_predictor(ref: str, factory: Callable) -> object:
    """The predictor of ``ref`` in this Python worker, built on first use.

    A module-level function: workers import it by name, so they share one
    cache over all tasks (a nested function travels by value, with a cache of
    its own each time).
    """
    if ref not in _PREDICTORS:
        _PREDICTORS[ref] = factory()
    return _PREDICTORS[ref]


def score_batches(df: DataFrame, predictor_factory: Callable[[], Callable[[pd.DataFrame], pd.Series]],
                  out: str = "prediction", out_type: str = "int", keep: Sequence[str] | None = None,
                  model_ref: str | None = None) -> DataFrame:
    """Apply ``predictor_factory()(batch) -> Series`` to Arrow batches.

    The factory (and so the model) is built once per Python worker and reused
    for every batch of every task; keep the model *path* in the factory's
    closure, not the loaded object.  ``model_ref`` names the model; by default
    it is a digest of the pickled factory, so another factory is another model.
    """
    from hashlib import sha256

    from pyspark import cloudpickle

    keep = list(keep) if keep is not None else df.columns
    base = df.select(*keep) if keep != df.columns else df
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
                       + [f"`{out}` {out_type}"])
    ref = model_ref or sha256(cloudpickle.dumps(predictor_factory)).hexdigest()

    def run(batches):
        from textpairs.operators.score import worker_predictor

        predictor = worker_predictor(ref, predictor_factory)
        for pdf in batches:
            pdf[out] = pd.Series(predictor(pdf), index=pdf.index)
            yield pdf

    return base.mapInPandas(run, schema)


def with_text_fn(df: DataFrame, col: str, *, column_fn: Callable[[Column], Column] | None = None,
                 python_fn: Callable | None = None, out: str | None = None, return_type: str = "string") -> DataFrame:
    """Apply a user function to a column.

    ``column_fn`` maps a Column to a Column and stays in Catalyst;
    ``python_fn`` maps one value to one value (nulls pass through) and runs as
    a pandas UDF.  Exactly one of them is given.
    """
    out = out or col
    if (column_fn is None) == (python_fn is None):
        raise ValueError("give either column_fn or python_fn")
    if column_fn is not None:
        return df.withColumn(out, column_fn(F.col(col)))

    @F.pandas_udf(return_type)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else python_fn(v))

    return df.withColumn(out, apply(F.col(col)))
