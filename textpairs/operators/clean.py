"""Projection, filter and validation operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.operators.rank import top_rows

# The NLI label encoding of the reference.
NLI_LABELS: dict[str, int] = {"entailment": 0, "neutral": 1, "contradiction": 2}

# Canonical column names per raw corpus shape.
QUESTION_PAIRS = {"question1": "sentence1", "question2": "sentence2", "is_duplicate": "label"}
NLI_COLUMNS = {"pairID": "id", "sentence1": "premise", "sentence2": "hypothesis"}


def canonical_pairs(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = (),
                    drop_null: bool = False) -> DataFrame:
    """keep ``keep`` + the mapped columns, renamed to canonical names.

    Null texts are kept, as the reference keeps null questions; ``drop_null``
    removes rows with a null in any mapped column.
    """
    out = df.select(*keep, *[F.col(src).alias(dst) for src, dst in mapping.items()])
    return out.dropna(subset=list(mapping.values())) if drop_null else out


def positive_pairs(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """rows whose label is 1 (pushed into the scan by Catalyst)."""
    return df.filter(F.col(label) == 1)


def nli_usable(gold: str = "gold_label", s1: str = "sentence1", s2: str = "sentence2") -> Column:
    """The F3 predicate: label present and not '-', both sentences present."""
    return (F.col(gold).isNotNull() & (F.col(gold) != "-")
            & F.col(s1).isNotNull() & F.col(s2).isNotNull())


def clean_nli(df: DataFrame, gold: str = "gold_label") -> DataFrame:
    """drop rows labelled '-', with a null label or with a null sentence."""
    return df.filter(nli_usable(gold))


def _map_literal(mapping: Mapping) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def encode_label(df: DataFrame, col: str = "gold_label", out: str = "label",
                 mapping: Mapping[str, int] = NLI_LABELS, on_unknown: str = "error") -> DataFrame:
    """dictionary encoding; an unknown label raises (or becomes null)."""
    looked = F.try_element_at(_map_literal(mapping), F.col(col)).cast("int")
    if on_unknown == "error":
        looked = F.when(looked.isNull(),
                        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(col), F.lit("NULL")))
                                      )).otherwise(looked).cast("int")
    return df.withColumn(out, looked)


def decode_label(df: DataFrame, col: str = "label", out: str = "gold_label",
                 mapping: Mapping[str, int] = NLI_LABELS) -> DataFrame:
    """class id back to label text through the inverse map (unknown -> null)."""
    inverse = {v: k for k, v in mapping.items()}
    return df.withColumn(out, F.try_element_at(_map_literal(inverse), F.col(col).cast("int")))


def check_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """one report row -- labels are contiguous from 0 (min 0, max = distinct - 1).

    A missing label column is allowed (unlabelled corpus): the report says so.
    """
    if label not in df.columns:
        return df.sparkSession.createDataFrame(
            [(False, None, None, 0, True)],
            "has_label boolean, min_label int, max_label int, n_classes long, ok boolean")
    agg = df.agg(F.min(label).cast("int").alias("min_label"),
                 F.max(label).cast("int").alias("max_label"),
                 F.count_distinct(label).alias("n_classes"))
    ok = ((F.col("min_label") == 0) & (F.col("max_label") == F.col("n_classes") - 1))
    return agg.select(F.lit(True).alias("has_label"), "min_label", "max_label", "n_classes",
                      F.coalesce(ok, F.lit(False)).alias("ok"))


def assert_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """F6 as a guard: fails the job (not the driver) when labels are not contiguous."""
    rep = check_labels(df, label)
    return rep.withColumn("ok", F.when(~F.col("ok"), F.raise_error(F.lit("labels are not 0..k-1")))
                          .otherwise(F.col("ok")))


def filter_report(df: DataFrame, predicate: Column, by: Sequence[str] = ()) -> DataFrame:
    """rows before and after a filter, in one pass (grouped by ``by``)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_before"),
                               F.count_if(predicate).alias("rows_after"))


def with_optional_label(df: DataFrame, label: str = "label", default: int | None = None) -> DataFrame:
    """F8: cast the label to int; add a null one when the corpus has none.

    ``default`` fills missing labels (the reference scores unlabelled rows with 0).
    """
    c = F.col(label).cast("int") if label in df.columns else F.lit(None).cast("int")
    if default is not None:
        c = F.coalesce(c, F.lit(default))
    return df.withColumn(label, c)


def every_nth(df: DataFrame, step: str, n: int) -> DataFrame:
    """keep steps with (step + 1) % n == 0."""
    return df.filter((F.col(step) + 1) % n == 0)


def head_slice(df: DataFrame, order: Sequence, start: int, stop: int, step: int = 1,
               name: str = "pos") -> DataFrame:
    """rows[start:stop:step] by ``order`` (the limit is the feature)."""
    head = top_rows(df, order, stop, name=name)
    return head.filter((F.col(name) >= start) & ((F.col(name) - start) % step == 0))
