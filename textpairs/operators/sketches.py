"""Mergeable figures of growing corpora (A12, T4): stored sketch states, merged and never recounted.

A file (or any group) is scanned once into one small state: an HLL sketch for
distinct tokens, a KLL sketch for the quantiles of a number.  States are rows
that can be written beside the corpus; a new file costs its own scan, and every
figure over several files is a merge of states.  Errors are those of the
sketches: HLL about ``1.04 / sqrt(2 ** LG_K)`` relative (0.8 % at 14), KLL a rank error of
about 1 % at the default size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LG_K = 14
KLL_K = 400


def distinct_states(df: DataFrame, by: Sequence[str], token: str, lg_k: int = LG_K) -> DataFrame:
    """``by, state`` -- one HLL state per group (partial aggregation, state-sized)."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(token, lg_k).alias("state"))


def quantile_states(df: DataFrame, by: Sequence[str], value: str, k: int = KLL_K) -> DataFrame:
    """T4: ``by, state`` -- one KLL state of a whole-number column per group."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("state"))


def new_groups(df: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """The rows of groups that have no stored state yet: what a refresh has to scan."""
    return df.join(stored.select(by).distinct(), by, "left_anti")


def distinct_growth(states: DataFrame, by: str) -> DataFrame:
    """A12 progressive: ``by, n_seen`` -- distinct tokens up to each group in name order, from states alone.

    The window runs over one state per group (file), not over tokens.
    """
    so_far = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return states.select(by, F.hll_sketch_estimate(F.hll_union_agg("state").over(so_far)).alias("n_seen"))


def distinct_total(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, n_tokens`` over merged states."""
    return states.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("n_tokens"))


def quantiles(states: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()) -> DataFrame:
    """``by, n, q array<long>``: quantiles over merged states."""
    merged = states.groupBy(*by).agg(F.kll_merge_agg_bigint("state").alias("_tp_s"))
    return merged.select(*by, F.kll_sketch_get_n_bigint("_tp_s").alias("n"), F.kll_sketch_get_quantile_bigint(
        "_tp_s", F.array(*[F.lit(float(r)) for r in ranks])).alias("q"))
