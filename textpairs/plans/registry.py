"""Query registry: key -> (Spark builder, optional DuckDB oracle SQL).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
test tables.  The oracle is the same computation in DuckDB SQL over the same
parquet tables (views expanded by ``with_views``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textpairs.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(sql, ctes)
        return fn
    return deco


def rounded(df: DataFrame, cols, places: int = 6) -> DataFrame:
    """Round double result columns (sums of doubles depend on evaluation order;
    the SQL twin rounds the same columns the same way)."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(F.col(c), places).alias(c) if c in cols else F.col(c) for c in df.columns])


def load_all() -> None:
    """Import every query module (they register on import)."""
    from textpairs.plans import (  # noqa: F401
        q_clean, q_text, q_pairs, q_mix, q_order, q_seq, q_vocab, q_score, q_metrics, q_stream, q_sources, q_chains,
        q_subword, q_numbers,
    )
