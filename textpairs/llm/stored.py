"""Lineage cuts: a table written as Parquet under the checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textpairs.session import materialise


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a scan of it (see ``session.cuts`` for its end)."""
    return materialise(df, name, "llm")
