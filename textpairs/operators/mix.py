"""Corpus union, direction swap and recipe over-sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Corpus recipes of the reference (corpus -> copies).
RECIPES: dict[str, dict[str, int]] = {
    "quora": {"quora": 1},
    "paws": {"paws": 1},
    "msrp": {"msrp": 1},
    "opinosis": {"opinosis": 1},
    "quora+paws": {"paws": 2, "quora": 1},
    "paws+msrp+opinosis": {"paws": 1, "msrp": 2, "opinosis": 2},
}


def union_corpora(corpora: Mapping[str, DataFrame], columns: Sequence[str], name: str = "corpus") -> DataFrame:
    """Bag union of corpora (no de-duplication), each row tagged with its corpus."""
    out = None
    for corpus, df in corpora.items():
        part = df.select(F.lit(corpus).alias(name), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def bidirectional(df: DataFrame, a: str, b: str, keep: Sequence[str] = (),
                  source: str = "source", target: str = "target") -> DataFrame:
    """Every pair forward and swapped, from one scan (no self-union)."""
    both = F.array(
        F.struct(F.col(a).alias(source), F.col(b).alias(target), F.lit(False).alias("swapped")),
        F.struct(F.col(b).alias(source), F.col(a).alias(target), F.lit(True).alias("swapped")))
    return df.select(*keep, F.inline(both))


def recipe_table(spark: SparkSession, recipes: Mapping[str, Mapping[str, int]] = RECIPES) -> DataFrame:
    rows = [(r, c, int(m)) for r, parts in recipes.items() for c, m in parts.items()]
    return spark.createDataFrame(rows, "recipe string, corpus string, multiplier int")


def mix(df: DataFrame, recipes: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Rows of each recipe, over-sampled by integer copies (``copy_no`` from 1).

    The recipe table is a handful of literal rows, so it is broadcast.
    """
    j = df.join(F.broadcast(recipes), corpus)
    return j.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("multiplier")))).drop("multiplier")
