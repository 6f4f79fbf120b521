"""Mixing sources to target weights (operator 6; DataFrame functions only).

Token counts are summed per source, every source gets a target share of the
whole by its weight, and the share divided by the source's size is its
repetition rate.  A document is emitted ``floor(rate)`` times, plus one copy
when its seeded hash, read as a number in [0, 1), is below the fraction.

Weights go round robin over the sources in code-point order (null last).  A
target stops at ``max_repeat`` times its source's size and the excess is
reshared by weight: in order of ``max_repeat * size / weight`` the sources that
hit their ceiling come first, so running sums give the common level
``lambda`` with ``target = min(ceiling, weight * lambda)`` in closed form.

Defined cases: null or empty text has size 0 and still gets its copies; a
source without tokens has rate 0; a null source is a source of its own; a null
doc_id hashes like the empty string; rows that repeat draw the same number, so
they are taken alike; an empty table gives an empty result.  Only the id, text
and source columns are read by ``mix_plan``; ``mix_documents`` keeps every
other column untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.llm.stored import stored
from textpairs.llm.words import count_words, text_or_empty, unused

#: Fixed values of the contract: weights in source order, and the most repeats.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Rows of the source table up to which it is broadcast.
BROADCAST_SOURCES = 100_000
_UNIT = float(1 << 52)


def draw(id_col: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from the md5 of seed and id (13 hex digits)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(_UNIT)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, target, rate)``, one row per source.

    ``sizes`` holds ``(source, size)`` rows.  The windows below run over one row
    per source (pre-aggregated map-side), not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    weight_list = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("k", F.row_number().over(in_order) - 1)
    per = per.withColumn("weight", F.element_at(weight_list, (F.col("k") % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, -1)
    per = (per
           .withColumn("total", F.sum("source_size").over(every))
           .withColumn("w_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
           .withColumn("n_left", F.col("total") - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
           .withColumn("level", F.col("n_left") / F.col("w_left"))
           .withColumn("open", F.col("weight") * F.col("level") <= max_repeat * F.col("source_size"))
           # the first source, in that order, that stays below its ceiling sets the level
           .withColumn("lambda", F.min_by(F.when(F.col("open"), F.col("level")),
                                          F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"),
                                                                         F.col("k")))).over(every)))
    target = F.least((max_repeat * F.col("source_size")).cast("double"), F.col("weight") * F.col("lambda"))
    per = per.withColumn("target", F.coalesce(target, F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _copies(rate: Column, id_col: Column, seed: str) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(id_col, seed) < rate - whole, 1).otherwise(0)).cast("long")


def _with_rates(docs: DataFrame, source: Column, sizes: DataFrame, weights, max_repeat: int, name: str) -> DataFrame:
    """``docs`` with source_size, target and rate of their source in a column ``name``.

    The table of sources is written once and counted: up to
    ``BROADCAST_SOURCES`` rows it is broadcast, so documents stay where they
    are; beyond that Spark joins it as it sees fit.
    """
    per = stored(source_targets(sizes, weights, max_repeat), "mix-sources")
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    of = unused(docs.columns, "__of")
    per = per.select(F.col("source").alias(of), F.struct("source_size", "target", "rate").alias(name))
    return docs.join(F.broadcast(per) if few else per, source.eqNullSafe(F.col(of)), "left").drop(of)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        count_words(text_or_empty(text_col)).alias("size"))
    out = _with_rates(sized, F.col("source"), sized.select("source", "size"), weights, max_repeat, "of")
    out = out.withColumn("copies", _copies(F.col("of.rate"), F.col("doc_id"), seed))
    return out.select("doc_id", "size", F.col("of.source_size").alias("source_size"), F.col("of.target").alias("target"),
                      "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED,
                  copy_col: str = "copy_no") -> DataFrame:
    """The mix itself: every input row, all columns, once per copy, numbered from 0 in ``copy_col``."""
    sizes = docs.select(F.col(source_col).alias("source"), count_words(text_or_empty(text_col)).alias("size"))
    of, n = unused(docs.columns, "__mix"), unused(docs.columns, "__n")
    out = _with_rates(docs, F.col(source_col), sizes, weights, max_repeat, of)
    out = out.withColumn(n, _copies(F.col(f"{of}.rate"), F.col(id_col), seed)).filter(F.col(n) > 0)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(copy_col)
    return out.select(*[docs[c] for c in docs.columns if c != copy_col], numbers)
