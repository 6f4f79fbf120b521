"""Sets of ids as 64-bit words, with rank (U4, V2, V3).

A set of non-negative ids is a table ``(word, bits)``: ``word = id div 64``, and
bit ``id mod 64`` of ``bits`` is set.  Collecting ids is a ``bit_or`` that combines
map-side in generated code, so what crosses the shuffle is bounded by the
vocabulary over 64 per task and no distinct runs over ids.  Tables of single
files can be stored and merged by another ``bit_or``.

The new id of an id is its rank: the bits of all words before its own, plus
those below it in its word.  Prefix sums run over words (blocks of 65,536,
then over the blocks), so no id is ever sorted; bits come out of a word in
ascending order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: words of a block
BLOCK_BITS = 16


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def id_words(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """U4 as a bitmap: ``(word, bits)`` of the ids in the id-array columns ``cols`` (null arrays and ids are left out)."""
    every = F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<int>")) for c in cols]))
    ids = df.select(F.explode(every).alias("_tp_id")).filter("_tp_id is not null")
    bad = F.raise_error(F.lit("negative ids have no place in a bitmap")).cast("long")
    at = F.when(F.col("_tp_id") < 0, bad).otherwise(F.col("_tp_id").cast("long"))
    word = F.call_function("shiftright", at, F.lit(6))
    return ids.groupBy(word.alias("word")).agg(F.bit_or(_bit(at.bitwiseAND(F.lit(63)))).alias("bits"))


def with_reserved(words: DataFrame, reserved: int) -> DataFrame:
    """The set with the ids 0..reserved-1 added."""
    meta = words.sparkSession.range(reserved).select(F.array(F.col("id")).alias("ids"))
    return merge_words([words, id_words(meta, ["ids"])])


def merge_words(tables: Sequence[DataFrame]) -> DataFrame:
    """The union of several sets, for example one per file."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def rank_words(words: DataFrame) -> DataFrame:
    """``(word, bits, before)``: how many ids of the set lie in earlier words."""
    block = F.call_function("shiftright", F.col("word"), F.lit(BLOCK_BITS))
    df = words.withColumn("_tp_n", F.bit_count("bits").cast("long")).withColumn("_tp_b", block)
    per = df.groupBy("_tp_b").agg(F.sum("_tp_n").alias("_tp_s"))
    earlier = Window.orderBy("_tp_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per 4 million ids
    per = per.select(F.col("_tp_b").alias("_tp_ob"), F.coalesce(F.sum("_tp_s").over(earlier), F.lit(0)).alias("_tp_off"))
    inside = Window.partitionBy("_tp_b").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_tp_in", F.coalesce(F.sum("_tp_n").over(inside), F.lit(0)))
    return df.join(per, F.col("_tp_b") == F.col("_tp_ob")).select(
        "word", "bits", (F.col("_tp_off") + F.col("_tp_in")).alias("before"))


def ranked_ids(words: DataFrame, name: str = "token_id") -> DataFrame:
    """V2 and V3: every id of the set with its rank as the new id."""
    places = F.filter(F.array(*[F.lit(i) for i in range(64)]), lambda i: F.col("bits").bitwiseAND(_bit(i)) != 0)
    rows = rank_words(words).select("word", "before", F.posexplode(places).alias("_tp_at", "_tp_i"))
    return rows.select((F.col("word") * 64 + F.col("_tp_i")).cast("int").alias(name),
                       (F.col("before") + F.col("_tp_at")).cast("int").alias("new_id"))


def new_id(id_col: Column, bits: Column, before: Column) -> Column:
    """The rank of an id from the row of its word, null if the set lacks it."""
    place = id_col.cast("long").bitwiseAND(F.lit(63)).cast("int")
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), place))
    return F.when(bits.bitwiseAND(_bit(place)) != 0, before + F.bit_count(bits.bitwiseAND(lower))).cast("int")


def remap_by_words(df: DataFrame, keys: Sequence[str], col: str, words: DataFrame, unk_new: int = 0,
                   out: str | None = None) -> DataFrame:
    """J8 over a set: id arrays under the new ids; ids that the set lacks become ``unk_new``.

    The side that is joined has a row per 64 ids of the vocabulary.
    """
    out = out or f"{col}_new"
    ids = df.select(*keys, F.posexplode_outer(F.col(col)).alias("_tp_p", "_tp_id"), F.col(col).isNull().alias("_tp_null"))
    ids = ids.withColumn("_tp_w", F.call_function("shiftright", F.col("_tp_id").cast("long"), F.lit(6)))
    at = rank_words(words).withColumnRenamed("word", "_tp_w")
    new = F.coalesce(new_id(F.col("_tp_id"), F.col("bits"), F.col("before")), F.lit(unk_new))
    rows = ids.join(at, "_tp_w", "left").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("_tp_p").isNotNull(), F.struct("_tp_p", new.alias("_tp_n"))))).alias("_tp_e"),
        F.bool_or("_tp_null").alias("_tp_null"))
    return rows.select(*keys, F.when(~F.col("_tp_null"), F.transform("_tp_e", lambda e: e["_tp_n"])).alias(out))
