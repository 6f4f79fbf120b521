"""Lookups in tables of vocabulary size that leave frequent words and ids where they are.

A vocabulary numbered by falling frequency has most occurrences of a corpus
under its first ids.  The rows of the first ``FREQUENT_IDS`` ids are broadcast (a
fixed size, whatever the corpus); only occurrences of other words or ids
cross a shuffle to their lookup.  Any other numbering gives the same rows, with
more of them shuffled.

Positions and ids go through the regroup as one long each, so the partial
lists of a row are eight bytes an occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids below this number are looked up by broadcast.
FREQUENT_IDS = 1 << 18


def is_frequent(number: Column) -> Column:
    """Whether an id is among the first ones; a null id counts as one of them (there is nothing to look up)."""
    return number.isNull() | number.between(0, FREQUENT_IDS - 1)


def lookup_ids(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """``rows`` left-joined to ``table`` on an id column: frequent ids by broadcast, the others by a shuffle."""
    often = is_frequent(F.col(on))
    first = rows.filter(often).join(F.broadcast(table.filter(often & F.col(on).isNotNull())), on, "left")
    return first.unionByName(rows.filter(~often).join(table.filter(~often), on, "left"))


def frequent_words(vocab: DataFrame) -> DataFrame:
    """``(word)``: the words of ``vocab(word, id)`` with a frequent id, once each."""
    return vocab.filter(is_frequent(F.col("id")) & F.col("id").isNotNull() & F.col("word").isNotNull()).select("word").distinct()


def lookup_words(rows: DataFrame, vocab: DataFrame, rest: DataFrame, value: str) -> DataFrame:
    """``rows(word, ...)`` with the ``value`` of each word: those of frequent words of ``vocab(word, id, value)`` by broadcast,
    of all others from ``rest(word, value)``, which has no frequent word, by a shuffle.  A null word has a null value."""
    frequent = F.broadcast(frequent_words(vocab))
    often = vocab.join(frequent, "word", "left_semi").select("word", value, F.lit(True).alias("_tp_often"))
    first = rows.join(F.broadcast(often), "word", "left").filter(F.col("_tp_often") | F.col("word").isNull()).drop("_tp_often")
    others = rows.filter(F.col("word").isNotNull()).join(frequent, "word", "left_anti")
    return first.unionByName(others.join(rest, "word", "left"))


def other_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``words(word, ...)`` without the frequent words of ``vocab``."""
    return words.join(F.broadcast(frequent_words(vocab)), "word", "left_anti")


def packed(position: Column, number: Column) -> Column:
    """Position and id as one long that sorts by position; null if either is."""
    return F.shiftleft(position.cast("long"), 32).bitwiseOR(number.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def id_of(long: Column) -> Column:
    """The id of a packed long."""
    return F.shiftright(F.shiftleft(long, 32), 32).cast("int")


def ids_in_order(longs: Column) -> Column:
    """The ids of packed longs, by position."""
    return F.transform(F.sort_array(longs), id_of)
