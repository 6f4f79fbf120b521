"""Sub-word segmentation over a vocabulary table, and decoding by join (Q2, Q3).

A word of the vocabulary is one id.  Any other word is cut greedily into the
longest pieces that the vocabulary holds: its first piece is a word of the
vocabulary that begins a word, the next ones are the same words continued,
under ids of their own (``id + top``, ``top`` being the size of the id range),
and a character that begins no piece becomes its UTF-8 bytes (ids 3 to 258).  So
no word is unknown, and decoding is exact.

Segmentation works on the *distinct* words that the vocabulary lacks, cut
into units of at most ``UNIT_CHARS`` characters (a piece does not cross
units), so that everything held for one unit is bounded.  Each place of a unit
is one row with its window of up to ``max_piece`` characters.  In the order of
strings the last piece of a size at or before a window begins that window if any
piece of the size does, so one sort of windows and pieces, dealt by their first
characters, finds the longest piece at every place without a row per prefix.  A
fold over the places of a unit walks from piece to piece.

Decoding joins ids to pieces and puts the pieces of a row back together as
bytes, so characters that were cut into bytes come out whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.operators.lookup import id_of, lookup_ids, lookup_words, other_words, packed
from textpairs.session import materialise

#: Special ids (unknown, begin, end), then one id per byte.
EOS_ID = 2
FIRST_BYTE = 3
RESERVED = 259

MAX_PIECE = 16
UNIT_CHARS = 256
#: Characters by which windows and pieces are dealt.
KEY_CHARS = 4


def _byte_ids(text: Column) -> Column:
    """Ids of the UTF-8 bytes of a short text."""
    h = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(h) / 2 - 1).cast("int")), lambda i: (
        F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + FIRST_BYTE))


def _units(words: DataFrame) -> DataFrame:
    """``(word, unit_no, unit)``; an empty word is one empty unit."""
    chars = F.split("word", "")
    n = F.size(chars)
    parts = F.transform(F.sequence(F.lit(0), F.call_function("div", F.greatest(n - 1, F.lit(0)), F.lit(UNIT_CHARS)).cast("int")),
                        lambda i: F.array_join(F.slice(chars, i * UNIT_CHARS + 1, F.lit(UNIT_CHARS)), ""))
    return words.select("word", F.posexplode(F.when(F.col("word") == "", F.array(F.lit(""))).otherwise(parts))
                        .alias("unit_no", "unit"))


def vocabulary_top(vocab: DataFrame) -> Column:
    """One more than the greatest id (a scalar): ids of continued pieces start there."""
    return vocab.agg(F.greatest(F.coalesce(F.max("id") + 1, F.lit(0)), F.lit(RESERVED)).cast("int")).scalar()


def _longest(units: DataFrame, vocab: DataFrame, max_piece: int) -> DataFrame:
    """``units(unit, begins, whole)`` -> one row per place of each unit, with ``hit``: place, size of the longest piece there (0:
    none) and its id in one long (16, 16 and 32 bits).

    Rows are dealt by the first ``KEY_CHARS`` characters; shorter pieces join
    every key that they begin, as do windows shorter than a key.
    """
    chars = F.split("unit", "")
    windows = F.transform(chars, lambda c, i: F.array_join(F.slice(chars, i + 1, F.lit(max_piece)), ""))
    places = units.select("unit", "begins", "whole", F.posexplode(windows).alias("place", "s"))
    places = places.withColumn("key", F.left("s", F.lit(KEY_CHARS)))
    held = vocab.select(F.col("word").alias("s"), F.col("id").cast("int").alias("id"), F.length("word").alias("size")).filter(
        (F.col("s") != "") & F.col("id").isNotNull() & (F.col("size") <= max_piece))
    begun = places.select("key").distinct().select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.length("key"), F.lit(KEY_CHARS - 1))), lambda n: F.left("key", n))).alias("s"))
    pieces = held.filter(F.col("size") >= KEY_CHARS).withColumn("key", F.left("s", F.lit(KEY_CHARS))).unionByName(
        held.filter(F.col("size") < KEY_CHARS).join(begun, "s"))
    rows = pieces.unionByName(places, allowMissingColumns=True)
    upto = Window.partitionBy("key").orderBy("s", F.col("size").isNull(), "id").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("size") == n, F.struct("s", "id")), ignorenulls=True).over(upto).alias(f"p{n}")
            for n in range(1, max_piece + 1)]
    rows = rows.select("unit", "begins", "whole", "place", "s", "size", *last).filter(F.col("size").isNull())
    best = F.coalesce(*[F.when(F.startswith("s", F.col(f"p{n}.s")), F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(
        F.col(f"p{n}.id").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))) for n in range(max_piece, 0, -1)], F.lit(0).cast("long"))
    return rows.select("unit", "begins", "whole", F.shiftleft(F.col("place").cast("long"), 48).bitwiseOR(best).alias("hit"))


def segment_words(words: DataFrame, vocab: DataFrame, max_piece: int = MAX_PIECE) -> DataFrame:
    """``words(word)``, distinct and not null -> ``(word, pieces array<int>)`` by greedy longest match.

    Meant for words that ``vocab(word, id)`` lacks; a word it holds comes out as
    that one piece if it has at most ``max_piece`` characters.
    """
    # a word of one unit is its own unit; units of longer words are cut once each
    whole = words.filter((F.length("word") <= UNIT_CHARS) & (F.col("word") != "")).select(
        F.col("word").alias("unit"), F.lit(True).alias("begins"), F.lit(True).alias("whole"))
    units = _units(words.filter(F.length("word") > UNIT_CHARS))
    begins = (F.col("unit_no") == 0).alias("begins")
    distinct = whole.unionByName(units.select("unit", begins).distinct().withColumn("whole", F.lit(False)))
    at = F.array_sort("at")
    rows = _longest(distinct, vocab, max_piece).groupBy("unit", "begins", "whole").agg(F.collect_list("hit").alias("at"))
    rows = rows.select("unit", "begins", "whole", F.split("unit", "").alias("chars"), F.transform(at, lambda h: F.struct(
        F.shiftright(h, 48).cast("int").alias("place"), F.shiftright(h, 32).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("size"),
        id_of(h).alias("id"))).alias("at"))
    rows = rows.withColumn("top", vocabulary_top(vocab))
    ids = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("next"), ids.alias("ids"))

    def walk(s: Column, e: Column) -> Column:
        first = F.col("begins") & (e["place"] == 0)
        space = F.when(first, F.array(F.lit(FIRST_BYTE + 32))).otherwise(ids)
        own = F.when(e["size"] == 0, F.concat(space, _byte_ids(F.get("chars", e["place"])))).otherwise(
            F.array(F.when(first, e["id"]).otherwise(e["id"] + F.col("top"))))
        return F.when(e["place"] < s["next"], s).otherwise(F.struct(
            (e["place"] + F.greatest(e["size"], F.lit(1))).alias("next"), F.concat(s["ids"], own).alias("ids")))

    # written once: words of one unit and the others read it
    cut = materialise(rows.select("unit", "begins", "whole", F.aggregate("at", start, walk, lambda s: s["ids"]).alias("ids")), "units")
    short = cut.filter("whole").select(F.col("unit").alias("word"), F.col("ids").alias("pieces"))
    parts = cut.filter(~F.col("whole")).select(F.col("unit").alias("u"), F.col("begins").alias("b"), "ids")
    joined = units.join(parts, (F.col("unit") == F.col("u")) & (begins == F.col("b")))
    long = joined.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("unit_no", "ids"))).alias("parts"))
    long = long.select("word", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("pieces"))
    # an empty word is the space before it and nothing else
    empty = words.filter("word = ''").select("word", F.array(F.lit(FIRST_BYTE + 32)).alias("pieces"))
    return short.unionByName(long).unionByName(empty)


def tokenise_subword(df: DataFrame, keys: Sequence[str], col: str, vocab: DataFrame, add_eos: bool = True,
                     max_piece: int = MAX_PIECE, out: str | None = None) -> DataFrame:
    """Q2 with segmentation: ``keys, <col>_ids``; the text is split on single spaces, a null text gives null."""
    keys, out = list(keys), out or f"{col}_ids"
    words = df.select(*keys, F.posexplode_outer(F.split(F.col(col), " ")).alias("_tp_p", "word"))
    v = vocab.select("word", F.col("id").cast("int").alias("id"), F.array(F.col("id").cast("int")).alias("_tp_pieces"))
    others = other_words(v, v)
    # written once: words of one unit, longer and empty ones are taken from it
    lacking = materialise(other_words(words.select("word").filter("word is not null"), v).distinct().join(
        others.select("word"), "word", "left_anti"), "lacking")
    rest = others.select("word", "_tp_pieces").unionByName(
        segment_words(lacking, vocab, max_piece).withColumnRenamed("pieces", "_tp_pieces"))
    found = lookup_words(words, v, rest, "_tp_pieces")
    # a word of one piece is one long, any other its place and pieces
    entry = packed(F.col("_tp_p"), F.when(F.size("_tp_pieces") == 1, F.get("_tp_pieces", F.lit(0))))
    kind = "array<struct<p:int,pieces:array<int>>>"
    rows = found.groupBy(*keys).agg(
        F.collect_list(entry).alias("_tp_one"),
        F.collect_list(F.when(entry.isNull() & F.col("_tp_p").isNotNull(), F.struct("_tp_p", "_tp_pieces"))).cast(kind).alias("_tp_more"),
        F.bool_or(F.col("_tp_p").isNull()).alias("_tp_null"))
    ones = F.transform("_tp_one", lambda e: F.struct(F.shiftright(e, 32).cast("int").alias("p"), F.array(id_of(e)).alias("pieces")))
    every = F.sort_array(F.concat(ones.cast(kind), F.col("_tp_more")))
    ids = F.when(F.size("_tp_more") == 0, F.transform(F.sort_array("_tp_one"), id_of)).otherwise(
        F.flatten(F.transform(every, lambda e: e["pieces"])))
    tail = F.array(F.lit(EOS_ID)) if add_eos else F.array().cast("array<int>")
    return rows.select(*keys, F.when(~F.col("_tp_null"), F.concat(ids, tail)).cast("array<int>").alias(out))


def decode_pieces(df: DataFrame, keys: Sequence[str], col: str, vocab: DataFrame, out: str | None = None) -> DataFrame:
    """Q3 over a vocabulary table: ``keys, <col>_text`` from ids that ``tokenise_subword`` made (or any others).

    A word id writes a space and its word, a continued one its word alone, a byte
    id its byte; the other special ids are skipped, as are ids that no piece
    has.  The space before the first word goes.  Bytes that are no UTF-8 come
    out as U+FFFD; null ids give a null text.  Frequent ids meet the vocabulary
    in a broadcast join, the others in a shuffled one; ``df`` is read for either
    kind of id: pass a written one.
    """
    keys, out = list(keys), out or f"{col}_text"
    ids = df.select(*keys, F.posexplode_outer(F.col(col)).alias("_tp_p", "_tp_id"), F.col(col).isNull().alias("_tp_null"))
    ids = ids.withColumn("_tp_top", vocabulary_top(vocab))
    goes_on = F.col("_tp_id") >= F.col("_tp_top")
    ids = ids.withColumn("_tp_of", F.when(F.col("_tp_id") >= RESERVED, F.when(goes_on, F.col("_tp_id") - F.col("_tp_top"))
                                          .otherwise(F.col("_tp_id"))))
    held = vocab.select(F.col("id").cast("int").alias("_tp_of"), F.col("word").alias("_tp_w"))
    byte = F.when(F.col("_tp_id").between(FIRST_BYTE, RESERVED - 1), F.unhex(F.lpad(F.hex(F.col("_tp_id") - FIRST_BYTE), 2, "0")).cast("string"))
    piece = F.coalesce(F.when(goes_on, F.col("_tp_w")).otherwise(F.concat(F.lit(" "), F.col("_tp_w"))), byte, F.lit(""))
    rows = lookup_ids(ids, held, "_tp_of").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_tp_p", piece.alias("_tp_h")))).alias("_tp_e"),
        F.bool_or("_tp_null").alias("_tp_null"))
    text = F.make_valid_utf8(F.array_join(F.transform("_tp_e", lambda e: e["_tp_h"]), ""))
    text = F.when(text.startswith(" "), F.substring(text, 2, 1 << 30)).otherwise(text)
    return rows.select(*keys, F.when(~F.col("_tp_null"), text).alias(out))
