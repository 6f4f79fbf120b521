"""Vocabulary collection and pruning (U4, U5, V1-V5, J7, J8, S8 helpers).

Token-level data crosses a shuffle only after a partial distinct, so the
shuffle is bounded by vocabulary x partitions.  Id maps are vocabulary-sized;
occurrences meet them through ``lookup``, tables of vocabulary size in joins left
to AQE (broadcast when the runtime size allows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.operators.lookup import ids_in_order, lookup_ids, packed
from textpairs.operators.rank import dense_ids
from textpairs.operators.tokens import EOS_ID, tokenise_vocab
from textpairs.session import materialise

RESERVED = 259

# SentencePiece piece types.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def seen_ids(df: DataFrame, cols: Sequence[str], name: str = "token_id") -> DataFrame:
    """U4: distinct ids over every id-array column (partial distinct before the shuffle)."""
    every = F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<int>")) for c in cols]))
    return df.select(F.explode(every).alias(name)).distinct()


def add_meta_ids(seen: DataFrame, reserved: int = RESERVED, name: str = "token_id") -> DataFrame:
    """The seen ids plus the reserved control/byte ids 0..reserved-1."""
    spark = seen.sparkSession
    meta = spark.range(reserved).select(F.col("id").cast("int").alias(name))
    return seen.select(F.col(name).cast("int").alias(name)).unionByName(meta).distinct()


def reserved_pieces(spark: SparkSession, reserved: int = RESERVED) -> DataFrame:
    """The reserved rows of a byte-fallback piece vocabulary: unk, bos, eos, then 256 byte pieces."""
    i = F.col("id")
    piece = (F.when(i == 0, "<unk>").when(i == 1, "<s>").when(i == 2, "</s>")
              .otherwise(F.format_string("<0x%02X>", (i - 3).cast("int"))))
    ptype = F.when(i == 0, UNKNOWN).when(i <= 2, CONTROL).otherwise(BYTE)
    return spark.range(reserved).select(i.cast("int").alias("id"), piece.alias("piece"),
                                        F.lit(0.0).cast("float").alias("score"), ptype.cast("int").alias("type"))


def vocab_table(words: DataFrame, reserved: int = RESERVED) -> DataFrame:
    """Full vocabulary ``(id, piece, score, type)`` from a word table ``(word, id)``."""
    body = words.select(F.col("id").cast("int").alias("id"), F.col("word").alias("piece"),
                        (F.lit(reserved) - F.col("id")).cast("float").alias("score"),
                        F.lit(NORMAL).alias("type"))
    return reserved_pieces(words.sparkSession, reserved).unionByName(body)


def prune_vocab(vocab: DataFrame, seen: DataFrame, reserved: int = RESERVED,
                name: str = "token_id") -> DataFrame:
    """V1: keep a piece if its id is reserved or seen; order (by id) kept, new id = position.

    The reserved ids join the seen ones (U5), so one semi-join decides.
    """
    wanted = add_meta_ids(seen, reserved, name).withColumnRenamed(name, "id")
    return dense_ids(vocab.join(wanted, "id", "left_semi"), "id", name="new_id")


def kept_ids(seen: DataFrame, reserved: int = RESERVED, name: str = "token_id") -> DataFrame:
    """V2: sorted(seen | 0..reserved-1) with the dense new id."""
    return dense_ids(add_meta_ids(seen, reserved, name), name, name="new_id")


def id_map(kept: DataFrame, name: str = "token_id") -> DataFrame:
    """V3: old id -> new id."""
    return kept.select(F.col(name).alias("old_id"), "new_id")


def remap_ids(df: DataFrame, keys: Sequence[str], col: str, mapping: DataFrame, unk_new: int = 0,
              out: str | None = None) -> DataFrame:
    """Rewrite an id array through ``mapping(old_id, new_id)``; unmapped -> ``unk_new``.

    posexplode, lookup (frequent ids by broadcast, the others by a shuffle),
    re-collect per key (the regroup is per row, bounded by the row's length).
    ``df`` is read for either kind of id: pass a written one.
    """
    out = out or f"{col}_new"
    ex = df.select(*keys, F.posexplode_outer(F.col(col)).alias("_tp_p", "old_id"))
    j = lookup_ids(ex, mapping, "old_id")
    entry = packed(F.col("_tp_p"), F.coalesce(F.col("new_id"), F.lit(unk_new)))
    g = j.groupBy(*keys).agg(F.collect_list(entry).alias("_tp_e"))
    # a null or empty array is a row without entries
    return g.select(*keys, F.when(F.size("_tp_e") > 0, ids_in_order(F.col("_tp_e"))).alias(out))


def gather_rows(matrix: DataFrame, mapping: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of a matrix for the kept ids, re-numbered densely (new_id)."""
    m = mapping.select(F.col("old_id").alias(id_col), "new_id")
    return matrix.join(m, id_col)


def seen_words(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct words of text columns (partial distinct before the shuffle)."""
    words = [F.coalesce(F.split(F.col(c), " "), F.array().cast("array<string>")) for c in cols]
    return df.select(F.explode(F.flatten(F.array(*words))).alias("word")).distinct()


def prune_words(df: DataFrame, cols: Sequence[str], vocab: DataFrame, reserved: int = RESERVED) -> DataFrame:
    """V4 on the vocabulary: ``(word, id, new_id)`` of the words that a corpus uses, ids pruned and re-numbered.

    Which ids are seen follows from the distinct words alone, so no id array is
    built to find out; ids below ``reserved`` are kept and keep their number.
    """
    # written once: ranks and the map read it several times, the corpus is read for it once
    used = materialise(vocab.join(seen_words(df, cols), "word", "left_semi").select("word", F.col("id").cast("int").alias("id")),
                       "used-words")
    kept = kept_ids(used.select(F.col("id").alias("token_id")), reserved)
    return used.join(kept.select(F.col("token_id").alias("id"), "new_id"), "id").select("word", "id", "new_id")


def prune_tokenise(df: DataFrame, keys: Sequence[str], cols: Sequence[str], vocab: DataFrame, reserved: int = RESERVED,
                   suffix: str = "_new") -> DataFrame:
    """V4: the corpus tokenised under its own pruned vocabulary, ``keys, <col>_new``.

    Words go to old ids and to new ids in joins of vocabulary size; the corpus
    is exploded and put together once, under the new ids.  The unknown and end
    ids are reserved and stay.
    """
    if reserved <= EOS_ID:
        raise ValueError("the unknown and end ids must be reserved")
    pruned = prune_words(df, cols, vocab, reserved).select("word", F.col("new_id").alias("id"))
    return tokenise_vocab(df, keys, cols, materialise(pruned, "pruned"), suffix=suffix)


def vocab_coverage(corpus_ids: DataFrame, col: str, kept: DataFrame, by: Sequence[str] = (),
                   name: str = "token_id") -> DataFrame:
    """V5: share of token occurrences in a corpus that a pruned vocabulary keeps.

    Occurrences are counted per (group, id) first (map-side), so the join and
    its shuffle are vocabulary-sized.
    """
    ex = corpus_ids.select(*by, F.explode(F.col(col)).alias(name))
    n = ex.groupBy(*by, name).agg(F.count(F.lit(1)).alias("_tp_n"))
    k = kept.select(F.col(name).cast("int").alias(name), F.lit(True).alias("_tp_k"))
    j = n.join(k, name, "left")
    tokens, found = F.sum("_tp_n"), F.coalesce(F.sum(F.when(F.col("_tp_k"), F.col("_tp_n"))), F.lit(0).cast("long"))
    return j.groupBy(*by).agg(tokens.alias("tokens"), found.alias("kept"), (found / tokens).alias("coverage"))


def prune_report(pieces: DataFrame, kept: DataFrame) -> DataFrame:
    """V1 vs V2: kept pieces, kept ids and their difference (seen ids beyond
    the piece table make the embedding matrix and the vocabulary differ)."""
    p = pieces.agg(F.count(F.lit(1)).alias("kept_pieces"))
    k = kept.agg(F.count(F.lit(1)).alias("kept_ids"))
    return p.select("kept_pieces", k.select("kept_ids").scalar().alias("kept_ids")) \
            .withColumn("ids_without_piece", F.col("kept_ids") - F.col("kept_pieces"))
