"""Ordering, batching, padding and collation.

Every window here is bounded: a chunk holds ``chunk * bs`` rows, a batch
``bs`` rows.  Global positions come from the skew-safe ranks of ``rank.py``;
per-batch tables are joined back on the batch key (AQE broadcasts them when
they are small, shuffles otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.functions import arrays as A
from textpairs.operators.permute import permute
from textpairs.operators.rank import hash_rank, ordered_rank, seeded_hash
from textpairs.session import materialise

CHUNK = 50  # batches per sortish chunk


def _sort_key(length: str, sort_key) -> Column:
    """An optional ``f(Column) -> Column`` applied to the length column."""
    c = F.col(length)
    return sort_key(c) if sort_key is not None else c


def length_order(df: DataFrame, length: str, key: str, name: str = "rank", sort_key=None) -> DataFrame:
    """Position by (length desc, key) -- the reference's longest-first order."""
    return ordered_rank(df, [_sort_key(length, sort_key).desc(), F.col(key).asc()], name=name)


def fixed_batches(df: DataFrame, order, batch_size: int, drop_last: bool = False,
                  name: str = "batch") -> DataFrame:
    """batch = position // bs; ``drop_last`` removes a final partial batch.

    When the order is a list of column names -- which must form a unique key,
    as a row index does -- only the key is range-sorted and checkpointed; wide
    rows (token arrays) join their position back on the key (an equi-join on a
    unique key: no skew) and are never written to the checkpoint.
    """
    cols = [order] if isinstance(order, (str, Column)) else list(order)
    if all(isinstance(c, str) for c in cols):
        pos = ordered_rank(df.select(*cols), cols, name="_tp_pos")
        r = df.join(pos, cols)
    else:
        r = ordered_rank(df, cols, name="_tp_pos")
    r = r.withColumn(name, F.floor(F.col("_tp_pos") / batch_size).cast("long")) \
         .withColumn("slot", (F.col("_tp_pos") % batch_size).cast("int")).drop("_tp_pos")
    if drop_last:
        full = F.floor(df.select(F.count(F.lit(1))).scalar() / F.lit(batch_size))
        r = r.filter(F.col(name) < full)
    return r


def sortish_batches(df: DataFrame, key: str, length: str, batch_size: int, seed=738,
                    chunk: int = CHUNK, sort_key=None, row: str | None = None, epoch: int = 0) -> DataFrame:
    """Length-bucketed shuffle into batches.

    rank (seeded) -> chunk of chunk*bs rows -> position in chunk by (length
    desc, key) -> batch.  The full batch with the longest head goes first, the
    last batch stays last, the others are permuted by a seeded hash, and rows
    inside a middle batch are permuted too.  Output adds ``batch``,
    ``batch_order`` (position of the batch) and ``slot`` (position inside it).

    With ``row``, a column of dense row numbers from 0, the rank of an ``epoch`` is
    arithmetic on it (``permute``): every epoch is batched anew without ranking
    the rows by an exchange.
    """
    bs = batch_size
    if sort_key is not None:
        df = df.withColumn("_tp_len", _sort_key(length, sort_key))
        out = sortish_batches(df, key, "_tp_len", batch_size, seed, chunk, row=row, epoch=epoch)
        return out.drop("_tp_len")
    # positions need the key and the length only; wide rows join them back once, at the end
    narrow = df.select(F.col(key), F.col(length).alias("_tp_by"), *([F.col(row).alias("_tp_row")] if row else []))
    if row:
        seed = f"{seed}:{epoch}"
        r = narrow.withColumn("_tp_rank", permute(F.col("_tp_row"), df.count(), seed))
    else:
        r = hash_rank(narrow, key, seed, name="_tp_rank")
    r = r.withColumn("_tp_chunk", F.floor(F.col("_tp_rank") / (chunk * bs)).cast("long"))
    in_chunk = Window.partitionBy("_tp_chunk").orderBy(F.col("_tp_by").desc(), F.col(key).asc())
    r = r.withColumn("_tp_pos", (F.row_number().over(in_chunk) - 1).cast("long"))
    r = r.withColumn("batch", (F.col("_tp_chunk") * chunk + F.floor(F.col("_tp_pos") / bs)).cast("long"))
    # the positions feed two scalar subqueries, the batch table and the final
    # join: write them once instead of re-ranking for every consumer
    r = materialise(r.select(key, "_tp_by", "_tp_pos", "batch"))
    bt = r.groupBy("batch").agg(F.count(F.lit(1)).alias("_tp_size"), F.max("_tp_by").alias("_tp_head"))
    top = bt.select(F.max_by("batch", F.struct(F.col("_tp_size") == bs, F.col("_tp_head"), -F.col("batch")))).scalar()
    last_b = bt.select(F.max("batch")).scalar()
    last = F.when(top == last_b, F.lit(0).cast("long")).otherwise(last_b)
    cls = F.when(F.col("batch") == top, 0).when(F.col("batch") == last, 2).otherwise(1)
    bt = bt.select("batch", cls.alias("_tp_cls"))
    middle = hash_rank(bt.filter(F.col("_tp_cls") == 1), "batch", seed, name="_tp_mid", tag="b")
    ends = bt.filter(F.col("_tp_cls") != 1).withColumn("_tp_mid", F.lit(None).cast("long"))
    order = (middle.unionByName(ends)
                   .withColumn("batch_order", F.when(F.col("_tp_cls") == 0, F.lit(0).cast("long"))
                               .when(F.col("_tp_cls") == 2, last_b)
                               .otherwise(F.col("_tp_mid") + 1))
                   .drop("_tp_mid"))
    out = r.join(order, "batch")
    in_batch = Window.partitionBy("batch").orderBy(seeded_hash(seed, F.col(key), tag="r"), F.col(key))
    slot = F.when(F.col("_tp_cls") == 1, F.row_number().over(in_batch) - 1).otherwise(F.col("_tp_pos") % bs)
    out = out.withColumn("slot", slot.cast("int")).select(key, "batch", "batch_order", "slot")
    return df.join(out, key)


def pad_widths(df: DataFrame, batch: str, ids: str, max_len: int, prefix: str = "") -> DataFrame:
    """Q8: per batch the longest untruncated row m and the padded width."""
    m = F.max(F.size(F.col(ids)))
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias(f"{prefix}rows"), m.alias(f"{prefix}max_len")) \
             .withColumn(f"{prefix}width", A.pad_width(F.col(f"{prefix}max_len"), max_len))


def pad_batch(df: DataFrame, batch: str, ids: str, max_len: int, pad: int = 0,
              out: str | None = None, mask: str | None = None) -> DataFrame:
    """Q9: truncate to max_len, right-pad to the batch width, 0/1 mask.

    The width is a max over the batch (a window of at most bs rows).
    """
    out = out or f"{ids}_padded"
    mask = mask or f"{ids}_mask"
    width = A.pad_width(F.max(F.size(F.col(ids))).over(Window.partitionBy(batch)), max_len)
    t = A.truncate(ids, max_len)
    return df.withColumn("_tp_w", width) \
             .withColumn(out, A.pad_to(t, F.col("_tp_w"), pad)) \
             .withColumn(mask, A.mask_of(t, F.col("_tp_w"))).drop("_tp_w")


def collate(df: DataFrame, batch: str, source: str, target: str, max_len: int, pad: int = 0,
            start: int = 0, mode: str = "seq2seq") -> DataFrame:
    """Q11: model-input records.

    ``seq2seq``: padded source + mask, decoder input = target shifted right,
    padded target + mask.  ``classifier``: padded source + mask, decoder input
    = one start id, target unpadded.
    """
    d = pad_batch(df, batch, source, max_len, pad, out="input_ids", mask="attention_mask")
    if mode == "seq2seq":
        d = pad_batch(d, batch, target, max_len, pad, out="target_ids", mask="target_mask")
        d = d.withColumn("decoder_input_ids", A.shift_right("target_ids", start))
    elif mode == "classifier":
        d = d.withColumn("decoder_input_ids", A.int_array([start])) \
             .withColumn("target_ids", F.col(target)).withColumn("target_mask", F.lit(None).cast("array<int>"))
    else:
        raise ValueError(mode)
    return d.withColumn("inputs", F.struct("input_ids", "attention_mask", "decoder_input_ids")) \
            .withColumn("targets", F.struct(F.col("target_ids").alias("ids"), F.col("target_mask").alias("mask")))


def padding_report(padded: DataFrame, batch: str, mask: str) -> DataFrame:
    """Q12: real tokens vs padded slots per batch."""
    return padded.groupBy(batch).agg(
        F.sum(F.aggregate(F.col(mask), F.lit(0).cast("long"), lambda a, x: a + x)).alias("real_tokens"),
        F.sum(F.size(F.col(mask))).cast("long").alias("slots"),
        F.count(F.lit(1)).alias("rows")) \
        .withColumn("fill", F.col("real_tokens") / F.col("slots"))
