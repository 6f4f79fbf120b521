"""Aggregations and metrics.

Everything is a partial aggregate (map-side combine before the shuffle) or a
per-row array expression; the only order-dependent metric, the EMA, is
computed block-wise so no window ever spans a whole key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.functions.arrays import cross_entropy
from textpairs.operators.rank import ordered_rank


def length_profile(df: DataFrame, col: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """T4: count, mean, std, min, 25/50/75 % and max of ``length(col)``.

    ``percentile`` keeps one counter per distinct length (bounded by the
    longest text), so it merges partially; ``exact=False`` uses sketches.
    """
    n = F.length(F.col(col))
    if exact:
        q = [F.percentile(n, p) for p in (0.25, 0.5, 0.75)]
    else:
        q = [F.percentile_approx(n, p, 10000).cast("double") for p in (0.25, 0.5, 0.75)]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"),
        F.min(n).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"),
        F.max(n).alias("max"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: counts of each value of each column, from one scan (stack, then count)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_s"))
    return stacked.groupBy(F.col("_s.column").alias("column"), F.col("_s.value").alias("value")) \
                  .agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """A4: percentage of rows with label = prediction."""
    return df.groupBy(*by).agg((F.avg(F.col(y).eqNullSafe(F.col(yhat)).cast("double")) * 100).alias("accuracy"))


def token_accuracy(df: DataFrame, pred: str, target: str, mask: str) -> DataFrame:
    """A5: token accuracy pooled over rows, with pad positions (as the reference
    counts them) and masked to real tokens."""
    hits = F.zip_with(F.col(pred), F.col(target), lambda p, t: F.when(p == t, 1).otherwise(0))
    hit_sum = F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x)
    masked = F.aggregate(F.zip_with(hits, F.col(mask), lambda h, m: h * m), F.lit(0).cast("long"),
                         lambda a, x: a + x)
    mask_sum = F.aggregate(F.col(mask), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.agg((F.sum(hit_sum) / F.sum(F.size(F.col(target)))).alias("acc_with_pad"),
                  (F.sum(masked) / F.sum(mask_sum)).alias("acc_masked"))


def row_loss(df: DataFrame, logits: str, target: str, loss_fn=None, out: str = "loss") -> DataFrame:
    """Per-row loss with a pluggable ``f(logits Column, target Column) -> Column``
    (cross-entropy by default)."""
    fn = loss_fn or cross_entropy
    return df.withColumn(out, fn(F.col(logits), F.col(target)))


def mean_cross_entropy(df: DataFrame, logits: str, target: str) -> DataFrame:
    """Mean cross-entropy of one label per row."""
    return df.agg(F.avg(cross_entropy(logits, target)).alias("loss"), F.count(F.lit(1)).alias("n"))


def masked_cross_entropy(df: DataFrame, logits: str, target: str, mask: str) -> DataFrame:
    """sum(mask * ce) / sum(mask) over every position of every row.

    ``logits`` is array<array<double>> (position x class), ``target`` and
    ``mask`` array<int> of the same length.
    """
    per_pos = F.zip_with(F.col(logits), F.col(target), lambda l, t: cross_entropy(l, t))
    num = F.aggregate(F.zip_with(per_pos, F.col(mask), lambda c, m: c * m.cast("double")),
                      F.lit(0.0).cast("double"), lambda a, x: a + x)
    den = F.aggregate(F.col(mask), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.agg((F.sum(num) / F.sum(den)).alias("loss"), F.sum(den).alias("n_tokens"))


def batch_loss(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """Mean of per-batch mean losses (what the reference logs) vs the pooled mean."""
    per = df.groupBy(batch).agg(F.avg(loss).alias("_m"), F.sum(loss).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return per.agg(F.avg("_m").alias("mean_of_batches"), (F.sum("_s") / F.sum("_n")).alias("pooled"),
                   F.count(F.lit(1)).alias("n_batches"))


#: rows of a block and blocks of a superblock, at most
_EMA_ROWS = 65536


def _ema_scale(rate: float) -> int:
    """Steps over which a decay of ``rate`` per step stays above e^-600 (its inverse fits a double)."""
    return max(1, min(_EMA_ROWS, int(600 / rate)))


def _local_fold(df: DataFrame, group: Sequence[str], pos: str, x: Column, beta: float, out: str) -> DataFrame:
    """``out`` = sum over earlier rows of the group of beta^(pos - pos') * x', the row's own x included.

    A scaled prefix sum; positions run from 0 inside the group.
    """
    inside = Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = F.sum(x * F.pow(F.lit(beta), -F.col(pos))).over(inside)
    return df.withColumn(out, F.pow(F.lit(beta), F.col(pos)) * scaled)


def ema(df: DataFrame, key: str, order: Sequence, value: str, alpha: float = 0.02,
        out: str = "ema", step: str = "step") -> DataFrame:
    """v0 = x0, v = a*x + (1-a)*v along ``order`` per ``key``, for every row.

    Two levels of blocks keep every window bounded and the summaries linear in
    the existing blocks, for any alpha:

    1. position per key (skew-safe rank), block = pos // B; a windowed prefix
       sum inside (key, block) gives each row its local part;
    2. the last local part of a block is its summary; summaries are folded the
       same way inside superblocks of S blocks;
    3. a superblock takes in the superblocks before it, up to those whose decay
       underflows (three at most unless blocks reach their size limit) and
       only as far as the key has superblocks;
    4. rows join their block's incoming value on (key, block).
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    beta = 1.0 - alpha
    rate = -math.log1p(-alpha) if alpha < 1.0 else 1000.0
    block = 1 if alpha == 1.0 else _ema_scale(rate)
    d_block = beta ** block
    supers = 1 if alpha == 1.0 else _ema_scale(rate * block)
    d_super = d_block ** supers
    look = 1 if alpha == 1.0 else int(math.ceil(745.0 / (rate * block * supers))) + 1

    r = ordered_rank(df, order, name=step, partition_by=[key])
    r = r.withColumn("_tp_blk", F.floor(F.col(step) / block).cast("long")) \
         .withColumn("_tp_j", (F.col(step) % block).cast("int"))
    x = F.col(value).cast("double")
    r = _local_fold(r, [key, "_tp_blk"], "_tp_j", F.lit(alpha) * x, beta, "_tp_c")

    # one row per block; the key's first value rides on its first block
    blocks = r.groupBy(key, "_tp_blk").agg(F.max_by("_tp_c", "_tp_j").alias("_tp_cb"),
                                           F.min_by(x, "_tp_j").alias("_tp_x0"))
    blocks = blocks.withColumn("_tp_sb", F.floor(F.col("_tp_blk") / supers).cast("long")) \
                   .withColumn("_tp_jj", (F.col("_tp_blk") % supers).cast("int"))
    blocks = _local_fold(blocks, [key, "_tp_sb"], "_tp_jj", F.col("_tp_cb"), d_block, "_tp_c2")

    tops = blocks.groupBy(key, "_tp_sb").agg(F.max_by("_tp_c2", "_tp_jj").alias("_tp_cs"),
                                             F.min_by("_tp_x0", "_tp_jj").alias("_tp_x0"))
    last = tops.groupBy(key).agg(F.max("_tp_sb").alias("_tp_last")).withColumnRenamed(key, "_tp_key")
    tops = tops.join(last, F.col(key).eqNullSafe(F.col("_tp_key"))).drop("_tp_key")
    until = F.least(F.col("_tp_sb") + look, F.col("_tp_last"))
    fan = tops.filter(F.col("_tp_sb") < F.col("_tp_last")).select(
        key, F.col("_tp_sb").alias("_tp_src"), "_tp_cs",
        F.when(F.col("_tp_sb") == 0, F.col("_tp_x0")).alias("_tp_x0"),
        F.explode(F.sequence(F.col("_tp_sb") + 1, until)).alias("_tp_sb"))
    # at most ``look`` earlier superblocks each
    vin = fan.groupBy(key, "_tp_sb").agg(
        F.sort_array(F.collect_list(F.struct("_tp_src", "_tp_cs"))).alias("_tp_p"),
        F.min("_tp_src").alias("_tp_from"), F.max("_tp_x0").alias("_tp_x0"))
    start = F.when(F.col("_tp_from") == 0, F.col("_tp_x0")).otherwise(F.lit(0.0))
    vin = vin.select(F.col(key).alias("_tp_key"), F.col("_tp_sb").alias("_tp_sb2"), F.aggregate(
        "_tp_p", start.cast("double"), lambda acc, p: acc * F.lit(d_super) + p["_tp_cs"]).alias("_tp_vs"))
    vin = vin.unionByName(tops.filter(F.col("_tp_sb") == 0).select(
        F.col(key).alias("_tp_key"), F.col("_tp_sb").alias("_tp_sb2"), F.col("_tp_x0").cast("double").alias("_tp_vs")))

    # incoming value of a block: its superblock's, decayed, plus the blocks before it there
    earlier = Window.partitionBy(key, "_tp_sb").orderBy("_tp_jj")
    blocks = blocks.withColumn("_tp_before", F.lag("_tp_c2", 1, 0.0).over(earlier))
    into = (blocks.join(vin, F.col(key).eqNullSafe(F.col("_tp_key")) & (F.col("_tp_sb") == F.col("_tp_sb2")))
            .select("_tp_key", F.col("_tp_blk").alias("_tp_blk2"),
                    (F.pow(F.lit(d_block), F.col("_tp_jj")) * F.col("_tp_vs") + F.col("_tp_before")).alias("_tp_vin")))
    res = r.join(into, F.col(key).eqNullSafe(F.col("_tp_key")) & (F.col("_tp_blk") == F.col("_tp_blk2")))
    v = F.pow(F.lit(beta), F.col("_tp_j") + 1) * F.col("_tp_vin") + F.col("_tp_c")
    return res.withColumn(out, v).drop("_tp_blk", "_tp_blk2", "_tp_key", "_tp_j", "_tp_c", "_tp_vin")


def best_by(df: DataFrame, key: str, metric: str, tie: str, cols: Sequence[str], mode: str = "min") -> DataFrame:
    """A10: per key the row with the best metric (ties: smaller ``tie``), partial-aggregated."""
    payload = F.struct(*[F.col(c) for c in cols])
    if mode == "min":
        best = F.min_by(payload, F.struct(F.col(metric), F.col(tie)))
    else:
        best = F.max_by(payload, F.struct(F.col(metric), -F.col(tie)))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def vocab_growth(df: DataFrame, file: str, token: str, files: DataFrame | None = None) -> DataFrame:
    """A12 progressive: distinct tokens seen after each file (files in name order).

    A token counts for the first file it occurs in (a partial min per token);
    the running sum runs over the per-file table (one row per file).  ``files``
    gives the list of files where it is known without reading the tokens.
    """
    first = df.groupBy(token).agg(F.min(file).alias(file))
    per = first.groupBy(file).agg(F.count(F.lit(1)).alias("n_new"))
    files = (df if files is None else files).select(file).distinct()
    per = files.join(per, file, "left").fillna(0, ["n_new"])
    w = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("n_seen", F.sum("n_new").over(w))


def vocab_size(df: DataFrame, token: str, exact: bool = True) -> DataFrame:
    """Number of distinct tokens (``approx_count_distinct`` when not exact)."""
    c = F.count_distinct(token) if exact else F.approx_count_distinct(token)
    return df.agg(c.alias("n_tokens"))


def epoch_plan(counts: DataFrame, rows: str = "rows", batch_size: int = 16, accum: int = 1,
               epochs: int = 5, warm_pct: int = 5) -> DataFrame:
    """Steps per epoch floor(rows/bs/accum), total steps, warm-up and decay lengths.

    warm-up = floor(total * warm%), decay = ceil(total * (100-warm)%) + 1 (integer arithmetic).
    """
    steps = F.floor(F.col(rows) / F.lit(batch_size * accum)).cast("long")
    total = steps * epochs
    return counts.select("*", steps.alias("steps_per_epoch"), total.alias("total_steps"),
                         F.floor(total * warm_pct / F.lit(100)).cast("long").alias("warmup_steps"),
                         (F.ceil(total * (100 - warm_pct) / F.lit(100)) + 1).cast("long").alias("decay_steps"))


def corpus_stats(df: DataFrame, by: Sequence[str] = ("corpus", "split"), label: str = "label") -> DataFrame:
    """Rows, labelled rows and positive rate per corpus and split."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count(label).alias("labelled"),
                               F.avg(F.col(label).cast("double")).alias("positive_rate"))


def round_double(c: Column | str, places: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), places)
