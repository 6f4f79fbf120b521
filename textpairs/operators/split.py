"""Exact, reproducible splits.

Sizes are exact (scikit-learn's ceil rule) and membership depends only on the
seed and the key -- never on partitioning.  The key must identify a row (a
pair id, a document id): rows that share a key fall on the same side.

A split is a threshold on the seeded hash of the key: counts per hash bucket
(4 hex digits) tell in which bucket the wanted rank lies, and only the keys of
that bucket are ranked.  Keys and hashes are written once, and counts, class
totals, quotas and thresholds all come from that narrow table.  The rows
themselves are then decided where they are scanned; they are not shuffled.  With ``by_group`` the key is a group column,
sizes count groups, and all rows of a group go to one side.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.operators.rank import hash_rank, seeded_hash, top_rows
from textpairs.session import materialise

DEFAULT_SEED = 738
STRATIFIED_SEED = 42
MAX_BROADCAST_CLASSES = 10_000


def _div(a: Column, b: Column) -> Column:
    """a div b for whole decimals: the remainder goes first, so the quotient is exact."""
    return ((a - a % b) / b).cast("long")


def _ceil_frac(n: Column, f) -> Column:
    """ceil(n * f) in whole-number arithmetic (f as an exact fraction)."""
    fr = Fraction(str(f)).limit_denominator(10**6)
    return _div(n.cast("decimal(19,0)") * F.lit(fr.numerator).cast("decimal(9,0)")
                + F.lit(fr.denominator - 1).cast("decimal(9,0)"), F.lit(fr.denominator).cast("decimal(9,0)"))


def _keys(df: DataFrame, key: str, seed, part: Sequence[str] = (), by_group: bool = False) -> DataFrame:
    """``(part..., _tp_k, _tp_h)``: keys (distinct ones with ``by_group``) and their seeded hashes.

    Written once: whatever the input is, a split evaluates it here and where its
    rows are decided, and nowhere else.
    """
    keys = df.select(*part, F.col(key).alias("_tp_k"))
    return materialise((keys.distinct() if by_group else keys).withColumn("_tp_h", seeded_hash(seed, "_tp_k")))


def _bucket() -> Column:
    return F.substring("_tp_h", 1, 4)


def _bucket_counts(keys: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """``(part..., _tp_b, _tp_n)``: at most 16**4 rows per part."""
    return keys.groupBy(*part, _bucket().alias("_tp_b")).agg(F.count(F.lit(1)).alias("_tp_n"))


def _at_rank(keys: DataFrame, counts: DataFrame, ranks: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """``(part..., _tp_t, _tp_ht, _tp_kt)``: the hash and key that hold rank ``_tp_t`` of their part.

    ``ranks(part..., _tp_t)`` holds a few ranks; one that no row holds gives no row.
    """
    before = Window.partitionBy(*part).orderBy("_tp_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_tp_off", F.coalesce(F.sum("_tp_n").over(before), F.lit(0)))

    def same(right: DataFrame, extra: Column) -> tuple[DataFrame, Column]:
        right = right.withColumnsRenamed({c: f"_tp_p{i}" for i, c in enumerate(part)})
        on = extra
        for i, c in enumerate(part):
            on = on & F.col(c).eqNullSafe(F.col(f"_tp_p{i}"))
        return right, on

    # the buckets of a part meet the few ranks of the part
    right, on = same(ranks, (F.col("_tp_off") <= F.col("_tp_t")) & (F.col("_tp_t") < F.col("_tp_off") + F.col("_tp_n")))
    edge = counts.join(right if part else F.broadcast(right), on).select(*part, "_tp_b", "_tp_t", "_tp_off")
    right, on = same(edge.withColumnRenamed("_tp_b", "_tp_eb"), _bucket() == F.col("_tp_eb"))
    inside = Window.partitionBy(*part, "_tp_t").orderBy("_tp_h", "_tp_k")
    rows = keys.join(right, on).withColumn("_tp_rn", F.row_number().over(inside) - 1 + F.col("_tp_off"))
    return rows.filter(F.col("_tp_rn") == F.col("_tp_t")).select(
        *part, "_tp_t", F.col("_tp_h").alias("_tp_ht"), F.col("_tp_k").alias("_tp_kt"))


def _below(df: DataFrame, key: str, seed, ht: Column, kt: Column) -> Column:
    """Whether a row's (hash, key) lies before a threshold; no threshold: every row does."""
    h = seeded_hash(seed, key)
    return F.when(ht.isNull(), F.lit(True)).otherwise((h < ht) | ((h == ht) & (F.col(key) < kt)))


def _thresholds(keys: DataFrame, *ranks: Column) -> list[tuple[Column, Column]]:
    """Scalar (hash, key) thresholds of ranks that are expressions over the total ``_tp_total``."""
    out = []
    counts = _bucket_counts(keys)
    total = counts.agg(F.coalesce(F.sum("_tp_n"), F.lit(0)).alias("_tp_total"))
    for rank in ranks:
        at = _at_rank(keys, counts, total.select(rank.alias("_tp_t"))).select(F.struct("_tp_ht", "_tp_kt")).scalar()
        out.append((at["_tp_ht"], at["_tp_kt"]))
    return out


def split_two(df: DataFrame, key: str, fraction: float = 0.1, seed=DEFAULT_SEED,
              names: tuple[str, str] = ("train", "valid"), out: str = "split", by_group: bool = False) -> DataFrame:
    """The first ceil(f*n) rows of the seeded permutation form the second part."""
    (cut,) = _thresholds(_keys(df, key, seed, by_group=by_group), _ceil_frac(F.col("_tp_total"), fraction))
    return df.withColumn(out, F.when(_below(df, key, seed, *cut), F.lit(names[1])).otherwise(F.lit(names[0])))


def split_three(df: DataFrame, key: str, seed=DEFAULT_SEED, held_out: float = 0.2,
                out: str = "split", by_group: bool = False) -> DataFrame:
    """80/10/10 -- t = ceil(0.2 n) held out, u = ceil(t / 2) of it is test."""
    t = _ceil_frac(F.col("_tp_total"), held_out)
    at_t, at_u = _thresholds(_keys(df, key, seed, by_group=by_group), t, F.shiftright(t + 1, 1))
    return df.withColumn(out, F.when(_below(df, key, seed, *at_u), "test")
                         .when(_below(df, key, seed, *at_t), "valid").otherwise("train"))


def stratified_quotas(df: DataFrame, label: str, fraction: float = 0.1) -> DataFrame:
    """Per-class quota of the held-out part, by largest remainder (ties: smaller label).

    Computed over the per-class count table only (one row per class).
    """
    return quotas_of_counts(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_label")), label, fraction)


def quotas_of_counts(c: DataFrame, label: str, fraction: float = 0.1) -> DataFrame:
    """The quotas from per-class counts ``c(label, n_label)``."""
    everything = Window.partitionBy()
    tot = F.sum("n_label").over(everything)
    q = c.withColumn("total", tot).withColumn("want", _ceil_frac(F.col("total"), fraction))
    # products of two counts: decimal(38,0), as a bigint would overflow from 1e10 x 1e9 rows
    product, total = F.col("want").cast("decimal(19,0)") * F.col("n_label").cast("decimal(19,0)"), \
        F.col("total").cast("decimal(19,0)")
    q = q.withColumn("base", _div(product, total)).withColumn("rem", product % total)
    q = q.withColumn("extra", F.col("want") - F.sum("base").over(everything))
    by_rem = Window.orderBy(F.col("rem").desc(), F.col(label).asc())
    q = q.withColumn("_tp_rn", F.row_number().over(by_rem))
    return q.select(label, "n_label",
                    (F.col("base") + F.when(F.col("_tp_rn") <= F.col("extra"), 1).otherwise(0))
                    .cast("long").alias("quota"))


def split_stratified(df: DataFrame, key: str, label: str, fraction: float = 0.1,
                     seed=STRATIFIED_SEED, names: tuple[str, str] = ("train", "valid"),
                     out: str = "split") -> DataFrame:
    """Per class, the first ``quota`` rows of a seeded in-class permutation are held out."""
    keys = _keys(df, key, seed, [label])
    counts = materialise(_bucket_counts(keys, [label]))
    per_class = counts.groupBy(label).agg(F.sum("_tp_n").alias("n_label"))
    # one threshold per class: broadcast if the classes are counted to be few, else joined
    few = per_class.limit(MAX_BROADCAST_CLASSES + 1).count() <= MAX_BROADCAST_CLASSES
    quotas = quotas_of_counts(per_class, label, fraction).select(label, F.col("quota").alias("_tp_t"))
    edges = _at_rank(keys, counts, quotas, [label])
    cuts = quotas.join(edges.withColumnRenamed(label, "_tp_l").drop("_tp_t"),
                       F.col(label).eqNullSafe(F.col("_tp_l")), "left").select(
        F.col(label).alias("_tp_cl"), "_tp_ht", "_tp_kt")
    r = df.join(F.broadcast(cuts) if few else cuts, F.col(label).eqNullSafe(F.col("_tp_cl")))
    held = _below(df, key, seed, F.col("_tp_ht"), F.col("_tp_kt"))
    return r.withColumn(out, F.when(held, F.lit(names[1])).otherwise(F.lit(names[0]))) \
            .drop("_tp_cl", "_tp_ht", "_tp_kt")


def sample_k(df: DataFrame, order: Sequence, key: str, m: int, k: int, seed=DEFAULT_SEED,
             out: str = "sample_pos") -> DataFrame:
    """K rows drawn (seeded) from the first m rows by ``order``."""
    head = top_rows(df, order, m, name="_tp_head")
    return hash_rank(head.drop("_tp_head"), key, seed, name=out).filter(F.col(out) < k)
