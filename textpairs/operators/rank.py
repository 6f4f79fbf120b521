"""Exact, deterministic positions without a single-partition window.

Two patterns, both shuffle-once and skew-safe:

* ``hash_rank`` -- the order is a seeded md5, so its first hex digits are
  *range* buckets of the order.  A count table per bucket (at most 16**digits
  rows, a proven bound, broadcast) gives each bucket's offset; a
  ``row_number`` inside the bucket finishes the rank.  md5 spreads rows evenly,
  so no bucket is hot even when a key value or a group is.
* ``ordered_rank`` -- any other total order.  Spark's range partitioner
  (sampled bounds over the *whole* sort key, so ties on a leading column are
  still split) sorts the data; per-partition counts (one row per partition,
  broadcast) give offsets, and ``monotonically_increasing_id`` numbers rows
  inside a partition.  The numbered rows are written once as Parquet (shared
  checkpoint folder), so the count and the numbering read the same data and
  an executor loss afterwards re-reads, never re-samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.session import materialise

ColumnLike = Column | str

#: Rows that one task may order and number.
MAX_TOP_ROWS = 100_000

_PID, _MID, _OFF = "_tp_pid", "_tp_mid", "_tp_off"


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_hash(seed, *keys: ColumnLike, tag: str | None = None) -> Column:
    """``md5(seed ':' [tag ':'] key)`` as lower-case hex (same text as DuckDB's md5)."""
    parts = [F.lit(str(seed))]
    if tag:
        parts.append(F.lit(tag))
    parts += [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_rank(df: DataFrame, key: ColumnLike, seed, name: str = "rank",
              partition_by: Sequence[str] = (), digits: int = 4,
              tag: str | None = None) -> DataFrame:
    """0-based position of each row in the order ``(md5(seed:key), key)``.

    ``key`` must be unique (a row id); rows sharing a key would share a bucket.

    With ``partition_by`` the position restarts inside every group; the hot
    group is still spread over 16**digits buckets.
    """
    part = list(partition_by)
    key_c = _col(key)
    h, b, rn, n = "_tp_h", "_tp_b", "_tp_rn", "_tp_n"
    d = (df.withColumn(h, seeded_hash(seed, key_c, tag=tag))
           .withColumn(b, F.conv(F.substring(F.col(h), 1, digits), 16, 10).cast("int")))
    counts = d.groupBy(*part, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(_OFF))
    if not part:
        # at most 16**digits rows: a proven size bound
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*part, b).orderBy(F.col(h), key_c)
    return (d.withColumn(rn, F.row_number().over(inside))
             .join(offsets, [*part, b])
             .withColumn(name, (F.col(_OFF) + F.col(rn) - 1).cast("long"))
             .drop(h, b, rn, _OFF))


def ordered_rank(df: DataFrame, order: Sequence[ColumnLike], name: str = "rank",
                 partition_by: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """0-based position by ``order`` (must be a total order, i.e. end in a key).

    With ``partition_by`` the position restarts per group: position inside the
    (range, group) run plus the group's rows in earlier ranges, joined on
    (range, group).  A run is never longer than a range, so a hot group stays
    spread over its ranges whatever the join strategy.  A null group counts.
    """
    part = list(partition_by)
    keys = [F.col(c).asc() for c in part] + [_col(o) for o in order]
    # without a fixed count AQE may coalesce neighbouring ranges (order is kept);
    # partition ids are read after that, and written with the rows
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    s = (ranged
           .sortWithinPartitions(*keys)
           .withColumn(_PID, F.spark_partition_id())
           .withColumn(_MID, F.monotonically_increasing_id()))
    # Partition ids and in-partition numbers must be read identically by the
    # count branch and the main branch; column pruning gives the two branches
    # different exchanges (re-sampled bounds), so the numbered rows are
    # written once to the shared checkpoint folder.
    s = materialise(s)
    if not part:
        counts = s.groupBy(_PID).agg(F.count(F.lit(1)).alias("_tp_n"))
        before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
        # one row per partition: a proven size bound
        offsets = F.broadcast(counts.select(
            _PID, F.coalesce(F.sum("_tp_n").over(before), F.lit(0)).alias(_OFF)))
        local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
        return (s.join(offsets, _PID)
                 .withColumn(name, (F.col(_OFF) + local).cast("long"))
                 .drop(_PID, _MID, _OFF))
    # a group lies in consecutive ranges: its rows in earlier ranges are carried
    # into each (range, group), and no join or window is on the group alone
    runs = s.groupBy(_PID, *part).agg(F.count(F.lit(1)).alias("_tp_n"), F.min(_MID).alias("_tp_m0"))
    before = Window.partitionBy(*part).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(
        F.col(_PID).alias("_tp_rp"), *[F.col(c).alias(f"_tp_rg{i}") for i, c in enumerate(part)],
        (F.coalesce(F.sum("_tp_n").over(before), F.lit(0)) - F.col("_tp_m0")).alias(_OFF))
    same = F.col(_PID) == F.col("_tp_rp")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_tp_rg{i}"))
    return (s.join(carried, same)
             .withColumn(name, (F.col(_OFF) + F.col(_MID)).cast("long"))
             .drop(_PID, _MID, _OFF, "_tp_rp", *[f"_tp_rg{i}" for i in range(len(part))]))


def int_rank(df: DataFrame, col: str, name: str = "rank", shift: int = 16) -> DataFrame:
    """0-based position by a distinct 32-bit integer column (token ids).

    Integer range buckets ``col >> shift`` follow the order, so the
    bucket-offset table has at most 2**(32-shift) rows (broadcast) and a
    bucket window holds at most 2**shift distinct ids: both bounds are proven
    by the type, whatever the data.  Deterministic, so no lineage cut.
    """
    b, rn, n = "_tp_ib", "_tp_irn", "_tp_in"
    d = df.withColumn(b, F.shiftright(F.col(col), shift))
    counts = d.groupBy(b).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select(b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(_OFF)))
    inside = Window.partitionBy(b).orderBy(F.col(col))
    return (d.withColumn(rn, F.row_number().over(inside))
             .join(offsets, b)
             .withColumn(name, (F.col(_OFF) + F.col(rn) - 1).cast("long"))
             .drop(b, rn, _OFF))


def dense_ids(df: DataFrame, order: ColumnLike | Sequence[ColumnLike], name: str = "new_id") -> DataFrame:
    """New id = position among the rows, by ``order`` (old id).

    A single distinct 32-bit integer id uses the bounded integer-bucket rank;
    any other order the range-sampled ``ordered_rank`` (a long).
    """
    cols = [order] if isinstance(order, (str, Column)) else list(order)
    if len(cols) == 1 and isinstance(cols[0], str) and dict(df.dtypes).get(cols[0]) == "int":
        return int_rank(df, cols[0], name=name).withColumn(name, F.col(name).cast("int"))
    return ordered_rank(df, cols, name=name)


def shuffle_rank(df: DataFrame, key: ColumnLike, seed=738, name: str = "rank") -> DataFrame:
    """A seeded random permutation as a rank column."""
    return hash_rank(df, key, seed, name=name)


def top_rows(df: DataFrame, order: Sequence[ColumnLike], k: int, name: str = "pos") -> DataFrame:
    """First ``k`` rows by ``order`` with their 0-based position.

    ``orderBy().limit(k)`` plans TakeOrderedAndProject (per-partition top-k,
    then a k-row merge); the numbering window then sees at most ``k`` rows.
    """
    if k > MAX_TOP_ROWS:  # too many for one task: the same positions by the range rank
        return ordered_rank(df, order, name=name).filter(F.col(name) < k)
    cols = [_col(o) for o in order]
    head = df.orderBy(*cols).limit(k)
    return head.withColumn(name, (F.row_number().over(Window.orderBy(*cols)) - 1).cast("long"))
