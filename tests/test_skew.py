"""Skew: one group holds a third of all rows.  Positions stay exact and the
rows are spread over partitions, not gathered in one task."""

from pyspark.sql import functions as F

from textpairs.operators import metrics as M
from textpairs.operators import pairs as P
from textpairs.operators.rank import hash_rank, ordered_rank


def _skewed(spark, n=30_000):
    # a third of the rows in group 0, the rest over 2,000 small groups
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000 + 1).alias("g"),
        F.col("id").alias("item"), ((F.col("id") * 7919) % 10007).alias("t"))


def test_hot_group_positions_are_exact_and_spread(spark):
    df = _skewed(spark)
    r = ordered_rank(df, [F.col("t"), F.col("item")], name="pos", partition_by=["g"], num_partitions=8)
    r = r.withColumn("pid", F.spark_partition_id())
    hot = r.filter(F.col("g") == 0)
    assert hot.count() == 10_000
    assert sorted(x.pos for x in hot.select("pos").collect()) == list(range(10_000))
    assert _largest_share(r) <= 2                 # of the mean: the stored ranges are packed into even splits
    parts = hot.select("pid").distinct().count()
    assert parts >= 2                             # the hot group lands in several tasks


def test_hot_group_hash_rank_uses_many_buckets(spark):
    df = _skewed(spark)
    r = hash_rank(df, "item", 7, partition_by=["g"])
    hot = r.filter(F.col("g") == 0)
    assert sorted(x.rank for x in hot.select("rank").collect()) == list(range(10_000))
    buckets = hot.select(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("7"), F.col("item").cast("string"))),
                                            1, 4), 16, 10).alias("b")).distinct().count()
    assert buckets > 5_000                        # the window runs per (group, bucket)


def test_hot_group_chain_and_ema(spark):
    df = _skewed(spark, 9_000)
    chain = P.chain_pairs(df, "g", "item", [F.col("t"), F.col("item")])
    assert chain.filter(F.col("g") == 0).count() == 3_000 - 1
    e = M.ema(df, "g", [F.col("t"), F.col("item")], "t", alpha=0.5)
    assert e.filter(F.col("g") == 0).count() == 3_000


def _largest_share(df, task="pid"):
    rows = [r["count"] for r in df.groupBy(task).count().collect()]
    return max(rows) / (sum(rows) / len(rows))


def _no_broadcast(spark):
    class Off:
        def __enter__(self):
            self.old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions",
                                                       "spark.sql.adaptive.coalescePartitions.enabled")}
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            spark.conf.set("spark.sql.shuffle.partitions", "16")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

        def __exit__(self, *_):
            for k, v in self.old.items():
                spark.conf.set(k, v)

    return Off()


def test_hot_key_stays_spread_without_broadcasts(spark):
    """Two thirds of the rows in one key, no broadcast: ranks, and the EMA's blocks, fill no task
    beyond twice the mean."""
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("g"),
                               F.col("id").alias("item"), (F.col("id") % 97).cast("double").alias("x"))
    with _no_broadcast(spark):
        r = ordered_rank(df, [F.col("item")], name="pos", partition_by=["g"], num_partitions=64)
        assert _largest_share(r.withColumn("pid", F.spark_partition_id())) <= 2
        assert r.filter("g = 0").agg(F.count_distinct("pos"), F.max("pos")).first()[:] == (40_000, 39_999)
        # alpha of 0.5 makes blocks of 865 rows: 46 of them in the hot key
        e = M.ema(df, "g", [F.col("item")], "x", alpha=0.5)
        tasks = [x["count"] for x in e.withColumn("pid", F.spark_partition_id()).groupBy("pid").count().collect()]
        assert len(tasks) >= 8 and max(tasks) < 0.25 * n


def test_ema_summaries_are_linear_in_the_blocks(spark, monkeypatch):
    """alpha of 1e-6, small blocks forced: as many superblock rows as exist, however far the decay reaches."""
    monkeypatch.setattr(M, "_EMA_ROWS", 50)
    df = spark.range(6_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("t"), (F.col("id") % 13).cast("double").alias("x"))
    for alpha in (1e-6, 1e-3, 0.3):
        got = {r.t: r.ema for r in M.ema(df, "g", [F.col("t")], "x", alpha=alpha).collect()}
        for g in (0, 1):
            v = None
            for t in range(g, 6_000, 2):
                v = float(t % 13) if v is None else alpha * (t % 13) + (1 - alpha) * v
                assert abs(got[t] - v) < 1e-9


def test_null_group_is_ranked(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, t int")
    got = sorted((r.g or "", r.t, r.pos) for r in ordered_rank(df, ["t"], name="pos", partition_by=["g"]).collect())
    assert got == [("", 1, 0), ("", 3, 1), ("a", 2, 0)]


def test_quotas_of_huge_classes(spark):
    from textpairs.operators import split as S

    # the counts themselves are the input: 1e11 rows in three classes
    counts = {"a": 33_333_333_333, "b": 33_333_333_334, "c": 33_333_333_333}
    df = spark.createDataFrame([(k, n) for k, n in counts.items()], "label string, n long")
    q = S.quotas_of_counts(df.withColumnRenamed("n", "n_label"), "label", 0.1)
    got = {r.label: r.quota for r in q.collect()}
    assert sum(got.values()) == 10_000_000_000 and all(abs(got[k] - counts[k] / 10) <= 1 for k in counts)
