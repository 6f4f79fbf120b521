"""Property tests (hypothesis) for the order-sensitive operators."""

import hashlib
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textpairs.functions import arrays as A
from textpairs.operators import batches as BT
from textpairs.operators import metrics as M
from textpairs.operators import mix as X
from textpairs.operators import split as S
from textpairs.operators.rank import dense_ids, hash_rank, ordered_rank

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _h(s):
    return hashlib.md5(s.encode()).hexdigest()


@SETTINGS
@given(n=st.integers(1, 300), seed=st.integers(0, 10_000))
def test_shuffle_rank_is_the_md5_permutation(spark, n, seed):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r.k: r.rank for r in hash_rank(df, "k", seed).collect()}
    want = sorted(range(n), key=lambda k: (_h(f"{seed}:{k}"), k))
    assert [got[k] for k in want] == list(range(n))


@SETTINGS
@given(n=st.integers(1, 400))
def test_split_sizes_exact_and_disjoint(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    three = {r.k: r.split for r in S.split_three(df, "k").collect()}
    t = math.ceil(n * 2 / 10)
    u = math.ceil(t / 2)
    assert len(three) == n
    assert sum(v == "test" for v in three.values()) == u
    assert sum(v == "valid" for v in three.values()) == t - u
    two = S.split_two(df, "k", 0.1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in two}.get("valid", 0) == math.ceil(n / 10)


@SETTINGS
@given(sizes=st.lists(st.integers(0, 60), min_size=2, max_size=4))
def test_stratified_quotas_sum_to_ceil(spark, sizes):
    rows = [(f"{c}-{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "id string, label int")
    out = S.split_stratified(df, "id", "label", 0.1)
    valid = out.filter(F.col("split") == "valid").count()
    assert valid == math.ceil(len(rows) / 10)
    assert out.count() == len(rows)


@SETTINGS
@given(n=st.integers(1, 200))
def test_ordered_rank_and_dense_ids(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % 1000).alias("v"), F.col("id").alias("k"))
    r = {x.k: x.rank for x in ordered_rank(df, [F.col("v").desc(), F.col("k")]).collect()}
    want = sorted(range(n), key=lambda k: (-(k * 7 % 1000), k))
    assert [r[k] for k in want] == list(range(n))
    d = dense_ids(df, "k").collect()
    assert sorted(x.new_id for x in d) == list(range(n))


@SETTINGS
@given(n=st.integers(1, 50))
def test_bidirectional_twice_is_identity(spark, n):
    df = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("string").alias("a"),
                               (F.col("id") * 3).cast("string").alias("b"))
    once = X.bidirectional(df, "a", "b", keep=["k"])
    assert once.count() == 2 * n
    fwd = once.filter(~F.col("swapped")).select("k", "source", "target")
    twice = X.bidirectional(fwd, "source", "target", keep=["k"]).filter(F.col("swapped"))
    assert sorted(twice.select("k", "source", "target").collect()) == sorted(
        once.filter(F.col("swapped")).select("k", "source", "target").collect())


@SETTINGS
@given(lens=st.lists(st.integers(0, 40), min_size=1, max_size=30), max_len=st.integers(1, 50))
def test_pad_then_unpad_is_truncate(spark, lens, max_len):
    rows = [(i, list(range(1, n + 1))) for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "k long, ids array<int>").withColumn("batch", F.lit(0))
    p = BT.pad_batch(df, "batch", "ids", max_len).collect()
    m = max(lens)
    width = math.ceil(min(max_len, m) / 8) * 8 if m > 8 else m
    for r in p:
        assert len(r.ids_padded) == width
        unpadded = [x for x, k in zip(r.ids_padded, r.ids_mask) if k == 1]
        assert unpadded == r.ids[:max_len]


def _sortish_python(keys, lens, bs, seed=738, chunk=50):
    """A plain restatement of the W8 rules."""
    order = sorted(keys, key=lambda k: (_h(f"{seed}:{k}"), k))
    rank = {k: i for i, k in enumerate(order)}
    rows = []
    chunks = {}
    for k in keys:
        chunks.setdefault(rank[k] // (chunk * bs), []).append(k)
    for c, members in chunks.items():
        members.sort(key=lambda k: (-lens[k], k))
        for pos, k in enumerate(members):
            rows.append((k, c * chunk + pos // bs, pos))
    batches = {}
    for k, b, pos in rows:
        batches.setdefault(b, []).append((k, pos))
    heads = {b: max(lens[k] for k, _ in m) for b, m in batches.items()}
    top = max(batches, key=lambda b: (len(batches[b]) == bs, heads[b], -b))
    last = max(batches)
    last = 0 if top == last else last
    cls = {b: 0 if b == top else 2 if b == last else 1 for b in batches}
    middle = sorted([b for b in batches if cls[b] == 1], key=lambda b: (_h(f"{seed}:b:{b}"), b))
    border = {b: i + 1 for i, b in enumerate(middle)}
    border[top] = 0
    if last != top:
        border[last] = len(batches) - 1
    out = {}
    for b, m in batches.items():
        if cls[b] == 1:
            ordered = sorted(m, key=lambda kp: (_h(f"{seed}:r:{kp[0]}"), kp[0]))
            for slot, (k, _) in enumerate(ordered):
                out[k] = (b, border[b], slot)
        else:
            for k, pos in m:
                out[k] = (b, border[b], pos % bs)
    return out


@SETTINGS
@given(n=st.integers(1, 400), bs=st.sampled_from([1, 2, 3, 4, 7]))
def test_sortish_matches_plain_rules_and_is_a_permutation(spark, n, bs):
    lens = {k: (k * 37) % 23 for k in range(n)}
    df = spark.createDataFrame([(k, lens[k]) for k in range(n)], "k long, len long")
    got = {r.k: (r.batch, r.batch_order, r.slot) for r in BT.sortish_batches(df, "k", "len", bs).collect()}
    assert got == _sortish_python(list(range(n)), lens, bs)
    positions = sorted((bo, s) for _, bo, s in got.values())
    assert len(set(positions)) == n


def _ema_seq(xs, alpha):
    v = None
    out = []
    for x in xs:
        v = x if v is None else alpha * x + (1 - alpha) * v
        out.append(v)
    return out


@SETTINGS
@given(n=st.integers(1, 600), alpha=st.sampled_from([0.02, 0.5, 0.999, 1.0]))
def test_blockwise_ema_equals_sequential_fold(spark, n, alpha):
    xs = [((i * 7919) % 97) / 7.0 - 5 for i in range(n)]
    df = spark.createDataFrame([(i % 3, i, xs[i]) for i in range(n)], "key long, t long, x double")
    got = {r.t: r.ema for r in M.ema(df, "key", [F.col("t")], "x", alpha=alpha).collect()}
    for key in range(3):
        ts = [i for i in range(n) if i % 3 == key]
        want = _ema_seq([xs[i] for i in ts], alpha)
        for t, w in zip(ts, want):
            assert abs(got[t] - w) <= 1e-9 * max(1.0, abs(w))


def test_ema_levels_stay_in_range():
    for rate in (-math.log(0.001), -math.log(0.98), 1e-6, 1e-9):
        block = M._ema_scale(rate)
        supers = M._ema_scale(rate * block)
        assert rate * block <= 600 or block == 1
        assert rate * block * supers <= 600 or supers == 1


def test_argmax_first_maximum_and_shift(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],)], "a array<double>")
    got = [r.m for r in df.select(A.argmax("a").alias("m")).collect()]
    assert got == [1, None]
    ids = spark.createDataFrame([([5, 6, 7],)], "a array<int>")
    assert ids.select(A.shift_right("a", 9).alias("s")).collect()[0].s == [9, 5, 6]


@SETTINGS
@given(ids=st.sets(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=300))
def test_int_dense_ids_match_sorted_order(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "token_id int")
    got = {r.token_id: r.new_id for r in dense_ids(df, "token_id").collect()}
    assert [got[i] for i in sorted(ids)] == list(range(len(ids)))


def test_split_by_group_keeps_groups_whole_and_sizes_exact(spark):
    df = spark.range(3_000).select((F.col("id") % 101).alias("g"), F.col("id").alias("k"))
    out = S.split_two(df, "g", 0.2, by_group=True)
    sides = {}
    for r in out.select("g", "split").distinct().collect():
        assert r.g not in sides
        sides[r.g] = r.split
    assert sum(v == "valid" for v in sides.values()) == 21  # ceil(0.2 * 101)
    three = S.split_three(df, "g", by_group=True).select("g", "split").distinct()
    assert {r.split: r["count"] for r in three.groupBy("split").count().collect()} == {"test": 11, "valid": 10, "train": 80}


def test_splits_of_nothing_and_of_everything(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.lit("a").alias("label"))
    assert {r.split for r in S.split_two(df, "k", 1.0).collect()} == {"valid"}
    assert {r.split for r in S.split_stratified(df, "k", "label", 1.0).collect()} == {"valid"}
    assert S.split_two(df.limit(0), "k").count() == 0 and S.split_stratified(df.limit(0), "k", "label").count() == 0
