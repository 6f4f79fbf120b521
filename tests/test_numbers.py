"""Orders and pairs by arithmetic, id sets as words of bits, mergeable sketches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textpairs.operators import id_words as W
from textpairs.operators import pairs as P
from textpairs.operators import sketches as K
from textpairs.operators import vocab as V
from textpairs.operators.permute import PRIME, _walk_steps, epoch_order, permute, round_keys, row_at


def reference(x, n, seed, tweak=0):
    """The network in plain whole numbers."""
    a = 1
    while a * a < n:
        a += 1
    b = -(-n // a)
    while True:
        left, right, ml, mr = x // b, x % b, a, b
        for m, o in round_keys(seed):
            t = ((right + tweak) % PRIME * m + o) % PRIME
            left, right, ml, mr = right, (left + t * (t + 1) % PRIME) % ml, mr, ml
        x = left * mr + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 64, 65, 1000, 4097])
def test_permute_is_one_to_one_and_invertible(spark, n):
    df = spark.range(n).select("id", permute(F.col("id"), n, "s").alias("p"), permute(F.col("id"), F.lit(n), "s", tweak=F.lit(77)).alias("q"))
    rows = df.withColumn("back", permute(F.col("p"), n, "s", inverse=True)).collect()
    assert sorted(r.p for r in rows) == sorted(r.q for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    assert all(r.p == reference(r.id, n, "s") and r.q == reference(r.id, n, "s", 77) for r in rows)


def test_orders_differ_and_look_random(spark):
    n = 3000
    df = spark.range(n).withColumnRenamed("id", "row_no")
    orders = []
    for e in range(2):
        one = epoch_order(df, "row_no", n, 738, e)
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        orders.append([r.position for r in one.orderBy("row_no").collect()])
        assert {tuple(r) for r in row_at(one, "position", n, 738, e, out="back").select("row_no", "back").collect()} == {(i, i) for i in range(n)}
    assert sum(a == b for a, b in zip(*orders)) < 20
    for o in orders:
        near = Counter(p * 10 // n for p in o[: n // 10])  # the first tenth lands in every tenth alike
        assert len(near) == 10 and max(near.values()) < 60 and min(near.values()) > 10


def test_large_numbers_nulls_and_bad_numbers(spark):
    n = (10**9) * (10**9 - 1) // 2
    xs = [0, 1, n - 1, n // 2, 123456789012345678]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = df.select("x", permute(F.col("x"), F.lit(n), "z").alias("p"))
    got = got.withColumn("back", permute(F.col("p"), F.lit(n), "z", inverse=True)).collect()
    assert all(r.back == r.x and 0 <= r.p < n and r.p == reference_large(r.x, n, "z") for r in got)
    assert spark.createDataFrame([(None,)], "x long").select(permute(F.col("x"), 10, "z")).first()[0] is None
    for x in (-1, 10):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([(x,)], "x long").select(permute(F.col("x"), 10, "z")).collect()
    assert _walk_steps(1) >= 1 and _walk_steps(4096) == 64 and _walk_steps(10**12) < 64


def reference_large(x, n, seed):
    import math

    a = math.ceil(math.sqrt(float(n)))
    b = -(-n // a)
    while True:
        left, right, ml, mr = x // b, x % b, a, b
        for m, o in round_keys(seed):
            t = (right % PRIME * m + o) % PRIME
            left, right, ml, mr = right, (left + t * (t + 1) % PRIME) % ml, mr, ml
        x = left * mr + right
        if x < n:
            return x


def _groups(spark, sizes):
    rows = [(g, 1000 * k + i) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, item long")


def test_sample_pairs_draws_k_different_pairs(spark):
    df = _groups(spark, {"a": 1, "b": 2, "c": 5, "d": 60, None: 7})
    rows = P.sample_pairs(df, "g", "item", ["item"], 12).collect()
    per = Counter(r.g for r in rows)
    assert per == {"b": 1, "c": 10, "d": 12, None: 12}
    assert len({(r.g, r.i, r.j) for r in rows}) == len(rows)
    pos = {(r.g, r.pos): r.item for r in P.group_positions(df, "g", "item", ["item"]).collect()}
    assert all(r.i < r.j and r.item_1 == pos[r.g, r.i] and r.item_2 == pos[r.g, r.j] for r in rows)
    assert {(r.i, r.j) for r in rows if r.g == "c"} == {(i, j) for j in range(5) for i in range(j)}
    again = P.sample_pairs(df.repartition(3), "g", "item", ["item"], 12).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    other = P.sample_pairs(df, "g", "item", ["item"], 12, seed=1).collect()
    assert {(r.g, r.i, r.j) for r in other} != {(r.g, r.i, r.j) for r in rows}


def test_sample_pairs_is_uniform_over_a_group(spark):
    df = _groups(spark, {"a": 40})
    seen = Counter()
    for seed in range(12):
        for r in P.sample_pairs(df, "g", "item", ["item"], 200, seed=seed).collect():
            seen[r.i] += 1
            seen[r.j] += 1
    # 12 x 400 ends over 40 positions
    assert min(seen.values()) > 80 and max(seen.values()) < 165


def test_large_draws_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "DRAW_BLOCK", 7)
    df = _groups(spark, {"a": 20, "b": 3})
    rows = P.sample_pairs(df, "g", "item", ["item"], 100).collect()
    assert Counter(r.g for r in rows) == {"a": 100, "b": 3}
    assert sorted(r.draw for r in rows if r.g == "a") == list(range(100))
    assert len({(r.g, r.i, r.j) for r in rows}) == 103


IDS = [[0, 1, 63, 64, 65], [127, 128, 2**31 - 1, 2**31 - 64], None, [], [5, 5, None, 4_194_304, 4_194_303], [70_000_000]]


def test_id_words_equal_distinct_and_dense_ids(spark):
    df = spark.createDataFrame([(i, x, x and x[::-1]) for i, x in enumerate(IDS)], "k int, a array<int>, b array<int>")
    words = W.id_words(df, ["a", "b"])
    want = sorted({i for x in IDS if x for i in x if i is not None})
    assert sorted(map(tuple, W.ranked_ids(words).collect())) == [(x, i) for i, x in enumerate(want)]
    kept = sorted(map(tuple, V.kept_ids(V.seen_ids(df.filter("k <> 4"), ["a"])).collect()))
    assert sorted(map(tuple, W.ranked_ids(W.with_reserved(W.id_words(df.filter("k <> 4"), ["a"]), 259)).collect())) == kept
    # sets of parts of the corpus merge to the set of the whole
    parts = [W.id_words(df.filter(F.col("k") % 2 == m), ["a"]) for m in (0, 1)]
    assert sorted(map(tuple, W.merge_words(parts).collect())) == sorted(map(tuple, words.collect()))
    assert W.ranked_ids(W.id_words(df.limit(0), ["a"])).collect() == []
    with pytest.raises(Exception, match="negative"):
        W.id_words(spark.createDataFrame([([-1],)], "a array<int>"), ["a"]).collect()


def test_id_words_plan_has_no_distinct_over_ids(spark):
    df = spark.createDataFrame([(x,) for x in IDS if x], "a array<int>")
    plan = W.ranked_ids(W.id_words(df, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "HashAggregate" in plan and "SortAggregate" not in plan


def test_remap_by_words(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(IDS)], "k int, a array<int>")
    words = W.id_words(spark.createDataFrame([([0, 63, 64, 127, 5, 2**31 - 1],)], "a array<int>"), ["a"])
    rank = {x: i for i, x in enumerate(sorted([0, 63, 64, 127, 5, 2**31 - 1]))}
    got = {r.k: r.a_new for r in W.remap_by_words(df, ["k"], "a", words, unk_new=9).collect()}
    assert got == {i: None if x is None else [rank.get(t, 9) for t in x] for i, x in enumerate(IDS)}


def test_sketches_merge_and_only_new_groups_are_scanned(spark):
    rng = random.Random(2)
    rows = [(f"f{i % 4}", f"t{rng.randrange(4000)}", rng.randrange(1000)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "file string, token string, n int")
    old = df.filter("file < 'f3'")
    stored = K.distinct_states(old, ["file"], "token")
    fresh = K.new_groups(df, stored, "file")
    assert {r.file for r in fresh.select("file").distinct().collect()} == {"f3"}
    states = stored.unionByName(K.distinct_states(fresh, ["file"], "token"))
    grown = {r.file: r.n_seen for r in K.distinct_growth(states, "file").collect()}
    for f in grown:
        exact = len({t for g, t, _ in rows if g <= f})
        assert abs(grown[f] - exact) <= 0.035 * exact
    assert K.distinct_total(states).first().n_tokens == grown["f3"]
    assert K.distinct_total(K.distinct_states(df, ["file"], "token")).first().n_tokens == grown["f3"]
    q = K.quantiles(K.quantile_states(df, ["file"], "n"), (0.1, 0.5, 0.9)).first()
    values = sorted(n for _, _, n in rows)
    assert q.n == len(rows)
    for p, v in zip((0.1, 0.5, 0.9), q.q):
        below, upto = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
        assert below <= p + 0.02 and upto >= p - 0.02


def test_batches_of_an_epoch_are_drawn_anew_from_one_numbering(spark):
    from textpairs.operators.batches import sortish_batches

    rng = random.Random(9)
    rows = [(i, rng.randrange(5, 90)) for i in range(423)]
    df = spark.createDataFrame(rows, "row_no long, n int").withColumn("id", F.col("row_no") + 7)
    seen = []
    for e in range(3):
        out = sortish_batches(df, "id", "n", 8, row="row_no", epoch=e, chunk=5).collect()
        assert sorted(r.id for r in out) == [i + 7 for i, _ in rows]
        places = sorted((r.batch_order, r.slot) for r in out)
        assert places == [(k // 8, k % 8) for k in range(len(rows))]  # full batches, the partial one last
        first = [r.n for r in out if r.batch_order == 0]
        assert max(first) == max(n for _, n in rows) and first == sorted(first, reverse=True) or len(first) == 8
        seen.append({r.id: (r.batch_order, r.slot) for r in out})
    assert sum(seen[0][i] == seen[1][i] for i in seen[0]) < 30 and seen[1] != seen[2]
