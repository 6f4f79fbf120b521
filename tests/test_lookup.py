"""Frequent words and ids are looked up where they lie; the others are shuffled, with the same results."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_subword import TEXTS, VOCAB, frame, greedy
from textpairs.operators import lookup as L
from textpairs.operators import subword as S
from textpairs.operators import vocab as V
from textpairs.operators.tokens import tokenise_vocab


@pytest.fixture()
def vocab(spark):
    return spark.createDataFrame(list(VOCAB.items()), "word string, id int")


@pytest.fixture()
def no_automatic_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first", [0, 262, 1 << 18])
def test_any_share_of_frequent_ids_gives_the_same_rows(spark, vocab, monkeypatch, first):
    monkeypatch.setattr(L, "FREQUENT_IDS", first)
    df = frame(spark, TEXTS)
    words = {r.k: r.t_ids for r in tokenise_vocab(df, ["k"], ["t"], vocab).collect()}
    assert words == {k: None if t is None else [VOCAB.get(w, 0) for w in t.split(" ")] + [2] for k, t in enumerate(TEXTS)}
    cut = S.tokenise_subword(df, ["k"], "t", vocab)
    assert {r.k: r.t_ids for r in cut.collect()} == {
        k: None if t is None else [i for w in t.split(" ") for i in greedy(w)] + [2] for k, t in enumerate(TEXTS)}
    assert {r.k: r.back for r in S.decode_pieces(cut, ["k"], "t_ids", vocab, out="back").collect()} == dict(enumerate(TEXTS))
    ids = spark.createDataFrame([(1, [260, 999, 300, 260]), (2, []), (3, None), (4, [7, None])], "k int, i array<int>")
    to = spark.createDataFrame([(260, 1), (300, 2), (7, None)], "old_id int, new_id int")
    assert {r.k: r.i_new for r in V.remap_ids(ids, ["k"], "i", to).collect()} == {1: [1, 0, 2, 1], 2: None, 3: None, 4: [0, 0]}


def test_a_word_with_two_ids_keeps_both(spark, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT_IDS", 262)
    twice = spark.createDataFrame([("a", 260), ("a", 270), ("b", 271), ("b", 272)], "word string, id int")
    got = tokenise_vocab(frame(spark, ["a b c"]), ["k"], ["t"], twice).collect()[0].t_ids
    assert got == [260, 270, 271, 272, 0, 2]
    assert S.tokenise_subword(frame(spark, ["a b"]), ["k"], "t", twice).collect()[0].t_ids == [260, 270, 271, 272, 2]


def test_frequent_occurrences_are_not_shuffled_to_their_lookup(spark, vocab, no_automatic_broadcast):
    df = frame(spark, TEXTS)
    ids = spark.createDataFrame([(1, [260, 300])], "k int, i array<int>")
    to = spark.createDataFrame([(260, 1)], "old_id int, new_id int")
    for out in (tokenise_vocab(df, ["k"], ["t"], vocab), S.tokenise_subword(df, ["k"], "t", vocab),
                S.decode_pieces(ids, ["k"], "i", vocab), V.remap_ids(ids, ["k"], "i", to)):
        assert "BroadcastHashJoin" in plan_of(out)


def test_segmentation_has_a_row_per_place(spark, vocab):
    """No row per prefix: as many rows as characters go through the search for the longest piece, and none is lost."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice(["the", "un", "a", "é", "q", "漢字", "able", "-", "x" * 9]) for _ in range(rng.randrange(1, 9)))
                    for _ in range(200)} - set(VOCAB)) + ["x" * 300, "x" * 700]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    units = df.select(F.col("word").alias("unit"), F.lit(True).alias("begins"), F.lit(True).alias("whole")).filter(F.length("unit") <= 256)
    assert S._longest(units, vocab, S.MAX_PIECE).count() == sum(len(w) for w in words if len(w) <= 256)
    assert {r.word: r.pieces for r in S.segment_words(df, vocab).collect()} == {w: greedy(w) for w in words}
