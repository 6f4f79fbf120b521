"""Sub-word segmentation against a plain greedy restatement, and exact decoding."""

import random

import pytest
from pyspark.sql import functions as F

from textpairs.operators import subword as S

VOCAB = {"the": 259, "cat": 260, "un": 261, "able": 262, "a": 263, "": 264, "believ": 265, "x" * 16: 266, "x" * 17: 267,
         "é": 268, "漢字": 269, "able-": 270}
TOP = 271


def greedy(word):
    if word in VOCAB:
        return [VOCAB[word]]
    if word == "":
        return [35]
    out = []
    for u in range(0, len(word), S.UNIT_CHARS):
        unit, at = word[u:u + S.UNIT_CHARS], 0
        while at < len(unit):
            first = u == 0 and at == 0
            for size in range(min(S.MAX_PIECE, len(unit) - at), 0, -1):
                if unit[at:at + size] in VOCAB:
                    out.append(VOCAB[unit[at:at + size]] + (0 if first else TOP))
                    at += size
                    break
            else:
                out += ([35] if first else []) + [b + 3 for b in unit[at].encode()]
                at += 1
    return out


TEXTS = ["the cat", "unbelievable", "un believable thecat", "", " ", "  the  ", None, "zzz the", "the zzz", "x" * 15, "x" * 16,
         "x" * 17, "x" * 18, "x" * 40, "漢字 漢 字漢字é", "🙂the🙂", "a\tb", "\n", "cat" * 200, "é" * 700 + " " + "q" * 513,
         "able-able", "A" * 256 + "the", "<unk> </s>"]


@pytest.fixture()
def vocab(spark):
    return spark.createDataFrame(list(VOCAB.items()), "word string, id int")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def test_segments_equal_greedy_matching(spark, vocab):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["the", "un", "a", "é", " ", "q", "漢字", "able", "-"]) for _ in range(rng.randrange(12)))
                     for _ in range(150)]
    got = {r.k: r.t_ids for r in S.tokenise_subword(frame(spark, texts), ["k"], "t", vocab).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (None if t is None else [i for w in t.split(" ") for i in greedy(w)] + [2]), t
    assert not any(0 in ids for ids in got.values() if ids)


def test_decoding_is_exact(spark, vocab):
    rng = random.Random(5)
    texts = TEXTS + ["".join(chr(rng.choice([32, 97, 233, 0x6F22, 0x1F642, 10, rng.randrange(1, 0xD800)])) for _ in range(rng.randrange(30)))
                     for _ in range(150)]
    ids = S.tokenise_subword(frame(spark, texts), ["k"], "t", vocab)
    got = {r.k: r.t_ids_text for r in S.decode_pieces(ids, ["k"], "t_ids", vocab).collect()}
    assert got == dict(enumerate(texts))


def test_decoding_other_ids(spark, vocab):
    rows = [(1, [260, 0, 1, 2, 259]), (2, []), (3, None), (4, [9999]), (5, [259, 3 + 0xC3, 2, 3 + 0xA9]), (6, [3 + 0xC3, 260]), (7, [259 + TOP, 260])]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    got = {r.k: r.text for r in S.decode_pieces(df, ["k"], "ids", vocab, out="text").collect()}
    assert got == {1: "cat the", 2: "", 3: None, 4: "", 5: "theé", 6: "� cat", 7: "the cat"}


def test_every_distinct_word_is_cut_once(spark, vocab):
    df = frame(spark, ["unbelievable"] * 500 + ["the"] * 500)
    words = df.select(F.explode(F.split("t", " ")).alias("word")).distinct().join(vocab.select("word"), "word", "left_anti")
    assert words.count() == 1
    assert [tuple(r) for r in S.segment_words(words, vocab).collect()] == [("unbelievable", greedy("unbelievable"))]
    assert S.tokenise_subword(df, ["k"], "t", vocab).count() == 1000
    empty = S.tokenise_subword(frame(spark, []), ["k"], "t", vocab)
    assert empty.collect() == [] and S.tokenise_subword(df.limit(3), ["k"], "t", vocab.limit(0)).count() == 3
