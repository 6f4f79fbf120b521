"""Operator 5 against brute force over all windows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import WORDS, documents, odd_rows, prose
from textpairs.llm.substring import _rolling, _sliding, remove_repeats, runs


def brute(rows, window=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for k in range(window)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def check(spark, rows, **options):
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(rows)], extra=True)
    out = remove_repeats(df, **options)
    assert out.columns == [*df.columns, "__n_words", "__n_removed", "__spans"]
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute(rows, options.get("window", 35))
    for i, t in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = got[i]
        assert re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") == want[i], i
        assert r["__n_words"] == len(words) and r["__n_removed"] == len(words) - len(want[i])
        covered = {k for s in r["__spans"] for k in range(s["start"], s["end"])}
        assert [w for k, w in enumerate(words) if k not in covered] == want[i]
        if not r["__n_removed"]:
            assert r["text"] == t


def test_planted_repeats(spark):
    rng = random.Random(4)
    shared = prose(77, 60)
    rows = [prose(i, rng.randrange(1, 300)) for i in range(60)]
    rows += [f"{prose(100 + i, 20)}\n{shared}\n{prose(200 + i, 40)}" for i in range(20)]
    rows += [prose(400, 120)] * 5  # copies
    rows += [prose(500, 34), prose(500, 34), prose(501, 35), prose(501, 35), prose(502, 36), " ".join(prose(502, 36).split()[1:])]
    rows += ["a " * 100, "b " * 35, "c " * 36, "x y " * 40, prose(600, 40) + " " + prose(600, 40)]
    a, b = prose(700, 50).split(), prose(701, 50).split()  # windows across a factor boundary, held by a third text
    rows += [" ".join(a), " ".join(b), " ".join(a + b), prose(702, 10) + " " + " ".join(a[-20:] + b[:20])]
    check(spark, rows)


def test_random_texts_of_few_words(spark):
    rng = random.Random(5)
    rows = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 80))) for _ in range(80)]
    check(spark, rows, window=9, gram=3)


def test_odd_rows(spark):
    df = documents(spark, odd_rows(), extra=True)
    got = remove_repeats(df).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[1]["__n_words"] == 0
    assert by[7]["__n_removed"] == 30_000 and by[7]["text"] == "" and by[8]["text"] == ""
    assert all(r["__n_removed"] == 60 for r in got if r["doc_id"] in (5, 6))
    assert by[None]["__n_removed"] == 0
    assert remove_repeats(documents(spark, [])).count() == 0
    assert remove_repeats(documents(spark, [(1, None, None, None)])).collect()[0]["__n_removed"] == 0


def test_many_small_chunks_change_nothing(spark):
    rows = [(i, prose(i % 7, 90), "en", "s") for i in range(40)] + [(99, prose(99, 90), "en", "s")]
    out = remove_repeats(documents(spark, rows), chunk_bytes=100).collect()
    assert {r["doc_id"] for r in out if not r["__n_removed"]} == {99}


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 28])
def test_sliding_and_rolling(length):
    x = np.random.default_rng(0).integers(0, 1 << 60, 300, np.uint64)
    for pick in (np.minimum, np.maximum):
        assert (_sliding(x, length, pick) == [pick.reduce(x[i:i + length]) for i in range(300 - length + 1)]).all()
    words = np.concatenate((x, x))
    h = _rolling(words, length, 0xD1342543DE82EF95)
    assert len(np.unique(h[:300])) == 300 and (h[:300 - length] == h[300:600 - length]).all()


def test_runs():
    assert runs(np.array([0, 1, 1, 0, 0, 1], bool)) == [(1, 3), (5, 6)]
    assert runs(np.zeros(4, bool)) == []
    assert WORDS


def few_bits(x):
    """All hashes in eight values: nearly every window is proposed for nearly every other."""
    return x & np.uint64(7 << 40)


def test_no_word_goes_unless_words_were_compared(spark):
    """With window hashes that collide all over, factors do not agree with their references and nothing clean is cut."""
    import textpairs.llm.substring as S

    shared = prose(77, 60)
    rows = [prose(i, 120) for i in range(20)] + [f"{prose(100 + i, 20)} {shared}" for i in range(3)] + [prose(5, 120)]
    whole, clean = S._rolling, set(range(20)) - {5}

    def clash(words, length, base):
        h = whole(words, length, base)
        return few_bits(h) if length == 35 else h

    # anchors are proper, so only windows under equal anchors are asked for
    texts = [pa.chunked_array([pa.array([t.encode() for t in rows])])]
    S._rolling = clash
    try:
        c = S._Chunk(texts[0], 35, 8)
    finally:
        S._rolling = whole
    places = np.flatnonzero(c.inside)
    told, refs = np.unique(c.hashes), np.full(len(np.unique(c.hashes)), -1, S._REF)
    found = S._Factors(c, places, c.hashes[places], told, refs)
    cut = found.covered(c.n)
    for i in clean:
        assert not cut[c.starts[i]:c.starts[i + 1]].any()


def test_factors_that_do_not_agree_are_left_out(spark, monkeypatch):
    """A reference to other words (here: every reference one word off) is answered, and its factor dropped everywhere."""
    import textpairs.llm.substring as S

    rows = [prose(9, 80)] * 2 + [prose(i, 80) for i in range(6)]
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    assert sorted(r["__n_removed"] for r in remove_repeats(df).collect()) == [0] * 6 + [80] * 2
    plain = S._send

    def shifted(kind, chunk, values, blocks, places=None):
        return plain(kind, chunk, values, blocks, None if places is None else places + 1)

    monkeypatch.setattr(S, "_send", shifted)
    c = [r["__n_removed"] for r in remove_repeats(df, chunk_bytes=1).collect()]
    assert c == [0] * 8 or sorted(c) == [0] * 6 + [80] * 2  # both copies in one chunk need no reference


def test_null_ids_spread_over_chunks(spark):
    from pyspark.sql import functions as F

    df = documents(spark, [(None, prose(i, 40), "en", "s") for i in range(400)])
    parts = df.withColumn("c", F.pmod(F.xxhash64("doc_id", "text"), F.lit(64))).groupBy("c").count().collect()
    assert max(r["count"] for r in parts) < 30
    assert remove_repeats(df).filter("__n_removed > 0").count() == 0


def test_positions_do_not_depend_on_the_order_rows_arrive_in(spark, monkeypatch):
    """Every pass gets a chunk's rows in an order of its own; no comparison may fail for it."""
    import textpairs.llm.substring as S

    rows = [(i, prose(i % 40, 60) + f" own{i}", "en", "s") for i in range(160)] + [(i, prose(900, 50), "en", "s") for i in range(200, 260)]
    want = sorted(r["__n_removed"] for r in remove_repeats(documents(spark, rows)).collect())
    plain = S.in_order

    def shuffled(table, order):
        import os
        import random as r

        at = list(range(table.num_rows))
        r.Random(os.urandom(8)).shuffle(at)
        return plain(table.take(pa.array(at, pa.int64())), order)

    monkeypatch.setattr(S, "in_order", shuffled)
    assert want[-1] > 0 and sorted(r["__n_removed"] for r in remove_repeats(documents(spark, rows)).collect()) == want
