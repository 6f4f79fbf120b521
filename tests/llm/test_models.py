"""Operators 8 and 9: held-out accuracy, exact code lengths, odd rows."""

import random
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_rows, prose
from textpairs.llm.lang_id import identify, language_ids, learn
from textpairs.llm.quality import calibrate, fit, indicators, keep_good, margin, quality_scores

SF = "/root/testdata/sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int").withColumn("text", F.lit("x")).withColumn("label", F.lit(9))


def test_indicators_are_the_distinct_grams():
    rng = random.Random(1)
    for text in ["", "a", "ab", "abc abc", prose(1, 300), "ä漢 x" * 50]:
        data = text.encode()
        found = indicators(data)
        assert len(found) == len(set(found.tolist())) and set(found) == set(indicators(data))
        if len(data) > 4:
            cut = rng.randrange(1, len(data) - 1)
            assert len(set(indicators(data[:cut])) - set(found)) < len(indicators(data[:cut]))
    assert len(indicators(b"")) == 1  # the length token


def test_fit_separates_and_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(200):
        good = i % 4 != 0
        x = set(rng.integers(0, 900, 20).tolist()) | {1000 + int(rng.integers(0, 5)) + (0 if good else 5)}
        rows.append(np.array(sorted(x)))
        y.append(int(good))
    y = np.array(y)
    ratio, w, bias = fit(rows, y, bits=11, epochs=300)
    m = np.array([margin(x, ratio, w, bias) for x in rows])
    assert ((m > 0) == (y == 1)).all()
    unseen = np.array([2000])
    assert ratio[2000] == pytest.approx(0) and margin(unseen, ratio, w, bias) == pytest.approx(bias)
    # stationary point of the primal: w = 2 C sum of weighted slack y v
    n_good, n_bad = y.sum(), (1 - y).sum()
    c = np.where(y == 1, 200 / (2 * n_good), 200 / (2 * n_bad)) * 10.0
    slack = np.maximum(0, 1 - np.where(y == 1, 1, -1) * m)
    want = np.zeros(1 << 11)
    for x, s, k, t in zip(rows, slack, c, y):
        v = ratio[x]
        want[x] += 2 * k * s * (1 if t else -1) * v / np.sqrt((v * v).sum())
    # each slack is settled to 1e-3, and counts 2 C times
    assert np.abs(want - w).max() < 0.1 * np.abs(w).max()


def test_calibration_follows_the_class_counts():
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1], 500)
    m = rng.normal(np.where(y, 1.0, -1.0), 1.0)
    even, rare = calibrate(m, y, 100, 100), calibrate(m, y, 900, 100)
    assert even[0] > 0 and rare[0] > 0 and rare[1] < even[1] - 1


def test_quality_held_out_accuracy(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_scores(docs, marks)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    rows = out.join(marks, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    right = {q: np.mean([r["predicted"] == q for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert right[1] > 0.96 and right[0] > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_never_learns_held_out_labels(spark):
    rows = [(i, ("clean words here " if i % 2 else "junk ### $$$ ") * 20 + prose(i, 10), "en", "s") for i in range(300)]
    docs = documents(spark, rows, extra=True)
    true = [(i, i % 2) for i in range(300)]
    import zlib

    lies = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in true]
    a, b = (quality_scores(docs, labels(spark, x)).orderBy("doc_id").collect() for x in (true, lies))
    assert a == b
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in a]) == 1
    assert {r["doc_id"] for r in a if r["held_out"]} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    kept = keep_good(docs, labels(spark, true))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(range(1, 300, 2))


def test_quality_odd_rows(spark):
    docs = documents(spark, odd_rows(), extra=True)
    for marks in ([], [(1, 1)], [(5, 1), (5, 0), (6, None), (7, 3)], [(None, 1), (5, 0), (7, 1), (7, 1), (10, 1)]):
        out = quality_scores(docs, labels(spark, marks)).collect()
        assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
        by = defaultdict(set)
        for r in out:
            by[r["doc_id"]].add(r["score"])
        assert all(len(v) == 1 for v in by.values()) and by[1] == by[2]
    assert keep_good(docs, labels(spark, [])).count() == docs.count()  # nothing learnt: all score 0.5
    assert quality_scores(documents(spark, []), labels(spark, [(1, 1)])).count() == 0


def brute_bits(texts, text, orders=4):
    """Code length by plain context trees, order by order."""
    tree = defaultdict(Counter)
    for t in texts:
        data = b"\n\n\n" + t.lower()
        for i in range(3, len(data)):
            for k in range(orders):
                tree[data[i - k:i]][data[i]] += 1
    data, total = b"\n\n\n" + text.lower(), 0.0
    for i in range(3, len(data)):
        for k in range(orders - 1, -2, -1):
            if k < 0:
                total += 8
                break
            seen = tree.get(data[i - k:i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= log2(seen[data[i]] / (n + d))
                break
            total -= log2(d / (n + d))
    return total


def test_code_lengths_equal_plain_trees(spark):
    learnt = {"xx": ["The cat sat on the mat, the end.", "a cat and a hat", "zzz"], "yy": ["El gato y el perro", "ñandú é"],
              "zz": ["9 8 7"]}
    rows = [(i, t, g, "s") for i, (g, t) in enumerate((g, t) for g, ts in learnt.items() for t in ts)]
    model = learn(documents(spark, rows).select("lang", "text"))
    assert model.langs == ["xx", "yy", "zz"]
    for text in ["the cat", "El perro", "", "qqq ñ", "漢字 cat", "The End", "x" * 40, "\n\n"]:
        got = model.bits(text.encode())
        want = [brute_bits([t.encode() for t in learnt[g]], text.encode()) for g in model.langs]
        assert got == pytest.approx(want)


def test_slices_of_a_long_text_add_up(spark, monkeypatch):
    import textpairs.llm.lang_id as lang_id

    model = learn(documents(spark, [(1, prose(1, 300), "a", "s"), (2, "ä ö ü " * 50, "b", "s")]).select("lang", "text"))
    text = (prose(2, 500) + " ä ö").encode()
    whole = model.bits(text)
    monkeypatch.setattr(lang_id, "_SLICE", 97)
    assert model.bits(text) == pytest.approx(whole)


def test_all_counts_are_kept_whatever_the_languages_and_shares(spark):
    """Rare lang values and small shares change no code length of a language."""
    rows = [(i, prose(i, 60), "en", "s") for i in range(20)] + [(50 + i, "ä ö ü ß " * 9 + prose(i, 3), "de", "s") for i in range(5)]
    dirty = [(100 + i, f"x{i}", f"odd{i:03}", "s") for i in range(40)]
    few = learn(documents(spark, rows).select("lang", "text"))
    many = learn(documents(spark, rows + dirty).select("lang", "text"), nodes=200)
    assert few.single and len(many.blocks) == 3 and max(len(x) for _, x in many.blocks) > 2
    assert many.langs == sorted({"en", "de", *(g for _, _, g, _ in dirty)})
    texts = {g: [t.encode() for _, t, h, _ in rows if h == g] for g in ("en", "de")}
    for text in [prose(77, 20), "Ä ö q", "qqq", "漢 w1"]:
        got = many.bits(text.encode())
        want = [brute_bits(texts[g], text.encode()) for g in ("en", "de")]
        assert [got[many.langs.index(g)] for g in ("en", "de")] == pytest.approx(want)
        assert few.bits(text.encode()) == pytest.approx(want[::-1])  # de, en
    out = {r["doc_id"]: r for r in identify(documents(spark, rows), many).collect()}
    for i, text, lang, _ in rows:
        bits = many.bits(text.encode())
        assert out[i]["lang_pred"] == many.langs[int(bits.argmin())] == lang
        assert out[i]["score"] == pytest.approx(1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum())


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_ids(docs)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = odd_rows() + [(20, "123 456 ½ ² !?", "en", "s"), (21, "漢", "en", "s")]
    docs = documents(spark, rows, extra=True)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_ids(docs).collect()}
    und = {i for i, p in got if p == "und"}
    assert und == {1, 2, 3, 20}
    assert len(language_ids(docs).collect()) == len(rows)
    nothing = documents(spark, [(1, "abc", None, "s")])
    assert [(r["lang_pred"], r["score"]) for r in language_ids(nothing).collect()] == [("und", 0.0)]
    assert language_ids(documents(spark, [])).count() == 0
    tie = learn(documents(spark, [(1, "same text", "b", "s"), (2, "same text", "a", "s")]).select("lang", "text"))
    assert identify(nothing, tie).collect()[0]["lang_pred"] == "a"


def test_sample_is_bounded_in_rows_and_indicators(spark, monkeypatch):
    """A labelled id with thousands of rows, and texts that hold every indicator."""
    from textpairs.llm import quality as Q

    size = 1 << 10
    rows = [(str(i), i % 2, bytes(4 * (10 + i)), 10 + i) for i in range(60)]
    rows += [("7", 1, (f"{j:04d}" * 10).encode(), 10) for j in range(3000)]  # one id, many texts
    rows += [("8", 0, b"same" * 5, 5)] * 3000  # one id, one text
    rows += [(f"long{i}", i % 2, bytes([i]) * 4 * size, size) for i in range(40)]
    df = spark.createDataFrame([(k, y, bytearray(x), n) for k, y, x, n in rows], "k string, label int, x binary, n long")
    kept = Q.bounded_rows(df, per_class=50).collect()
    assert Counter(r["label"] for r in kept) == {0: 50, 1: 50}
    assert sum(r["k"] == "8" for r in kept) <= 2  # its own text and the repeated one
    tight = Q.bounded_rows(df, per_class=2000, most=8 * size).collect()
    assert 0 < sum(len(r["x"]) // 4 for r in tight) <= 8 * size and {r["label"] for r in tight} == {0, 1}
    again = Q.bounded_rows(df.repartition(7), per_class=50).collect()
    key = lambda r: (r["k"], r["label"], bytes(r["x"]))
    assert sorted(map(key, again)) == sorted(map(key, kept))
    one = Q.bounded_rows(df.filter("k = 'long0'"), most=4)  # a first row that is too large by itself still counts
    assert one.count() == 1
