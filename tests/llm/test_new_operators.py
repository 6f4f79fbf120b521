"""Operators 11 to 13: token counts, centroid clustering, filter interaction audit."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF_MID
from tests.llm.helpers import documents, odd_rows, prose
from textpairs.llm import token_counts as tc
from textpairs.llm.centroids import cluster_vectors, distances, integer_vectors
from textpairs.llm.filter_audit import audit, filter_audit
from textpairs.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    with open(VOCABULARY, encoding="utf-8") as f:
        return tc.TokenCounter(f.read())


def test_counts_equal_library_on_random_text(library, counter):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "'s", "'T", "the", "über", "漢字", "<|endoftext|>", "<|endoftext", "\x1c", "\x85",
             " ", "̀", "é", "12", "٣", "²", "Ⅷ", "...", "🙂", "\U000e0001", "՘", "࢏", "﻿", "\0"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
                       for _ in range(rng.randrange(30)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_counts_equal_library_on_every_character(library, counter):
    for low in range(0, 0x30000, 0x400):
        if 0xD800 <= low < 0xE000:
            continue
        chars = list(map(chr, range(low, low + 0x400)))
        for text in ("".join(chars), " ".join(chars), "a".join(chars)):
            assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_long_words_and_texts(library, counter, monkeypatch):
    texts = ["a" * 100_000, "ab" * 60_000, "漢" * 50_000, " " * 100_000, "<|endoftext|>" * 5000, "the cat " * 60_000]
    whole = [counter.count(t) for t in texts]
    assert whole == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(tc, "LISTED_CHARS", 10)
    monkeypatch.setattr(tc, "MEMO_PIECES", 3)
    assert [counter.count(t) for t in texts] == whole


def test_merges_count_as_naive_merging(counter):
    merges = counter.memo.merges
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b" etaoinshr\xc3\xa9") for _ in range(rng.randrange(1, 25)))
        symbols = [merges.first[b] for b in piece]
        while True:
            found = [(merges.of[a * merges.width + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
                     if a * merges.width + b in merges.of]
            if not found:
                break
            (_, new), i = min((f, i) for f, i in found)
            symbols[i:i + 2] = [new]
        assert merges.count(piece) == len(symbols)


def test_token_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for r in docs:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"], len((r["text"] or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, QUERIES["op11_token_counts"](spark, SF_MID).collect())) == want


def test_token_counts_odd_rows(spark, library):
    got = tc.token_counts(documents(spark, odd_rows(), extra=True), VOCABULARY).collect()
    want = Counter()
    for i, text, _, _ in odd_rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, got)) == want
    assert tc.token_counts(documents(spark, []), VOCABULARY).collect() == []


def test_other_vocabularies_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        tc.token_counts(documents(spark, []), public_tokenizers.path("word_bpe_49k.json"))


def brute_clusters(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(cents)):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            if own:
                cents[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [nearest(v) for _, v in kept]
    inertia = sum(d for d, _ in last)
    each = Counter()
    for d, c in last:
        each[c] += d
    return Counter((i, c, d, each[c], inertia, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, last))


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumn("label", F.lit(1)).withColumn("id", F.lit("x")).withColumn("cluster", F.lit("y"))


def random_vectors(n, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, spread, 64)]) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = random_vectors(120) + random_vectors(30, 2, 1000.0)
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [rows[5], rows[5]]  # ties, copies, repeated rows
    rows += [(700, None), (701, []), (702, rows[0][1][:63]), (703, [None] + rows[0][1][1:]), (704, [float("nan")] + rows[0][1][1:]),
             (705, [float("inf")] * 64), (706, [0.0] * 64), (None, [0.25] * 64), (707, rows[0][1] + [1.0])]
    got = cluster_vectors(vectors(spark, rows).repartition(5)).drop("centroid").collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows)


def test_few_or_no_vectors(spark):
    rows = random_vectors(5)
    assert Counter(map(tuple, cluster_vectors(vectors(spark, rows)).drop("centroid").collect())) == brute_clusters(rows)
    assert cluster_vectors(vectors(spark, [(1, None)])).collect() == []
    empty = cluster_vectors(vectors(spark, []))
    assert empty.collect() == [] and empty.dtypes == cluster_vectors(vectors(spark, rows)).dtypes


def test_huge_components_are_bounded(spark):
    rows = random_vectors(20) + [(90, [3e38] * 64), (91, [-3e38] * 64)]
    got = {r["vec_id"]: r for r in cluster_vectors(vectors(spark, rows), rounds=0).collect()}
    assert len(got) == 22 and all(r["distance"] >= 0 for r in got.values())
    assert got[90]["distance"] == 0 or got[90]["centroid"] != [1 << 27] * 64


def test_distance_tables():
    rng = np.random.default_rng(4)
    for spread in (50, 1 << 26):
        v, c = rng.integers(-spread, spread, (300, 7)), rng.integers(-spread, spread, (5, 7))
        assert (distances(v, c) == ((v[:, None, :] - c[None]) ** 2).sum(axis=2)).all()
    import pyarrow as pa

    rows, whole = integer_vectors(pa.array([[0.5, -0.01], None, [1.0], [None, 1.0], [2.0, 3.0]], pa.list_(pa.float32())), dim=2)
    assert rows.tolist() == [0, 4] and whole.tolist() == [[32, -1], [128, 192]]


def outcomes(rows):
    """(part, five failures, id) of each row."""
    out = []
    for i, text, _, part in rows:
        text = text or ""
        w = WORD.findall(text)
        earlier = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _, _ in rows)
        out.append((part or "", (len(w) < 200, 100 * len(set(w)) < 50 * len(w),
                                 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                                 any(c in "#$%&*|" for c in text), earlier), i))
    return out


def brute_audit(rows, labels):
    """Every order is applied to every document, step by step."""
    docs = outcomes(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p for p, _, _ in docs}:
        own = [(f, i) for p, f, i in docs if p == part]
        share = Counter()
        for order in permutations(range(5)):
            left = own
            for step, axis in enumerate(order):
                gone = [(f, i) for f, i in left if f[axis]]
                left = [(f, i) for f, i in left if not f[axis]]
                share[axis] += len(gone)
                out[part, "".join("ABCDE"[a] for a in order), step + 1] = (
                    len(left), len(gone), sum(f[axis] for f, _ in own) - len(gone),
                    sum(f[axis] and sum(f) == 1 for f, _ in own), sum(i in good for _, i in gone),
                    sum(i in toxic for _, i in gone))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v[:6], share["ABCDE".index(order[step - 1])])
    return out


def test_audit_equals_applying_the_filters(spark):
    rows = odd_rows() + [(20 + i, prose(20 + i, 150 + 20 * i) + " #" * (i % 2), "en", f"s{i % 3}") for i in range(12)]
    rows += [(50 + i, "SHOUT " * 250, "en", "hot") for i in range(9)] + [(49, "SHOUT " * 250, "en", "")]
    rows += [(None, "SHOUT " * 250, "en", "hot"), (51, "SHOUT " * 250, "en", "hot"), (51, "other", "en", "hot")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(5, 60)] + [(7, None, 1), (51, 1, 1), (51, 0, 0), (None, 1, 1), (9999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit("x"))
    got = filter_audit(documents(spark, rows, extra=True).withColumn("part", F.lit("p")).withColumn("code", F.lit("c")), frame).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want
    assert filter_audit(documents(spark, []), frame).collect() == []


def test_shapley_sums_to_what_all_filters_remove():
    rng = np.random.default_rng(2)
    every = rng.integers(0, 50, (3, 32))
    found = audit({"every": every, "good": every, "toxic": np.zeros_like(every)})
    for p in range(3):
        per_order = found["removed"][p].reshape(120, 5)
        assert (per_order.sum(axis=1) == every[p, 1:].sum()).all()
        assert found["shapley"][p, :5].sum() == 120 * every[p, 1:].sum()
        assert (found["good_lost"][p] == found["removed"][p]).all() and not found["toxic_lost"][p].any()
