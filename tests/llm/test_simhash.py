"""Operator 2 against brute force over all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tests.conftest import SF_MID
from tests.llm.helpers import documents, odd_rows, prose
from textpairs.llm.queries import QUERIES
from textpairs.llm.simhash import components, fingerprint, keep_one, links, near_duplicates


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [b" ".join(words)]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(ids_fps, bits=3):
    """Smallest id reachable, by union over all pairs of distinct fingerprints."""
    fps = sorted({f for _, f in ids_fps})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                up[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for i, f in ids_fps:
        if i is not None:
            r = root(f)
            least[r] = i if least[r] is None else min(least[r], i)
    return {(i, f): least[root(f)] for i, f in ids_fps}


def test_fingerprint():
    for text in ["", " \n", "One", "one TWO", "a b c", "É é A a Z", prose(1, 500), "x " * 9000, "ÄÖ\x0b\x0cb c"]:
        got = fingerprint(text.encode()) % (1 << 64)
        assert got == brute_fp(text)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r["doc_id"], brute_fp(r["text"])) for r in docs]
    want = brute_components(fps)
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in QUERIES["op2_simhash"](spark, SF_MID).collect()}
    assert got == want
    assert len({v for v in got.values()}) < len(docs)


def test_odd_rows(spark):
    docs = documents(spark, odd_rows(), extra=True)
    out = near_duplicates(docs).collect()
    fps = [(i, brute_fp(t)) for i, t, _, _ in odd_rows()]
    want = brute_components(fps)
    assert sorted(((r["doc_id"] or -1, int(r["fingerprint"], 16), r["component_id"] or -1) for r in out)) == sorted(
        (i or -1, f, want[i, f] or -1) for i, f in fps)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect())
    assert ids == [-1, 1, 4, 5, 5, 7, 10]  # 2 and 3 are like 1, 6 is like 5, 8 is like 7; repeated rows stay together
    assert near_duplicates(documents(spark, [])).count() == 0 and keep_one(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [2, 4, 64])
def test_links_through_crowded_keys(spark, hot):
    """The same components whether keys count as crowded or not: near copies around a few centres, and noise."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for _ in range(rng.randrange(0, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
        fps |= {centre ^ 0xF, centre ^ 0xFF0, centre ^ (7 << 60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = components(links(spark.createDataFrame(signed, "fp long"), hot=hot))
    root = {r["node"] % (1 << 64): r["root"] for r in found.collect()}
    groups = defaultdict(set)
    for f in fps:
        groups[root.get(f, ("alone", f))].add(f)
    want = defaultdict(set)
    for (_, f), r in brute_components([(f, f) for f in fps]).items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5000, 5001)]
    random.Random(1).shuffle(edges)
    rows = components(spark.createDataFrame([(max(e), min(e)) if i % 2 else e for i, e in enumerate(edges)], "a long, b long"))
    got = {r["node"]: r["root"] for r in rows.collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, 5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert rows.select(F.count_distinct("node")).first()[0] == rows.count()
