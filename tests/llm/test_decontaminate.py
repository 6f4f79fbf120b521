"""Operator 7: recall at the largest distance, exactness of what is returned."""

import random

import numpy as np
import pytest

from tests.conftest import SF_MID
from tests.llm.helpers import documents, odd_rows, prose
from textpairs.llm.decontaminate import (ItemIndex, allowed_edits, best_run, contaminated, drop_contaminated,
                                         hashed_words, sampled_walks)
from textpairs.llm.queries import QUERIES


def edited(rng, words, edits):
    out = list(words)
    for k in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"sub{k}{at}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"ins{k}{at}")
    return out


def brute_distance(a, b):
    """Edits from a to the nearest run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_best_run_equals_plain_dynamic_programming():
    rng = random.Random(2)
    for _ in range(150):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(0, 25))]
        d, s, e = best_run(np.array(a, np.uint64), np.array(b, np.uint64))
        assert d == brute_distance(a, b)
        assert brute_distance(a, b[s:e]) == d


def test_recall_at_the_largest_distance_and_no_false_match():
    rng = random.Random(6)
    items = [(i, prose(1000 + i, rng.randrange(15, 60)).encode()) for i in range(120)]
    index = ItemIndex(items)
    docs, want = [], set()
    for i, (item, text) in enumerate(items):
        words = edited(rng, text.decode().split(), allowed_edits(len(text.split())))
        docs.append((i, (prose(i, 80) + " " + " ".join(words) + "\n" + prose(i + 500, 60)).encode()))
        want.add((i, item))
    docs += [(1000 + i, prose(5000 + i, 200).encode()) for i in range(60)]
    found = list(index.matches(docs))
    got = {(m[0], m[1]) for m in found}
    assert len(got & want) >= 0.99 * len(want)
    texts = dict(items)
    for doc, item, s, e, n, edits in found:  # every match is real
        words = dict(docs)[doc].split()[s:e]
        assert edits <= allowed_edits(n) and brute_distance(texts[item].split(), words) == edits


def test_single_walks_agree_more_the_nearer():
    rng = random.Random(8)
    share = []
    for edits in (0, 1, 4, 12):
        same = []
        for k in range(40):
            a = prose(k, 40).split()
            x, y = (hashed_words(" ".join(w).encode()) for w in (a, edited(rng, a, edits)))
            y = np.resize(y, 40) if len(y) >= 40 else np.concatenate((y, np.zeros(40 - len(y), np.uint64)))
            keys = sampled_walks([x, y])
            same.append((keys[0] == keys[1]).mean())
        share.append(sum(same) / len(same))
    assert share[0] == 1 and share[0] > share[1] > share[2] > share[3]


def test_query_finds_every_whole_item(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items
            if " ".join(i["text"].split()) in " ".join(d["text"].split())}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontaminate"](spark, SF_MID).collect()}
    assert want <= got and want
    texts, own = {d["doc_id"]: d["text"] for d in docs}, {i["item_id"]: i["text"] for i in items}
    for doc, item in got - want:
        a, b = hashed_words(own[item].encode()).tolist(), hashed_words(texts[doc].encode()).tolist()
        assert brute_distance(a, b) <= allowed_edits(len(a))


def bench(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("t", F.lit(1))


def test_odd_rows_and_item_blocks(spark):
    item = prose(5, 60)
    items = bench(spark, [(1, item), (2, item), (3, None), (4, " "), (5, "one"), (6, prose(3000, 20)), (1, item)])
    docs = documents(spark, odd_rows(), extra=True)
    got = sorted({(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()})
    assert got == [(4, 5), (5, 1), (5, 2), (6, 1), (6, 2)]
    assert sorted({(r["doc_id"], r["item_id"]) for r in contaminated(docs, items, item_block=2).collect()}) == got
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect())
    assert ids == [-1, 1, 2, 3, 7, 8, 10]
    assert drop_contaminated(docs, items, item_block=2).count() == len(ids)
    assert contaminated(docs, bench(spark, [])).count() == 0 and drop_contaminated(docs, bench(spark, [])).count() == docs.count()
    assert contaminated(documents(spark, []), items).count() == 0


def test_case_punctuation_and_line_breaks_do_not_hide_an_item():
    item = prose(42, 30)
    index = ItemIndex([(1, item.encode())])
    shown = item.upper().replace(" ", ",\n", 5)
    assert [m[:2] for m in index.matches([(9, ("x y z " + shown + "! end").encode())])] == [(9, 1)]
    twice = list(index.matches([(9, f"{item} mid {item}".encode())]))
    assert len(twice) == 2


def fresh(rng, n):
    return [f"v{rng.randrange(20_000)}" for _ in range(n)]


def worn(rng, words, kind):
    """The words at their largest distance, by one kind of edit."""
    out = list(words)
    for _ in range(allowed_edits(len(words))):
        what = rng.choice(["sub", "ins", "del"]) if kind == "mixed" else kind
        at = 0 if what == "front" else len(out) - 1 if what == "back" else rng.randrange(len(out))
        if what == "sub":
            out[at] = fresh(rng, 1)[0]
        elif what == "ins":
            out.insert(at, fresh(rng, 1)[0])
        else:
            del out[at]
    return out


@pytest.mark.parametrize("n", [10, 16, 50, 100, 200])
@pytest.mark.parametrize("kind", ["sub", "ins", "del", "mixed", "front", "back"])
def test_recall_per_kind_of_edit_and_length(n, kind):
    rng = random.Random(n)
    items = [(i, fresh(rng, n)) for i in range(100)]
    index = ItemIndex([(i, " ".join(w).encode()) for i, w in items])
    docs = [(i, " ".join(fresh(rng, n) + worn(rng, w, kind) + fresh(rng, n)).encode()) for i, w in items]
    found = {m[:2] for m in index.matches(docs)}
    assert len(found & {(i, i) for i, _ in items}) >= 95


@pytest.mark.parametrize("n", [10, 16, 50, 100, 200])
def test_unrelated_windows_are_rarely_candidates(n):
    rng = random.Random(n + 1)
    index = ItemIndex([(i, " ".join(fresh(rng, n)).encode()) for i in range(20)])
    windows = [hashed_words(" ".join(fresh(rng, n)).encode()) for _ in range(1500)]
    named = sum(any((r, key) in index.buckets for r, key in enumerate(keys)) for keys in sampled_walks(windows).tolist())
    assert named < 15
    assert all(key for _, key in index.buckets)


def test_walks_that_have_passed_the_text_name_nothing():
    short = np.arange(1, 3, dtype=np.uint64) << np.uint64(40)
    padded = np.concatenate((short, np.zeros(60, np.uint64)))
    keys = sampled_walks([padded])[0]
    assert (keys == 0).mean() > 0.5
    same = sampled_walks([short, short])
    assert (same[0] == same[1]).all() and (same[0] != 0).any()
