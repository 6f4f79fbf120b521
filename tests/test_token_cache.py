"""The incremental token cache: only changed rows are tokenised, a killed run leaves the old cache readable."""

import os

import pytest
from pyspark.sql import functions as F

from textpairs.sources import token_cache as C


def corpus(spark, rows):
    return spark.createDataFrame([(c, s, k, t) for (c, s, k), t in rows.items()], "corpus string, split string, id long, text string")


def tokenise(seen):
    def run(df):
        seen.append(sorted(r.id for r in df.select("id").collect()))
        return df.select("corpus", "split", "id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    return run


def rows_of(df):
    return {(r.corpus, r.split, r.id): r.ids for r in df.collect()}


def want(rows):
    return {k: None if t is None else [len(w) for w in t.split(" ")] for k, t in rows.items()}


BASE = {("paws", "train", i): f"text number {i}" for i in range(20)} | {("paws", "valid", i): f"held {i}" for i in range(5)} | {
    ("quora", "train", i): f"question {i} ?" for i in range(7)} | {("quora", "train", 99): None, ("quora", "train", 98): ""}


def test_a_second_run_tokenises_only_what_changed(spark, tmp_dir):
    at, seen = os.path.join(tmp_dir, "cache"), []
    assert C.load_cache(spark, at) is None and C.vacuum(spark, at) == []
    first = C.refresh_tokens(corpus(spark, BASE), at, "id", ["text"], tokenise(seen))
    assert first["tokenised"] == len(BASE) and rows_of(C.load_cache(spark, at)) == want(BASE)
    assert C.refresh_tokens(corpus(spark, BASE), at, "id", ["text"], tokenise(seen))["tokenised"] == 0 and len(seen) == 1

    now = dict(BASE)
    now["paws", "train", 3] = "another text"
    now["paws", "train", 500] = "new"
    now["quora", "train", 98] = None
    del now["quora", "train", 0]
    second = C.refresh_tokens(corpus(spark, now), at, "id", ["text"], tokenise(seen))
    assert seen[1] == [3, 98, 500] and second["tokenised"] == 3
    assert rows_of(C.load_cache(spark, at)) == want(now)
    made = {(r.corpus, r.split, r.id): r.generation for r in C.load_cache(spark, at).collect()}
    assert {k for k, g in made.items() if g == 2} == {("paws", "train", 3), ("paws", "train", 500), ("quora", "train", 98)}
    # the partition that did not change stays in its folder
    folders = {(p["corpus"], p["split"]): p["folder"] for p in second["partitions"]}
    assert folders["paws", "valid"] == first["partitions"][0]["folder"] != folders["paws", "train"]
    assert rows_of(C.load_cache(spark, at, corpus="quora", split="train")) == {k: v for k, v in want(now).items() if k[0] == "quora"}

    only = {k: v for k, v in now.items() if k[:2] == ("paws", "valid")}
    third = C.refresh_tokens(corpus(spark, only), at, "id", ["text"], tokenise(seen))
    assert third["tokenised"] == 0 and len(third["partitions"]) == 1 and rows_of(C.load_cache(spark, at)) == want(only)
    assert len(C.vacuum(spark, at)) == 1
    assert rows_of(C.load_cache(spark, at)) == want(only) and C.vacuum(spark, at) == []


def test_a_killed_run_leaves_the_old_cache_readable(spark, tmp_dir, monkeypatch):
    at, seen = os.path.join(tmp_dir, "cache"), []
    C.refresh_tokens(corpus(spark, BASE), at, "id", ["text"], tokenise(seen))
    reader = C.load_cache(spark, at)
    now = {**BASE, ("paws", "train", 1): "changed"}

    def fails(df):
        return df.select("corpus", "split", "id", F.raise_error(F.lit("killed")).cast("array<int>").alias("ids"))

    with pytest.raises(Exception, match="killed"):
        C.refresh_tokens(corpus(spark, now), at, "id", ["text"], fails)
    assert rows_of(C.load_cache(spark, at)) == want(BASE)

    def stop(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(C, "_write_manifest", stop)  # data written, manifest not swapped
    with pytest.raises(KeyboardInterrupt):
        C.refresh_tokens(corpus(spark, now), at, "id", ["text"], tokenise(seen))
    assert rows_of(C.load_cache(spark, at)) == want(BASE)
    monkeypatch.undo()
    open(os.path.join(at, "manifests", "2.json.abc.tmp"), "w").write("{")  # a draft that was never renamed
    C.refresh_tokens(corpus(spark, now), at, "id", ["text"], tokenise(seen))
    assert rows_of(C.load_cache(spark, at)) == want(now)
    assert rows_of(reader) == want(BASE)  # a reader of the old cache goes on
    assert len(C.vacuum(spark, at)) >= 1 and rows_of(C.load_cache(spark, at)) == want(now)


def test_repeated_rows_and_odd_names(spark, tmp_dir):
    at, seen = os.path.join(tmp_dir, "cache"), []
    twice = corpus(spark, BASE).unionByName(corpus(spark, BASE))
    assert C.refresh_tokens(twice, at, "id", ["text"], tokenise(seen))["tokenised"] == len(BASE)
    with pytest.raises(ValueError, match="plain words"):
        C.refresh_tokens(corpus(spark, {("a/b", "train", 1): "x"}), os.path.join(tmp_dir, "c2"), "id", ["text"], tokenise(seen))
    numbered = {("2024", "01", 1): "a b"}
    C.refresh_tokens(corpus(spark, numbered), os.path.join(tmp_dir, "c3"), "id", ["text"], tokenise(seen))
    assert rows_of(C.load_cache(spark, os.path.join(tmp_dir, "c3"))) == want(numbered)
