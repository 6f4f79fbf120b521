"""A token cache that grows by what changed.

The cache holds tokenised rows by (corpus, split), each with the hash of its
text and the generation that tokenised it.  A refresh

1. compares the corpus with the cache by (corpus, split, key, hash) and
   tokenises only the rows that the cache lacks (an anti-join);
2. writes the partitions that gained or lost rows into a folder of a new
   generation, kept rows copied as they are; other partitions are not touched;
3. swaps the manifest: a small file that lists the folder of every partition is
   written under another name and renamed.

Nothing that the old manifest names is changed or deleted, so a refresh that is
killed at any point leaves the old cache readable, and readers of the old one
go on undisturbed.  ``vacuum`` removes what the newest manifest does not name.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.session import cuts, materialise

PARTS = ("corpus", "split")
HASH, MADE = "text_hash", "generation"


def text_hash(cols: Sequence[str]) -> Column:
    """Hash of the texts of a row; a null text is not an empty one."""
    each = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("|", *each), 256)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, directory: str) -> dict | None:
    """The newest complete manifest: ``{"number": n, "partitions": [{corpus, split, folder, rows}]}``."""
    at, fs = _path(spark, os.path.join(directory, "manifests"))
    if not fs.exists(at):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
    if not numbers:
        return None
    file, fs = _path(spark, os.path.join(directory, "manifests", f"{max(numbers)}.json"))
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, directory: str, manifest: dict) -> None:
    name = os.path.join(directory, "manifests", f"{manifest['number']}.json")
    draft, fs = _path(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft)
    try:
        out.write(json.dumps(manifest).encode())
    finally:
        out.close()
    final, _ = _path(spark, name)
    if not fs.rename(draft, final):
        raise RuntimeError(f"another refresh wrote manifest {manifest['number']}")


def load_cache(spark: SparkSession, directory: str, corpus: str | None = None, split: str | None = None) -> DataFrame | None:
    """The cached rows (only the folders of the partitions asked for are listed); None without a cache or partition."""
    manifest = read_manifest(spark, directory)
    if manifest is None:
        return None
    out = schema = None
    for p in manifest["partitions"]:  # the names are constants of a read: a filter on them prunes
        if corpus in (None, p["corpus"]) and split in (None, p["split"]):
            one = (spark.read.schema(schema) if schema else spark.read).parquet(_partition(p["folder"], p))
            schema = schema or one.schema
            one = one.withColumns({c: F.lit(p[c]) for c in PARTS})
            out = one if out is None else out.unionByName(one)
    return out


def _partition(folder: str, p: dict) -> str:
    return os.path.join(folder, *(f"{c}={p[c]}" for c in PARTS))


def refresh_tokens(df: DataFrame, directory: str, key: str, texts: Sequence[str],
                   tokenise: Callable[[DataFrame], DataFrame]) -> dict:
    """Bring the cache to the state of ``df(corpus, split, key, texts...)``; returns the new manifest.

    ``tokenise`` gets the rows that have to be tokenised, with all columns of
    ``df``, and returns ``corpus, split, key`` and its id columns.  Corpus and split
    names are plain words (letters, digits, ``_.-``).  Rows that repeat key
    and texts count once.  The manifest says how many rows were tokenised.
    """
    spark = df.sparkSession
    old = read_manifest(spark, directory) or {"number": 0, "partitions": []}
    number = old["number"] + 1
    same = [*PARTS, key, HASH]
    with cuts(spark):
        src = df.withColumn(HASH, text_hash(texts)).dropDuplicates(same)
        cache = load_cache(spark, directory)
        keys = materialise(src.select(*same))
        fresh = materialise(src if cache is None else src.join(cache.select(*same), same, "left_anti"))
        gained = {(r[0], r[1]): r[2] for r in fresh.groupBy(*PARTS).count().collect()}  # a row per partition
        bad = [x for part in gained for x in part if not x or not all(ch.isalnum() or ch in "_.-" for ch in x)]
        if bad:
            raise ValueError(f"corpus and split names must be plain words: {bad[0]!r}")
        kept = None if cache is None else cache.join(keys, same, "left_semi")
        stay = {} if kept is None else {(r[0], r[1]): r[2] for r in kept.groupBy(*PARTS).count().collect()}
        before = {(p["corpus"], p["split"]): p for p in old["partitions"]}
        touched = {p for p in set(gained) | set(before) if gained.get(p) or stay.get(p, 0) != before.get(p, {"rows": 0})["rows"]}
        if not touched:
            return {**old, "tokenised": 0}
        folder = os.path.join(directory, f"generation-{number}-{uuid.uuid4().hex}")
        back = fresh.select(*same).withColumn(MADE, F.lit(number))
        out = tokenise(fresh.drop(HASH)).join(back, [*PARTS, key])
        if kept is not None:
            here = F.concat_ws("/", *PARTS).isin([f"{c}/{s}" for c, s in touched])
            out = out.unionByName(kept.filter(here).select(*out.columns))
        if any(gained.get(p, 0) + stay.get(p, 0) for p in touched):
            out.write.partitionBy(*PARTS).parquet(folder)
        partitions = [p for at, p in before.items() if at not in touched]
        partitions += [{"corpus": c, "split": s, "folder": folder, "rows": n} for c, s in sorted(touched)
                       if (n := gained.get((c, s), 0) + stay.get((c, s), 0))]
        _write_manifest(spark, directory, {"number": number, "partitions": partitions})
        return {"number": number, "partitions": partitions, "tokenised": sum(gained.values())}


def vacuum(spark: SparkSession, directory: str) -> list[str]:
    """Delete generations that the newest manifest does not name, and older manifests; returns the folders deleted."""
    manifest = read_manifest(spark, directory)
    if manifest is None:
        return []
    named = {os.path.basename(p["folder"]) for p in manifest["partitions"]}
    at, fs = _path(spark, directory)
    gone = [f.getPath().toString() for f in fs.listStatus(at)
            if f.getPath().getName().startswith("generation-") and f.getPath().getName() not in named]
    for folder in gone:
        fs.delete(_path(spark, folder)[0], True)
    at, fs = _path(spark, os.path.join(directory, "manifests"))
    for f in fs.listStatus(at):
        if f.getPath().getName() != f"{manifest['number']}.json":
            fs.delete(f.getPath(), False)
    return gone
