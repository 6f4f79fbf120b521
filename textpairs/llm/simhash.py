"""SimHash near-de-duplication by multi-index hashing (operator 2).

Fingerprints: A-Z lower-cased words, 3-word shingles with repeats, XXH64
(seed 42) of each, bit set when set in over half of them.  Arrow batches of
UTF-8 text go through numpy; a document is one row in and one number out.

Search: a 64-bit fingerprint is cut into two 32-bit segments.  Fingerprints
within 3 bits agree up to one bit in one of them, so each distinct fingerprint
probes, per segment, the Hamming ball of radius 1 (33 keys) in a table of all
segments, and matches are verified by the whole distance.

Segment keys that many distinct fingerprints share (``hot`` and more) would
make pairs by the square.  They leave the tables and are linked exactly in
linear size instead: fingerprints a and b lie within 3 bits exactly if some
point lies within 1 bit of a and within 2 of b.  Each such fingerprint writes
its points of radius 0 to 2; per point, if anyone lies within 1, the smallest
of those links to all others that wrote the point.

Components: alternating large-star and small-star rounds over the links,
each round written as Parquet under the checkpoint folder.

Defined cases: null, empty and wordless texts have fingerprint zero and link
like any other; fewer than three words make one shingle; repeated rows give
repeated results; null ids are kept, as component null unless a group mate has
an id; an empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.stored import stored
from textpairs.llm.words import unused

SHINGLE = 3
MAX_BITS = 3
#: Distinct fingerprints under one segment key from which its links are found by points.
HOT = 64
SEED = 42


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text, as a signed number."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes.lower touches A-Z only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at:at + 8192].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * count > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """``(doc_id, fp)`` per row, and the row's key if ``row_col`` names one."""
    keys = [row_col] if row_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py() or b"", shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]],
                                             names=["doc_id", "fp", *keys])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), *keys)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keys)))


def _flip(value: Column, bits: int, radius: int) -> Column:
    """All values within ``radius`` (0 to 2) bits, first the value itself."""
    masks = [0] + [1 << i for i in range(bits)] * (radius >= 1)
    if radius >= 2:
        masks += [(1 << i) | (1 << j) for i in range(bits) for j in range(i)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: value.bitwiseXOR(m))


def _segments(fps: DataFrame) -> DataFrame:
    low = F.lit((1 << 32) - 1)
    parts = F.array(*[F.struct(F.lit(i).alias("seg"), v.alias("key")) for i, v in enumerate((
        F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low)))])
    return fps.select("fp", F.explode(parts).alias("p")).select("fp", "p.seg", "p.key")


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Links between distinct fingerprints ``fps(fp)`` within ``max_bits`` (at most 3): ``(a, b)``, a < b.

    From groups under hot keys come links that connect the same fingerprints,
    not every pair.
    """
    if max_bits > 3:
        raise ValueError("two segments with balls of radius 1 hold up to 3 bits")
    segs = stored(_segments(fps), "simhash-segments")
    crowded = segs.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot)
    probes = segs.withColumn("key", F.explode(_flip(F.col("key"), 32, 1)))
    # a probe of a crowded key, or from one, is left to the points
    calm = segs.join(crowded, ["seg", "key"], "left_anti")
    near = calm.select("seg", "key", F.col("fp").alias("b"))
    pairs = probes.withColumnRenamed("fp", "a").join(near, ["seg", "key"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    pairs = pairs.select("a", "b")

    # whoever lies in a crowded key, or probes one, takes part with its points
    beside = crowded.select("seg", F.explode(_flip(F.col("key"), 32, 1)).alias("key"))
    warm = segs.join(beside, ["seg", "key"], "left_semi").select("fp").distinct()
    reach = F.explode(F.concat(
        F.transform(_flip(F.col("fp"), 64, 1), lambda c: F.struct(c.alias("c"), F.lit(True).alias("close"))),
        F.transform(F.slice(_flip(F.col("fp"), 64, 2), 66, 2016),
                    lambda c: F.struct(c.alias("c"), F.lit(False).alias("close")))))
    points = warm.select("fp", reach.alias("p")).select("fp", "p.c", "p.close")
    # at most 2081 fingerprints lie within 2 bits of a point, so a group is bounded
    met = points.groupBy("c").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"),
                                  F.collect_set("fp").alias("all"))
    met = met.filter(F.col("hub").isNotNull() & (F.size("all") > 1))
    by_point = met.select(F.col("hub"), F.explode("all").alias("fp")).filter("hub <> fp")
    by_point = by_point.filter(F.bit_count(F.col("hub").bitwiseXOR(F.col("fp"))) <= max_bits)
    by_point = by_point.select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b"))
    return pairs.unionByName(by_point).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)`` for every node, root its smallest node.

    Large-star: each node links its larger neighbours to its smallest one.
    Small-star: each node links its smaller neighbours to the smallest of them.
    Both keep the components; they end in stars around the smallest nodes.
    """
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "links")
    size = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = (small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
                 .filter("a <> b").distinct())
        now = stored(small, "links")
        # done when the edges are stars and did not change: their number and a sum of hashes stay the same
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == size:
            break
        size = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def _least(fps: DataFrame, value: Column, max_bits: int, hot: int) -> DataFrame:
    """``(fp, least)``: the smallest value of each fingerprint's component, nulls aside."""
    reps = fps.groupBy("fp").agg(F.min(value).alias("least"))
    found = components(links(reps.select("fp"), max_bits, hot))
    per_fp = reps.join(found, reps["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    # least of the component, then back to the fingerprints
    least = per_fp.groupBy("root").agg(F.min("least").alias("least"))
    return per_fp.drop("least").join(least, "root").select("fp", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fp (long), fingerprint (hex), component_id (smallest doc_id reachable)."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    of = _least(fps, F.col("doc_id"), max_bits, hot).withColumnRenamed("least", "component_id")
    out = fps.join(of, "fp", "left")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS, hot: int = HOT, repeats: bool = True) -> DataFrame:
    """The row of the smallest id of each component, all columns kept; a row without an id stays only if no
    row of its component has one.

    With ``repeats``, other rows of the kept id in the component stay too; without, one row is left of each.
    """
    # rows are told apart by a key that is written with them: ids may be null or repeat
    row, drop_col = unused(docs.columns, "__row"), unused(docs.columns, "__drop")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-documents")
    fps = stored(fingerprints(rows, id_col, text_col, shingle, row), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)
    of = _least(fps, first, max_bits, hot)
    stays = F.col(row) == F.col(f"least.{row}")
    if repeats:
        stays = stays | F.coalesce(F.col("doc_id") == F.col("least.doc_id"), F.lit(False))
    drop = fps.join(of, "fp").filter(~stays).select(F.col(row).alias(drop_col))
    return rows.join(drop, rows[row] == F.col(drop_col), "left_anti").drop(row)
