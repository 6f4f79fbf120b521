"""Filter interaction audit by contraction of contingency tensors (operator 13).

Five filters pass or fail every document.  Per part (source) the documents are
counted by their five outcomes: a 2x2x2x2x2 tensor, axis by axis pass or fail.
Everything the audit asks of an order of the filters is a contraction of that
tensor: a step selects pass (filters before it), fail (its own) or all (filters
after it) along each axis, and einsum adds up what is selected.  The tensors
are five-dimensional whatever the corpus, so all 120 orders cost 120 x 5 small
sums a part, not 600 passes over documents.

Counting: texts are read once; documents are narrowed to (id, part, digest of
the text, outcomes) where they lie, and that table is written.  A document fails E if its text's smallest id is another:
the smallest id per digest is a map-side minimum, and it joins back on (digest,
id), so that a text that a third of all rows share meets one row of the join
and not a third of them.  Labels are semi-joins on the id, which leaves large
sides to be split by the optimiser.  Outcome counts combine map-side and are
gathered into one row of 32 cells per part; parts are contracted in Arrow
batches wherever they lie.

Defined cases: a null text counts as empty; a null source is the part ``""``,
one with an empty source; equal texts under the same id pass E alike; a null
id has no smaller id, is none, and has no label; a label counts if any row of
its id has it; repeated rows are documents of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.stored import stored
from textpairs.llm.words import text_or_empty, words_of

FILTERS = "ABCDE"
#: Limits of the filters.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SIGNS = "[#$%&*|]"

CELLS = 1 << len(FILTERS)
COUNTED = ("every", "good", "toxic")
#: Selections along an axis: weights of (pass, fail).
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

_OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long")


def text_outcomes(text: Column, words: Column) -> Column:
    """Failures of A to D as a number of four bits, A highest."""
    n = F.size(words)
    fails = [n < MIN_WORDS,
             100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
             100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_UPPER_PERCENT * F.length(text).cast("long"),
             text.rlike(SIGNS)]
    code = F.lit(0)
    for k, f in enumerate(fails):
        code = code + F.when(f, 1 << (len(FILTERS) - 1 - k)).otherwise(0)
    return code


def document_outcomes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      part_col: str = "source") -> DataFrame:
    """``(id, part, code, n)``: documents by id, part and their five outcomes (a bit each, A highest, E lowest)."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                     text_or_empty(text_col).alias("t"))
    df = df.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), "t", words_of(F.col("t")).alias("w"))
    rows = stored(df.select("id", "part", "digest", text_outcomes(F.col("t"), F.col("w")).alias("code"))
                  .groupBy("id", "part", "digest", "code").agg(F.count(F.lit(1)).alias("n")), "outcomes")
    first = (rows.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("first")).filter("first is not null"))
    joined = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("id") == F.col("first")), "left")
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    return joined.select("id", "part", (F.col("code") + copy.cast("int")).alias("code"), "n")


def contingency(outcomes: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """One row per part: a list of 32 counts for all documents, those of label quality = 1 and those of toxic = 1."""

    def cells(df: DataFrame, kind: str) -> DataFrame:
        return df.groupBy("part", "code").agg(F.sum("n").alias("n")).withColumn("kind", F.lit(kind))

    def labelled(flag: str) -> DataFrame:
        ids = labels.filter(F.col(flag) == 1).select(F.col(label_id).alias("of"))
        return cells(outcomes.join(ids, F.col("id") == F.col("of"), "left_semi"), flag)

    counts = cells(outcomes, "every").unionByName(labelled("quality")).unionByName(labelled("toxic"))
    kinds = ("every", "quality", "toxic")
    return counts.groupBy("part").agg(*[
        F.array(*[F.sum(F.when((F.col("kind") == kind) & (F.col("code") == c), F.col("n")).otherwise(0))
                  for c in range(CELLS)]).alias(name) for kind, name in zip(kinds, COUNTED)])


def _selection(order: tuple[int, ...], before, own, after) -> list:
    """What each step of an order selects along each axis: (steps, axes, 2)."""
    out = []
    for step, axis in enumerate(order):
        pick = [after] * len(order)
        for a in order[:step]:
            pick[a] = before
        pick[axis] = own
        out.append(pick)
    return out


def contract(tensor: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """(parts, steps): what each step's selection (steps, axes, 2) adds up of each part's tensor (parts, 2, 2, 2, 2, 2)."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensor, *np.moveaxis(pick, 1, 0), optimize="greedy")


def audit(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Figures (parts, orders x steps) from counts (parts, 32) of all, good and toxic documents."""
    n = len(FILTERS)
    orders = list(permutations(range(n)))
    tensor = {k: np.asarray(v, np.int64).reshape((-1,) + (2,) * n) for k, v in counts.items()}
    picks = {name: np.array([s for o in orders for s in _selection(o, *kind)], np.int64) for name, kind in (
        ("kept", (PASS, PASS, ALL)), ("removed", (PASS, FAIL, ALL)), ("failing", (ALL, FAIL, ALL)),
        ("unique_fails", (PASS, FAIL, PASS)))}
    out = {name: contract(tensor["every"], pick) for name, pick in picks.items()}
    out["redundant"] = out.pop("failing") - out["removed"]
    out["good_lost"], out["toxic_lost"] = (contract(tensor[k], picks["removed"]) for k in ("good", "toxic"))
    # what a filter removes, summed over all orders wherever it stands
    axis = np.array([a for o in orders for a in o])
    share = np.stack([out["removed"][:, axis == a].sum(axis=1) for a in range(n)], axis=1)
    out["shapley"] = share[:, axis]
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    table = contingency(document_outcomes(docs, id_col, text_col, part_col), labels)
    names = [f.split()[0] for f in _OUT.split(", ")]
    orders = ["".join(o) for o in permutations(FILTERS) for _ in o]
    steps = [k + 1 for _ in permutations(FILTERS) for k in range(len(FILTERS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # 600 rows a part
                b = whole.slice(at, 256)
                found = audit({k: np.array(b.column(1 + i).to_pylist(), np.int64).reshape(-1, CELLS)
                               for i, k in enumerate(COUNTED)})
                each = pa.array(np.repeat(np.arange(b.num_rows), len(orders)))
                figures = [pa.array(found[k].ravel(), pa.int64()) for k in names[3:]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(each), pa.array(orders * b.num_rows), pa.array(steps * b.num_rows, pa.int32()),
                     *figures], names=names)

    return table.mapInArrow(run, _OUT)
