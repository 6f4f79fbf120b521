"""Language identification by prediction by partial matching (operator 9).

For every language a variable-order context tree over UTF-8 bytes (A-Z
lower-cased) holds how often each byte followed each context of 0 to 3 bytes.
The code length of a byte under a tree is found at the longest context: a byte
seen there costs ``-log2(count / (total + distinct))``, another costs the
escape ``-log2(distinct / (total + distinct))`` plus its cost one order lower; a context
never seen costs nothing and passes on; below order 0 every byte costs 8 bits.
A text goes to the language that codes it in the fewest bits; statistics are
frozen before scoring.

Learning counts 4-byte runs over all learnable documents (Arrow batches, then
a sum by run that combines map-side); lower orders are marginal sums.  All
counts are kept.  The trees are cut into shares of at most about ``4 * nodes``
entries: by blocks of languages, and within a block by the last context byte,
as a byte's code length asks only contexts that end in the byte before it.
Workers hold one share at a time.  Code lengths are a function of 4 bytes,
tabled once per share; a document is scored by table look-ups over all its
bytes, in slices, summed over the shares, without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
as is everything when no language could be learnt; ties go to the first
language in code-point order; null lang is not learnt from; repeated rows
count and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm.quality import held_out
from textpairs.llm.stored import stored

#: Parameters.
ORDERS = 4
NODES = 400_000
WIDE = 16
FOLDS = 4
HELD_OUT = 2
UNDETERMINED = "und"

_PAD = b"\n\n\n"
_SLICE = 1 << 20
_HELD = 1 << 22
_SLOT_BITS = 21


def _runs(data: np.ndarray) -> np.ndarray:
    """All 4-byte runs of a byte array, as numbers."""
    b = data.astype(np.uint32)
    return (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(_PAD + text.lower(), np.uint8)


def count_runs(docs: DataFrame) -> DataFrame:
    """``docs(lang, text)`` -> (lang, run, n): 4-byte runs, every text behind three line feeds."""

    def counted(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()),
                                           pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                                          names=["lang", "run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = _padded(text.as_py() or b"")
                for at in range(0, len(data) - 3, _SLICE):
                    runs = _runs(data[at:at + _SLICE + 3])
                    waiting.setdefault(lang, []).append(runs)
                    held[lang] = held.get(lang, 0) + len(runs)
                    if held[lang] >= _HELD:  # what waits to be counted stays bounded
                        yield counted(lang, waiting.pop(lang))
                        held[lang] = 0
        for lang, parts in waiting.items():
            yield counted(lang, parts)

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def entries(runs: DataFrame) -> DataFrame:
    """The whole trees: (lang, order, gram, n), order = bytes of context plus one."""
    orders = F.array(*[F.struct(F.lit(k).alias("order"), F.col("run").bitwiseAND((1 << (8 * k)) - 1).alias("gram"))
                       for k in range(1, ORDERS + 1)])
    return (runs.select("lang", "n", F.explode(orders).alias("o")).groupBy("lang", "o.order", "o.gram")
            .agg(F.sum("n").alias("n")))


class Model:
    """Code-length tables of the languages of a table, for runs whose third byte lies in ``asked``."""

    def __init__(self, trees: pa.Table, asked: tuple[int, int] = (0, 256)):
        self.asked = asked
        langs = trees["lang"].to_pylist()
        self.langs = sorted(set(langs))
        of = {x: i for i, x in enumerate(self.langs)}
        lang = np.fromiter((of[x] for x in langs), np.int64, len(langs))
        order, gram, n = (trees[c].to_numpy() for c in ("order", "gram", "n"))
        wide = len(self.langs)
        self.grams: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        for k in range(1, ORDERS + 1):
            at = order == k
            grams, place = np.unique(gram[at], return_inverse=True)
            contexts, ctx = np.unique(gram[at] >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), wide)), np.zeros((len(contexts), wide))
            np.add.at(total, (ctx, lang[at]), n[at])
            np.add.at(distinct, (ctx, lang[at]), 1)
            count = np.zeros((len(grams), wide))
            count[place, lang[at]] = n[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = np.searchsorted(contexts, grams >> 8)
                cost = -np.log2(count / (total + distinct)[own])
            lower = self.fallback(k, grams & ((1 << (8 * (k - 1))) - 1))
            self.grams.append(grams)
            self.costs.append(np.where(count > 0, cost, escape[own] + lower))
            self.contexts.append(contexts)
            self.escapes.append(escape)
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)
        self.top = self.grams[-1].astype(np.uint32)
        self.slots[self._slot(self.top)] = np.arange(len(self.top))
        self.by_lang = [np.ascontiguousarray(self.costs[-1][:, i]) for i in range(wide)]

    @staticmethod
    def _slot(runs: np.ndarray) -> np.ndarray:
        return (runs * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOT_BITS)

    def fallback(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Costs per language at the orders below ``k``, for runs of k - 1 bytes."""
        if k == 1:
            return np.full((len(grams), len(self.langs)), 8.0)
        known, costs = self.grams[k - 2], self.costs[k - 2]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        out = costs[at]
        miss = np.flatnonzero(known[at] != grams)
        if len(miss):
            out[miss] = self.escape(k - 1, grams[miss])
        return out

    def escape(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Costs of runs of ``k`` bytes that no language holds: escape, then one order lower."""
        contexts = self.contexts[k - 1]
        at = np.minimum(np.searchsorted(contexts, grams >> 8), len(contexts) - 1)
        step = np.where((contexts[at] == grams >> 8)[:, None], self.escapes[k - 1][at], 0.0)
        return step + self.fallback(k, grams & ((1 << (8 * (k - 1))) - 1))

    def bits(self, text: bytes) -> np.ndarray:
        """Code length of a text under every language."""
        total = np.zeros(len(self.langs))
        data = _padded(text)
        for at in range(0, len(data) - 3, _SLICE):
            runs = _runs(data[at:at + _SLICE + 3])
            if self.asked != (0, 256):
                last = (runs >> np.uint32(8)) & np.uint32(255)
                runs = runs[(last >= self.asked[0]) & (last < self.asked[1])]
            place = self.slots[self._slot(runs)]
            miss = np.flatnonzero(self.top[place] != runs)
            if len(miss):  # a slot taken by another run, or a run that no tree holds
                found = np.minimum(np.searchsorted(self.top, runs[miss]), len(self.top) - 1)
                place[miss] = found
                new = miss[self.top[found] != runs[miss]]
                if len(new):
                    total += self.escape(ORDERS, runs[new].astype(np.int64)).sum(axis=0)
                    place = np.delete(place, new)
            for i, costs in enumerate(self.by_lang):
                total[i] += costs[place].sum()
        return total


class Trees:
    """The models of all languages as broadcast shares, by blocks of languages in code-point order."""

    def __init__(self, blocks: list[tuple[list[str], list[Broadcast]]]):
        self.blocks = blocks
        self.langs = [x for langs, _ in blocks for x in langs]
        self.single = sum(len(shares) for _, shares in blocks) == 1

    def _block_bits(self, langs: list[str], shares: list[Broadcast], texts: list[pa.Scalar]) -> np.ndarray:
        out = np.zeros((len(texts), len(langs)))
        for share in shares:
            model = share.value
            for row, text in zip(out, texts):
                row += model.bits(text.as_py())
            if not self.single:
                share.__dict__.pop("_value", None)  # one share at a time
        return out

    def bits(self, text: bytes) -> np.ndarray:
        """Code length of a text under every language."""
        return np.concatenate([self._block_bits(*x, [pa.scalar(text, pa.binary())])[0] for x in self.blocks])

    def predict(self, texts: list[pa.Scalar]) -> list[tuple[str, float]]:
        """``(language, score)`` of each text."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        told = [i for i, x in enumerate(texts) if x.is_valid and any(map(str.isalpha, x.as_py().decode("utf-8", "replace")))]
        if not told:
            return out
        best, total = np.full(len(told), np.inf), np.zeros(len(told))
        name = np.zeros(len(told), np.int64)
        at = 0
        for langs, shares in self.blocks:
            bits = self._block_bits(langs, shares, [texts[i] for i in told])
            least = np.minimum(best, bits.min(axis=1))
            name = np.where(bits.min(axis=1) < best, at + bits.argmin(axis=1), name)
            total = total * np.exp2(np.maximum(least - best, -1000.0)) + np.exp2(
                np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
            best = least
            at += len(langs)
        for i, k, t in zip(told, name, total):
            out[i] = self.langs[k], float(1 / t)
        return out


def _shares(sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of byte values from 0 to 256, of at most ``most`` entries or one value each."""
    cuts, held = [0], 0
    for v in range(256):
        n = sizes.get(v, 0)
        if held and held + n > most:
            cuts.append(v)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], 256]))


def learn(docs: DataFrame, nodes: int = NODES) -> Trees | None:
    """Trees from every row of ``docs(lang, text)`` with both given, in shares of about ``4 * nodes`` entries."""
    runs = stored(count_runs(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())), "byte-runs")
    last = F.when(F.col("order") > 1, F.shiftright("gram", 8).bitwiseAND(255)).otherwise(-1)
    trees = stored(entries(runs).withColumn("last", last), "byte-trees")
    # at most 257 numbers a language
    sizes: dict[str, dict[int, int]] = {}
    for r in trees.groupBy("lang", "last").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        sizes.setdefault(r["lang"], {})[r["last"]] = r["n"]
    langs = sorted(sizes)
    sc = docs.sparkSession.sparkContext
    blocks = []
    for i in range(0, len(langs), WIDE):
        block = langs[i:i + WIDE]
        by_last: Counter = Counter()
        for x in block:
            by_last.update(sizes[x])
        shares = []
        for lo, hi in _shares(by_last, ORDERS * nodes):
            part = trees.filter(F.col("lang").isin(block) & ((F.col("order") == 1) | (F.col("last") >= lo) & (F.col("last") < hi)))
            shares.append(sc.broadcast(Model(part.select("lang", "order", "gram", "n").toArrow(), (lo, hi))))
        blocks.append((block, shares))
    return Trees(blocks) if blocks else None


def identify(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = trees.predict(list(b.column(1))) if trees is not None else [(UNDETERMINED, 0.0)] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()),
                                              pa.array([x[1] for x in found], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_ids(docs: DataFrame, nodes: int = NODES) -> DataFrame:
    """One row per document of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score."""
    aside = held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    model = learn(docs.filter(~aside).select("lang", "text"), nodes)
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
