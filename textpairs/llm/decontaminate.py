"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 7).

A document is contaminated by an item when some run of its words is within
``n // 5`` word edits of the item's ``n`` words (similarity of 0.8 or more; A-Z
lower-cased, ASCII punctuation dropped).

1. Windows of each item length slide over every document.  Within d edits an
   item-sized window shares at least ``n - 1 - 2 d`` word pairs with the item,
   so windows with fewer pairs of items of that length are left out; that
   loses no match.
2. Each remaining window, and each item, goes through ``repeats`` CGK random
   walks: a walk of ``3 n`` steps copies the word it stands on and moves on if a
   random bit of (walk, step, word) says so.  Texts at a small edit distance
   end up at a small Hamming distance.
3. Bit sampling: ``samples`` positions of each walk's output, all taken where
   the walk still stands on words, are hashed; a window is a candidate for the
   items with an equal hash in some walk, and a walk whose samples carry no word
   names none.  With ``p`` the chance that one walk agrees at all samples,
   recall is ``1 - (1 - p) ** repeats``.  At the largest distance the tests ask
   for a recall of 0.95 per kind of edit and length, and for unrelated windows
   as candidates in fewer than 1 % of cases.
4. Candidates are verified by the exact edit distance between the item and the
   best run of words around the window.

Items are taken in blocks of about ``item_block`` by the hash of their id; each
block is one pass over the documents, so what is shared with the workers is
bounded by a parameter.  Documents are never shuffled.

Defined cases: null or wordless texts and items match nothing; items of fewer
than five words match exactly; repeated rows give repeated results; equal
items are reported each; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm.words import word_hashes

#: Parameters.
REPEATS = 60
SAMPLES = 3
STRETCH = 3
LIVE = 0.6
EARLY = 30
GAP = 3
ITEM_BLOCK = 5000

_DROP = punctuation.encode()
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SLOT_BITS = 20
_MATCH = "doc_id long, item_id long, start_word long, end_word long, item_words long, edits long"


def hashed_words(text: bytes) -> np.ndarray:
    words = text.lower().translate(None, _DROP).split()
    return word_hashes(words)


def allowed_edits(n: int) -> int:
    return n // 5


def _pairs(words: np.ndarray) -> np.ndarray:
    return (words[:-1] * _PAIR ^ words[1:]) * _MIX


def _flat(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in windows], np.int64)
    out = np.zeros((len(windows), int(sizes.max()) + 1), np.uint64)
    for i, w in enumerate(windows):
        out[i, :len(w)] = w  # a zero word stands behind the end
    return out, sizes


def _reaches(sizes: np.ndarray, kind: int) -> np.ndarray:
    """Steps of a walk that its samples are taken from, by window size.

    A walk has passed the whole window after about two thirds of its steps, and
    texts that differ by many insertions drift apart along it: a third of the
    walks sample the live part, a third its first quarter, a third its first
    ``EARLY`` steps.
    """
    live = LIVE * STRETCH * sizes
    return (live, np.minimum(live, np.maximum(live / 2.4, EARLY)), np.minimum(live, EARLY))[kind]


def sampled_walks(windows: list[np.ndarray], repeats: int = REPEATS, samples: int = SAMPLES) -> np.ndarray:
    """(windows, repeats): the hash of the sampled positions of each walk; 0 where a sample carries no word."""
    words, sizes = _flat(windows)
    out = np.zeros((len(words), repeats), np.uint64)
    every = np.arange(len(words))
    for r in range(repeats):
        rng = np.random.default_rng(1000 + r)
        at = np.sort(rng.random(samples))  # the same places of a walk for equal lengths
        picked = (at[None, :] * _reaches(sizes, r % 3)[:, None]).astype(np.int64)
        for s in range(1, samples):  # so far apart that they rarely carry one word
            picked[:, s] = np.maximum(picked[:, s], picked[:, s - 1] + GAP)
        salts = rng.integers(1, 1 << 62, int(STRETCH * sizes.max()) + samples * GAP + 1, np.uint64) | np.uint64(1)
        order = np.argsort(-picked[:, -1], kind="stable")  # walks that are sampled to the end come first
        last = -picked[order, -1]
        seen = np.zeros((int(-last[0]) + 1, len(words)), np.uint64)
        place = np.zeros(len(words), np.int64)
        own, ends = words[order], sizes[order]
        for j in range(len(seen)):
            live = int(np.searchsorted(last, -j, side="right"))
            word = own[every[:live], place[:live]]
            seen[j, :live] = word
            place[:live] = np.minimum(place[:live] + ((word * salts[j]) >> np.uint64(63)).astype(np.int64), ends[:live])
        key, dead = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
        for s in range(samples):
            word = seen[picked[order, s], every]
            dead |= word == 0
            key = (key * _PAIR ^ word) * _MIX + np.uint64(s + 1)
        key ^= ends.astype(np.uint64)
        key[dead] = 0
        out[order, r] = key
    return out


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """``(edits, start, end)`` of the run of words nearest to the item (first end, shortest run on ties)."""

    def ends(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        along = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else along.copy()
        for i, x in enumerate(a):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
            row = np.minimum.accumulate(new - along) + along
        return row

    last = ends(item, words, True)
    end = int(np.argmin(last))
    edits = int(last[end])
    back = ends(item[::-1], words[:end][::-1], False)
    return edits, end - int(np.flatnonzero(back == edits)[0]) if (back == edits).any() else end, end


class ItemIndex:
    """One block of items: their word pairs by item length, and their sampled walks."""

    def __init__(self, items: list[tuple[int, bytes]], repeats: int = REPEATS, samples: int = SAMPLES):
        self.repeats, self.samples = repeats, samples
        self.items = [(i, w) for i, w in ((i, hashed_words(t)) for i, t in items) if len(w)]
        self.lengths = sorted({len(w) for _, w in self.items if len(w) > 1})
        self.singles = np.unique([w[0] for _, w in self.items if len(w) == 1]).astype(np.uint64)
        self.needed = [max(0, n - 1 - 2 * allowed_edits(n)) for n in self.lengths]
        every = [_pairs(w) for _, w in self.items]
        self.pairs = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        row = {n: k for k, n in enumerate(self.lengths)}
        self.most = max((int(np.unique(p, return_counts=True)[1].max()) for p in every if len(p)), default=1)
        self.of_length = np.zeros((len(self.lengths), len(self.pairs)), bool)
        for (_, w), p in zip(self.items, every):
            if len(w) > 1:
                self.of_length[row[len(w)], np.searchsorted(self.pairs, p)] = True
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.slots[self._slot(self.pairs)] = np.arange(len(self.pairs))
        self.buckets: dict[tuple[int, int], list[int]] = defaultdict(list)
        if self.items:
            for k, keys in enumerate(sampled_walks([w for _, w in self.items], repeats, samples).tolist()):
                for r, key in enumerate(keys):
                    if key:
                        self.buckets[r, key].append(k)
        # a window with enough pairs has this many in some run of as many pairs as the shortest item has
        self.step = max(1, min(self.lengths, default=2) - 1)
        self.least = min((-(-c // -(-(n - 1) // self.step)) for n, c in zip(self.lengths, self.needed)), default=0)

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _known(self, pairs: np.ndarray) -> np.ndarray:
        """Index of each pair among the items' pairs, or -1."""
        if not len(self.pairs):
            return np.full(len(pairs), -1)
        at = self.slots[self._slot(pairs)].astype(np.int64)
        miss = np.flatnonzero((at >= 0) & (self.pairs[at] != pairs))
        if len(miss):  # few pairs share a slot: settle those by search
            found = np.minimum(np.searchsorted(self.pairs, pairs[miss]), len(self.pairs) - 1)
            at[miss] = np.where(self.pairs[found] == pairs[miss], found, -1)
        return at

    def windows(self, words: np.ndarray) -> list[tuple[int, int]]:
        """``(start, length)`` of the item-sized windows with enough word pairs of items of their length.

        A pair counts in a window as often as an item may hold it (``most``) and no
        more: its place counts for the windows that begin behind its ``most``-th
        last appearance.
        """
        out = []
        if len(self.singles):  # items of one word have no pairs
            out += [(int(s), 1) for s in np.flatnonzero(np.isin(words, self.singles))]
        at = self._known(_pairs(words))
        hits = np.flatnonzero(at >= 0)
        if not len(hits) or len(hits) < self.least:
            return out
        pair = at[hits]
        order = np.argsort(pair, kind="stable")
        behind = np.full(len(hits), -1)
        same = pair[order[self.most:]] == pair[order[:-self.most]] if len(hits) > self.most else np.zeros(0, bool)
        behind[order[self.most:][same]] = hits[order[:-self.most][same]]

        def counts(places: np.ndarray, last: np.ndarray, size: int, starts: int) -> np.ndarray:
            first = np.maximum(np.maximum(places - size + 2, 0), last + 1)
            change = np.bincount(first, minlength=starts + 1)[:starts + 1]
            change = change - np.bincount(places + 1, minlength=starts + 1)[:starts + 1]
            return np.cumsum(change[:starts])

        if counts(hits, behind, min(self.step + 1, len(words)), len(words)).max() < self.least:
            return out
        for row, n, need in zip(self.of_length, self.lengths, self.needed):
            own = row[pair]
            if own.sum() < need:
                continue
            size = min(n, len(words))  # a window cut short by the end of the document still counts
            found = counts(hits[own], behind[own], size, len(words) - size + 1)
            out += [(int(s), n) for s in np.flatnonzero(found >= need)]
        return out

    def matches(self, docs: list[tuple[int | None, bytes]]) -> Iterator[tuple]:
        """Verified matches of a batch of documents."""
        texts, spots, windows = {}, [], []
        for k, (_, text) in enumerate(docs):
            words = hashed_words(text)
            found = self.windows(words)
            if found:
                texts[k] = words
                for s, n in found:
                    spots.append((k, s))
                    windows.append(_fit(words[s:s + n], n))
        near: dict[tuple[int, int], list[int]] = defaultdict(list)
        for at in range(0, len(windows), 20_000):
            keys = sampled_walks(windows[at:at + 20_000], self.repeats, self.samples).tolist()
            for (k, s), own in zip(spots[at:at + 20_000], keys):
                for item in {i for r, key in enumerate(own) for i in self.buckets.get((r, key), ())}:
                    near[k, item].append(s)
        for (k, item), starts in sorted(near.items()):
            item_id, words = self.items[item]
            n, edits = len(words), allowed_edits(len(words))
            low = None
            for s in sorted(starts):
                if low is not None and s > high + n:
                    yield from self._verified(docs[k][0], item_id, words, texts[k], low, high + n + edits)
                    low = None
                low, high = (s if low is None else low), s
            yield from self._verified(docs[k][0], item_id, words, texts[k], low, high + n + edits)

    def _verified(self, doc_id, item_id: int, item: np.ndarray, words: np.ndarray, low: int, high: int) -> Iterator[tuple]:
        """Best run between two words, then what lies left and right of it."""
        edits = allowed_edits(len(item))
        todo = [(max(0, low - edits), min(len(words), high))]
        while todo:
            a, b = todo.pop()
            if b - a < len(item) - edits:
                continue
            d, s, e = best_run(item, words[a:b])
            if d <= edits:
                yield doc_id, item_id, a + s, a + e, len(item), d
                todo += [(a, a + s), (a + e, b)]


def _fit(words: np.ndarray, n: int) -> np.ndarray:
    """A window at the end of a document, filled up with zero words."""
    return words if len(words) == n else np.concatenate((words, np.zeros(n - len(words), np.uint64)))


def item_blocks(benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> list[list[tuple[int, bytes]]]:
    """``(item_id, text)`` of the items, in blocks of about ``item_block``, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("t"))
    items = items.filter("t is not null")
    blocks = max(1, -(-items.count() // item_block))
    own = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return [[(r["item_id"], bytes(r["t"])) for r in items.filter(own == k).collect()] for k in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 repeats: int = REPEATS, samples: int = SAMPLES, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Every match: doc_id, item_id, start_word, end_word (exclusive), item_words, edits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    names = [f.split()[0] for f in _MATCH.split(", ")]
    found = None
    for block in item_blocks(benchmark, item_block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, repeats, samples)
            for b in batches:
                out = list(index.matches([(i, x.as_py() or b"") for i, x in zip(b.column(0).to_pylist(), b.column(1))]))
                columns = zip(*out) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        one = rows.mapInArrow(run, _MATCH)
        found = one if found is None else found.unionByName(one)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", repeats: int = REPEATS,
                      samples: int = SAMPLES, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The documents without a match, all columns kept."""
    at, schema = docs.columns.index(text_col), docs.schema
    for block in item_blocks(benchmark, item_block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, repeats, samples)
            for b in batches:
                texts = b.column(at).cast(pa.binary())
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in index.matches([(i, x.as_py() or b"") for i, x in enumerate(texts)])]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
