"""Substring de-duplication by relative Lempel-Ziv parsing (operator 5).

Every document is factored greedily against the rest of the corpus as its
reference.  A factor begins at a word whose next ``window`` words also start
somewhere else (same document included) and carries on, window by window, as
long as the text goes on at the same reference; then the next factor begins.
Factors hold at least ``window`` words, all windows across a factor's boundary
are looked up as well, and the words of every factor are compared with the words
at its reference: what agrees is a duplicate span.

The reference index is cut into blocks by hash range and nobody holds more
than one block of it:

1. Documents are dealt into chunks by a hash (the one shuffle of text; chunks
   hold about ``chunk_bytes``) and stand there in the order of another, so that
   positions mean the same in every pass.
2. Each chunk names its anchors: the smallest ``gram``-word hash inside each
   window.  Equal windows have equal anchors, and there is about one anchor
   position per 14 words.  A chunk sends each index block its sorted distinct
   anchors, with a bit for those it holds twice; the block answers with one
   bit per anchor: held elsewhere or not.
3. Windows under such anchors, and only those, are asked for with their
   position; the block answers with a reference position, in another chunk, of
   each that is held there.  Windows that a chunk holds twice refer to itself.
4. With these positions each chunk factors its documents, compares factors
   that refer to itself, and sends the words of the others to the chunk they
   refer to, which compares them with its own.  Equal requests meet in a
   map-side aggregation first.  Only factors that do not agree are answered.
5. Each chunk factors again, leaves out what did not agree, and cuts the spans.

A chunk sends a value once, however often it holds it, so a passage that a
third of all documents share costs an index block one value per chunk, and the
chunk it refers to one comparison: no group of equal values is ever gathered.
Hashes (64 bits) only propose; no word is removed unless its words were
compared.  Two different windows of one hash, of which one also occurs a third
time, could hide that third one (a chance of about 1 in 10**19 a pair).

Defined cases: a null text stays null and has no words; texts below
``window`` words are kept whole; rows with a repeated or null id are documents
of their own; an empty table gives an empty result.  All columns of the input are
kept under their names, and results come in columns that start with ``__``.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpairs.llm.words import unused, word_hashes

#: Parameters.
WINDOW = 35
GRAM = 8
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 32 << 20
LEAST_CHUNKS = 256
LEAST_BLOCKS = 64

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rolling(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of words[i:i+length] for every i, by prefix sums of a polynomial modulo 2**64."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    back = pow(base, -1, 1 << 64)
    up = np.full(n, base, np.uint64)
    up[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * np.cumprod(up), out=sums[1:])
    down = np.full(n - length + 1, back, np.uint64)
    down[0] = 1
    return _mixed((sums[length:] - sums[:-length]) * np.cumprod(down))


def _sliding(x: np.ndarray, length: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i:i+length] for every i, by doubling."""
    reach = 1
    while 2 * reach <= length:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    return pick(x[:len(x) - (length - reach)], x[length - reach:]) if reach < length else x


class _Chunk:
    """The words of a chunk's documents, end to end, and the windows inside documents."""

    def __init__(self, texts: pa.ChunkedArray, window: int, gram: int):
        self.texts = [t.as_py() or b"" for t in texts.cast(pa.binary())]
        split = [t.split() for t in self.texts]
        self.words = split
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        n = int(self.starts[-1])
        hashes = np.empty(n, np.uint64)
        for words, at in zip(split, self.starts):
            hashes[at:at + len(words)] = word_hashes(words)
        self.window, self.n = window, n
        if n < window:
            self.inside = np.zeros(0, bool)
            self.anchor = self.hashes = np.zeros(0, np.uint64)
            self.anchors = np.zeros(0, np.uint64)
            return
        whole = np.ones(n - window + 1, bool)
        for end in self.starts[1:-1]:  # windows that would run into the next document
            whole[max(0, end - window + 1):end] = False
        last = self.starts[-1]
        whole[last - window + 1:] = False
        self.inside = whole
        grams = _rolling(hashes, gram, 0xD1342543DE82EF95)
        span = window - gram + 1
        self.anchor = _sliding(grams, span, np.minimum)
        # a position is an anchor if its hash is the least of any whole window around it
        best = np.where(whole, self.anchor, np.uint64(0))
        pad = np.zeros(span - 1, np.uint64)
        top = _sliding(np.concatenate((pad, best, pad)), span, np.maximum)
        # least hashes crowd at the low end of the range: mixed again, they spread over the index blocks
        self.anchors, self.anchor = _mixed(grams[top == grams]), _mixed(self.anchor)
        self.hashes = _rolling(hashes, window, 0xAF251AF3B0F025B5)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, their first places, and whether each comes twice or more."""
    found, first, n = np.unique(values, return_index=True, return_counts=True)
    return found, first, n > 1


def _cut(values: np.ndarray, blocks: int) -> np.ndarray:
    """Bounds of the index blocks in sorted values."""
    edges = (np.arange(1, blocks, dtype=np.uint64)) << np.uint64(64 - (blocks.bit_length() - 1))
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


def _send(kind: int, chunk: int, values: np.ndarray, blocks: int, places: np.ndarray | None = None) -> pa.Table:
    """A message to each index block: sorted distinct values, a bit for those held twice, their first ``places``."""
    found, first, twice = _distinct(values)
    where = np.zeros(0, np.int32) if places is None else places[first].astype(np.int32)
    at = _cut(found, blocks)
    full = np.flatnonzero(at[1:] > at[:-1])
    return pa.table({
        "kind": pa.array([kind] * len(full), pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()),
        "block": pa.array(full, pa.int32()),
        "hashes": pa.array([found[at[b]:at[b + 1]].tobytes() for b in full], pa.binary()),
        "twice": pa.array([np.packbits(twice[at[b]:at[b + 1]]).tobytes() for b in full], pa.binary()),
        "at": pa.array([where[at[b]:at[b + 1]].tobytes() for b in full], pa.binary())})


_SENT = "kind int, chunk long, block int, hashes binary, twice binary, at binary"
_ANSWER = "kind int, chunk long, block int, bits binary, refs binary"
_ASK = "chunk long, at long, n long, words binary"
_REF = np.dtype([("chunk", "i8"), ("at", "i4")])


def _answer(asked: pa.Table) -> pa.Table:
    """One index block: which of the values asked for occur elsewhere, and, if positions were sent, where.

    The reference of a value is its place in the first chunk that holds it, for
    that chunk itself in the second; a value that a chunk holds twice needs none.
    """
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in asked["hashes"]]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool)
             for x, p in zip(asked["twice"], parts)]
    places = [np.frombuffer(x.as_py(), np.int32) for x in asked["at"]]
    chunks = asked["chunk"].to_numpy()
    every = np.concatenate(parts)
    owner = np.repeat(chunks, [len(p) for p in parts])
    order = np.lexsort((owner, every))
    same = every[order]
    starts = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    size = np.diff(np.concatenate((starts, [len(same)])))
    first = np.repeat(starts, size)
    held = np.empty(len(same), bool)
    held[order] = np.repeat(size > 1, size)
    other = np.empty(len(same), np.int64)
    # the first of a group refers to the second, the others to the first
    other[order] = order[np.where((np.arange(len(same)) == first) & np.repeat(size > 1, size), first + 1, first)]
    at = np.concatenate(places) if asked["kind"][0].as_py() == 2 else None
    out, refs, k = [], [], 0
    for p, t in zip(parts, twice):
        own = slice(k, k + len(p))
        out.append(np.packbits(held[own] | t).tobytes())
        if at is None:
            refs.append(b"")
        else:
            far = other[own][held[own] & ~t]
            ref = np.empty(len(far), _REF)
            ref["chunk"], ref["at"] = owner[far], at[far]
            refs.append(ref.tobytes())
        k += len(p)
    return pa.table({"kind": asked["kind"], "chunk": asked["chunk"], "block": asked["block"],
                     "bits": pa.array(out, pa.binary()), "refs": pa.array(refs, pa.binary())})


def _told(values: np.ndarray, answers: pa.Table, kind: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values that the index blocks answered yes for, sorted, and their references (chunk -1: none sent)."""
    found, _, twice = _distinct(values)
    at = _cut(found, blocks)
    yes = np.zeros(len(found), bool)
    refs = np.full(len(found), -1, np.dtype(_REF))
    for k, b, bits, ref in zip(answers["kind"].to_pylist(), answers["block"].to_pylist(), answers["bits"], answers["refs"]):
        if k == kind:
            part = slice(at[b], at[b + 1])
            yes[part] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=at[b + 1] - at[b]).astype(bool)
            far = np.flatnonzero(yes[part] & ~twice[part]) + at[b]
            sent = np.frombuffer(ref.as_py(), _REF)
            if len(sent):
                refs[far] = sent
    return found[yes], refs[yes]


def in_order(rows: pa.Table, order: str) -> pa.Table:
    """A chunk's rows in one order for all passes (rows arrive in any): positions count words in it."""
    return rows.sort_by(order)


def _isin(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    if not len(those):
        return np.zeros(len(values), bool)
    at = np.searchsorted(those, values)
    at[at == len(those)] = 0
    return those[at] == values


class _Factors:
    """Greedy factors of a chunk: ``start`` (word), ``n`` (words), ``chunk`` and ``at`` of the reference (chunk -1: itself)."""

    def __init__(self, c: _Chunk, places: np.ndarray, hashes: np.ndarray, told: np.ndarray, refs: np.ndarray):
        """``places`` are the windows with a reference, ``hashes`` theirs; ``told`` and ``refs`` what the blocks said."""
        ref = refs[np.searchsorted(told, hashes)]
        chunk, at = ref["chunk"].astype(np.int64), ref["at"].astype(np.int64)
        own = chunk < 0
        if own.any():
            # inside the chunk: the first place of the value, for that place itself the second
            order = np.lexsort((places, hashes))
            value = hashes[order]
            starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
            size = np.diff(np.concatenate((starts, [len(value)])))
            first = np.repeat(starts, size)
            twin = np.minimum(np.where(np.arange(len(value)) == first, first + 1, first), len(value) - 1)
            near = np.empty(len(value), np.int64)
            near[order] = places[order[twin]]
            at = np.where(own, near, at)
        if len(places):
            goes_on = (places[1:] == places[:-1] + 1) & (chunk[1:] == chunk[:-1]) & (at[1:] == at[:-1] + 1)
            begin = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        else:
            begin = np.zeros(0, np.int64)
        size = np.diff(np.concatenate((begin, [len(places)])))
        self.start, self.n = places[begin], size + c.window - 1
        self.chunk, self.at = chunk[begin], at[begin]
        flat = [w for words in c.words for w in words] if len(begin) else []
        self.words = [flat[s:s + n] for s, n in zip(self.start.tolist(), self.n.tolist())]
        self.good = np.array([k >= 0 or (a != s and flat[a:a + n] == w) for k, a, s, n, w in zip(
            self.chunk.tolist(), self.at.tolist(), self.start.tolist(), self.n.tolist(), self.words)], bool)

    def asks(self) -> set[tuple[int, int, int, bytes]]:
        """Comparisons to ask other chunks for."""
        return {(k, a, len(w), b" ".join(w)) for k, a, w in zip(self.chunk.tolist(), self.at.tolist(), self.words) if k >= 0}

    def leave_out(self, wrong: set[tuple[int, int, bytes]]) -> None:
        """Drops factors that did not agree with their reference."""
        if wrong:
            for i, (k, a, w) in enumerate(zip(self.chunk.tolist(), self.at.tolist(), self.words)):
                self.good[i] &= k < 0 or (k, a, sha256(b" ".join(w)).digest()) not in wrong

    def covered(self, n: int) -> np.ndarray:
        """Whether each word of the chunk lies in a factor."""
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, self.start[self.good], 1)
        np.add.at(edge, (self.start + self.n)[self.good], -1)
        return np.cumsum(edge[:-1]) > 0


def runs(covered: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of covered words."""
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return [(int(s), int(e)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _without(text: bytes, spans: list[tuple[int, int]], n: int) -> tuple[str, int]:
    """Text without the words of spans, white space between kept neighbours as it was; the number removed."""
    keep = np.ones(n, bool)
    for s, e in spans:
        keep[s:e] = False
    at = [m.span() for m in _WORD.finditer(text)]
    edge = np.diff(np.concatenate(([0], keep.astype(np.int8), [0])))
    parts = [text[at[s][0]:at[e - 1][1]] for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return b"\n".join(parts).decode("utf-8", "replace"), int(n - keep.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns, the text without its duplicate spans, and ``__n_words``, ``__n_removed``, ``__spans``."""
    columns = docs.columns
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, -(-n_bytes // chunk_bytes))
    blocks = 1 << (max(LEAST_BLOCKS, -(-n_bytes // BLOCK_BYTES)) - 1).bit_length()
    # all passes read the same shuffled rows, so Spark reuses one exchange of the text
    chunk, order = unused(columns, "__chunk"), unused(columns, "__order")
    base = docs.withColumns({chunk: F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)),
                             order: F.xxhash64(F.col(text_col))})

    def chunk_of(rows: pa.Table) -> _Chunk:
        return _Chunk(rows[text_col], window, gram)

    def anchors(key: tuple, rows: pa.Table) -> pa.Table:
        return _send(1, key[0].as_py(), chunk_of(rows).anchors, blocks)

    def wanted(c: _Chunk, answers: pa.Table) -> np.ndarray:
        """Places of the windows whose anchor is held elsewhere."""
        if not len(c.anchor):
            return np.zeros(0, np.int64)
        return np.flatnonzero(c.inside & _isin(c.anchor, _told(c.anchors, answers, 1, blocks)[0]))

    def windows(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = chunk_of(in_order(rows, order))
        ask = wanted(c, answers)
        return _send(2, key[0].as_py(), c.hashes[ask], blocks, ask)

    def factored(c: _Chunk, answers: pa.Table) -> _Factors:
        ask = wanted(c, answers)
        told, refs = _told(c.hashes[ask], answers, 2, blocks)
        places = ask[_isin(c.hashes[ask], told)]
        return _Factors(c, places, c.hashes[places], told, refs)

    def requests(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        asks = sorted(factored(chunk_of(in_order(rows, order)), answers).asks())
        columns = zip(*asks) if asks else ([], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=["chunk", "at", "n", "words"])

    def compare(key: tuple, rows: pa.Table, asks: pa.Table) -> pa.Table:
        """The requests whose words are not those of this chunk at their place."""
        texts = in_order(rows, order)[text_col].cast(pa.binary()) if asks.num_rows else []
        flat = [w for t in texts for w in (t.as_py() or b"").split()]
        wrong = [(k, a, sha256(w).digest()) for k, a, n, w in zip(*(asks[x].to_pylist() for x in ("chunk", "at", "n", "words")))
                 if flat[a:a + n] != w.split(b" ")]
        columns = zip(*wrong) if wrong else ([], [], [])
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                        names=["ref_chunk", "at", "digest"])

    def parse(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = in_order(rows, order)
        c = chunk_of(rows)
        found = factored(c, answers)
        found.leave_out({(int.from_bytes(b[:8], "big"), int.from_bytes(b[8:16], "big"), b[16:]) for k, b in zip(
            answers["kind"].to_pylist(), answers["refs"].to_pylist()) if k == 3})
        covered = found.covered(c.n)
        texts, removed, spans = [], [], []
        plain = rows[text_col]
        for i, words in enumerate(c.words):
            own = covered[c.starts[i]:c.starts[i + 1]]
            if own.any():
                cut = runs(own)
                text, n = _without(c.texts[i], cut, len(words))
            else:
                cut, text, n = [], plain[i].as_py(), 0
            texts.append(text)
            removed.append(n)
            spans.append([{"start": s, "end": e} for s, e in cut])
        out = rows.select(columns).set_column(columns.index(text_col), text_col, pa.array(texts, pa.string()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return (out.append_column("__n_words", pa.array([len(w) for w in c.words], pa.int64()))
                .append_column("__n_removed", pa.array(removed, pa.int64()))
                .append_column("__spans", pa.array(spans, span)))

    by_chunk = base.groupBy(chunk)
    told = by_chunk.applyInArrow(anchors, _SENT).groupBy("block").applyInArrow(_answer, _ANSWER)
    more = (by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(windows, _SENT)
            .groupBy("block").applyInArrow(_answer, _ANSWER))
    answers = told.unionByName(more)
    asks = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(requests, _ASK)
    asks = asks.groupBy("chunk", "at", "n", "words").agg(F.count(F.lit(1)).alias("askers")).drop("askers")
    wrong = by_chunk.cogroup(asks.groupBy("chunk")).applyInArrow(compare, "ref_chunk long, at long, digest binary")
    # next to never a row: every chunk is told
    place = [F.unhex(F.lpad(F.hex(x), 16, "0")) for x in ("ref_chunk", "at")]
    wrong = wrong.select(F.lit(3).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
                         F.lit(0).alias("block"), F.lit(None).cast("binary").alias("bits"), F.concat(*place, "digest").alias("refs"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()),
                           T.StructField("__n_removed", T.LongType()),
                           T.StructField("__spans", T.ArrayType(T.StructType([
                               T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return by_chunk.cogroup(answers.unionByName(wrong).groupBy("chunk")).applyInArrow(parse, schema)
