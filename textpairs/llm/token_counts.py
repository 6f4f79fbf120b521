"""Token counts by heap-and-linked-list byte-pair merging (operator 11).

A text is cut at the vocabulary's added tokens (one token each), then into
pieces by the byte-level pattern.  A piece starts as one symbol per UTF-8 byte,
held in a doubly linked list; a heap holds every adjacent pair that has a merge,
keyed by (rank, place).  The lowest is popped, its symbols become one, and the
pairs that the new symbol makes with its neighbours are pushed; an entry whose
symbols have changed since is stale and skipped.  The count of a piece is its
initial symbols minus its merges; no token id is emitted.  A piece of n bytes
takes O(n log n) time and O(n) memory, so a text of one word of megabytes is
counted like any other.

The vocabulary is a ``tokenizers`` JSON file of a byte-level BPE, read on the
driver and broadcast: its size is that of the file, whatever the corpus.  The
counts of short pieces are kept in each worker in a table of at most
``MEMO_PIECES`` entries.  Where the library and this pattern engine know
different Unicode versions, each character is put to both when it is first met,
and a text that holds one they class differently is cut by the library.

Documents are read in Arrow batches where they lie, without a shuffle.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows
give repeated results; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters.
MAX_TOKENS = 512
MEMO_PIECES = 1_000_000  # about 120 MB a worker
MEMO_CHARS = 32
LISTED_CHARS = 1_000_000

#: Fixed value: the pattern that cuts a text for a byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = regex.compile(PATTERN)
_OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the characters
    from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """Merge ranks of a byte-level BPE: ``pair -> (rank, merged symbol)`` and the symbol of each byte."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in (
                "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.width = max(ids.values()) + 1
        self.first = [ids[c] for c in byte_symbols()]
        self.of: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.of[ids[a] * self.width + ids[b]] = (rank, ids[a + b])

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n = len(piece)
        if n < 2:
            return n
        width, of = self.width, self.of
        symbol = [self.first[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = of.get(symbol[i] * width + symbol[i + 1])
            if found:
                heap.append((found[0], i, found[1]))
        heapify(heap)
        left = n
        while heap:
            rank, i, new = heappop(heap)
            if symbol[i] < 0:
                continue
            j = after[i]
            if j >= n:
                continue
            found = of.get(symbol[i] * width + symbol[j])
            if found is None or found[0] != rank:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = of.get(new * width + symbol[k])
                if found:
                    heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = of.get(symbol[h] * width + new)
                if found:
                    heappush(heap, (found[0], h, found[1]))
        return left


class Memo(dict):
    """Counts of short pieces met so far, emptied when full."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.count(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of texts as the library does for one vocabulary file."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        pre = conf["pre_tokenizer"]
        if conf["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        added = conf["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.memo = Memo(Merges(conf["model"]))
        # of two that begin at one place the longer one counts
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.known: set[str] = set()  # characters met, at most all of Unicode
        self.unsure: set[str] = set()

    def _is_unsure(self, text: str) -> bool:
        """Whether the text holds a character that the two engines class differently."""
        if text.isascii():
            return False
        chars = set(text)
        new = chars - self.known
        if new:
            self.unsure.update(c for c in new if not _classed_alike(c))
            self.known |= new
        return not self.unsure.isdisjoint(chars)

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if self._is_unsure(text):
            pieces = (text[a:b] for _, (a, b) in _byte_level().pre_tokenize_str(text))
        elif len(text) <= LISTED_CHARS:
            pieces = _PIECE.findall(text)
        else:
            pieces = (m.group() for m in _PIECE.finditer(text))
        return sum(map(self.memo.__getitem__, pieces))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        total, at = 0, 0
        for m in self.added.finditer(text):
            total += self.plain(text[at:m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


@lru_cache(maxsize=1)
def _byte_level():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


def _classed_alike(char: str) -> bool:
    """Whether the library and the pattern engine cut alike around a character (behind a letter, a digit and a sign)."""
    return all(len(_PIECE.findall(x + char)) == len(_byte_level().pre_tokenize_str(x + char)) for x in "a1!")


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(key: str, shared) -> TokenCounter:
    """One counter per worker process and vocabulary."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(shared.value)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``max_tokens``)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    TokenCounter(spec)  # a vocabulary of another kind fails here, not in a task
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    key = sha256(spec.encode()).hexdigest()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(key, shared).count
        for b in batches:
            texts = b.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = [count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(n, pa.int64()),
                                              pa.array([x > max_tokens for x in n], pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, _OUT)
