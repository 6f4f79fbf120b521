"""Pruning on the vocabulary equals pruning step by step."""

import pytest

from textpairs.operators import vocab as V
from textpairs.operators.tokens import tokenise_vocab

VOCAB = [("the", 259), ("cat", 260), ("dog", 261), ("", 262), ("sat", 300), ("unused", 301), ("mat", 5000)]
ROWS = [(1, "the cat sat", "the mat"), (2, None, "the dog"), (3, "", " "), (4, "what is this", None), (5, None, None),
        (6, "cat  cat", "mat mat")]


def steps(df, vocab):
    tok = tokenise_vocab(df, ["id"], ["a", "b"], vocab)
    m = V.id_map(V.kept_ids(V.seen_ids(tok, ["a_ids", "b_ids"])))
    out = {}
    for c in ("a", "b"):
        for r in V.remap_ids(tok, ["id"], f"{c}_ids", m, out="new").collect():
            out.setdefault(r.id, {})[c] = r.new
    return out


@pytest.mark.parametrize("rows", [ROWS, ROWS[:2], [], [(1, "what", "is")]])
@pytest.mark.parametrize("size", [0, 3, 7])
def test_pruned_tokens_equal_the_steps(spark, rows, size):
    df = spark.createDataFrame(rows, "id int, a string, b string")
    vocab = spark.createDataFrame(VOCAB[:size], "word string, id int")
    got = {r.id: {"a": r.a_new, "b": r.b_new} for r in V.prune_tokenise(df, ["id"], ["a", "b"], vocab).collect()}
    assert got == steps(df, vocab)


def test_only_used_words_are_kept_and_numbered_densely(spark):
    df = spark.createDataFrame(ROWS, "id int, a string, b string")
    got = {r.word: (r.id, r.new_id) for r in V.prune_words(df, ["a", "b"], spark.createDataFrame(VOCAB, "word string, id int")).collect()}
    used = [("the", 259), ("cat", 260), ("dog", 261), ("", 262), ("sat", 300), ("mat", 5000)]
    assert got == {w: (i, 259 + k) for k, (w, i) in enumerate(used)}
    with pytest.raises(ValueError, match="reserved"):
        V.prune_tokenise(df, ["id"], ["a"], spark.createDataFrame(VOCAB, "word string, id int"), reserved=0)
