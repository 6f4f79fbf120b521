"""The remaining fixture rows of FIXTURES.md section 2."""

import math

import pytest
from pyspark.sql import functions as F

from textpairs.functions import text as T
from textpairs.functions import treebank as TB
from textpairs.operators import batches as BT
from textpairs.operators import clean
from textpairs.operators import vocab as V


def test_nli_labels_and_nulls(spark):
    raw = spark.createDataFrame([
        ("entailment", "p", "h", "1"), ("neutral", "p", "h", "2"), ("contradiction", "p", "h", "3"),
        ("-", "p", "h", "4"), (None, "p", "h", "5"), ("neutral", None, "h", "6"), ("neutral", "p", None, "7"),
    ], "gold_label string, sentence1 string, sentence2 string, pairID string")
    kept = clean.encode_label(clean.clean_nli(raw))
    assert sorted((r.pairID, r.label) for r in kept.collect()) == [("1", 0), ("2", 1), ("3", 2)]
    report = clean.filter_report(raw, clean.nli_usable()).collect()[0]
    assert (report.rows_before, report.rows_after) == (7, 3)
    unknown = spark.createDataFrame([("maybe", "p", "h", "8")], raw.schema)
    with pytest.raises(Exception):
        clean.encode_label(clean.clean_nli(unknown)).collect()
    back = clean.decode_label(kept, "label", out="text").collect()
    assert all(r.text == r.gold_label for r in back)


@pytest.mark.parametrize("labels,ok", [([0, 1, 2], True), ([0, 2], False), ([1, 2], False)])
def test_contiguous_label_check(spark, labels, ok):
    df = spark.createDataFrame([(x,) for x in labels], "label int")
    assert clean.check_labels(df).collect()[0].ok is ok
    if not ok:
        with pytest.raises(Exception):
            clean.assert_labels(df).collect()


def test_label_check_without_label_column(spark):
    rep = clean.check_labels(spark.createDataFrame([("a",)], "premise string")).collect()[0]
    assert rep.has_label is False and rep.ok is True


def test_spaces_tabs_clitics_brackets(spark):
    df = spark.createDataFrame([("\t  a   b  c \t",), ("do n't stop , `` now '' ( it 's 1,000 ) .",)], "s string")
    rows = df.select(T.normalise_space("s").alias("n"), TB.treebank_detokenise(F.col("s")).alias("d")).collect()
    assert rows[0].n == "a b c"
    assert rows[1].d == "don't stop, \"now\" (it's 1,000)."
    tok = spark.createDataFrame([("don't stop, \"now\" (it's 1,000).",)], "s string")
    assert tok.select(TB.treebank_text(F.col("s")).alias("t")).collect()[0].t == \
        "do n't stop , `` now '' ( it 's 1,000 ) ."


@pytest.mark.parametrize("max_len", [10, 12])   # 10 is not a multiple of 8
def test_pad_width_boundaries(spark, max_len):
    for lens in ([1], [8], [9], [max_len - 1], [max_len], [max_len + 1], [1, 9, max_len + 1]):
        rows = [(i, list(range(1, n + 1))) for i, n in enumerate(lens)]
        df = spark.createDataFrame(rows, "k long, ids array<int>").withColumn("batch", F.lit(0))
        w = BT.pad_widths(df, "batch", "ids", max_len).collect()[0]
        m = max(lens)
        want = math.ceil(min(max_len, m) / 8) * 8 if m > 8 else m
        assert (w.max_len, w.width) == (m, want)
        for r in BT.pad_batch(df, "batch", "ids", max_len).collect():
            assert len(r.ids_padded) == want
            assert sum(r.ids_mask) == min(len(r.ids), max_len)


def test_kept_ids_beyond_vocabulary(spark):
    words = spark.createDataFrame([("a", 259), ("b", 260)], "word string, id int")
    vocab = V.vocab_table(words)
    seen = spark.createDataFrame([(5,), (260,), (999,)], "token_id int")   # 999 >= vocabulary size
    pieces = V.prune_vocab(vocab, seen)
    kept = V.kept_ids(seen)
    assert pieces.count() == 260                       # 259 reserved + "b"
    assert kept.count() == 261                         # 259 reserved + 260 + 999
    ids = {r.token_id: r.new_id for r in kept.collect()}
    assert ids[999] == 260 and ids[260] == 259
    remap = V.remap_ids(spark.createDataFrame([(1, [260, 999, 300])], "k long, ids array<int>"),
                        ["k"], "ids", V.id_map(kept))
    assert remap.collect()[0].ids_new == [259, 260, 0]  # 300 was never seen -> unk
