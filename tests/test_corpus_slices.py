"""Corpus tokenisation in slices: what a worker holds is bounded by rows and items, not by the Arrow batch."""

import pyarrow as pa

from textpairs.operators import tokens as TK


def test_slices_cover_all_rows_within_the_bounds():
    sizes = [TK.SLICE_ITEMS // 2] * 5 + [3 * TK.SLICE_ITEMS] + [None, 0, 1] * 1000
    cut = list(TK._slices(sizes))
    assert [k for at, n in cut for k in range(at, at + n)] == list(range(len(sizes)))
    for at, n in cut:
        assert n <= TK.SLICE_ROWS and (n == 1 or sum(x or 0 for x in sizes[at:at + n]) <= TK.SLICE_ITEMS)
    assert list(TK._slices([])) == []


def test_long_texts_leave_a_worker_in_several_batches(spark):
    word = "wort "
    n = TK.SLICE_ITEMS // (4 * len(word)) + 1
    df = spark.range(40).coalesce(1).selectExpr("id", f"repeat('{word}', {n}) AS text")
    got = TK.tokenise_corpus(df, ["text"])
    sizes = got.select("text_ids").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert sizes.agg({"n": "sum"}).first()[0] == 40
    one = [*TK._processor(TK.MODEL_PATH).encode(word * n), TK.EOS_ID]
    rows = got.select("id", "text_ids").filter("id % 13 = 0").collect()
    assert all(r.text_ids == one for r in rows) and len(rows) == 4


def test_round_trip_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "id long, text string")
    ids = TK.tokenise_corpus(df, ["text"])
    rows = {r.id: r for r in TK.decode_corpus(ids, "text_ids", out="back").collect()}
    assert rows[1].back == "Hello world" and rows[2].text_ids is None and rows[2].back is None
    assert rows[3].text_ids == [TK.EOS_ID] and rows[3].back == ""
    audit = TK.roundtrip_audit(df, "text").first()
    assert (audit.rows, audit.same) == (3, 3)
