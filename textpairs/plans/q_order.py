"""Registered queries: ranks, splits, samples and batch layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.operators import batches as BT
from textpairs.operators.rank import dense_ids, shuffle_rank
from textpairs.operators.split import sample_k, split_three, split_two
from textpairs.plans import bridge as B
from textpairs.plans.q_mix import SPLIT3_SQL
from textpairs.plans.registry import register

SORTISH_BS = 7
SORTISH_CTES = {
    "sb_r": """SELECT doc_id AS key, n_chars AS len,
                      row_number() OVER (ORDER BY md5('738:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rnk
               FROM documents""",
    "sb_p": f"""SELECT *, row_number() OVER (PARTITION BY rnk // {50 * SORTISH_BS}
                                            ORDER BY len DESC, key) - 1 AS pos,
                       rnk // {50 * SORTISH_BS} AS chunk
               FROM sb_r""",
    "sb_b": f"SELECT *, chunk * 50 + pos // {SORTISH_BS} AS batch FROM sb_p",
    "sb_bt": "SELECT batch, count(*) AS size, max(len) AS head FROM sb_b GROUP BY batch",
    "sb_top": f"SELECT batch AS top FROM sb_bt ORDER BY (size = {SORTISH_BS}) DESC, head DESC, batch LIMIT 1",
    "sb_last": "SELECT max(batch) AS mb FROM sb_bt",
    "sb_cls": """SELECT sb_bt.batch, mb,
                        CASE WHEN sb_bt.batch = top THEN 0
                             WHEN sb_bt.batch = (CASE WHEN top = mb THEN 0 ELSE mb END) THEN 2 ELSE 1 END AS cls
                 FROM sb_bt, sb_top, sb_last""",
    "sb_ord": """SELECT batch, cls,
                        CASE cls WHEN 0 THEN 0 WHEN 2 THEN mb
                             ELSE row_number() OVER (PARTITION BY cls ORDER BY md5('738:b:' || CAST(batch AS VARCHAR)),
                                                     batch) END AS batch_order
                 FROM sb_cls""",
}


@register("shuffle_rank", sql="""
    SELECT doc_id, row_number() OVER (ORDER BY md5('738:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank
    FROM documents""")
def q_shuffle_rank(spark, sf_dir):
    return shuffle_rank(B.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=738)


@register("dense_ids", sql="""
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM labels""")
def q_dense_ids(spark, sf_dir):
    return dense_ids(B.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@register("split_two", sql="""
    SELECT doc_id, CASE WHEN rnk < t THEN 'valid' ELSE 'train' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('738:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rnk,
                 (count(*) OVER () + 9) // 10 AS t FROM documents)""")
def q_split_two(spark, sf_dir):
    return split_two(B.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, seed=738)


@register("split_three", sql=f"SELECT id, split FROM ({SPLIT3_SQL.format(key='id', src='v_qqp')})")
def q_split_three(spark, sf_dir):
    return split_three(B.v_qqp(spark, sf_dir).select("id"), "id", seed=738)


@register("sample_k", sql="""
    SELECT doc_id, sample_pos FROM (
        SELECT doc_id, row_number() OVER (ORDER BY md5('738:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS sample_pos
        FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100))
    WHERE sample_pos < 10""")
def q_sample_k(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id")
    return sample_k(docs, [F.col("doc_id")], "doc_id", m=100, k=10, seed=738)


@register("length_order", sql="""
    SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents""")
def q_length_order(spark, sf_dir):
    return BT.length_order(B.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@register("sortish_batches", sql=f"""
    SELECT b.key AS doc_id, b.batch, o.batch_order,
           CAST(CASE WHEN o.cls = 1
                     THEN row_number() OVER (PARTITION BY b.batch
                                             ORDER BY md5('738:r:' || CAST(b.key AS VARCHAR)), b.key) - 1
                     ELSE b.pos % {SORTISH_BS} END AS INTEGER) AS slot
    FROM sb_b b JOIN sb_ord o ON b.batch = o.batch""", ctes=SORTISH_CTES)
def q_sortish_batches(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    out = BT.sortish_batches(docs, "doc_id", "n_chars", SORTISH_BS, seed=738)
    return out.select("doc_id", "batch", "batch_order", "slot")


@register("fixed_batches", sql="""
    SELECT doc_id, pos // 32 AS batch, CAST(pos % 32 AS INTEGER) AS slot
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
    WHERE pos // 32 < n // 32""")
def q_fixed_batches(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id")
    return BT.fixed_batches(docs, "doc_id", 32, drop_last=True).select("doc_id", "batch", "slot")
