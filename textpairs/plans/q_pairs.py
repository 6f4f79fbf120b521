"""Registered queries: index-coded reconstruction (T7, J4-J6, J9, A11),
first-seen lookup (J3), groups (A1, A2, J2 re-aimed, J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.operators import pairs as P
from textpairs.plans import bridge as B
from textpairs.plans.registry import register

_GLUED_SQL = r"^\(\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\)$"

REF_CTES = {
    "idx_parts": """
        SELECT id, label, side, qid0, CAST(unnest(range(len(ps))) AS INTEGER) AS part, unnest(ps) AS ptxt
        FROM (SELECT id, label, 0 AS side, qid1 AS qid0, string_split(sentence1, '/') AS ps FROM v_index
              UNION ALL
              SELECT id, label, 1 AS side, qid2 AS qid0, string_split(sentence2, '/') AS ps FROM v_index)""",
    "idx_subs": """
        SELECT id, label, side, qid0, part, glued, CAST(unnest(range(len(subs))) AS INTEGER) AS sub,
               unnest(subs) AS stxt
        FROM (SELECT *, starts_with(ptxt, '(') AS glued,
                     CASE WHEN starts_with(ptxt, '(') THEN string_split(ptxt, ':') ELSE [ptxt] END AS subs
              FROM idx_parts)""",
    "refs": f"""
        SELECT id, label, side, part, sub, qid, idx, qid IS NULL OR idx IS NULL AS malformed
        FROM (SELECT id, label, side, part, sub,
                     CASE WHEN glued THEN TRY_CAST(regexp_extract(stxt, '{_GLUED_SQL}', 1) AS BIGINT)
                          ELSE qid0 END AS qid,
                     CASE WHEN glued THEN TRY_CAST(regexp_extract(stxt, '{_GLUED_SQL}', 2) AS BIGINT)
                          ELSE TRY_CAST(trim(stxt) AS BIGINT) END AS idx
              FROM idx_subs)""",
    "looked": """
        SELECT r.*,
               CASE WHEN t.tokens IS NOT NULL AND r.idx >= 0 AND r.idx < len(t.tokens)
                    THEN t.tokens[r.idx + 1] END AS token,
               CASE WHEN r.malformed THEN 'malformed'
                    WHEN t.tokens IS NULL THEN 'missing_qid'
                    WHEN NOT (r.idx >= 0 AND r.idx < len(t.tokens)) THEN 'index_out_of_range'
                    WHEN t.tokens[r.idx + 1] = '' THEN 'empty_token' END AS reason
        FROM refs r LEFT JOIN v_qtokens t ON r.qid = t.qid""",
    "rebuilt": """
        SELECT id, label, bool_and(reason IS NULL) AS ok,
               string_agg(CASE WHEN side = 0 THEN CASE WHEN sub = 0 AND part > 0 THEN ' ' ELSE '' END || token END,
                          '' ORDER BY part, sub) AS s1,
               string_agg(CASE WHEN side = 1 THEN CASE WHEN sub = 0 AND part > 0 THEN ' ' ELSE '' END || token END,
                          '' ORDER BY part, sub) AS s2
        FROM looked GROUP BY id, label""",
}


def _refs(spark, sf_dir, packed=False):
    return P.both_sides(B.v_index(spark, sf_dir), ["id", "label"], packed=packed)


def _looked(spark, sf_dir):
    return P.lookup_tokens(_refs(spark, sf_dir, packed=True), B.v_qtokens(spark, sf_dir))


@register("parse_index_string", sql="SELECT id, side, part, sub, qid, idx, malformed FROM refs", ctes=REF_CTES)
def q_parse_index_string(spark, sf_dir):
    return _refs(spark, sf_dir).select("id", "side", "part", "sub", "qid", "idx", "malformed")


@register("lookup_tokens", sql="SELECT id, side, part, sub, qid, idx, token, reason FROM looked", ctes=REF_CTES)
def q_lookup_tokens(spark, sf_dir):
    return _looked(spark, sf_dir).select("id", "side", "part", "sub", "qid", "idx", "token", "reason")


@register("rebuild_sentences", sql="""
    SELECT id, side,
           CASE WHEN bool_and(reason IS NULL)
                THEN string_agg(CASE WHEN sub = 0 AND part > 0 THEN ' ' ELSE '' END || token, '' ORDER BY part, sub)
           END AS sentence,
           bool_and(reason IS NULL) AS ok
    FROM looked GROUP BY id, side""", ctes=REF_CTES)
def q_rebuild_sentences(spark, sf_dir):
    return P.rebuild_sentences(P.resolve_tokens(_refs(spark, sf_dir, packed=True), B.v_qtokens(spark, sf_dir)), ["id", "side"])


@register("rebuild_pairs", sql="""
    SELECT id, label, s1 AS sentence1, s2 AS sentence2 FROM rebuilt WHERE ok""", ctes=REF_CTES)
def q_rebuild_pairs(spark, sf_dir):
    r = P.rebuild_pairs(B.v_index(spark, sf_dir), B.v_qtokens(spark, sf_dir), id_cols=["id", "label"])
    return r.filter("ok").select("id", "label", "sentence1", "sentence2")


@register("build_report", sql="""
    SELECT count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS fail, count(*) AS total
    FROM rebuilt""", ctes=REF_CTES)
def q_build_report(spark, sf_dir):
    r = P.rebuild_pairs(B.v_index(spark, sf_dir), B.v_qtokens(spark, sf_dir), id_cols=["id", "label"])
    return P.build_report(r)


@register("missing_refs", sql="""
    SELECT id, side, part, sub, qid, idx, reason FROM looked WHERE reason IS NOT NULL""", ctes=REF_CTES)
def q_missing_refs(spark, sf_dir):
    return P.missing_refs(B.v_index(spark, sf_dir), B.v_qtokens(spark, sf_dir), id_cols=["id"])


@register("first_seen", sql="""
    SELECT qid, text FROM (
        SELECT qid, text, row_number() OVER (PARTITION BY qid ORDER BY conv_id, turn, side) AS rn FROM (
            SELECT qid1 AS qid, question1 AS text, conv_id, turn, 0 AS side FROM v_turn_pairs
            UNION ALL
            SELECT qid2 AS qid, question2 AS text, conv_id, turn, 1 AS side FROM v_turn_pairs))
    WHERE rn = 1""")
def q_first_seen(spark, sf_dir):
    tp = B.v_turn_pairs(spark, sf_dir)
    return P.first_seen(tp, [("qid1", "question1"), ("qid2", "question2")], ["conv_id", "turn"])


_POS_SQL = """SELECT paraphrase_group_index, phrase_index,
                     row_number() OVER (PARTITION BY paraphrase_group_index ORDER BY phrase_index) - 1 AS pos
              FROM v_groups"""


@register("collect_groups", sql=f"SELECT paraphrase_group_index, pos, phrase_index FROM ({_POS_SQL})")
def q_collect_groups(spark, sf_dir):
    return P.group_positions(B.v_groups(spark, sf_dir), "paraphrase_group_index", "phrase_index",
                             [F.col("phrase_index")])


@register("group_size_histogram", sql="""
    SELECT group_size, count(*) AS n_groups FROM (
        SELECT paraphrase_group_index, count(*) AS group_size FROM v_groups GROUP BY 1) GROUP BY group_size""")
def q_group_size_histogram(spark, sf_dir):
    return P.group_size_histogram(B.v_groups(spark, sf_dir), "paraphrase_group_index")


@register("group_pair_counts", sql="""
    SELECT paraphrase_group_index, count(*) AS n_members, count(*) * (count(*) - 1) // 2 AS n_pairs
    FROM v_groups GROUP BY 1""")
def q_group_pair_counts(spark, sf_dir):
    return P.group_pair_counts(B.v_groups(spark, sf_dir), "paraphrase_group_index")


_CHAIN_SQL = f"""SELECT a.paraphrase_group_index, a.pos, a.phrase_index AS item_1, b.phrase_index AS item_2
                 FROM ({_POS_SQL}) a JOIN ({_POS_SQL}) b
                   ON a.paraphrase_group_index = b.paraphrase_group_index AND b.pos = a.pos + 1"""


@register("chain_pairs", sql=_CHAIN_SQL)
def q_chain_pairs(spark, sf_dir):
    return P.chain_pairs(B.v_groups(spark, sf_dir), "paraphrase_group_index", "phrase_index",
                         [F.col("phrase_index")])


@register("attach_phrases", sql=f"""
    SELECT c.paraphrase_group_index, c.pos, c.item_1, c.item_2, p1.phrase AS sentence1, p2.phrase AS sentence2
    FROM ({_CHAIN_SQL}) c JOIN v_phrases p1 ON p1.phrase_index = c.item_1
                          JOIN v_phrases p2 ON p2.phrase_index = c.item_2""")
def q_attach_phrases(spark, sf_dir):
    chain = P.chain_pairs(B.v_groups(spark, sf_dir), "paraphrase_group_index", "phrase_index",
                          [F.col("phrase_index")])
    return P.attach_phrases(chain, B.v_phrases(spark, sf_dir), "item_1", "item_2")
