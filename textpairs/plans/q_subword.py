"""Registered queries: sub-word segmentation over a vocabulary table and decoding by join (Q2, Q3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.operators import subword as S
from textpairs.plans import bridge as B
from textpairs.plans.registry import register
from textpairs.session import materialise

#: words that occur once are left out of the vocabulary, so they have to be segmented
MIN_COUNT = 2


def _vocabulary(spark, sf_dir):
    return materialise(B.v_vocab(spark, sf_dir).filter(F.col("cnt") >= MIN_COUNT).select("word", "id"))


SUBWORD_CTES = {
    "sub_vocab": f"SELECT word, id FROM v_vocab WHERE cnt >= {MIN_COUNT}",
    "sub_top": "SELECT greatest(max(id) + 1, 259) AS top FROM sub_vocab",
    "sub_lacking": "SELECT DISTINCT word FROM v_words WHERE word NOT IN (SELECT word FROM sub_vocab)",
    "sub_units": f"""
        SELECT word, CAST(i AS INTEGER) AS unit_no, substr(word, i * {S.UNIT_CHARS} + 1, {S.UNIT_CHARS}) AS unit
        FROM (SELECT word, unnest(range(greatest(length(word) - 1, 0) // {S.UNIT_CHARS} + 1)) AS i FROM sub_lacking)""",
    "sub_best": f"""
        SELECT unit, p, max(size) AS size, arg_max(v.id, size) AS id
        FROM (SELECT unit, p, unnest(range(1, least({S.MAX_PIECE}, length(unit) - p) + 1)) AS size
              FROM (SELECT unit, unnest(range(length(unit))) AS p FROM (SELECT DISTINCT unit FROM sub_units)))
        JOIN sub_vocab v ON v.word = substr(unit, p + 1, size) GROUP BY unit, p""",
    "sub_walk": """
        SELECT DISTINCT unit, unit_no = 0 AS begins, CAST(0 AS BIGINT) AS p, CAST([] AS INTEGER[]) AS ids FROM sub_units
        UNION ALL
        SELECT w.unit, w.begins, w.p + coalesce(m.size, 1),
               w.ids || CASE WHEN m.id IS NULL
                   THEN (CASE WHEN w.begins AND w.p = 0 THEN [35] ELSE CAST([] AS INTEGER[]) END)
                        || [CAST('0x' || substr(hex(substr(w.unit, w.p + 1, 1)), 2 * j + 1, 2) AS INTEGER) + 3
                            FOR j IN range(length(hex(substr(w.unit, w.p + 1, 1))) // 2)]
                   WHEN w.begins AND w.p = 0 THEN [m.id] ELSE [CAST(m.id + top AS INTEGER)] END
        FROM sub_walk w JOIN sub_top ON true LEFT JOIN sub_best m ON m.unit = w.unit AND m.p = w.p
        WHERE w.p < length(w.unit)""",
    "sub_pieces": """
        SELECT word, flatten(list(CASE WHEN u.unit = '' THEN [35] ELSE w.ids END ORDER BY unit_no)) AS pieces
        FROM sub_units u JOIN sub_walk w ON w.unit = u.unit AND w.begins = (u.unit_no = 0) AND w.p = length(u.unit)
        GROUP BY word""",
}


@register("tokenise_subword", sql="""
    SELECT doc_id, line_no, array_to_string(flatten(list(coalesce(s.pieces, [v.id]) ORDER BY pos)) || [2], ',') AS ids
    FROM v_words w LEFT JOIN sub_vocab v ON v.word = w.word LEFT JOIN sub_pieces s ON s.word = w.word
    GROUP BY doc_id, line_no""", ctes=SUBWORD_CTES)
def q_tokenise_subword(spark, sf_dir):
    """Every line of every document; words that occur once are cut into pieces and bytes, and no id is the unknown one."""
    t = S.tokenise_subword(B.v_lines(spark, sf_dir), ["doc_id", "line_no"], "line", _vocabulary(spark, sf_dir))
    return t.select("doc_id", "line_no", F.array_join("line_ids", ",").alias("ids"))


@register("decode_subword", sql="SELECT doc_id, line_no, line AS decoded FROM v_lines")
def q_decode_subword(spark, sf_dir):
    """The round trip: what is decoded from the ids is the text."""
    vocab = _vocabulary(spark, sf_dir)
    t = materialise(S.tokenise_subword(B.v_lines(spark, sf_dir), ["doc_id", "line_no"], "line", vocab))
    return S.decode_pieces(t, ["doc_id", "line_no"], "line_ids", vocab, out="decoded")
