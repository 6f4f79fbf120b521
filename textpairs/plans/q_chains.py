"""Registered queries: whole preparation chains from raw pairs to the final table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.functions import treebank as TB
from textpairs.operators import pairs as P
from textpairs.operators.split import split_three
from textpairs.plans import bridge as B
from textpairs.plans.q_mix import SPLIT3_SQL
from textpairs.plans.q_text import tb_detok_sql, tb_text_sql
from textpairs.plans.registry import register
from textpairs.session import materialise

CHAIN_CTES = {
    "seen_text": """
        SELECT qid, text FROM (
            SELECT qid, text, row_number() OVER (PARTITION BY qid ORDER BY conv_id, turn, side) AS rn FROM (
                SELECT qid1 AS qid, question1 AS text, conv_id, turn, 0 AS side FROM v_turn_pairs
                UNION ALL
                SELECT qid2 AS qid, question2 AS text, conv_id, turn, 1 AS side FROM v_turn_pairs))
        WHERE rn = 1""",
    "seen_tokens": f"SELECT qid, {tb_text_sql('text')} AS tokens FROM seen_text",
    "pair_union": """
        SELECT 'qqp:' || CAST(id AS VARCHAR) AS id, 'qqp' AS corpus, question1 AS s1, question2 AS s2
        FROM v_qqp WHERE is_duplicate = 1
        UNION ALL
        SELECT 'turns:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), 'turns', question1, question2
        FROM v_turn_pairs""",
}


@register("question_corpus_chain", sql="""
    SELECT v.conv_id, v.turn, a.tokens AS sentence1, b.tokens AS sentence2
    FROM v_turn_pairs v JOIN seen_tokens a ON a.qid = v.qid1 JOIN seen_tokens b ON b.qid = v.qid2
    WHERE a.tokens <> '' AND b.tokens <> ''""", ctes=CHAIN_CTES)
def q_question_corpus_chain(spark, sf_dir):
    """Pairs -> first-seen text per question -> Treebank tokens -> index strings -> token lookup -> sentences.

    The index strings name every token of the question in order, so the
    rebuilt sentence is the question's token string.
    """
    pairs = B.v_turn_pairs(spark, sf_dir)
    seen = P.first_seen(pairs, [("qid1", "question1"), ("qid2", "question2")], ["conv_id", "turn"])
    tokens = materialise(seen.select("qid", TB.treebank_tokenise(F.col("text")).alias("tokens")))
    n = F.size("tokens")
    every = tokens.select("qid", F.when(n > 0, F.array_join(F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: i.cast("string")), "/")).otherwise(F.lit("")).alias("s"))
    one = every.select(F.col("qid").alias("qid1"), F.col("s").alias("sentence1"))
    two = every.select(F.col("qid").alias("qid2"), F.col("s").alias("sentence2"))
    coded = pairs.select("conv_id", "turn", "qid1", "qid2").join(one, "qid1").join(two, "qid2")
    rebuilt = P.rebuild_pairs(coded, tokens, id_cols=["conv_id", "turn"])
    return rebuilt.filter("ok").select("conv_id", "turn", "sentence1", "sentence2")


@register("pair_corpus_chain", sql=f"""
    SELECT id, corpus, split, {tb_detok_sql(tb_text_sql('s1'))} AS sentence1, {tb_detok_sql(tb_text_sql('s2'))} AS sentence2
    FROM ({SPLIT3_SQL.format(key='id', src='pair_union')})""", ctes=CHAIN_CTES)
def q_pair_corpus_chain(spark, sf_dir):
    """Positive pairs of two corpora -> union -> both sides tokenised and detokenised -> 80/10/10."""
    qqp = B.v_qqp(spark, sf_dir).filter("is_duplicate = 1").select(
        F.concat(F.lit("qqp:"), F.col("id").cast("string")).alias("id"), F.lit("qqp").alias("corpus"),
        F.col("question1").alias("s1"), F.col("question2").alias("s2"))
    turns = B.v_turn_pairs(spark, sf_dir).select(
        F.concat_ws(":", F.lit("turns"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.lit("turns").alias("corpus"), F.col("question1").alias("s1"), F.col("question2").alias("s2"))
    pairs = split_three(qqp.unionByName(turns), "id", seed=738)
    back = {f"sentence{k}": TB.treebank_detokenise(TB.treebank_text(F.col(f"s{k}"))) for k in (1, 2)}
    return pairs.select("id", "corpus", "split", *[c.alias(name) for name, c in back.items()])
