"""Registered queries: corpus union, swap, recipe mixing (U1-U3), epoch plan
(A13) and corpus inventory (A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.operators import metrics as M
from textpairs.operators import mix as X
from textpairs.operators.split import split_three
from textpairs.plans import bridge as B
from textpairs.plans.q_clean import NLI_EXAMPLES_CTE, nli_examples
from textpairs.plans.registry import register, rounded

_RECIPE_VALUES = ", ".join(f"('{r}', '{c}', {m})" for r, parts in X.RECIPES.items() for c, m in parts.items())

MIX_CTES = {
    "recipes": f"SELECT * FROM (VALUES {_RECIPE_VALUES}) AS t(recipe, corpus, multiplier)",
    "mixed": """
        SELECT r.recipe, c.doc_id, c.corpus, CAST(unnest(range(1, r.multiplier + 1)) AS INTEGER) AS copy_no
        FROM v_corpora c JOIN recipes r ON c.corpus = r.corpus""",
}


@register("union_corpora", sql="""
    SELECT 'quora' AS corpus, CAST(id AS VARCHAR) AS id, question1 AS sentence1, question2 AS sentence2,
           is_duplicate AS label FROM v_qqp
    UNION ALL
    SELECT 'nli', id, premise, hypothesis, label FROM nli_examples
    UNION ALL
    SELECT 'turns', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), question1, question2,
           CAST(NULL AS INTEGER) FROM v_turn_pairs""", ctes=NLI_EXAMPLES_CTE)
def q_union_corpora(spark, sf_dir):
    quora = B.v_qqp(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("question1").alias("sentence1"),
                                          F.col("question2").alias("sentence2"), F.col("is_duplicate").alias("label"))
    nli = nli_examples(spark, sf_dir).select("id", F.col("premise").alias("sentence1"),
                                             F.col("hypothesis").alias("sentence2"), "label")
    turns = B.v_turn_pairs(spark, sf_dir).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("question1").alias("sentence1"), F.col("question2").alias("sentence2"),
        F.lit(None).cast("int").alias("label"))
    return X.union_corpora({"quora": quora, "nli": nli, "turns": turns},
                           ["id", "sentence1", "sentence2", "label"])


@register("bidirectional", sql="""
    SELECT conv_id, turn, question1 AS source, question2 AS target, false AS swapped FROM v_turn_pairs
    UNION ALL
    SELECT conv_id, turn, question2, question1, true FROM v_turn_pairs""")
def q_bidirectional(spark, sf_dir):
    return X.bidirectional(B.v_turn_pairs(spark, sf_dir), "question1", "question2", keep=["conv_id", "turn"])


@register("mix_corpora", sql="SELECT recipe, doc_id, corpus, copy_no FROM mixed", ctes=MIX_CTES)
def q_mix_corpora(spark, sf_dir):
    c = B.v_corpora(spark, sf_dir).select("doc_id", "corpus")
    return X.mix(c, X.recipe_table(spark)).select("recipe", "doc_id", "corpus", "copy_no")


@register("epoch_plan", sql="""
    SELECT recipe, rows, rows // 16 AS steps_per_epoch, (rows // 16) * 5 AS total_steps,
           ((rows // 16) * 5 * 5) // 100 AS warmup_steps,
           CAST(ceil(((rows // 16) * 5 * 95) / 100.0) AS BIGINT) + 1 AS decay_steps
    FROM (SELECT recipe, count(*) AS rows FROM mixed GROUP BY recipe)""", ctes=MIX_CTES)
def q_epoch_plan(spark, sf_dir):
    mixed = X.mix(B.v_corpora(spark, sf_dir).select("doc_id", "corpus"), X.recipe_table(spark))
    counts = mixed.groupBy("recipe").agg(F.count(F.lit(1)).alias("rows"))
    return M.epoch_plan(counts, "rows", batch_size=16, accum=1, epochs=5, warm_pct=5)


SPLIT3_SQL = """
    SELECT *, CASE WHEN rnk < (t + 1) // 2 THEN 'test' WHEN rnk < t THEN 'valid' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY md5('738:' || CAST({key} AS VARCHAR)), {key}) - 1 AS rnk,
                 (count(*) OVER () + 4) // 5 AS t
          FROM {src})"""


@register("corpus_stats", sql=f"""
    SELECT corpus, split, count(*) AS rows, count(label) AS labelled,
           round(avg(CAST(label AS DOUBLE)), 6) AS positive_rate
    FROM ({SPLIT3_SQL.format(key='doc_id', src='v_corpora')}) GROUP BY corpus, split""")
def q_corpus_stats(spark, sf_dir):
    c = split_three(B.v_corpora(spark, sf_dir), "doc_id", seed=738)
    return rounded(M.corpus_stats(c, ["corpus", "split"], "label"), ["positive_rate"])
