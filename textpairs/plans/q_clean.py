"""Registered queries: projection / filter / validation (F1-F10) and the
flagship NLI preparation (F3 -> F4 -> F1 -> W5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.operators import clean
from textpairs.operators.rank import ordered_rank
from textpairs.operators.split import split_stratified
from textpairs.plans import bridge as B
from textpairs.plans.registry import register

ENCODE_SQL = """CASE gold_label WHEN 'entailment' THEN 0 WHEN 'neutral' THEN 1
                WHEN 'contradiction' THEN 2 END"""

CLEAN_WHERE = "gold_label IS NOT NULL AND gold_label <> '-' AND sentence1 IS NOT NULL AND sentence2 IS NOT NULL"

NLI_EXAMPLES_CTE = {
    "nli_examples": f"""
        SELECT pairID AS id, sentence1 AS premise, sentence2 AS hypothesis,
               CAST({ENCODE_SQL} AS INTEGER) AS label
        FROM v_nli WHERE {CLEAN_WHERE}""",
}

STRATIFIED_CTES = dict(NLI_EXAMPLES_CTE, **{
    "cls": """SELECT label, count(*) AS n_label FROM nli_examples GROUP BY label""",
    "q0": """SELECT label, n_label, sum(n_label) OVER () AS total,
                    (sum(n_label) OVER () + 9) // 10 AS want FROM cls""",
    "q1": """SELECT *, (want * n_label) // total AS base, (want * n_label) % total AS rem FROM q0""",
    "q2": """SELECT *, want - sum(base) OVER () AS extra,
                    row_number() OVER (ORDER BY rem DESC, label) AS rn FROM q1""",
    "quota": """SELECT label, base + CASE WHEN rn <= extra THEN 1 ELSE 0 END AS quota FROM q2""",
    "strat": """SELECT e.*, CASE WHEN row_number() OVER (PARTITION BY e.label
                         ORDER BY md5('42:' || e.id), e.id) - 1 < q.quota THEN 'valid' ELSE 'train' END AS split
                FROM nli_examples e JOIN quota q ON e.label = q.label""",
})


def nli_examples(spark, sf_dir):
    """F3 -> F4 -> F1 over the raw NLI view: (id, premise, hypothesis, label)."""
    raw = B.v_nli(spark, sf_dir)
    enc = clean.encode_label(clean.clean_nli(raw))
    return clean.canonical_pairs(enc, {**clean.NLI_COLUMNS, "label": "label"})


def nli_split(spark, sf_dir):
    return split_stratified(nli_examples(spark, sf_dir), key="id", label="label", fraction=0.1, seed=42)


@register("nli_split_counts", sql="""
    SELECT split, label, count(*) AS n FROM strat GROUP BY split, label""", ctes=STRATIFIED_CTES)
def nli_split_counts(spark, sf_dir):
    """Flagship: rows per (split, label) after clean, encode and stratified split."""
    return nli_split(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("split_stratified", sql="SELECT id, label, split FROM strat", ctes=STRATIFIED_CTES)
def q_split_stratified(spark, sf_dir):
    return nli_split(spark, sf_dir).select("id", "label", "split")


@register("canonical_pairs", sql="""
    SELECT id, question1 AS sentence1, question2 AS sentence2, is_duplicate AS label FROM v_qqp""")
def q_canonical_pairs(spark, sf_dir):
    return clean.canonical_pairs(B.v_qqp(spark, sf_dir), clean.QUESTION_PAIRS, keep=["id"])


@register("positive_pairs", sql="""
    SELECT id, question1 AS sentence1, question2 AS sentence2 FROM v_qqp WHERE is_duplicate = 1""")
def q_positive_pairs(spark, sf_dir):
    pos = clean.positive_pairs(B.v_qqp(spark, sf_dir), "is_duplicate")
    return pos.select("id", F.col("question1").alias("sentence1"), F.col("question2").alias("sentence2"))


@register("clean_nli", sql=f"SELECT pairID, sentence1, sentence2, gold_label FROM v_nli WHERE {CLEAN_WHERE}")
def q_clean_nli(spark, sf_dir):
    return clean.clean_nli(B.v_nli(spark, sf_dir)).select("pairID", "sentence1", "sentence2", "gold_label")


@register("encode_label", sql="SELECT id, premise, hypothesis, label FROM nli_examples", ctes=NLI_EXAMPLES_CTE)
def q_encode_label(spark, sf_dir):
    return nli_examples(spark, sf_dir)


@register("decode_label", sql="""
    SELECT id, label, CASE label WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral'
                      WHEN 2 THEN 'contradiction' END AS decoded FROM nli_examples""", ctes=NLI_EXAMPLES_CTE)
def q_decode_label(spark, sf_dir):
    ex = nli_examples(spark, sf_dir).select("id", "label")
    return clean.decode_label(ex, "label", out="decoded")


@register("check_labels", sql="""
    SELECT true AS has_label, CAST(min(label) AS INTEGER) AS min_label, CAST(max(label) AS INTEGER) AS max_label,
           count(DISTINCT label) AS n_classes,
           coalesce(min(label) = 0 AND max(label) = count(DISTINCT label) - 1, false) AS ok
    FROM nli_examples""", ctes=NLI_EXAMPLES_CTE)
def q_check_labels(spark, sf_dir):
    return clean.check_labels(nli_examples(spark, sf_dir), "label")


@register("filter_report", sql=f"""
    SELECT source, count(*) AS rows_before, count(*) FILTER (WHERE {CLEAN_WHERE}) AS rows_after
    FROM v_nli GROUP BY source""")
def q_filter_report(spark, sf_dir):
    return clean.filter_report(B.v_nli(spark, sf_dir), clean.nli_usable(), by=["source"])


@register("optional_label", sql=f"""
    SELECT pairID AS id, CAST(CASE WHEN {CLEAN_WHERE} THEN {ENCODE_SQL} END AS INTEGER) AS label,
           CAST(coalesce(CASE WHEN {CLEAN_WHERE} THEN {ENCODE_SQL} END, 0) AS INTEGER) AS label_filled
    FROM v_nli""")
def q_optional_label(spark, sf_dir):
    raw = B.v_nli(spark, sf_dir)
    # unusable rows are "unlabelled": their label column is null (one projection, no join)
    masked = raw.select(F.col("pairID").alias("id"),
                        F.when(clean.nli_usable(), F.col("gold_label")).alias("gold_label"))
    enc = clean.with_optional_label(clean.encode_label(masked, on_unknown="null"), "label")
    return enc.select("id", "label", F.coalesce(F.col("label"), F.lit(0)).alias("label_filled"))


@register("every_nth", sql="""
    SELECT user_id, event_id, step, value FROM (
        SELECT user_id, event_id, value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
        FROM v_metric) WHERE (step + 1) % 10 = 0""")
def q_every_nth(spark, sf_dir):
    m = B.v_metric(spark, sf_dir)
    stepped = ordered_rank(m, [F.col("ts"), F.col("event_id")], name="step", partition_by=["user_id"])
    return clean.every_nth(stepped, "step", 10).select("user_id", "event_id", "step", "value")


@register("head_slice", sql="""
    SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
    WHERE pos < 320 AND pos % 20 = 0""")
def q_head_slice(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id")
    return clean.head_slice(docs, [F.col("doc_id")], 0, 320, 20)
