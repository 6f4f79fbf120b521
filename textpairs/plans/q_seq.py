"""Registered queries: sequence examples, batch widths, padding and collation
(Q5-Q12) over the vocabulary-tokenised NLI corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.functions import arrays as A
from textpairs.operators import batches as BT
from textpairs.operators import mix as X
from textpairs.operators import tokens as TK
from textpairs.plans.q_vocab import NLI_TOK_CTES, nli_tok
from textpairs.plans.registry import register, rounded


# Ids of the prompts "paraphrase: " (with end), "mnli hypothesis: "
# and " premise: " under the public 32k piece model.
PARA_IDS = [940, 377, 2176, 555, 28747, 28705, 2]
HYP_IDS = [290, 28711, 1144, 23592, 28747, 28705]
PREM_IDS = [28705, 5146, 864, 28747, 28705]
NLI_MAX_LEN = 128
S2S_MAX_LEN = 64
BATCH = 16


def _lit(ids: list[int]) -> str:
    return "[" + ", ".join(str(i) for i in ids) + "]"


_HALF = NLI_MAX_LEN // 2
SEQ_CTES = dict(NLI_TOK_CTES, **{
    "ex6": f"""
        SELECT id, label,
               {_lit(HYP_IDS)} || hypothesis_ids[1:greatest(least({_HALF - 1}, len(hypothesis_ids) - 1), 0)]
               || {_lit(PREM_IDS)} || premise_ids[1:least({_HALF}, len(premise_ids))] AS input
        FROM nli_tok""",
    "b6": f"SELECT *, (row_number() OVER (ORDER BY id) - 1) // {BATCH} AS batch FROM ex6",
    "w6": f"""
        SELECT *, CASE WHEN max(len(input)) OVER (PARTITION BY batch) > 8
                       THEN CAST(ceil(least({NLI_MAX_LEN}, max(len(input)) OVER (PARTITION BY batch)) / 8.0) * 8 AS INTEGER)
                       ELSE CAST(max(len(input)) OVER (PARTITION BY batch) AS INTEGER) END AS width
        FROM b6""",
    "ex5": f"""
        SELECT id, false AS swapped, {_lit(PARA_IDS)} || premise_ids AS src, hypothesis_ids AS tgt FROM nli_tok
        UNION ALL
        SELECT id, true AS swapped, {_lit(PARA_IDS)} || hypothesis_ids AS src, premise_ids AS tgt FROM nli_tok""",
    "b5": f"SELECT *, (row_number() OVER (ORDER BY id, swapped) - 1) // {BATCH} AS batch FROM ex5",
    "w5": f"""
        SELECT *,
          CASE WHEN max(len(src)) OVER (PARTITION BY batch) > 8
               THEN CAST(ceil(least({S2S_MAX_LEN}, max(len(src)) OVER (PARTITION BY batch)) / 8.0) * 8 AS INTEGER)
               ELSE CAST(max(len(src)) OVER (PARTITION BY batch) AS INTEGER) END AS sw,
          CASE WHEN max(len(tgt)) OVER (PARTITION BY batch) > 8
               THEN CAST(ceil(least({S2S_MAX_LEN}, max(len(tgt)) OVER (PARTITION BY batch)) / 8.0) * 8 AS INTEGER)
               ELSE CAST(max(len(tgt)) OVER (PARTITION BY batch) AS INTEGER) END AS tw
        FROM b5""",
    "c5": f"""
        SELECT id, swapped, batch,
               list_resize(src[1:{S2S_MAX_LEN}], sw, 0) AS input_ids,
               list_resize(list_transform(src[1:{S2S_MAX_LEN}], lambda x: 1), sw, 0) AS attention_mask,
               list_resize(tgt[1:{S2S_MAX_LEN}], tw, 0) AS target_ids,
               list_resize(list_transform(tgt[1:{S2S_MAX_LEN}], lambda x: 1), tw, 0) AS target_mask
        FROM w5""",
})


def _j(c: str):
    return F.array_join(F.col(c), ",").alias(c)


def seq2seq(spark, sf_dir, cache: bool = False):
    tok = nli_tok(spark, sf_dir, cache=cache)
    both = X.bidirectional(tok, "premise_ids", "hypothesis_ids", keep=["id"])
    return both.select("id", "swapped", A.seq2seq_input(PARA_IDS, "source").alias("src"),
                       F.col("target").alias("tgt"))


def nli_inputs(spark, sf_dir, cache: bool = False):
    tok = nli_tok(spark, sf_dir, cache=cache)
    return tok.select("id", "label", A.nli_input("hypothesis_ids", "premise_ids", HYP_IDS, PREM_IDS,
                                                 NLI_MAX_LEN).alias("input"))


@register("seq2seq_examples", sql="""
    SELECT id, swapped, array_to_string(src, ',') AS input_ids, array_to_string(tgt, ',') AS target_ids FROM ex5""",
    ctes=SEQ_CTES)
def q_seq2seq_examples(spark, sf_dir):
    s = seq2seq(spark, sf_dir)
    return s.select("id", "swapped", F.array_join("src", ",").alias("input_ids"),
                    F.array_join("tgt", ",").alias("target_ids"))


@register("nli_examples", sql="""
    SELECT id, label, array_to_string(input, ',') AS input_ids, len(input) AS n FROM ex6""", ctes=SEQ_CTES)
def q_nli_examples(spark, sf_dir):
    ex = nli_inputs(spark, sf_dir)
    return ex.select("id", "label", F.array_join("input", ",").alias("input_ids"),
                     F.size("input").cast("long").alias("n"))


@register("drop_last_id", sql="""
    SELECT id, array_to_string(premise_ids[1:len(premise_ids) - 1], ',') AS premise_trimmed FROM nli_tok""",
    ctes=SEQ_CTES)
def q_drop_last_id(spark, sf_dir):
    tok = nli_tok(spark, sf_dir)
    return tok.select("id", F.array_join(A.drop_last_id("premise_ids"), ",").alias("premise_trimmed"))


@register("shift_right", sql="""
    SELECT id, array_to_string(CASE WHEN len(hypothesis_ids) = 0 THEN hypothesis_ids
                                    ELSE [0] || hypothesis_ids[1:len(hypothesis_ids) - 1] END, ',') AS decoder_input
    FROM nli_tok""", ctes=SEQ_CTES)
def q_shift_right(spark, sf_dir):
    tok = nli_tok(spark, sf_dir)
    return tok.select("id", F.array_join(A.shift_right("hypothesis_ids", 0), ",").alias("decoder_input"))


@register("pad_width", sql=f"""
    SELECT batch, count(*) AS rows, CAST(max(len(input)) AS INTEGER) AS max_len,
           CASE WHEN max(len(input)) > 8 THEN CAST(ceil(least({NLI_MAX_LEN}, max(len(input))) / 8.0) * 8 AS INTEGER)
                ELSE CAST(max(len(input)) AS INTEGER) END AS width
    FROM b6 GROUP BY batch""", ctes=SEQ_CTES)
def q_pad_width(spark, sf_dir):
    b = BT.fixed_batches(nli_inputs(spark, sf_dir, cache=True), "id", BATCH)
    return BT.pad_widths(b, "batch", "input", NLI_MAX_LEN)


@register("pad_batch", sql=f"""
    SELECT id, batch, array_to_string(list_resize(input[1:{NLI_MAX_LEN}], width, 0), ',') AS input_padded,
           array_to_string(list_resize(list_transform(input[1:{NLI_MAX_LEN}], lambda x: 1), width, 0), ',') AS mask
    FROM w6""", ctes=SEQ_CTES)
def q_pad_batch(spark, sf_dir):
    b = BT.fixed_batches(nli_inputs(spark, sf_dir, cache=True), "id", BATCH)
    p = BT.pad_batch(b, "batch", "input", NLI_MAX_LEN, pad=TK.PAD_ID, out="input_padded", mask="mask")
    return p.select("id", "batch", _j("input_padded"), _j("mask"))


def _collated(spark, sf_dir):
    b = BT.fixed_batches(seq2seq(spark, sf_dir, cache=True), ["id", "swapped"], BATCH)
    return BT.collate(b, "batch", "src", "tgt", S2S_MAX_LEN, pad=TK.PAD_ID, start=0, mode="seq2seq")


@register("collate", sql="""
    SELECT id, swapped, batch, array_to_string(input_ids, ',') AS input_ids,
           array_to_string(attention_mask, ',') AS attention_mask,
           array_to_string(CASE WHEN len(target_ids) = 0 THEN target_ids
                                ELSE [0] || target_ids[1:len(target_ids) - 1] END, ',') AS decoder_input_ids,
           array_to_string(target_ids, ',') AS target_ids, array_to_string(target_mask, ',') AS target_mask
    FROM c5""", ctes=SEQ_CTES)
def q_collate(spark, sf_dir):
    c = _collated(spark, sf_dir)
    return c.select("id", "swapped", "batch", F.array_join("inputs.input_ids", ",").alias("input_ids"),
                    F.array_join("inputs.attention_mask", ",").alias("attention_mask"),
                    F.array_join("inputs.decoder_input_ids", ",").alias("decoder_input_ids"),
                    F.array_join("targets.ids", ",").alias("target_ids"),
                    F.array_join("targets.mask", ",").alias("target_mask"))


@register("collate_classifier", sql=f"""
    SELECT id, batch, array_to_string(list_resize(input[1:{NLI_MAX_LEN}], width, 0), ',') AS input_ids,
           array_to_string(list_resize(list_transform(input[1:{NLI_MAX_LEN}], lambda x: 1), width, 0), ',')
             AS attention_mask,
           '0' AS decoder_input_ids, CAST(label AS VARCHAR) AS target_ids
    FROM w6""", ctes=SEQ_CTES)
def q_collate_classifier(spark, sf_dir):
    ex = nli_inputs(spark, sf_dir, cache=True).withColumn("target", F.array(F.col("label")))
    b = BT.fixed_batches(ex, "id", BATCH)
    c = BT.collate(b, "batch", "input", "target", NLI_MAX_LEN, pad=TK.PAD_ID, start=0, mode="classifier")
    return c.select("id", "batch", F.array_join("inputs.input_ids", ",").alias("input_ids"),
                    F.array_join("inputs.attention_mask", ",").alias("attention_mask"),
                    F.array_join("inputs.decoder_input_ids", ",").alias("decoder_input_ids"),
                    F.array_join("targets.ids", ",").alias("target_ids"))


@register("padding_report", sql="""
    SELECT batch, CAST(sum(list_sum(attention_mask)) AS BIGINT) AS real_tokens,
           CAST(sum(len(attention_mask)) AS BIGINT) AS slots, count(*) AS rows,
           round(sum(list_sum(attention_mask)) / sum(len(attention_mask)), 6) AS fill
    FROM c5 GROUP BY batch""", ctes=SEQ_CTES)
def q_padding_report(spark, sf_dir):
    c = _collated(spark, sf_dir).select("batch", F.col("inputs.attention_mask").alias("attention_mask"))
    return rounded(BT.padding_report(c, "batch", "attention_mask"), ["fill"])
