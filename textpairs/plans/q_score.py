"""Registered queries: scoring and evaluation (P2-P4, Q13, Q14, W10) and the
loss / accuracy metrics (A3-A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.functions import arrays as A
from textpairs.operators import batches as BT
from textpairs.operators import metrics as M
from textpairs.operators import score as S
from textpairs.plans import bridge as B
from textpairs.plans.registry import register, rounded

SEQ_POS = 8  # positions per sequence row in the sequence-logit bridge

LOGIT_CTES = {
    "scored": """
        SELECT vec_id, label, logits, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS prediction
        FROM v_logits""",
    "ce": """
        SELECT vec_id, label, ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
                              + list_max(logits) - logits[label + 1] AS loss
        FROM v_logits""",
    "v_seq": f"""
        SELECT vec_id,
               list_transform(range({SEQ_POS}), lambda p: list_transform(range({SEQ_POS}),
                   lambda c: CAST(embedding[p * {SEQ_POS} + c + 1] AS DOUBLE))) AS logits,
               list_transform(range(vec_id % {SEQ_POS} + 1), lambda p: CAST((vec_id + p) % {SEQ_POS} AS INTEGER))
                   AS target
        FROM embeddings""",
    "v_seq2": f"""
        SELECT vec_id, logits, target,
               list_transform(logits, lambda l: CAST(list_position(l, list_max(l)) - 1 AS INTEGER)) AS pred,
               list_resize(target, {SEQ_POS}, 0) AS target_padded,
               list_resize(list_transform(target, lambda t: 1), {SEQ_POS}, 0) AS mask
        FROM v_seq""",
}


def scored(spark, sf_dir):
    return S.predict(B.v_logits(spark, sf_dir))


def v_seq(spark, sf_dir):
    """Sequence bridge over embeddings: 8 positions x 8 class logits per row;
    target (length vec_id % 8 + 1) = (vec_id + p) % 8; padded target and mask."""
    emb = B.table(spark, sf_dir, "embeddings")
    n = SEQ_POS
    logits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.get(F.col("embedding"), p * n + c).cast("double")))
    target = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % n).cast("int")),
                         lambda p: ((F.col("vec_id") + p) % n).cast("int"))
    d = emb.select("vec_id", logits.alias("logits"), target.alias("target"))
    return d.select("vec_id", "logits", "target",
                    F.transform("logits", lambda l: A.argmax(l)).alias("pred"),
                    A.pad_to("target", n, 0).alias("target_padded"),
                    A.mask_of("target", n).alias("mask"))


@register("linear_head", sql="SELECT vec_id, " + ", ".join(
    f"round(logits[{c + 1}], 6) AS logit_{c}" for c in range(B.N_CLASSES)) + " FROM v_logits")
def q_linear_head(spark, sf_dir):
    lg = B.v_logits(spark, sf_dir)
    return lg.select("vec_id", *[M.round_double(F.get("logits", c)).alias(f"logit_{c}") for c in range(B.N_CLASSES)])


@register("argmax", sql="SELECT vec_id, prediction FROM scored", ctes=LOGIT_CTES)
def q_argmax(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "prediction")


@register("predictions_table", sql="SELECT CAST(vec_id AS VARCHAR) AS id, prediction FROM scored", ctes=LOGIT_CTES)
def q_predictions_table(spark, sf_dir):
    return S.predictions_table(B.v_logits(spark, sf_dir), "vec_id")


@register("evaluate", sql="""
    SELECT label, prediction, n, round(sum(CASE WHEN label = prediction THEN n ELSE 0 END) OVER () * 100.0
                                       / sum(n) OVER (), 6) AS accuracy
    FROM (SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction)""", ctes=LOGIT_CTES)
def q_evaluate(spark, sf_dir):
    return rounded(S.evaluate(scored(spark, sf_dir)), ["accuracy"])


@register("value_counts", sql="""
    SELECT 'label' AS column, CAST(label AS VARCHAR) AS value, count(*) AS n FROM scored GROUP BY label
    UNION ALL
    SELECT 'prediction', CAST(prediction AS VARCHAR), count(*) FROM scored GROUP BY prediction""", ctes=LOGIT_CTES)
def q_value_counts(spark, sf_dir):
    return M.value_counts(scored(spark, sf_dir), ["label", "prediction"])


@register("accuracy", sql="""
    SELECT round(avg(CAST(label IS NOT DISTINCT FROM prediction AS DOUBLE)) * 100, 6) AS accuracy FROM scored""",
    ctes=LOGIT_CTES)
def q_accuracy(spark, sf_dir):
    return rounded(M.accuracy(scored(spark, sf_dir), "label", "prediction"), ["accuracy"])


@register("top_candidates", sql="""
    SELECT vec_id, cls AS candidate, cand_rank, round(logit, 6) AS logit FROM (
        SELECT vec_id, cls, logit, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, cls) - 1 AS cand_rank
        FROM (SELECT vec_id, CAST(unnest(range(len(logits))) AS INTEGER) AS cls, unnest(logits) AS logit
              FROM v_logits))
    WHERE cand_rank < 5""")
def q_top_candidates(spark, sf_dir):
    lg = B.v_logits(spark, sf_dir).select("vec_id", F.posexplode("logits").alias("candidate", "logit"))
    top = S.top_candidates(lg, "vec_id", "candidate", "logit", 5)
    return top.select("vec_id", "candidate", "cand_rank", M.round_double("logit").alias("logit"))


@register("cross_entropy", sql="SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM ce", ctes=LOGIT_CTES)
def q_cross_entropy(spark, sf_dir):
    return rounded(M.mean_cross_entropy(B.v_logits(spark, sf_dir), "logits", "label"), ["loss"])


@register("batch_loss", sql="""
    SELECT round(avg(m), 6) AS mean_of_batches, round(sum(s) / sum(n), 6) AS pooled, count(*) AS n_batches FROM (
        SELECT batch, avg(loss) AS m, sum(loss) AS s, count(*) AS n FROM (
            SELECT loss, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM ce) GROUP BY batch)""",
    ctes=LOGIT_CTES)
def q_batch_loss(spark, sf_dir):
    lg = B.v_logits(spark, sf_dir).withColumn("loss", A.cross_entropy("logits", "label"))
    b = BT.fixed_batches(lg.select("vec_id", "loss"), "vec_id", 32)
    return rounded(M.batch_loss(b, "batch", "loss"), ["mean_of_batches", "pooled"])


@register("token_accuracy", sql=f"""
    SELECT round(sum(list_sum(list_transform(range({SEQ_POS}), lambda i: CASE WHEN pred[i + 1] = target_padded[i + 1]
                                                               THEN 1 ELSE 0 END)))
             / sum(len(target_padded)), 6) AS acc_with_pad,
           round(sum(list_sum(list_transform(range({SEQ_POS}), lambda i: CASE WHEN pred[i + 1] = target_padded[i + 1]
                                                               THEN mask[i + 1] ELSE 0 END)))
             / sum(list_sum(mask)), 6) AS acc_masked
    FROM v_seq2""", ctes=LOGIT_CTES)
def q_token_accuracy(spark, sf_dir):
    return rounded(M.token_accuracy(v_seq(spark, sf_dir), "pred", "target_padded", "mask"),
                   ["acc_with_pad", "acc_masked"])


@register("masked_cross_entropy", sql=f"""
    SELECT round(sum(list_sum(list_transform(range({SEQ_POS}), lambda i: mask[i + 1] * (
               ln(list_sum(list_transform(logits[i + 1], lambda x: exp(x - list_max(logits[i + 1])))))
               + list_max(logits[i + 1]) - logits[i + 1][target_padded[i + 1] + 1]))))
             / sum(list_sum(mask)), 6) AS loss,
           CAST(sum(list_sum(mask)) AS BIGINT) AS n_tokens
    FROM v_seq2""", ctes=LOGIT_CTES)
def q_masked_cross_entropy(spark, sf_dir):
    return rounded(M.masked_cross_entropy(v_seq(spark, sf_dir), "logits", "target_padded", "mask"), ["loss"])


@register("clip_width", sql="""
    SELECT vec_id, array_to_string(pred[1:len(target)], ',') AS pred_clipped FROM v_seq2""", ctes=LOGIT_CTES)
def q_clip_width(spark, sf_dir):
    s = v_seq(spark, sf_dir)
    return s.select("vec_id", F.array_join(A.clip_width("pred", "target"), ",").alias("pred_clipped"))
