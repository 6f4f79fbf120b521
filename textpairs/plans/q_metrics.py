"""Registered queries: ordered metric logs -- EMA (A9) and best-of (A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.operators import metrics as M
from textpairs.plans import bridge as B
from textpairs.plans.registry import register

ALPHA = 0.02


@register("ema", sql=f"""
    SELECT user_id, event_id, step,
           round(pow({1 - ALPHA}, step + 1) * x0 + {ALPHA} * pow({1 - ALPHA}, step) * s, 6) AS ema
    FROM (SELECT user_id, event_id, step,
                 first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x0,
                 sum(value * pow({1 - ALPHA}, -step)) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                                           ROWS UNBOUNDED PRECEDING) AS s
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM v_metric))""")
def q_ema(spark, sf_dir):
    m = B.v_metric(spark, sf_dir)
    e = M.ema(m, "user_id", [F.col("ts"), F.col("event_id")], "value", alpha=ALPHA)
    return e.select("user_id", "event_id", "step", M.round_double("ema").alias("ema"))


@register("best_by", sql="""
    SELECT user_id, event_id, value FROM v_metric
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1""")
def q_best_by(spark, sf_dir):
    return M.best_by(B.v_metric(spark, sf_dir), "user_id", "value", "event_id", ["event_id", "value"])
