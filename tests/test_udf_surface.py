"""User functions and pluggable callables."""

from pyspark.sql import functions as F

from textpairs.operators import batches as BT
from textpairs.operators import metrics as M
from textpairs.operators.score import with_text_fn


def test_with_text_fn_column_function_stays_in_catalyst(spark):
    df = spark.createDataFrame([("a b",)], "s string")
    out = with_text_fn(df, "s", column_fn=F.upper, out="u")
    assert out.collect()[0].u == "A B"
    assert "BatchEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()


def test_with_text_fn_python_function_is_vectorised(spark):
    df = spark.createDataFrame([("a b",), (None,)], "s string")
    out = with_text_fn(df, "s", python_fn=lambda v: v[::-1], out="r")
    assert sorted((r.r or "") for r in out.collect()) == ["", "b a"]
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()


def test_pluggable_sort_key_and_loss(spark):
    df = spark.createDataFrame([(k, [1] * (k % 5)) for k in range(20)], "k long, ids array<int>")
    df = df.withColumn("len", F.size("ids"))
    neg = BT.length_order(df, "len", "k", sort_key=lambda c: -c).collect()
    first = min(neg, key=lambda r: r["rank"])
    assert first.len == 0
    b = BT.sortish_batches(df, "k", "len", 4, sort_key=lambda c: c * 2)
    assert sorted(r.k for r in b.collect()) == list(range(20))
    lg = spark.createDataFrame([([0.0, 1.0], 1)], "logits array<double>, y int")
    zero = M.row_loss(lg, "logits", "y", loss_fn=lambda l, t: F.lit(0.0)).collect()[0].loss
    ce = M.row_loss(lg, "logits", "y").collect()[0].loss
    assert zero == 0.0 and abs(ce - 0.31326168751822286) < 1e-12


def test_a_python_function_is_never_taken_for_a_column_function(spark):
    import pytest

    df = spark.createDataFrame([("abcdef",), (None,)], "s string")
    out = with_text_fn(df, "s", python_fn=lambda v: v[1:3], out="r").collect()
    assert [r.r for r in out] == ["bc", None]
    with pytest.raises(ValueError):
        with_text_fn(df, "s")
    with pytest.raises(ValueError):
        with_text_fn(df, "s", python_fn=str, column_fn=F.upper)


def test_predictor_is_built_once_per_worker(spark, tmp_dir):
    from textpairs.operators.score import score_batches

    mark = tmp_dir

    def factory():
        import os
        import uuid

        open(os.path.join(mark, uuid.uuid4().hex), "w").close()
        return lambda pdf: pdf["id"] % 2

    out = score_batches(spark.range(0, 4000, 1, 16), factory)
    assert out.filter("prediction <> id % 2").count() == 0
    import os

    assert len(os.listdir(mark)) <= 2 * spark.sparkContext.defaultParallelism < 16
