"""Plan assertions and determinism under different shuffle
partition counts."""

import re

import pytest

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textpairs.operators import split as S
from textpairs.plans.registry import QUERIES, load_all
from textpairs.session import ensure_checkpoint_dir
from tools.check_oracle import digest

load_all()
PYTHON_WORKER_KEYS = {"tokenise_corpus", "decode_corpus", "roundtrip_audit", "score_batches"}
STREAM_KEYS = {"stream_scoring", "stream_value_counts", "stream_ema", "stream_ema_ordered"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAM_KEYS))
def test_no_row_at_a_time_python(spark, key):
    plan = plan_of(QUERIES[key](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan
    if key in PYTHON_WORKER_KEYS:
        assert "MapInPandas" in plan
    else:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_splits_decide_rows_where_they_are_scanned(spark):
    """No exchange carries the text columns: thresholds come from keys alone."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for df in (S.split_two(docs, "doc_id"), S.split_three(docs, "doc_id"), S.split_stratified(docs, "doc_id", "lang"),
               S.split_two(docs, "source", by_group=True)):
        plan = df._jdf.queryExecution().explainString(mode)
        moved = re.findall(r"\) (?:Exchange|BroadcastExchange)\nInput \[\d+\]: \[([^\]]*)\]", plan)
        assert moved and not any("text" in cols for cols in moved)
        assert df.filter(F.col("text").isNull()).count() == 0


def test_positive_pairs_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["positive_pairs"](spark, SF_SMALL))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    assert any("EqualTo(quality,1)" in p for p in pushed), plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(QUERIES["shuffle_rank"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all(s == "struct<doc_id:bigint>" for s in schemas), schemas


def _single_partition_inputs(plan: str):
    """Operators that feed an Exchange SinglePartition (child line below it)."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and i + 1 < len(lines):
            out.append(lines[i + 1].strip())
    return out


@pytest.mark.parametrize("key", ["shuffle_rank", "split_two", "split_three", "split_stratified",
                                 "sortish_batches", "fixed_batches", "every_nth", "ema"])
def test_single_partition_only_over_aggregated_tables(spark, key):
    plan = plan_of(QUERIES[key](spark, SF_SMALL))
    for child in _single_partition_inputs(plan):
        assert "Aggregate" in child, (key, child)  # hash, object-hash or (keyless) sort aggregate


@pytest.mark.parametrize("key", ["split_stratified", "sortish_batches", "ema", "tokenise_vocab", "collect_groups"])
def test_results_do_not_depend_on_shuffle_partitions(spark, key):
    digests = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "8", "33"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[key](spark, SF_SMALL)
            digests.append(digest(df.columns, [tuple(r) for r in df.collect()])[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(set(digests)) == 1


def _scans(df, table: str) -> int:
    """File scans of a table in the whole plan, subqueries included."""
    text = plan_of(df).split("+- == Initial Plan ==")[0]
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", text))


def test_splits_read_the_rows_once(spark):
    """Thresholds come from the written keys: the table itself is scanned where the rows are decided."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for df in (S.split_two(docs, "doc_id"), S.split_three(docs, "doc_id"), S.split_stratified(docs, "doc_id", "lang"),
               S.split_two(docs, "source", by_group=True)):
        assert _scans(df, "documents") == 1


@pytest.mark.parametrize("key", ["rebuild_pairs", "rebuild_sentences"])
def test_rebuilds_read_references_and_tokens_once(spark, key):
    assert _scans(QUERIES[key](spark, SF_SMALL), "documents") == 2


def test_many_idle_references_spread_over_tasks(spark):
    """References that ask nothing have no common key: neither join deals them to one task."""
    from textpairs.operators import pairs as P

    refs = spark.range(20_000).select("id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("qid"),
                                      F.lit(None).cast("long").alias("idx"), F.lit(True).alias("malformed"))
    tokens = spark.createDataFrame([(1, ["a"])], "qid long, tokens array<string>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (P.resolve_tokens(refs, tokens), P.lookup_tokens(refs, tokens)):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 20_000 and max(sizes) < 6000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
