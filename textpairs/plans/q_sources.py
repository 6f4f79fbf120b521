"""Registered queries of the readers and writers (S1-S12): a view of the test
tables is written in the dialect to a fresh folder under the checkpoint folder
and read back.  The SQL twin is the view itself with the dialect's rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textpairs.operators import vocab as V
from textpairs.operators.split import split_three
from textpairs.plans import bridge as B
from textpairs.plans.q_clean import NLI_EXAMPLES_CTE, nli_examples
from textpairs.plans.q_mix import SPLIT3_SQL
from textpairs.plans.q_score import LOGIT_CTES
from textpairs.plans.q_vocab import NLI_TOK_CTES
from textpairs.plans.registry import register
from textpairs.session import scratch_path
from textpairs.sources import io

_NA = ", ".join(f"'{w}'" for w in io.NA_WORDS)


def _known(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({_NA}) THEN {c} END"


def _quoted(df, path, sep):
    """Standard double-quote quoting, white space kept."""
    (df.write.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


@register("read_pairs_tsv", sql=f"""
    SELECT id, {_known('question1')} AS sentence1, {_known('question2')} AS sentence2, is_duplicate AS label FROM v_qqp""")
def q_read_pairs_tsv(spark, sf_dir):
    path = scratch_path(spark, "pairs-tsv")
    v = B.v_qqp(spark, sf_dir)
    _quoted(v.select("id", F.col("question1").alias("sentence1"), F.col("question2").alias("sentence2"),
                     F.col("is_duplicate").alias("label")), path, "\t")
    return io.read_pairs_tsv(spark, path)


@register("read_nli_tsv", sql=f"""
    SELECT gold_label, {_known("translate(sentence1, chr(9) || chr(13), '  ')")} AS sentence1,
           {_known("translate(sentence2, chr(9) || chr(13), '  ')")} AS sentence2, pairID FROM v_nli""")
def q_read_nli_tsv(spark, sf_dir):
    """S6 writes, S2 reads: quoting off, missing words null."""
    path = scratch_path(spark, "nli-tsv")
    v = B.v_nli(spark, sf_dir)
    io.write_plain_tsv(v.select("gold_label", *[F.translate(c, "\t\r", "  ").alias(c) for c in ("sentence1", "sentence2")],
                                "pairID"), path)
    return io.read_nli_tsv(spark, path)


@register("read_examples_csv", sql=f"""
    SELECT id, {_known('premise')} AS premise, {_known('hypothesis')} AS hypothesis, label FROM nli_examples""",
          ctes=NLI_EXAMPLES_CTE)
def q_read_examples_csv(spark, sf_dir):
    path = scratch_path(spark, "examples-csv")
    _quoted(nli_examples(spark, sf_dir).select("id", "premise", "hypothesis", "label"), path, ",")
    return io.read_examples_csv(spark, path)


@register("scan_corpus", sql=f"""
    SELECT id, {_known('premise')} AS premise, {_known('hypothesis')} AS hypothesis, label, true AS is_part
    FROM nli_examples""", ctes=NLI_EXAMPLES_CTE)
def q_scan_corpus(spark, sf_dir):
    path = scratch_path(spark, "corpus-csv")
    _quoted(nli_examples(spark, sf_dir).select("id", "premise", "hypothesis", "label"), path, ",")
    return io.scan_corpus(spark, path).select("id", "premise", "hypothesis", "label",
                                              F.col("file_name").rlike(r"^part-.*\.csv$").alias("is_part"))


@register("read_quoted_breaks", sql=f"""
    SELECT doc_id, {_known('text')} AS text, {_known('source')} AS source FROM documents""")
def q_read_quoted_breaks(spark, sf_dir):
    """Whole texts, line breaks and quotes included, through quoted files that split over tasks."""
    path = scratch_path(spark, "texts-csv")
    _quoted(B.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path, ",")
    return io.read_examples_csv(spark, path, "doc_id long, text string, source string")


@register("read_indexed_lines", sql="""
    SELECT replace(text, chr(10), ' ') AS phrase, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents""")
def q_read_indexed_lines(spark, sf_dir):
    """Files of consecutive documents, one line a document: a file's lines are numbered on their own, files follow by
    their first id."""
    path = scratch_path(spark, "lines")
    docs = B.v_phrases(spark, sf_dir)
    (docs.repartitionByRange("phrase_index").sortWithinPartitions("phrase_index")
     .select(F.concat_ws("\t", F.col("phrase_index").cast("string"), "phrase")).write.text(path))
    lines = io.read_indexed_lines(spark, path)
    lines = lines.select("file", "phrase_index", F.split("phrase", "\t", 2).alias("l"))
    per = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(F.get("l", F.lit(0)).cast("long")).alias("low"))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    per = per.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return lines.join(per, "file").select(F.get("l", F.lit(1)).alias("phrase"), (F.col("ahead") + F.col("phrase_index")).alias("line_no"))


_SPLIT_DOCS = SPLIT3_SQL.format(key="doc_id", src="v_corpora")


def _split_docs(spark, sf_dir):
    return split_three(B.v_corpora(spark, sf_dir), "doc_id", seed=738)


@register("write_splits", sql=f"SELECT doc_id, corpus, label, n_chars, split FROM ({_SPLIT_DOCS})")
def q_write_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    io.write_splits(_split_docs(spark, sf_dir).select("doc_id", "corpus", "label", "n_chars", "split"), path)
    return spark.read.parquet(path)


@register("load_tokens", sql=f"""
    SELECT doc_id, len(string_split(text, ' ')) AS n_tokens FROM ({_SPLIT_DOCS}) s JOIN documents d USING (doc_id)
    WHERE corpus = 'paws' AND split = 'train'""")
def q_load_tokens(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    toks = B.v_qtokens(spark, sf_dir).withColumnRenamed("qid", "doc_id")
    io.save_tokens(_split_docs(spark, sf_dir).select("doc_id", "corpus", "split").join(toks, "doc_id"), path)
    got = io.load_tokens(spark, path, corpus="paws", split="train")
    return got.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@register("token_cache_refresh", sql="""
    SELECT c.doc_id AS id, c.corpus, 'train' AS split, len(string_split(t, ' ')) AS n_ids,
           CAST(CASE WHEN c.doc_id % 10 = 0 THEN 2 ELSE 1 END AS INTEGER) AS generation
    FROM v_corpora c JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' changed' ELSE text END AS t
                           FROM documents) d USING (doc_id) WHERE c.doc_id % 13 <> 0""")
def q_token_cache_refresh(spark, sf_dir):
    """Two runs of the cache; between them a tenth of the texts change and a thirteenth goes.  ``generation`` tells which
    run tokenised a row."""
    from textpairs.sources import token_cache as C

    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    names = B.v_corpora(spark, sf_dir).select(F.col("doc_id").alias("id"), "corpus", F.lit("train").alias("split"))
    rows = docs.join(names, "id")
    changed = F.when(F.col("id") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    path = scratch_path(spark, "token-cache")

    def lengths(df):
        return df.select("corpus", "split", "id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))

    C.refresh_tokens(rows, path, "id", ["text"], lengths)
    C.refresh_tokens(rows.filter(F.col("id") % 13 != 0).withColumn("text", changed), path, "id", ["text"], lengths)
    return C.load_cache(spark, path).select("id", "corpus", "split", F.size("ids").cast("long").alias("n_ids"), "generation")


@register("kept_ids_file", sql="SELECT token_id, new_id FROM kept", ctes=NLI_TOK_CTES)
def q_kept_ids_file(spark, sf_dir):
    from textpairs.plans.q_vocab import nli_tok

    path = scratch_path(spark, "kept")
    io.write_kept_ids(V.add_meta_ids(V.seen_ids(nli_tok(spark, sf_dir), ["premise_ids", "hypothesis_ids"])), path)
    return io.read_kept_ids(spark, path, position="new_id").select("token_id", F.col("new_id").cast("int").alias("new_id"))


@register("existing_inputs", sql="""
    SELECT 'labels.parquet' AS name, count(*) AS n FROM labels
    UNION ALL SELECT 'documents.parquet', count(*) FROM documents""")
def q_existing_inputs(spark, sf_dir):
    found = io.existing_inputs(spark, sf_dir, ["labels.parquet", "no, such {file}*.parquet", "documents.parquet"])
    rows = None
    for path in found:
        one = spark.read.parquet(path).agg(F.lit(path.rsplit("/", 1)[-1]).alias("name"), F.count(F.lit(1)).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@register("write_predictions", sql="SELECT CAST(vec_id AS VARCHAR) AS id, prediction FROM scored", ctes=LOGIT_CTES)
def q_write_predictions(spark, sf_dir):
    from textpairs.operators.score import predictions_table

    path = scratch_path(spark, "predictions")
    io.write_predictions(predictions_table(B.v_logits(spark, sf_dir), "vec_id"), path)
    return spark.read.schema("id string, prediction int").option("header", True).csv(path)


@register("load_subsets", sql=f"SELECT doc_id, n_chars, split FROM ({_SPLIT_DOCS})")
def q_load_subsets(spark, sf_dir):
    path = scratch_path(spark, "subsets")
    io.write_splits(_split_docs(spark, sf_dir).select("doc_id", "n_chars", "split"), path)
    return io.load_subsets(spark, {s: f"{path}/split={s}" for s in ("train", "valid", "test")}, reader=spark.read.parquet)
