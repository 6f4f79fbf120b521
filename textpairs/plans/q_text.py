"""Registered queries: text functions (T1-T6, T8, T9), line-indexed text (S4),
path parts (S13), length profile (T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.functions import text as T
from textpairs.functions import treebank as TB
from textpairs.operators.metrics import length_profile
from textpairs.plans import bridge as B
from textpairs.plans.q_clean import NLI_EXAMPLES_CTE, nli_examples
from textpairs.plans.registry import register, rounded

_WS = "[ \\t\\n\\r\\f\\x0B]"


def _norm_sql(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, ' +', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


_TB_TEXT_SQL = "regexp_replace({x}, '^" + _WS + "+|" + _WS + "+$', '', 'g')"


def tb_text_sql(e: str) -> str:
    return _TB_TEXT_SQL.format(x=TB.as_duckdb(e, TB.TOKENISE_RULES))


def tb_detok_sql(e: str) -> str:
    return _norm_sql(TB.as_duckdb(e, TB.DETOKENISE_RULES))


@register("indexed_lines", sql="SELECT doc_id, line_no, line FROM v_lines")
def q_indexed_lines(spark, sf_dir):
    return B.v_lines(spark, sf_dir)


_PREPARED_SQL = "chr(9) || ' ' || replace(text, ' ', '  ') || ' ' || chr(10)"


@register("normalise_space", sql=f"""
    SELECT doc_id, {_norm_sql(_PREPARED_SQL)} AS normalised,
           {_norm_sql(_PREPARED_SQL)} = text AS same_as_text
    FROM documents""")
def q_normalise_space(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    prepared = F.concat(F.lit("\t "), F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit(" \n"))
    n = docs.select("doc_id", "text", T.normalise_space(prepared).alias("normalised"))
    return n.select("doc_id", "normalised", (F.col("normalised") == F.col("text")).alias("same_as_text"))


@register("treebank_tokenise", sql=f"""
    SELECT doc_id, line_no, t AS tokens, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_tokens
    FROM (SELECT doc_id, line_no, {tb_text_sql('line')} AS t FROM v_lines)""")
def q_treebank_tokenise(spark, sf_dir):
    # the rule chain is evaluated once per line, in its own projection
    lines = B.v_lines(spark, sf_dir).select("doc_id", "line_no", TB.treebank_tokenise(F.col("line")).alias("_t"))
    return lines.select("doc_id", "line_no", F.array_join("_t", " ").alias("tokens"),
                        F.size("_t").cast("long").alias("n_tokens"))


@register("treebank_detokenise", sql=f"""
    SELECT doc_id, line_no, d AS detokenised, d = line AS same_as_line
    FROM (SELECT doc_id, line_no, line, {tb_detok_sql(tb_text_sql('line'))} AS d FROM v_lines)""")
def q_treebank_detokenise(spark, sf_dir):
    lines = B.v_lines(spark, sf_dir)
    d = lines.select("doc_id", "line_no", "line",
                     TB.treebank_detokenise(TB.treebank_text(F.col("line"))).alias("detokenised"))
    return d.select("doc_id", "line_no", "detokenised", (F.col("detokenised") == F.col("line")).alias("same_as_line"))


@register("space_split", sql="""
    SELECT doc_id, line_no, len(string_split(line, ' ')) AS n_tokens,
           array_to_string(string_split(line, ' '), '|') AS joined
    FROM v_lines""")
def q_space_split(spark, sf_dir):
    lines = B.v_lines(spark, sf_dir)
    s = T.space_split("line")
    return lines.select("doc_id", "line_no", F.size(s).cast("long").alias("n_tokens"),
                        F.array_join(s, "|").alias("joined"))


@register("equal_ignoring_space", sql=f"""
    SELECT doc_id, line_no, replace(line, ' ', '') IS NOT DISTINCT FROM replace({tb_text_sql('line')}, ' ', '')
             AS equal_ignoring_space
    FROM v_lines""")
def q_equal_ignoring_space(spark, sf_dir):
    lines = B.v_lines(spark, sf_dir)
    return lines.select("doc_id", "line_no",
                        T.equal_ignoring_space("line", TB.treebank_text(F.col("line"))).alias("equal_ignoring_space"))


@register("paraphrase_prompt", sql="""
    SELECT id, 'paraphrase: ' || question1 AS prompt FROM v_qqp""")
def q_paraphrase_prompt(spark, sf_dir):
    return B.v_qqp(spark, sf_dir).select("id", T.paraphrase_prompt("question1").alias("prompt"))


@register("nli_prompt", sql="""
    SELECT id, 'mnli hypothesis: ' || hypothesis || ' premise: ' || premise AS prompt FROM nli_examples""",
    ctes=NLI_EXAMPLES_CTE)
def q_nli_prompt(spark, sf_dir):
    return nli_examples(spark, sf_dir).select("id", T.nli_prompt("premise", "hypothesis").alias("prompt"))


@register("name_parts", sql="""
    SELECT page_id, folder, file_name, regexp_replace(file_name, '\\.[^.]*$', '') AS stem,
           string_split(folder, '_')[1] AS corpus
    FROM (SELECT page_id, seg[-1] AS file_name,
                 CASE WHEN len(seg) >= 2 THEN seg[-2] ELSE '' END AS folder
          FROM (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS seg FROM pages))""")
def q_name_parts(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages")
    parts = T.path_parts("url")
    return pages.select("page_id", *[v.alias(k) for k, v in parts.items()])


@register("length_profile", sql="""
    SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS std,
           CAST(min(length(text)) AS INTEGER) AS min, round(quantile_cont(length(text), 0.25), 6) AS p25,
           round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.75), 6) AS p75,
           CAST(max(length(text)) AS INTEGER) AS max
    FROM documents GROUP BY lang""")
def q_length_profile(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return rounded(length_profile(docs, "text", by=["lang"]), ["mean", "std", "p25", "p50", "p75"])
