"""Registered queries: vocabulary-table tokenisation (Q2), vocabulary collection
and pruning (U4, U5, V1-V5, J7, J8), vocabulary size (A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.operators import metrics as M
from textpairs.operators import tokens as TK
from textpairs.operators import vocab as V
from textpairs.plans import bridge as B
from textpairs.plans.q_clean import NLI_EXAMPLES_CTE, nli_examples
from textpairs.plans.registry import register, rounded
from textpairs.session import materialise

NLI_TOK_CTES = dict(NLI_EXAMPLES_CTE, **{
    "tok_words": """
        SELECT id, c, CAST(unnest(range(len(ws))) AS INTEGER) AS p, unnest(ws) AS word FROM (
            SELECT id, 0 AS c, string_split(premise, ' ') AS ws FROM nli_examples
            UNION ALL
            SELECT id, 1 AS c, string_split(hypothesis, ' ') AS ws FROM nli_examples)""",
    "tok_ids": """
        SELECT w.id, w.c, w.p, coalesce(v.id, 0) AS tid FROM tok_words w LEFT JOIN v_vocab v ON w.word = v.word""",
    "nli_tok": """
        SELECT e.id, e.label, t.premise_ids, t.hypothesis_ids
        FROM nli_examples e JOIN (
            SELECT id, list(tid ORDER BY p) FILTER (WHERE c = 0) || [2] AS premise_ids,
                       list(tid ORDER BY p) FILTER (WHERE c = 1) || [2] AS hypothesis_ids
            FROM tok_ids GROUP BY id) t ON e.id = t.id""",
    "seen": """
        SELECT DISTINCT t AS token_id FROM (SELECT unnest(premise_ids) AS t FROM nli_tok
                                           UNION ALL SELECT unnest(hypothesis_ids) AS t FROM nli_tok)""",
    "kept": """
        SELECT token_id, CAST(row_number() OVER (ORDER BY token_id) - 1 AS INTEGER) AS new_id FROM (
            SELECT CAST(token_id AS INTEGER) AS token_id FROM seen
            UNION SELECT CAST(range AS INTEGER) FROM range(259))""",
    "full_vocab": """
        SELECT CAST(range AS INTEGER) AS id,
               CASE WHEN range = 0 THEN '<unk>' WHEN range = 1 THEN '<s>' WHEN range = 2 THEN '</s>'
                    ELSE printf('<0x%02X>', CAST(range - 3 AS INTEGER)) END AS piece,
               CAST(0.0 AS FLOAT) AS score,
               CASE WHEN range = 0 THEN 2 WHEN range <= 2 THEN 3 ELSE 6 END AS type
        FROM range(259)
        UNION ALL
        SELECT id, word AS piece, CAST(259 - id AS FLOAT) AS score, 1 AS type FROM v_vocab""",
})


def nli_tok(spark, sf_dir, cache: bool = False, vocab=None):
    """NLI examples with vocabulary-table ids (the shared input of Q5-Q12, U4, V*).

    ``cache=True`` writes the tokenised corpus once (the reference's cache point
    after tokenisation) for queries that read it from several branches; a
    query that needs the vocabulary elsewhere too passes its one ``vocab``.
    """
    ex = nli_examples(spark, sf_dir)
    tok = TK.tokenise_vocab(ex, ["id"], ["premise", "hypothesis"], vocab if vocab is not None else B.v_vocab(spark, sf_dir),
                           carry=["label"])
    return materialise(tok) if cache else tok


def _seen(spark, sf_dir, vocab=None):
    return V.seen_ids(nli_tok(spark, sf_dir, vocab=vocab), ["premise_ids", "hypothesis_ids"])


def _kept(spark, sf_dir, vocab=None):
    return V.kept_ids(_seen(spark, sf_dir, vocab))


@register("tokenise_vocab", sql="""
    SELECT doc_id, line_no, array_to_string(list(tid ORDER BY p) || [2], ',') AS ids, count(*) + 1 AS n_ids
    FROM (SELECT w.doc_id, w.line_no, w.pos AS p, coalesce(v.id, 0) AS tid
          FROM v_words w LEFT JOIN v_vocab v ON w.word = v.word)
    GROUP BY doc_id, line_no""")
def q_tokenise_vocab(spark, sf_dir):
    lines = B.v_lines(spark, sf_dir)
    t = TK.tokenise_vocab(lines, ["doc_id", "line_no"], ["line"], B.v_vocab(spark, sf_dir))
    return t.select("doc_id", "line_no", F.array_join("line_ids", ",").alias("ids"),
                    F.size("line_ids").cast("long").alias("n_ids"))


@register("seen_ids", sql="SELECT CAST(token_id AS INTEGER) AS token_id FROM seen", ctes=NLI_TOK_CTES)
def q_seen_ids(spark, sf_dir):
    return _seen(spark, sf_dir).select(F.col("token_id").cast("int").alias("token_id"))


@register("add_meta_ids", sql="SELECT token_id FROM kept", ctes=NLI_TOK_CTES)
def q_add_meta_ids(spark, sf_dir):
    return V.add_meta_ids(_seen(spark, sf_dir))


@register("kept_ids", sql="SELECT token_id, new_id FROM kept", ctes=NLI_TOK_CTES)
def q_kept_ids(spark, sf_dir):
    return _kept(spark, sf_dir)


@register("id_map", sql="SELECT token_id AS old_id, new_id FROM kept", ctes=NLI_TOK_CTES)
def q_id_map(spark, sf_dir):
    return V.id_map(_kept(spark, sf_dir))


@register("prune_vocab", sql="""
    SELECT id, piece, score, type, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS new_id
    FROM full_vocab WHERE id < 259 OR id IN (SELECT token_id FROM seen)""", ctes=NLI_TOK_CTES)
def q_prune_vocab(spark, sf_dir):
    words = B.v_vocab(spark, sf_dir)
    return V.prune_vocab(V.vocab_table(words), _seen(spark, sf_dir, words))


@register("prune_report", sql="""
    SELECT p.kept_pieces, k.kept_ids, k.kept_ids - p.kept_pieces AS ids_without_piece
    FROM (SELECT count(*) AS kept_pieces FROM full_vocab
          WHERE id < 259 OR id IN (SELECT token_id FROM seen)) p,
         (SELECT count(*) AS kept_ids FROM kept) k""", ctes=NLI_TOK_CTES)
def q_prune_report(spark, sf_dir):
    words = B.v_vocab(spark, sf_dir)
    seen = materialise(_seen(spark, sf_dir, words))
    pieces = V.prune_vocab(V.vocab_table(words), seen)
    return V.prune_report(pieces, V.kept_ids(seen))


_REMAP_SQL = """
    SELECT t.id, array_to_string(list(coalesce(k.new_id, 0) ORDER BY t.p), ',') AS premise_new
    FROM (SELECT id, unnest(premise_ids) AS old, unnest(range(len(premise_ids))) AS p FROM nli_tok) t
    LEFT JOIN kept k ON k.token_id = t.old GROUP BY t.id"""


@register("remap_ids", sql=_REMAP_SQL, ctes=NLI_TOK_CTES)
def q_remap_ids(spark, sf_dir):
    tok = nli_tok(spark, sf_dir, cache=True)
    m = V.id_map(V.kept_ids(V.seen_ids(tok, ["premise_ids", "hypothesis_ids"])))
    r = V.remap_ids(tok, ["id"], "premise_ids", m, out="premise_new")
    return r.select("id", F.array_join("premise_new", ",").alias("premise_new"))


@register("prune_end_to_end", sql="""
    SELECT t.id, t.side, array_to_string(list(coalesce(k.new_id, 0) ORDER BY t.p), ',') AS ids_new
    FROM (SELECT id, 0 AS side, unnest(premise_ids) AS old, unnest(range(len(premise_ids))) AS p FROM nli_tok
          UNION ALL
          SELECT id, 1 AS side, unnest(hypothesis_ids) AS old, unnest(range(len(hypothesis_ids))) AS p FROM nli_tok) t
    LEFT JOIN kept k ON k.token_id = t.old GROUP BY t.id, t.side""", ctes=NLI_TOK_CTES)
def q_prune_end_to_end(spark, sf_dir):
    """V4: corpus -> seen -> kept ids -> both text columns under the pruned vocabulary, in one pass over the words."""
    r = V.prune_tokenise(nli_examples(spark, sf_dir), ["id"], ["premise", "hypothesis"], B.v_vocab(spark, sf_dir), B.RESERVED)
    sides = F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.array_join(f"{c}_new", ",").alias("ids_new"))
                               for k, c in enumerate(("premise", "hypothesis"))]))
    return r.select("id", sides)


@register("prune_steps", sql="""
    SELECT t.id, t.side, array_to_string(list(coalesce(k.new_id, 0) ORDER BY t.p), ',') AS ids_new
    FROM (SELECT id, 0 AS side, unnest(premise_ids) AS old, unnest(range(len(premise_ids))) AS p FROM nli_tok
          UNION ALL
          SELECT id, 1 AS side, unnest(hypothesis_ids) AS old, unnest(range(len(hypothesis_ids))) AS p FROM nli_tok) t
    LEFT JOIN kept k ON k.token_id = t.old GROUP BY t.id, t.side""", ctes=NLI_TOK_CTES)
def q_prune_steps(spark, sf_dir):
    """V4 step by step: tokenised corpus -> seen -> kept ids -> both id columns remapped."""
    tok = nli_tok(spark, sf_dir, cache=True)
    m = V.id_map(V.kept_ids(V.seen_ids(tok, ["premise_ids", "hypothesis_ids"])))
    sides = tok.select("id", F.lit(0).alias("side"), F.col("premise_ids").alias("ids")).unionByName(
        tok.select("id", F.lit(1).alias("side"), F.col("hypothesis_ids").alias("ids")))
    r = V.remap_ids(sides, ["id", "side"], "ids", m, out="ids_new")
    return r.select("id", "side", F.array_join("ids_new", ",").alias("ids_new"))


@register("gather_rows", sql="""
    SELECT k.new_id, e.vec_id AS old_id, len(e.embedding) AS dim,
           round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS checksum
    FROM embeddings e JOIN kept k ON k.token_id = e.vec_id""", ctes=NLI_TOK_CTES)
def q_gather_rows(spark, sf_dir):
    emb = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    g = V.gather_rows(emb, V.id_map(_kept(spark, sf_dir)), "id")
    total = F.aggregate(F.col("embedding"), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return g.select("new_id", F.col("id").alias("old_id"), F.size("embedding").cast("long").alias("dim"),
                    M.round_double(total).alias("checksum"))


@register("vocab_coverage", sql="""
    SELECT d.lang, count(*) AS tokens, count(k.token_id) AS kept, round(count(k.token_id) / count(*), 6) AS coverage
    FROM (SELECT w.doc_id, coalesce(v.id, 0) AS tid FROM v_words w LEFT JOIN v_vocab v ON w.word = v.word
          UNION ALL SELECT doc_id, 2 AS tid FROM v_lines) t
    JOIN documents d ON d.doc_id = t.doc_id
    LEFT JOIN kept k ON k.token_id = t.tid GROUP BY d.lang""", ctes=NLI_TOK_CTES)
def q_vocab_coverage(spark, sf_dir):
    """V5: kept ids from the NLI sentences, coverage measured on every line of every document."""
    words = B.v_vocab(spark, sf_dir)
    lines = B.table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    ids = TK.tokenise_vocab(lines, ["doc_id", "line_no"], ["line"], words, carry=["lang"])
    cov = V.vocab_coverage(ids, "line_ids", _kept(spark, sf_dir, words), by=["lang"])
    return rounded(cov, ["coverage"])


@register("vocab_size", sql="""
    SELECT source, n_new, CAST(sum(n_new) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_seen
    FROM (SELECT s.source, count(f.word) AS n_new
          FROM (SELECT DISTINCT source FROM documents) s
          LEFT JOIN (SELECT w.word, min(d.source) AS source FROM v_words w JOIN documents d ON d.doc_id = w.doc_id
                     GROUP BY w.word) f ON f.source = s.source
          GROUP BY s.source)""")
def q_vocab_size(spark, sf_dir):
    """A12 (progressive by file): distinct words seen after each source, sources in name order."""
    docs = B.table(spark, sf_dir, "documents")
    words = docs.select("source", F.explode(F.split("text", "[ \n]")).alias("word"))
    return M.vocab_growth(words, "source", "word", files=docs.select("source")).select("source", "n_new", "n_seen")


@register("prune_pieces_and_rows", sql="""
    SELECT k.new_id, p.id AS old_id, p.piece, p.type, len(e.embedding) AS dim,
           round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS checksum
    FROM full_vocab p JOIN kept k ON k.token_id = p.id LEFT JOIN embeddings e ON e.vec_id = p.id""", ctes=NLI_TOK_CTES)
def q_prune_pieces_and_rows(spark, sf_dir):
    """V4's other half: the pruned piece table beside the gathered rows of the matrix, under the new ids."""
    words = B.v_vocab(spark, sf_dir)
    seen = materialise(_seen(spark, sf_dir, words))
    pieces = V.prune_vocab(V.vocab_table(words), seen)
    emb = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = V.gather_rows(emb, V.id_map(V.kept_ids(seen)), "id").select("new_id", "embedding")
    total = F.aggregate(F.col("embedding"), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return pieces.join(rows, "new_id", "left").select(
        "new_id", F.col("id").alias("old_id"), "piece", "type",
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dim"), M.round_double(total).alias("checksum"))
