"""Registered queries over dense numbers: orders and pairs by arithmetic (W1, J2), id sets as words of
bits (U4, V2, V3, J8), mergeable sketches (A12, T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpairs.operators import id_words as W
from textpairs.operators import metrics as M
from textpairs.operators import pairs as P
from textpairs.operators import sketches as K
from textpairs.operators.batches import sortish_batches
from textpairs.operators.permute import permute, permute_sql, row_at
from textpairs.operators.rank import ordered_rank
from textpairs.plans import bridge as B
from textpairs.plans.q_order import SORTISH_BS, SORTISH_CTES
from textpairs.plans.q_vocab import NLI_TOK_CTES, nli_tok
from textpairs.plans.registry import register
from textpairs.session import materialise

EPOCHS = 3
SEED = 738


def _epoch_ctes() -> dict[str, str]:
    """Rows of all epochs; every epoch has round keys of its own, so each is walked on its own."""
    out = {"numbered": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM documents"}
    for e in range(EPOCHS):
        start = ("(SELECT doc_id, row_no, row_no AS x, (SELECT count(*) FROM documents) AS n, CAST(0 AS BIGINT) AS tweak "
                 "FROM numbered)")
        out[f"walk_{e}"] = (f"{permute_sql(start, f'{SEED}:{e}')} UNION ALL "
                            f"{permute_sql(f'(SELECT * FROM walk_{e} WHERE x >= n)', f'{SEED}:{e}')}")
    return out


@register("epoch_order", sql=" UNION ALL ".join(
    f"SELECT doc_id, {e} AS epoch, x AS position, row_no AS row_back FROM walk_{e} WHERE x < n" for e in range(EPOCHS)),
          ctes=_epoch_ctes())
def q_epoch_order(spark, sf_dir):
    """A fresh order of all documents per epoch from one dense numbering, and the row number back from the place."""
    docs = ordered_rank(B.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], name="row_no")
    n = docs.count()
    out = None
    for e in range(EPOCHS):
        one = docs.select("doc_id", F.lit(e).alias("epoch"), permute(F.col("row_no"), n, f"{SEED}:{e}").alias("position"))
        one = row_at(one, "position", n, SEED, e, out="row_back")
        out = one if out is None else out.unionByName(one)
    return out


BATCH_EPOCH = 1


def _epoch_batches_ctes() -> dict[str, str]:
    """The batch CTEs with the rank of an epoch in place of the hash rank."""
    out = dict(SORTISH_CTES, **_epoch_ctes())
    out["sb_r"] = f"SELECT w.doc_id AS key, n_chars AS len, x AS rnk FROM walk_{BATCH_EPOCH} w JOIN documents USING (doc_id) WHERE x < n"
    out["sb_ord"] = out["sb_ord"].replace("'738:b:'", f"'{SEED}:{BATCH_EPOCH}:b:'")
    return out


@register("sortish_epoch", sql=f"""
    SELECT b.key AS doc_id, b.batch, o.batch_order,
           CAST(CASE WHEN o.cls = 1
                     THEN row_number() OVER (PARTITION BY b.batch
                                             ORDER BY md5('{SEED}:{BATCH_EPOCH}:r:' || CAST(b.key AS VARCHAR)), b.key) - 1
                     ELSE b.pos % {SORTISH_BS} END AS INTEGER) AS slot
    FROM sb_b b JOIN sb_ord o ON b.batch = o.batch""", ctes=_epoch_batches_ctes())
def q_sortish_epoch(spark, sf_dir):
    """W8 for one epoch: the rank is arithmetic on a dense numbering that all epochs share."""
    docs = ordered_rank(B.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], name="row_no")
    out = sortish_batches(docs, "doc_id", "n_chars", SORTISH_BS, seed=SEED, row="row_no", epoch=BATCH_EPOCH)
    return out.select("doc_id", "batch", "batch_order", "slot")


PAIRS_A_GROUP = 200

PAIR_CTES = {
    "grouped": """
        SELECT paraphrase_group_index AS g, phrase_index AS item,
               row_number() OVER (PARTITION BY paraphrase_group_index ORDER BY phrase_index) - 1 AS pos FROM v_groups""",
    "drawn": f"""
        SELECT g, unnest(range(least({PAIRS_A_GROUP}, n))) AS draw, n,
               CAST('0x' || substr(md5(coalesce(g, '')), 1, 7) AS BIGINT) AS tweak
        FROM (SELECT g, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n FROM grouped GROUP BY g)""",
    "pair_walk": (permute_sql("(SELECT g, draw, draw AS x, n, tweak FROM drawn)", f"pairs:{SEED}") + " UNION ALL "
                  + permute_sql("(SELECT * FROM pair_walk WHERE x >= n)", f"pairs:{SEED}")),
}


@register("sample_pairs", sql="""
    SELECT w.g AS paraphrase_group_index, w.draw, a.pos AS i, b.pos AS j, a.item AS item_1, b.item AS item_2
    FROM pair_walk w JOIN grouped a ON a.g IS NOT DISTINCT FROM w.g JOIN grouped b ON b.g IS NOT DISTINCT FROM w.g
    WHERE w.x < w.n AND a.pos < b.pos AND b.pos * (b.pos - 1) // 2 + a.pos = w.x""", ctes=PAIR_CTES)
def q_sample_pairs(spark, sf_dir):
    return P.sample_pairs(B.v_groups(spark, sf_dir), "paraphrase_group_index", "phrase_index", ["phrase_index"],
                          PAIRS_A_GROUP, seed=SEED)


@register("kept_ids_bits", sql="SELECT token_id, new_id FROM kept", ctes=NLI_TOK_CTES)
def q_kept_ids_bits(spark, sf_dir):
    """The kept ids with their new ids from words of bits: no distinct over ids and no sort of ids."""
    words = W.id_words(nli_tok(spark, sf_dir), ["premise_ids", "hypothesis_ids"])
    return W.ranked_ids(W.with_reserved(words, B.RESERVED))


@register("remap_ids_bits", sql="""
    SELECT t.id, array_to_string(list(coalesce(k.new_id, 0) ORDER BY t.p), ',') AS premise_new
    FROM (SELECT id, unnest(premise_ids) AS old, unnest(range(len(premise_ids))) AS p FROM nli_tok) t
    LEFT JOIN (SELECT token_id, CAST(row_number() OVER (ORDER BY token_id) - 1 AS INTEGER) AS new_id FROM (
        SELECT DISTINCT CAST(unnest(hypothesis_ids) AS INTEGER) AS token_id FROM nli_tok
        UNION SELECT CAST(range AS INTEGER) FROM range(259))) k ON k.token_id = t.old GROUP BY t.id""", ctes=NLI_TOK_CTES)
def q_remap_ids_bits(spark, sf_dir):
    """Premises under the vocabulary of the hypotheses: what that lacks becomes the unknown id."""
    tok = nli_tok(spark, sf_dir, cache=True)
    words = W.with_reserved(W.id_words(tok, ["hypothesis_ids"]), B.RESERVED)
    r = W.remap_by_words(tok, ["id"], "premise_ids", words, out="premise_new")
    return r.select("id", F.array_join("premise_new", ",").alias("premise_new"))


@register("vocab_size_sketch", sql="""
    SELECT source, CAST(sum(n_new) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_exact, true AS within
    FROM (SELECT s.source, count(f.word) AS n_new
          FROM (SELECT DISTINCT source FROM documents) s
          LEFT JOIN (SELECT w.word, min(d.source) AS source FROM v_words w JOIN documents d ON d.doc_id = w.doc_id
                     GROUP BY w.word) f ON f.source = s.source
          GROUP BY s.source)""")
def q_vocab_size_sketch(spark, sf_dir):
    """Distinct words after each source from merged states, beside the exact count: four standard errors apart at most."""
    docs = B.table(spark, sf_dir, "documents")
    words = docs.select("source", F.explode(F.split("text", "[ \n]")).alias("word"))
    grown = K.distinct_growth(materialise(K.distinct_states(words, ["source"], "word")), "source")
    exact = M.vocab_growth(words, "source", "word", files=docs.select("source")).select("source", F.col("n_seen").alias("n_exact"))
    error = 4 * 1.04 / 2 ** (K.LG_K / 2)
    return exact.join(grown, "source").select("source", "n_exact", (
        F.abs(F.col("n_seen") - F.col("n_exact")) <= F.greatest(F.col("n_exact") * error, F.lit(1.0))).alias("within"))


RANKS = (0.25, 0.5, 0.75)


@register("length_profile_sketch", sql=f"""
    SELECT lang, n, unnest([{', '.join(f'{r}::DOUBLE' for r in RANKS)}]) AS p, true AS within
    FROM (SELECT lang, count(text) AS n FROM documents GROUP BY lang)""")
def q_length_profile_sketch(spark, sf_dir):
    """Quartiles of text lengths by language from states per (language, source): their true ranks are within 2 %."""
    docs = B.table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("lang", "source", F.length("text").alias("chars"))
    states = materialise(K.quantile_states(docs, ["lang", "source"], "chars"))
    q = K.quantiles(states, RANKS, by=["lang"]).select("lang", "n", F.posexplode("q").alias("at", "value"))
    q = q.withColumn("p", F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.col("at") + 1))
    # one row per language and quantile: a small side
    met = docs.join(q, "lang").groupBy("lang", "n", "p").agg(
        F.avg((F.col("chars") < F.col("value")).cast("double")).alias("below"),
        F.avg((F.col("chars") <= F.col("value")).cast("double")).alias("upto"))
    return met.select("lang", "n", "p", ((F.col("below") <= F.col("p") + 0.02) & (F.col("upto") >= F.col("p") - 0.02)).alias("within"))
