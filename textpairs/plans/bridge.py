"""Bridge views: the reference's corpus shapes derived from the test tables.

Each view is written twice -- here as a DataFrame, in ``plans/oracle_views.py``
as DuckDB SQL -- and the two must stay identical in meaning.  All views read
whole tables and whole texts; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the bridge (not of the reference): vocabulary ids below
# RESERVED are kept for control and byte pieces, as in the 32k piece model.
RESERVED = 259
NEWLINE = "\n"


#: Session setting, off unless given: tables of long texts are dealt over so many
#: tasks by key.  For inputs whose files cannot be split (one row group), as in the bench.
FAN_OUT = "spark.textpairs.scanFanOut"
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table (one plan per session and path: the schema is read once)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    tasks = spark.conf.get(FAN_OUT, None)
    key = (id(spark), spark.sparkContext.applicationId, path, tasks)
    df = _TABLES.get(key)
    if df is None:
        df = spark.read.parquet(path)
        if tasks and name in TEXT_TABLES:
            df = df.repartition(int(tasks), TEXT_TABLES[name])
        _TABLES[key] = df
    return df


def _lines_of(text: Column) -> Column:
    return F.split(text, NEWLINE)


def head_lines(lines: Column) -> Column:
    """Every line but the last, joined by a space (the whole text when it has one line)."""
    n = F.size(lines)
    return F.when(n >= 2, F.array_join(F.slice(lines, 1, n - 1), " ")).otherwise(F.get(lines, 0))


def last_line(lines: Column) -> Column:
    """The last line; null when the text has a single line."""
    return F.when(F.size(lines) >= 2, F.element_at(lines, -1))


def head_of(text: Column) -> Column:
    """``head_lines`` of a text, without an array of its lines."""
    before = F.left(text, F.length(text) - F.length(F.substring_index(text, NEWLINE, -1)) - 1)
    return F.when(F.contains(text, F.lit(NEWLINE)), F.replace(before, F.lit(NEWLINE), F.lit(" "))).otherwise(text)


def last_of(text: Column) -> Column:
    """``last_line`` of a text, without an array of its lines."""
    return F.when(F.contains(text, F.lit(NEWLINE)), F.substring_index(text, NEWLINE, -1))


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (doc_id, line_no, line), one row per line (S4 over a text column)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(_lines_of(F.col("text"))).alias("line_no", "line"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_has_label"))


def v_nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw NLI rows over whole texts: pairID, sentence1 = all lines but the last,
    sentence2 = the last line (null for a one-line text), gold_label from labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    j = docs.join(_labels(spark, sf_dir), "doc_id", "left")
    gold = (F.when(F.col("_has_label").isNull(), F.lit("-"))
             .when(F.col("toxic") == 1, F.lit("contradiction"))
             .when(F.col("quality") == 1, F.lit("entailment"))
             .otherwise(F.lit("neutral")))
    return j.select(F.col("doc_id").cast("string").alias("pairID"),
                    head_of(F.col("text")).alias("sentence1"),
                    last_of(F.col("text")).alias("sentence2"),
                    gold.alias("gold_label"),
                    "source")


def v_qqp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw question pairs over whole texts (split as in ``v_nli``); every document is a row,
    ``is_duplicate`` null where it has no label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") * 2).alias("qid1"),
        (F.col("doc_id") * 2 + 1).alias("qid2"),
        head_of(F.col("text")).alias("question1"),
        last_of(F.col("text")).alias("question2"),
        F.col("quality").alias("is_duplicate"))


def v_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as a question pair.

    qid1 = conv_id, qid2 = conv_id + 1, so question ids repeat with different
    texts across rows (the first-seen case).  Built by an equi self-join on
    (conv_id, turn + 1): no window over a whole conversation.
    """
    conv = table(spark, sf_dir, "conversations")
    a = conv.select("conv_id", "turn", F.col("text").alias("question1"))
    b = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("question2"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.col("conv_id").alias("qid1"),
        (F.col("conv_id") + 1).alias("qid2"),
        "question1", "question2")


def v_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase-group membership: group = source, phrase_index = doc_id (list order)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("paraphrase_group_index"),
                       F.col("doc_id").alias("phrase_index"))


def v_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase list: phrase_index = doc_id, phrase = the whole text on one line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("phrase_index"),
                       F.replace(F.col("text"), F.lit(NEWLINE), F.lit(" ")).alias("phrase"))


def v_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index-coded pairs (token references instead of text), over every token of a document.

    sentence1 = ``n-1/.../2/1/0`` over the document's own n tokens; where
    doc_id % 5 = 0 the last part is the glued ``(d,0):(d,1)``; where
    doc_id % 7 = 0 an extra part ``100000`` (index out of range); where
    doc_id % 11 = 0 an extra glued part referring to the missing qid -1.
    sentence2 = ``0/1/.../n-1``.  Every document is one row.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n"))
    d = F.col("doc_id").cast("string")
    glued = F.concat(F.lit("("), d, F.lit(",0):("), d, F.lit(",1)"))
    down = F.when(F.col("n") > 1, F.concat(F.array_join(F.transform(
        F.sequence(F.col("n") - 1, F.lit(1)), lambda i: i.cast("string")), "/"), F.lit("/"))).otherwise(F.lit(""))
    s1 = F.concat(down,
                  F.when(F.col("doc_id") % 5 == 0, glued).otherwise(F.lit("0")),
                  F.when(F.col("doc_id") % 7 == 0, F.lit("/100000")).otherwise(F.lit("")),
                  F.when(F.col("doc_id") % 11 == 0,
                         F.concat(F.lit("/("), d, F.lit(",2):(-1,0)"))).otherwise(F.lit("")))
    s2 = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i.cast("string")), "/")
    return docs.select(d.alias("id"), F.col("doc_id").alias("qid1"), s1.alias("sentence1"),
                       F.col("doc_id").alias("qid2"), s2.alias("sentence2"),
                       (F.col("doc_id") % 2).cast("string").alias("label"))


def v_qtokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token list per question id: the whole text split on single spaces."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("qid"), F.split(F.col("text"), " ").alias("tokens"))


CORPORA = ("quora", "paws", "msrp", "opinosis")


def v_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents tagged with a corpus name by doc_id % 4; label = quality (null if none)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    names = F.element_at(F.array(*[F.lit(c) for c in CORPORA]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.join(lab, "doc_id", "left").select("doc_id", names.alias("corpus"), "label", "n_chars")


def v_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every line: (doc_id, line_no, pos, word)."""
    return v_lines(spark, sf_dir).select(
        "doc_id", "line_no", F.posexplode(F.split(F.col("line"), " ")).alias("pos", "word"))


def v_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vocabulary: id = RESERVED + rank by (count desc, word asc)."""
    from textpairs.operators.rank import ordered_rank

    # splitting on newline-or-space gives exactly the words of v_words (lines
    # split on '\n', then on ' '), without materialising the lines; a text of spaces
    # splits on one character, without a pattern
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.split(F.translate("text", NEWLINE, " "), " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = ordered_rank(counts, [F.col("cnt").desc(), F.col("word").asc()], name="_r")
    return ranked.select("word", (F.col("_r") + RESERVED).cast("int").alias("id"), "cnt")


N_CLASSES = 10
DIM = 64


def head_weights(n_classes: int = N_CLASSES, dim: int = DIM) -> list[list[float]]:
    """Bridge weights of the linear class head: W[c][i] = ((c*31 + i*17) % 11 - 5) / 5."""
    return [[((c * 31 + i * 17) % 11 - 5) / 5.0 for i in range(dim)] for c in range(n_classes)]


def v_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (vec_id, label, logits array<double>) through the bridge head."""
    from textpairs.operators.score import linear_head

    emb = table(spark, sf_dir, "embeddings")
    return linear_head(emb, "embedding", head_weights(), out="logits").select("vec_id", "label", "logits")


def v_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a metric log: key user_id, order (ts, event_id), value."""
    ev = table(spark, sf_dir, "events")
    return ev.select("user_id", "event_id", "ts", "value", "event_type")
