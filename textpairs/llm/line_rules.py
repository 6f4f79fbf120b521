"""Quality rules with cross-document line frequency (operator 10; DataFrame functions only).

Texts are read once: base figures are computed inside the row (no shuffle of
words), and two numbers a line are kept beside them.  Lines are normalised (A-Z lower-cased, white space runs to one space, trimmed)
and hashed, and the number of distinct documents of a host that hold the line
is counted.  Exact copies of a text are one document there: a copied article
is no boilerplate.  Lines in more than ``max(min_docs, host_share * documents
of the host)`` documents are removed, and a document that keeps less than
``min_left`` of its word characters is rejected, as is one that fails the base
rules.  The host is the ``source`` column.

What the limit lets through: a line that at most 0.5 % of a host's distinct
documents hold stays, however many those are (on a host of 1e9 documents up to
5 million); of a host of up to 2,000 documents a line in up to 10 stays.

Defined cases: a null text counts as empty (no words: base_failed); a null
host is a host of its own; repeated rows give repeated results; an empty table
gives an empty result.  Only the id, text and host columns are read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.stored import stored
from textpairs.llm.words import SPACE_CLASS, WORD_CLASS, text_or_empty, words_of

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Line limits.
MIN_DOCS = 10
HOST_SHARE = 0.005
MIN_LEFT = 0.5

#: Low bits of a packed window that hold its position.
POS_BITS = 24


def _repeats_packed(tri: Column, order: Column, pos_bits: int) -> tuple[Column, Column]:
    """Positions of the windows that occur twice or more, and whether packing hides any.

    ``order`` holds one number per window, (high bits of its hash, position),
    sorted: equal windows lie side by side unless another window shares their
    high bits, which is told by the second result.
    """
    mask = F.lit((1 << pos_bits) - 1)

    def at(x: Column) -> Column:
        return F.get(tri, x.bitwiseAND(mask).cast("int"))

    def twin(x: Column, i: Column) -> Column:
        here = at(x)
        return F.coalesce(here == at(F.get(order, i - 1)), F.lit(False)) | F.coalesce(
            here == at(F.get(order, i + 1)), F.lit(False))

    def clash(x: Column, i: Column) -> Column:
        after = F.get(order, i + 1)
        near = F.shiftright(x, pos_bits) == F.shiftright(after, pos_bits)
        return F.coalesce(near & (at(x) != at(after)), F.lit(False))

    hits = F.sort_array(F.transform(F.filter(order, twin), lambda x: x.bitwiseAND(mask)))
    return hits, F.exists(F.transform(order, clash), lambda x: x)


def _repeats_whole(tri: Column) -> Column:
    """The same positions from (whole hash, position) pairs: for texts that packing does not fit."""
    pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("at"))))

    def hits(p: Column) -> Column:
        twins = F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False))
                         | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(twins, lambda x: x["at"]))

    return F.get(F.transform(F.array(pairs), hits), F.lit(0))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, ascii_uppercase, ascii_lowercase), SPACE_CLASS + "+", " "))


def _line(line: Column) -> Column:
    """Hash and word characters of a normalised line."""
    return F.struct(F.xxhash64(line).alias("line"), F.length(F.replace(line, F.lit(" "), F.lit(""))).cast("long").alias("chars"))


def base_figures(docs: DataFrame, pos_bits: int = POS_BITS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the base columns of the contract, ``copy`` (hash of the text) and ``lines``
    (hash and word characters of every line with a word) beside the other columns.

    Repeated windows are found by a sort of packed numbers; texts of more than
    ``2 ** pos_bits`` windows, and those where two windows share the high bits of
    their hashes, sort whole hashes instead.
    """
    rest = [c for c in docs.columns if c != "text"]
    df = docs.select(*rest, text_or_empty("text").alias("t"))
    df = df.select(*rest, "t", words_of(F.col("t")).alias("w"))
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD_CLASS))
    df = df.select(*rest, "t", n.cast("long").alias("n_words"), windows.alias("tri"), lines.alias("lines"))
    repeated = F.size("tri") > F.size(F.array_distinct("tri"))
    fits = F.size("tri") <= (1 << pos_bits)
    order = F.when(repeated & fits, F.sort_array(F.transform("tri", lambda h, i: F.shiftleft(
        F.shiftright(h, pos_bits), pos_bits).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *rest, "n_words", "tri", repeated.alias("repeated"), F.xxhash64("t").alias("copy"),
        F.length(F.regexp_replace("t", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.transform("lines", _normal), _line).alias("lines"), order.alias("order"))
    packed, hidden = _repeats_packed(F.col("tri"), F.col("order"), pos_bits)
    whole = F.col("repeated") & ((F.size("order") == 0) | hidden)
    df = df.withColumn("hit", F.when(whole, _repeats_whole(F.col("tri"))).when(F.size("order") > 0, packed))
    steps = F.transform("hit", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(
        F.get("hit", i + 1) - p, F.lit(3).cast("long"))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    df = df.withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     failed.alias("base_failed"), "copy", "lines")


def frequent_lines(lines: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS,
                   host_share: float = HOST_SHARE) -> DataFrame:
    """Lines above the limit of their host: ``(host, line)``, from ``lines(host, line, copy)`` and ``docs(host, copy)``.

    Distinct (host, line, copy) first, then a count per line: both aggregations
    combine map-side, so a line that a third of all documents share reaches
    the last task as one partial count per map task.
    """
    per_host = (docs.select("host", "copy").distinct()
                .groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("host", "of"))
    counted = (lines.select("host", "line", "copy").distinct()
               .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
               .filter(F.col("n_docs") > min_docs))
    joined = counted.join(per_host, counted["host"].eqNullSafe(per_host["of"]), "left")
    return joined.filter(F.col("n_docs") > host_share * F.col("host_docs")).select("host", "line")


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: the base columns, left_chars and kept.

    Texts are read once: what is kept of them, the base figures and two numbers
    a line, is written, and counts and cuts come from that table.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    # ids may be null or repeat: rows are told apart by a number that is written with them
    base = stored(base_figures(df).withColumn("row", F.monotonically_increasing_id()), "line-figures")
    lines = base.select("row", "host", "copy", F.inline("lines"))
    bad = frequent_lines(lines, base, min_docs, host_share).select(F.col("host").alias("of"), F.col("line").alias("l"))
    hit = lines.join(bad, lines["host"].eqNullSafe(bad["of"]) & (lines["line"] == bad["l"]), "left_semi")
    cut = hit.groupBy(F.col("row").alias("cut_row")).agg(F.sum("chars").alias("cut_chars"))
    out = base.join(cut, F.col("row") == F.col("cut_row"), "left")
    left = F.col("word_chars") - F.coalesce(F.col("cut_chars"), F.lit(0).cast("long"))
    # a line that a document repeats is cut at every place, and counted once per place
    out = out.withColumn("left_chars", F.greatest(left, F.lit(0).cast("long")))
    kept = ~F.col("base_failed") & (F.col("left_chars") >= min_left * F.col("word_chars"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "left_chars", kept.alias("kept"))
