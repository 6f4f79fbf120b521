r"""Chat formatting by a grammar round trip (operator 4; DataFrame functions only).

A conversation is rendered as ``<|im_start|>role\ntext<|im_end|>\n`` per turn.
A deterministic parser reads the rendered text back: it splits at
``<|im_start|>``, takes the role up to the first line feed and the text up to
the first ``<|im_end|>``, after which only a line feed may follow.  When the
recovered turns differ from the source, the conversation is rendered again
with its control strings escaped, under a leading ``<|escaped|>\n``, and parsed
again; a text without control strings is never changed.

Escaping puts one more backslash between ``<`` and ``|`` wherever only
backslashes stand between them, so no ``<|`` is left and taking one away
restores the text.  In a role, line feeds also become ``<|nl|>``.

Every conversation also gets its loss mask: (start, length) in code points of
the rendered assistant texts.

Defined cases: turns are ordered by turn, then role, then text, repeated rows
kept; null turn sorts first; null text or role is empty; a null conv_id is a
conversation of its own; an empty table gives an empty result.  Only the four
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
START = "<|im_start|>"
END = "<|im_end|>"
ESCAPED = "<|escaped|>\n"
NEW_LINE = "<|nl|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEW_LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEW_LINE), F.lit("\n")))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Rendered text -> array of (role, text); what breaks the grammar gives a null text."""
    is_escaped = F.startswith(formatted, F.lit(ESCAPED))
    body = F.when(is_escaped, F.substring(formatted, len(ESCAPED) + 1, 2**31 - 1)).otherwise(formatted)
    parts = F.split(body, r"<\|im_start\|>", -1)
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        rest = F.substring(part, F.length(role) + 2, F.lit(2**31 - 1))
        text = F.substring_index(rest, END, 1)
        whole = rest == F.concat(text, F.lit(END + "\n"))
        return F.struct(F.when(is_escaped, unescape_role(role)).otherwise(role).alias("role"),
                        F.when(whole, F.when(is_escaped, unescape(text)).otherwise(text)).alias("text"))

    return F.transform(parts, turn)


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped, loss_spans, turns (read back)."""
    df = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                              F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                              F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # offsets of every turn under both renderings, by running sums over the conversation
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("n", F.row_number().over(order))
    for level, role, text in ((0, F.col("role"), F.col("text")),
                              (1, escape_role(F.col("role")), escape(F.col("text")))):
        ahead = F.coalesce(F.sum(F.length(render_turn(role, text))).over(before), F.lit(0))
        df = df.withColumn(f"at{level}", F.struct(
            (ahead + F.length(role) + len(START) + 1 + level * len(ESCAPED)).cast("long").alias("start"),
            F.length(text).cast("long").alias("length")))
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "at0", "at1"))).alias("src"))
    source = F.transform("src", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    df = df.select("conv_id", "src", source.alias("source"))
    plain = F.array_join(F.transform("source", lambda t: render_turn(t["role"], t["text"])), "")
    df = df.withColumn("plain", plain)
    df = df.withColumn("escaped", ~(parse(F.col("plain")) == F.col("source")))
    safe = F.concat(F.lit(ESCAPED), F.array_join(F.transform(
        "source", lambda t: render_turn(escape_role(t["role"]), escape(t["text"]))), ""))
    df = df.withColumn("formatted", F.when(F.col("escaped"), safe).otherwise(F.col("plain")))
    df = df.withColumn("turns", parse(F.col("formatted")))
    spoken = F.filter("src", lambda t: t["role"] == LOSS_ROLE)
    spans = F.when(F.col("escaped"), F.transform(spoken, lambda t: t["at1"])).otherwise(
        F.transform(spoken, lambda t: t["at0"]))
    exact = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(
        F.raise_error(F.lit("chat formatting: the round trip failed")))
    return df.select("conv_id", "formatted", "escaped", spans.alias("loss_spans"), exact.alias("turns"))


#: Code points of a piece that spans are cut from.
PIECE = 1 << 16


def masked_text(formatted: Column, escaped: Column, spans: Column) -> Column:
    """The text under the loss mask: the spans cut out of the formatted text, unescaped, one after the other.

    The text is cut into pieces first, so a span costs a piece and not all the text before it.
    """
    last = F.call_function("div", F.greatest(F.length(formatted) - 1, F.lit(0)), F.lit(PIECE)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(formatted, k * PIECE + 1, F.lit(PIECE)))

    def cut(p: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.call_function("div", s["start"], F.lit(PIECE)).cast("int")
            end = F.call_function("div", s["start"] + s["length"], F.lit(PIECE)).cast("int")
            near = F.array_join(F.slice(p, first + 1, end - first + 1), "")
            text = F.substring(near, (s["start"] - first * PIECE + 1).cast("int"), s["length"].cast("int"))
            return F.when(escaped, unescape(text)).otherwise(text)

        return F.array_join(F.transform(spans, one), "")

    return F.get(F.transform(F.array(pieces), cut), F.lit(0))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digest columns from the turns that the parser read back and from the text under the loss mask."""
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("escaped"), F.col("loss_spans"))
    df = formatted.select("conv_id", "formatted", "turns", loss.alias("loss"))
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                     F.sha2(all_turns, 256).alias("turns_sha256"),
                     F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                     F.length("formatted").cast("long").alias("formatted_chars"))
