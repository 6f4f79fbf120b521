"""Penn-Treebank style word tokenising (T3) and its inverse (T2) as chains of
``regexp_replace``.  Pure Catalyst, no Python per row.  The rules use no
look-around, so the same table runs in Java regex (Spark) and RE2 (DuckDB);
``as_duckdb`` rewrites a chain for the oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpairs.functions.text import normalise_space, strip_space

# Treebank conventions (pattern, replacement), applied in order
# to the text padded with one space on each side.
TOKENISE_RULES: list[tuple[str, str]] = [
    (r'([ (\[{<])"', "$1 `` "),
    (r"\.\.\.", " ... "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([;@#$%&?!\]\[(){}<>])", " $1 "),
    # only the period that ends the text, before closing quotes and brackets, is a token of its own
    (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "),
    (r"--", " -- "),
    (r'"', " '' "),
    # clitics and the apostrophe that ends a possessive or a quotation, twice over: "I'd've" holds two
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'[sSmMdD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'[sSmMdD]|') ", "$1 $2 "),
    # contractions that are split although they hold no apostrophe
    (r"\b([cC]an)(not)\b", "$1 $2"),
    (r"\b([dD])('ye)\b", "$1 $2"),
    (r"\b([gG]im|[lL]em)(me)\b", "$1 $2"),
    (r"\b([gG]on|[wW]an)(na)\b", "$1 $2"),
    (r"\b([gG]ot)(ta)\b", "$1 $2"),
    (r"\b([mM]ore)('n)\b", "$1 $2"),
    (r" ('[tT])(is|was)\b", " $1 $2"),
    (r"\s+", " "),
]

# The inverse rules, applied in order to the padded token string.
DETOKENISE_RULES: list[tuple[str, str]] = [
    (r" `` ", ' "'),
    (r" ''", '"'),
    (r"\b([cC]an) (not)\b", "$1$2"),
    (r"\b([dD]) ('ye)\b", "$1$2"),
    (r"\b([gG]im|[lL]em) (me)\b", "$1$2"),
    (r"\b([gG]on|[wW]an) (na)\b", "$1$2"),
    (r"\b([gG]ot) (ta)\b", "$1$2"),
    (r"\b([mM]ore) ('n)\b", "$1$2"),
    (r" ('[tT]) (is|was)\b", " $1$2"),
    (r" ('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'[sSmMdD]|') ", "$1 "),
    (r" ('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'[sSmMdD]|') ", "$1 "),
    (r" ([,.;:?!%)\]}])", "$1"),
    (r"([(\[{$]) ", "$1"),
]


#: Strings of which a text must hold one for a rule to change it (by the rule's pattern): a
#: search for bytes is much cheaper than a regular expression, and most rules change few texts.
NEEDS: dict[str, tuple[str, ...]] = {
    r'([ (\[{<])"': ('"',),
    r"\.\.\.": ("...",),
    r"([:,])([^0-9])": (":", ","),
    r"([;@#$%&?!\]\[(){}<>])": tuple(";@#$%&?!][(){}<>"),
    r"([^.])(\.)([\])}>\"']*)\s*$": (".",),
    r"--": ("--",),
    r'"': ('"',),
    r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'[sSmMdD]|') ": ("'",),
    r"\b([cC]an)(not)\b": ("annot",),
    r"\b([dD])('ye)\b": ("'ye",),
    r"\b([gG]im|[lL]em)(me)\b": ("imme", "emme"),
    r"\b([gG]on|[wW]an)(na)\b": ("onna", "anna"),
    r"\b([gG]ot)(ta)\b": ("otta",),
    r"\b([mM]ore)('n)\b": ("ore'n",),
    r" ('[tT])(is|was)\b": (" '",),
    # a run of one space stays
    r"\s+": ("  ", "\t", "\n", "\x0b", "\f", "\r"),
    r" `` ": (" `` ",),
    r" ''": (" ''",),
    r"\b([cC]an) (not)\b": ("an not",),
    r"\b([dD]) ('ye)\b": (" 'ye",),
    r"\b([gG]im|[lL]em) (me)\b": ("im me", "em me"),
    r"\b([gG]on|[wW]an) (na)\b": ("on na", "an na"),
    r"\b([gG]ot) (ta)\b": ("ot ta",),
    r"\b([mM]ore) ('n)\b": ("ore 'n",),
    r" ('[tT]) (is|was)\b": (" '",),
    r" ('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'[sSmMdD]|') ": ("'",),
    r" ([,.;:?!%)\]}])": tuple(f" {x}" for x in ",.;:?!%)]}"),
    r"([(\[{$]) ": tuple(f"{x} " for x in "([{$"),
}


def _apply(c: Column, pattern: str, repl: str) -> Column:
    def rule(x: Column) -> Column:
        held = [F.contains(x, F.lit(n)) for n in NEEDS[pattern]]
        return F.when(reduce(Column.__or__, held), F.regexp_replace(x, pattern, repl)).otherwise(x)

    # the lambda's variable holds the text so far, which is worked out once
    return F.get(F.transform(F.array(c), rule), F.lit(0)) if pattern in NEEDS else F.regexp_replace(c, pattern, repl)


def _chain(c: Column, rules) -> Column:
    for pattern, repl in rules:
        c = _apply(c, pattern, repl)
    return c


def _pad(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(" "), c, F.lit(" "))


def treebank_text(c) -> Column:
    """T3 as a string: tokens separated by single spaces."""
    return strip_space(_chain(_pad(c), TOKENISE_RULES))


def treebank_tokenise(c) -> Column:
    """Array of Treebank tokens (empty text gives an empty array).

    The rule chain is referenced once: the only empty token a split can yield
    here is the one of an empty text, which the filter removes.
    """
    return F.filter(F.split(treebank_text(c), " "), lambda tok: tok != "")


def treebank_detokenise(c) -> Column:
    """Join a space-separated token string back into text, then T1."""
    return normalise_space(_chain(_pad(c), DETOKENISE_RULES))


def as_duckdb(expr_sql: str, rules, padded: bool = True) -> str:
    """The same rule chain as DuckDB SQL over ``expr_sql`` (RE2, global flag)."""
    out = f"(' ' || {expr_sql} || ' ')" if padded else expr_sql
    for pattern, repl in rules:
        p = pattern.replace("'", "''")
        r = repl.replace("'", "''").replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return out
