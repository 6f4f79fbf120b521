"""Rules that are skipped where a text lacks what they need: the result is that of the whole chain."""

import random

from pyspark.sql import functions as F

from textpairs.functions import treebank as TB


def _plain(c, rules):
    for pattern, repl in rules:
        c = F.regexp_replace(c, pattern, repl)
    return c


def test_every_rule_names_what_it_needs():
    assert all(pattern in TB.NEEDS for pattern, _ in TB.TOKENISE_RULES + TB.DETOKENISE_RULES)


def test_skipped_rules_change_nothing(spark):
    bits = ["cannot", "Can not", "d'ye", "D 'ye", "gimme", "lem me", "gonna", "Wan na", "gotta", "got ta", "more'n", "more 'n", "'tis",
            "'T was", "it's", "they'LL", "I'd've", "dogs'", "...", "--", '"', "(\"", "``", " ''", ":", ",", "1,000", "3:15", "; [x]", "{y}",
            "<z>", "$ 5", "( a )", "end.", "a.b.", ".)", "  ", "\t", "\r", "\x0b", "\f", "ä", "日本", "plain", "words", "", " "]
    rnd = random.Random(5)
    texts = [None, *bits, *(" ".join(rnd.choices(bits, k=rnd.randint(1, 6))) for _ in range(1500)),
             *("".join(rnd.choices(bits, k=rnd.randint(1, 5))) for _ in range(500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (TB.TOKENISE_RULES, TB.DETOKENISE_RULES):
        padded = TB._pad("t")
        diff = df.select("t", TB._chain(padded, rules).alias("a"), _plain(padded, rules).alias("b")).filter("NOT a <=> b")
        assert diff.collect() == []
