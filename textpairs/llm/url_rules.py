"""URL filters by association rules (operator 3).

Written rules (host, path, verdict) decide first.  For the other urls, pattern
growth (FP-growth) mines combinations of url tokens from labelled pages that no
written rule decides (label ``allow`` or ``block`` per page id): scheme, host
suffixes, words of the host, path words, query keys and fragment.  A rule
"tokens => verdict" is kept when at least ``min_count`` labelled urls say so,
however many others there are, its confidence reaches its limit and no smaller
kept set of its tokens says the same at least as surely.

Each distinct set of tokens, rarest first, goes to every one of its tokens with
the commoner ones behind it; a token's sets are grown there by further tokens.
Spark ML's own FPGrowth is not used: it collects every frequent token on the
driver and broadcasts their ranks, a table that grows with the corpus when the
support is a count, and it emits each subset of tokens that always come
together.  A token that all sets at hand hold, or any token where all labels agree, could
only give rules that a smaller set makes needless, and is left out: a site
costs as many sets as it has sections that differ, not one per subset.

Matching goes over an inverted index: each mined rule is filed under its rarest
token, urls look it up by their tokens, and hits are verified by set
inclusion; the surest rule wins, then the better supported, the longer, and
the first in order.  Urls are reduced to their distinct token sets first, so a
set that a third of all pages share is matched once.  A url that no rule fits
is allowed.

Defined cases: a null url, or one without ``://``, has empty host and path, no
tokens, and the default verdict; repeated rows give repeated results; an id
labelled both ways counts as block, other labels are ignored; without labelled
urls nothing is mined; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.stored import stored

#: Fixed values of the contract: rule and verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow",
         "net/es/": "block", "net/fr/": "block"}
#: Parameters.
MIN_COUNT = 20
MIN_CONFIDENCE = 0.9
DEFAULT = "allow"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def written_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of a short list of rules that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; numbers stand for no site or section and are left out."""
    url = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.lit("host:"), F.array_join(F.slice(labels, i, n), ".")))).otherwise(F.array().cast("array<string>"))
    site = F.filter(F.split(host, r"[^\p{L}\p{N}]+"), lambda x: x.rlike(r"\p{L}"))
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x.rlike(r"\p{L}"))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    fragment = F.regexp_extract(url, r"(?s)#(.*)$", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    every = F.concat(
        suffixes, F.transform(site, lambda x: F.concat(F.lit("word:"), x)), F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(keys, lambda x: F.concat(F.lit("query:"), x)),
        F.when(fragment != "", F.array(F.concat(F.lit("at:"), fragment))).otherwise(F.array().cast("array<string>")),
        F.when(scheme != "", F.array(F.concat(F.lit("scheme:"), F.lower(scheme)))).otherwise(F.array().cast("array<string>")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def _grow(sets: Iterable[tuple[tuple[str, ...], int, int]], held: tuple[str, ...], least: int, sure: float, out: list) -> None:
    """Adds the rules of ``held`` and of its extensions by tokens of ``sets`` (tokens, allow, block), all with ``held``."""
    allow, block = sum(x[1] for x in sets), sum(x[2] for x in sets)
    for verdict, n in (("allow", allow), ("block", block)):
        if n >= least and n / (allow + block) >= sure:
            out.append((held, verdict, n, n / (allow + block)))
    if not allow or not block:
        return
    counts: dict[str, list[int]] = {}
    for toks, a, b in sets:
        for x in toks:
            c = counts.setdefault(x, [0, 0])
            c[0] += a
            c[1] += b
    more = {x for x, c in counts.items() if max(c) >= least and sum(c) < allow + block}
    below: dict[str, dict[tuple[str, ...], list[int]]] = {x: {} for x in more}
    for toks, a, b in sets:
        toks = tuple(x for x in toks if x in more)
        for i, x in enumerate(toks):
            c = below[x].setdefault(toks[i + 1:], [0, 0])
            c[0] += a
            c[1] += b
    for x in list(below):
        _grow([(t, a, b) for t, (a, b) in below.pop(x).items()], (*held, x), least, sure, out)


def mine(examples: DataFrame, min_support: float | None = None, min_confidence: float = MIN_CONFIDENCE,
         min_count: int = MIN_COUNT) -> DataFrame:
    """``examples(tokens, label)`` -> (antecedent, verdict, confidence, support) of the rules kept.

    ``min_support``, a share of the examples, takes the place of ``min_count`` if given.
    """
    sets = stored(examples.groupBy("tokens").agg(F.count_if(F.col("label") == "allow").alias("allow"),
                                                 F.count_if(F.col("label") == "block").alias("block")), "url-sets")
    n = sets.agg(F.sum(F.col("allow") + F.col("block"))).first()[0] or 0
    least = max(1, min_count if min_support is None else ceil(min_support * n - 1e-9))
    # tokens that reach the count, rarest first in each set
    each = sets.select("tokens", "allow", "block", F.explode("tokens").alias("token"))
    use = each.groupBy("token").agg(F.sum("allow").alias("a"), F.sum("block").alias("b"))
    use = use.filter(F.greatest("a", "b") >= least).select("token", (F.col("a") + F.col("b")).alias("n"))
    ranked = each.join(use, "token").groupBy("tokens", "allow", "block").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("by"))
    ranked = ranked.select("allow", "block", F.col("by.token").alias("by"))
    parts = ranked.select("allow", "block", "by", F.posexplode("by").alias("at", "first"))
    parts = parts.groupBy("first", F.slice("by", F.col("at") + 2, F.size("by")).alias("rest")).agg(
        F.sum("allow").alias("allow"), F.sum("block").alias("block"))

    def grown(part: pa.Table) -> pa.Table:
        out: list = []
        rows = zip(map(tuple, part["rest"].to_pylist()), part["allow"].to_pylist(), part["block"].to_pylist())
        _grow(list(rows), (part["first"][0].as_py(),), least, min_confidence, out)
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.list_(pa.string()), pa.string(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["antecedent", "verdict", "n", "confidence"])

    rules = parts.groupBy("first").applyInArrow(grown, "antecedent array<string>, verdict string, n long, confidence double")
    rules = stored(rules.select(F.array_sort("antecedent").alias("antecedent"), "verdict", "confidence",
                                (F.col("n") / F.lit(float(n or 1))).alias("support")), "url-rules")
    # pruned when one token less says the same as surely; each rule asks for its sets of one token less
    smaller = rules.select(F.col("antecedent").alias("less"), F.col("verdict").alias("v"),
                           F.col("confidence").alias("sure"))
    shorter = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("out"))
    shorter = shorter.withColumn("less", F.filter("antecedent", lambda x: x != F.col("out")))
    needless = (shorter.join(smaller, ["less"]).filter((F.col("verdict") == F.col("v")) & (F.col("sure") >= F.col("confidence")))
                .select("antecedent", "verdict").distinct())
    return rules.join(needless, ["antecedent", "verdict"], "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets(tokens)`` (distinct) -> (tokens, mined): the verdict of the best rule held by the set."""
    use = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = rules.select("antecedent", "verdict", "confidence", "support", F.explode("antecedent").alias("token"))
    filed = filed.join(use, "token").groupBy("antecedent", "verdict", "confidence", "support").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(filed, "token")
    hits = hits.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("antecedent"), F.array_join("antecedent", " "), "verdict")
    return hits.groupBy("tokens").agg(F.min_by("verdict", order).alias("mined"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules: dict[str, str] = RULES, min_support: float | None = None, min_confidence: float = MIN_CONFIDENCE,
               default: str = DEFAULT, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per page: page_id, host, path, rule, mined (null: no mined rule), verdict.

    ``labels(page_id, label)`` holds the labelled pages.
    """
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    df = df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    df = df.withColumn("rule", written_rule(F.col("host"), F.col("path"), rules))
    df = df.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    told = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        told = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(told)
    df = df.withColumn("told", told).select("page_id", "host", "path", "rule", "told", "tokens")
    known = labels.filter(F.col("label").isin("allow", "block")).groupBy("page_id").agg(F.max("label").alias("label"))
    examples = df.filter("told is null and size(tokens) > 0").join(known, "page_id").select("tokens", "label")
    if examples.isEmpty():
        return df.select("page_id", "host", "path", "rule", F.lit(None).cast("string").alias("mined"),
                         F.coalesce("told", F.lit(default)).alias("verdict"))
    sets = df.filter("told is null and size(tokens) > 0").select("tokens").distinct()
    # written, so that the join is between two plain tables and a set that many pages share can be split
    mined = stored(match(sets, mine(examples, min_support, min_confidence, min_count)), "url-verdicts").withColumnRenamed("tokens", "set")
    out = df.join(mined, (df["tokens"] == mined["set"]) & df["told"].isNull(), "left")
    return out.select("page_id", "host", "path", "rule", "mined",
                      F.coalesce("told", "mined", F.lit(default)).alias("verdict"))
