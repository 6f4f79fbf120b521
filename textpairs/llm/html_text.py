"""HTML extraction by a maximum-scoring subsequence (operator 1).

A page becomes a row of tokens, texts and tags.  Words score positive by the
element they stand in, tags score negative, and one linear scan finds the
contiguous stretch with the greatest sum: the content region.  Its blocks,
without what stands in menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, are the text.

Weights come from labelled pages: pages that mark their content themselves
(``article``, ``main`` or ``role=main``) tell content words and tags from the
others.  A word's weight is the log-ratio of how often words of its element
lie inside and outside, a tag's the log-ratio of the pages that have it
outside and inside (apart for tags of page furniture, and without the elements
that hold the content), each held in a fixed range so that words stay positive
and tags negative; what no labelled page shows has a small weight.  Furniture is
cut from the region by itself, so its tags and words score nothing and cannot
split a text around it.  A closing tag belongs to the element it closes.  At most
about ``label_pages`` labelled pages are counted, picked by a hash of their id.

On a page that marks its content, marked tags cost nothing (nothing inside the
mark can split it) and words outside the mark score nothing.  Elsewhere a list
or table is scored as one: it never counts against the text around it, and if
at least half of its words are links, by ``LINK_LIST`` at most, so a content
list between lead and body does not part them while a stray menu between a
site's name and its text still does.

An element is furniture by its tag, or when every part of one of its class, id
or role names is a word for furniture or a layout word beside one
(``related-posts``, but not ``related-work``).

Pages are read in Arrow batches, one page at a time, without a shuffle.

Defined cases: null or wordless html gives an empty text; broken markup
(unclosed elements, comments, quotes) is read as far as it goes; repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters.
LABEL_PAGES = 2000
WORD_RANGE = (0.2, 2.0)
TAG_RANGE = (0.05, 6.0)
UNSEEN_WORD, UNSEEN_TAG = 1.0, -0.2
LINK_LIST = -5.0

#: Element names of HTML, and words that name page furniture in class, id and role.
RAW = "script style noscript template svg math iframe object canvas select button textarea title head"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCK = ("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
         "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
         "summary table tbody td tfoot th thead tr ul")
FURNITURE = "nav aside footer form menu dialog fieldset search"
MARKS = "article main"
NAMED = ("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
         "cookie cookies discussion disqus footer header masthead menu modal navbar navigation nav newsletter notice notices notification "
         "pager pagination popup promo promotion reply replies related respond share sharing sidebar signup social "
         "sponsor sponsored subscribe toolbar widget complementary contentinfo alert")
OWN = "article entry post story content"
LAYOUT = ("area bar body bottom box btn button buttons block column container content end entry fixed form fixed group icon icons "
          "inner item items left link links list main mobile outer page panel placeholder post posts right row section "
          "site slot sticky story stories text thread top unit wrap wrapper wrapping zone article articles global primary secondary")
UNITS = "ul ol dl table"

_RAW, _VOID, _BLOCK, _FURNITURE, _MARKS, _NAMED, _OWN, _LAYOUT, _UNITS = (
    frozenset(x.split()) for x in (RAW, VOID, BLOCK, FURNITURE, MARKS, NAMED, OWN, LAYOUT, UNITS))
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S | re.X)
_ATTR = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _names_furniture(called: str) -> bool:
    """Whether a class, id or role name is made of furniture and layout words only (``has-sidebar`` tells of the page)."""
    parts = set(_PARTS.findall(_HUMP.sub("-", called).lower()))
    named = parts & _NAMED
    if not named or named == {"header"} and parts & _OWN:
        return False
    return all(x in _NAMED or x in _LAYOUT or x.isdigit() for x in parts)


def _unwanted(name: str, attrs: str, marked: bool) -> bool:
    """Whether an element is page furniture by its name or by what its attributes call it."""
    if name in _FURNITURE or name == "header" and not marked:
        return True
    if not attrs.strip() or name in ("html", "body", "article", "main") and "comment" not in attrs:
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or (
        " hidden" in f" {attrs} ".replace("=", " ") and "hidden" in attrs.split())
    return hidden or any(_names_furniture(x) for k in ("class", "id", "role") for x in found.get(k, "").split())


Token = tuple[str, str, bool, bool, str, int]


def tokens(html: str) -> Iterator[Token]:
    """``(kind, name, wanted, marked, text, depth)``: kind is text or tag; name the element.

    The text of a tag is ``open`` or ``close``, or empty where it has no content to
    read; depth counts the elements around it.
    """
    stack: list[tuple[str, bool, bool]] = [("", True, False)]
    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        upto = m.start() if m else len(html)
        if upto > at:
            name, wanted, marked = stack[-1]
            yield "text", name, wanted, marked, html[at:upto], len(stack)
        if not m:
            return
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            closed = stack[-1]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    closed = stack[k]
                    del stack[k:]
                    break
            yield "tag", name, closed[1], closed[2], "close", len(stack)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in _RAW and not attrs.rstrip().endswith("/"):
            # everything up to the end tag is not text; a head also ends where the body begins
            close = re.compile(rf"</{name}\s*>" + ("|(?=<body)" if name == "head" else ""), re.I).search(html, at)
            at = close.end() if close else len(html)
            yield "tag", name, False, stack[-1][2], "", len(stack)
            continue
        if name in _BLOCK and name != "br":
            # a block ends an open paragraph; an item or cell ends the one before it
            ends = {"p"} | ({name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        _, wanted, marked = stack[-1]
        is_mark = name in _MARKS or "main" in attrs and re.search(r"role\s*=\s*[\"']?main", attrs) is not None
        wanted = wanted and not _unwanted(name, attrs, marked)
        marked = marked or is_mark and wanted
        opens = name not in _VOID and not attrs.rstrip().endswith("/")
        depth = len(stack)
        if opens:
            stack.append((name, wanted, marked))
        yield "tag", name, wanted, marked, "open" if opens else "", depth


def _element(name: str) -> str:
    return name if name in _BLOCK or name in ("a", "b", "i", "em", "strong", "span") else "other"


def _holders(seen: list[Token]) -> set[int]:
    """Places of the tags of elements that hold marked content: they stand neither inside nor outside."""
    out: set[int] = set()
    inner: list[tuple[int, str]] = []
    for i, (kind, name, wanted, marked, text, _) in enumerate(seen):
        if marked:
            for at, _ in reversed(inner):
                if at in out:
                    break
                out.add(at)
        elif kind == "tag" and wanted and text == "open":
            inner.append((i, name))
        elif kind == "tag" and wanted and text == "close":
            for k in range(len(inner) - 1, -1, -1):
                if inner[k][1] == name:
                    if inner[k][0] in out:
                        out.add(i)
                    del inner[k:]
                    break
    return out


def count_page(html: str, counts: Counter) -> None:
    """Words inside and outside the content of a page that marks it, and which tags lie there (once a page)."""
    seen = list(tokens(html))
    if not any(t[3] for t in seen):
        return
    holders = _holders(seen)
    tags = set()
    for i, (kind, name, wanted, marked, text, _) in enumerate(seen):
        inside = wanted and marked
        if i in holders:
            continue
        if kind == "tag":
            tags.add(("tag" if wanted else "furniture", _element(name), inside))
        elif wanted:
            counts["word", _element(name), inside] += len(text.split())
    counts.update(tags)


def weights(counts: dict) -> dict[tuple[str, str], float]:
    """``(kind, element) -> score``, words above zero and tags below."""
    out = {}
    for kind, name in {(k, n) for k, n, _ in counts}:
        inside, outside = counts.get((kind, name, True), 0), counts.get((kind, name, False), 0)
        ratio = log((inside + 1) / (outside + 1))
        out[kind, name] = (min(max(ratio, WORD_RANGE[0]), WORD_RANGE[1]) if kind == "word" else
                           -min(max(-ratio, TAG_RANGE[0]), TAG_RANGE[1]))
    return out


def _scores(seen: list[Token], score: dict[tuple[str, str], float]) -> list[float]:
    """What each token adds to a stretch."""
    page_marked = any(t[3] and t[0] == "text" and t[4].strip() for t in seen)
    out = []
    for kind, name, wanted, marked, text, _ in seen:
        if kind == "tag":
            # furniture is cut by itself, wherever it stands
            out.append(0.0 if not wanted or page_marked and marked else score.get(("tag", _element(name)), UNSEEN_TAG))
        elif wanted and (marked or not page_marked):
            out.append(len(text.split()) * score.get(("word", _element(name)), UNSEEN_WORD))
        else:
            out.append(0.0)
    if not page_marked:
        _as_units(seen, out)
    return out


def _as_units(seen: list[Token], out: list[float]) -> None:
    """Gives the score of each outermost list or table, kept from counting against its surroundings, to its last token."""
    i, n = 0, len(seen)
    while i < n:
        kind, name, wanted, _, text, depth = seen[i]
        if kind != "tag" or name not in _UNITS or not wanted or text != "open":
            i += 1
            continue
        end = i + 1
        while end < n and seen[end][5] > depth:
            end += 1
        if end < n and seen[end][:2] == ("tag", name) and seen[end][4] == "close":
            end += 1
        words = linked = link = 0
        for kind, name, wanted, _, text, at in seen[i:end]:
            if kind == "tag":
                link = 0 if link and at < link else at + 1 if not link and name == "a" and text == "open" else link
            elif wanted:
                words += (k := len(text.split()))
                linked += k if link and at >= link else 0
        least = LINK_LIST if 2 * linked >= words else 0.0
        total = max(sum(out[i:end]), least)
        out[i:end] = [0.0] * (end - i - 1) + [total]
        i = end


def extract(html: str | None, score: dict[tuple[str, str], float]) -> str:
    """Main text: blocks joined by line feeds."""
    if not html:
        return ""
    seen = list(tokens(html))
    page_marked = any(t[3] and t[0] == "text" and t[4].strip() for t in seen)
    best = total = 0.0
    start = first = last = 0
    for i, x in enumerate(_scores(seen, score)):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    if not best:
        return ""
    # whole blocks: an inline tag does not end one
    while first and not (seen[first - 1][0] == "tag" and seen[first - 1][1] in _BLOCK):
        first -= 1
    while last < len(seen) and not (seen[last][0] == "tag" and seen[last][1] in _BLOCK):
        last += 1
    blocks: list[str] = []
    parts: list[str] = []
    for kind, name, wanted, marked, text, _ in [*seen[first:last], ("tag", "p", True, False, "", 0)]:
        if kind == "text":
            if wanted and (marked or not page_marked):
                parts.append(text)
        elif name in _BLOCK:
            line = " ".join(unescape("".join(parts)).split())
            if line:
                blocks.append(line)
            parts = []
    return "\n".join(blocks)


def learn_weights(pages: DataFrame, label_pages: int = LABEL_PAGES) -> dict[tuple[str, str], float]:
    """Weights from about ``label_pages`` of ``pages(page_id, html)`` that mark their content."""
    marked = pages.filter(F.col("html").rlike(r"(?i)<(article|main)\b|role\s*=\s*.?main"))
    share = max(1, marked.count() // label_pages)
    sample = marked.filter(F.pmod(F.xxhash64("page_id"), F.lit(share)) == 0).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for page in b.column(0):
                count_page(page.as_py(), counts)
        rows = [(k, n, i, c) for (k, n, i), c in counts.items()]
        columns = zip(*rows) if rows else ([], [], [], [])
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "element", "inside", "n"])

    found = sample.mapInArrow(run, "kind string, element string, inside boolean, n long")
    # one row per kind of token and element name of the fixed list
    found = found.groupBy("kind", "element", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r["kind"], r["element"], r["inside"]): r["n"] for r in found})


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               label_pages: int = LABEL_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    score = learn_weights(rows, label_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(page.as_py(), score) for page in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
