"""Operators 1 and 3: extraction from built pages, url verdicts against plain Python."""

import html as H
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.helpers import prose
from textpairs.llm.html_text import count_page, extract, main_texts, tokens, weights
from textpairs.llm.queries import QUERIES
from textpairs.llm.url_rules import RULES, host_of, judge_urls, match, mine, path_of, written_rule

FURNITURE = """<head><title>Site</title><style>p{}</style></head><body class="has-sidebar"><header><a href="/">Home</a> The site</header>
<nav><ul><li><a href=x>Menu one</a><li><a>Menu two</a></ul></nav><div class="cookie-notice">We use cookies on this long notice</div>
<!-- a > comment --><script>var x = "<p>no</p>";</script><div id="ad-1">Buy now</div>"""
TAIL = """<section class="comments"><h2>Comments</h2><div class="comment"><p>I like this article a lot, dear friend</p></div></section>
<aside class=sidebar><p>Related things to read</p></aside><form><label>Mail</label><input name=a></form><footer>&copy; us</footer></body></html>"""


def score():
    counts = Counter()
    for k in range(20):
        body = "".join(f"<p>{prose(k * 50 + j, 30)}</p>" for j in range(5))
        count_page(f"{FURNITURE}<article><h1>{prose(k, 6)}</h1>{body}</article>{TAIL}", counts)
    return weights(counts)


def test_weights_have_their_signs():
    w = score()
    assert all(v > 0 for (k, _), v in w.items() if k == "word") and all(v < 0 for (k, _), v in w.items() if k == "tag")
    assert w["furniture", "li"] < w["tag", "p"] and ("word", "p") in w and ("word", "a") not in w


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div role="main">', "</div>"),
                                          ("<div class=post-content>", "</div>"), ("", ""),
                                          ('<div class="content with-sidebar no-ads">', "</div>")])
def test_content_between_furniture(open_, close):
    paras = [prose(k, 25) for k in range(4)]
    body = f"<h1>{prose(99, 5)}</h1>" + "".join(f"<p>{p}</p>\n  " for p in paras[:3])
    body += f'<div class="advert">inline ad words</div><p>{paras[3]}'
    page = FURNITURE + open_ + body + close + TAIL
    assert extract(page, score()) == "\n".join([prose(99, 5), *paras])


def test_blocks_references_and_white_space():
    w = score()
    page = "<article><h1>T &amp;amp; &eacute;&#233;</h1><p>a\n\t b<b>c</b> d &lt;p&gt;</p><ul><li>one<li>two</ul>x<br>y <p> <p>z</article>"
    assert extract(page, w) == "T &amp; éé\na bc d <p>\none\ntwo\nx\ny\nz"
    short = "<nav><a>menu menu menu menu menu</a></nav><article><p>Hi.</p></article><footer>foot foot foot</footer>"
    assert extract(short, w) == "Hi."


LINKS = "<ul>" + "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("marked", [True, False])
@pytest.mark.parametrize("furniture", [f"<nav class=toc>{LINKS}</nav>", f"<div class=share>{LINKS * 3}</div>",
                                       f"<aside>{LINKS}<p>Read on</p></aside>", "<script>x()</script>" * 20])
def test_furniture_inside_the_article_does_not_split_it(furniture, marked):
    title, lead, rest = prose(1, 5), prose(2, 12), [prose(k, 30) for k in range(3, 7)]
    body = "".join(f"<p>{p}</p>" for p in rest)
    for inner in (f"<h1>{title}</h1>{furniture}<p>{lead}</p>{body}", f"<h1>{title}</h1><p>{lead}</p>{furniture}{body}",
                  f"<h1>{title}</h1><p>{lead}</p>{body.replace('</p>', '</p>' + furniture)}"):
        page = FURNITURE + (f"<article>{inner}</article>" if marked else f"<div>{inner}</div>") + TAIL
        assert extract(page, score()) == "\n".join([title, lead, *rest])


def link_list_score():
    """Weights of pages with a plain link list outside their article."""
    counts = Counter()
    links = "".join(f"<li><a href=/{i}>w{i}</a></li>" for i in range(12))
    for k in range(300):
        body = "".join(f"<p>{prose(k * 50 + j, 30)}</p>" for j in range(4))
        count_page(f"{FURNITURE}<div class=links><ul>{links}</ul></div><article><h1>{prose(k, 6)}</h1>{body}</article>{TAIL}", counts)
    return weights(counts)


ITEMS = [f"w{i}" for i in range(40)]
WANTED = {
    "links": ("<ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ITEMS) + "</ul>", ITEMS),
    "contents": ("<ol>" + "".join(f"<li><a href=#{i}>{prose(i, 3)}</a>" for i in range(15)) + "</ol>", [prose(i, 3) for i in range(15)]),
    "references": ("<ol>" + "".join(f"<li>{prose(i, 9)} <a href=#r>up</a></li>" for i in range(30)) + "</ol>", [f"{prose(i, 9)} up" for i in range(30)]),
    "table": ("<table>" + "".join("<tr>" + "".join(f"<td>{i}{j}</td>" for j in range(9)) + "</tr>" for i in range(9)) + "</table>",
              [f"{i}{j}" for i in range(9) for j in range(9)]),
    "nested": ("<ul>" + "".join(f"<li>{x}<ul><li>sub {x}</li></ul></li>" for x in ITEMS) + "</ul>", [y for x in ITEMS for y in (x, f"sub {x}")]),
}


@pytest.mark.parametrize("kind", sorted(WANTED))
@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<div>", "</div>")])
def test_wanted_lists_and_tables_do_not_split_the_text(kind, open_, close):
    html, lines = WANTED[kind]
    title, lead, rest = prose(1, 5), prose(2, 12), [prose(k, 30) for k in range(3, 7)]
    body = "".join(f"<p>{p}</p>" for p in rest)
    for w in (score(), link_list_score()):
        page = FURNITURE + f"{open_}<h1>{title}</h1><p>{lead}</p>{html}{body}{close}" + TAIL
        assert extract(page, w) == "\n".join([title, lead, *lines, *rest])
        page = FURNITURE + f"{open_}<h1>{title}</h1>{html}<p>{lead}</p>{body}{close}" + TAIL
        assert extract(page, w) == "\n".join([title, *lines, lead, *rest])


def test_a_stray_menu_does_not_join_the_name_of_the_site():
    menu = "<ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ITEMS) + "</ul>"
    rest = [prose(k, 30) for k in range(3, 7)]
    page = f"<div>My site</div><div class=links>{menu}</div><div>" + "".join(f"<p>{p}</p>" for p in rest) + f"</div><div>{menu}</div>"
    assert extract(page, link_list_score()) == "\n".join(rest)


@pytest.mark.parametrize("name", ["social-studies", "alert-note", "related-work", "menu-of-the-day", "share-price", "notice-period",
                                  "comment-of-the-judge", "has-sidebar", "no-ads", "story", "post-header", "adverbs"])
def test_names_that_only_hold_a_furniture_word_stay(name):
    text = [prose(k, 50) for k in range(3)]
    for open_, close in (("<article>", "</article>"), ("<div>", "</div>")):
        page = FURNITURE + f'{open_}<p>{text[0]}</p><div class="{name}"><p>{text[1]}</p></div><p id="{name}">{text[2]}</p>{close}' + TAIL
        assert extract(page, score()) == "\n".join(text)


@pytest.mark.parametrize("name", ["related-posts", "social share-buttons", "comment-list", "siteFooter", "ad", "ad-slot-3", "cookie_notice",
                                  "newsletter-signup box", "sidebar", "main-nav", "post-comments"])
def test_names_made_of_furniture_words_go(name):
    text = [prose(k, 50) for k in range(2)]
    for open_, close in (("<article>", "</article>"), ("<div>", "</div>")):
        page = FURNITURE + f'{open_}<p>{text[0]}</p><div class="{name}"><p>{prose(9, 40)}</p></div><p>{text[1]}</p>{close}' + TAIL
        assert extract(page, score()) == "\n".join(text)


def wrapped_score():
    """Weights of pages whose article stands in layout elements."""
    counts = Counter()
    for k in range(500):
        count_page(f"{FURNITURE}<div class=page><div class=wrap><div class=column><article><h1>{prose(k, 6)}</h1>"
                   f"<p>{prose(k + 1, 60)}</p></article></div></div></div>{TAIL}", counts)
    return weights(counts)


def test_divs_are_not_outside_for_the_adverts_and_wrappers():
    lines = [prose(k, 3 + k % 8) for k in range(20)]
    lead, rest = prose(50, 6), [prose(60 + k, 30) for k in range(3)]
    for w in (score(), wrapped_score()):
        page = FURNITURE + "<div><div>" + "".join(f"<div>{x}</div>\n" for x in lines) + "</div></div>" + TAIL
        assert extract(page, w) == "\n".join(lines)
        inner = f"<div class=lead><div>{lead}</div></div>" + "".join(f"<p>{p}</p>" for p in rest)
        for page in (f"<article>{inner}</article>", f"<div>{inner}</div>"):
            assert extract(FURNITURE + page + TAIL, w) == "\n".join([lead, *rest])


def test_broken_markup():
    w = score()
    text = prose(3, 40)
    for page in [f"<article><p>{text}", f"<article><p><b>{text}<br></article>", f"<article><p>{text}</p></div></article",
                 f"<article><p title='x>{text}</p></article>", f"<article><p>{text}</p><!-- never ends <p>x</p>",
                 f"<article><p>{text}</p><script>never ends <p>x</p>", f"{text}", f"<p>{text}</p><"]:
        assert text in extract(page, w)
    for page in [None, "", " ", "<", "<!doctype html>", "<p></p>", "<script>x</script>", "<<<<", "</p></p>"]:
        assert extract(page, w).replace("<", "") == ""
    assert list(tokens("a<b")) and extract("1 < 2 and 3 > 2", w) == "1 < 2 and 3 > 2"
    assert len(extract("<article><p>" + "word " * 200_000 + "</p></article>", w).split()) == 200_000


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "host", "path", "rule", "tokens", "label"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_operator_rows(spark):
    page = FURNITURE + f"<article><p>{prose(1, 40)}</p></article>" + TAIL
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "no tags at all here")]
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_texts(pages(spark, rows)).collect())
    t = prose(1, 40)
    assert got == Counter({(1, "u", t, len(t)): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1,
                           (3, "w", "no tags at all here", 19): 1})
    assert main_texts(pages(spark, [])).count() == 0


def test_query_texts_are_the_articles(spark):
    """The tables' pages mark their article, whose blocks are known."""
    import re

    own = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    got = QUERIES["op1_html_text"](spark, SF_MID).collect()
    assert len(got) == len(own)
    for r in got:
        body = own[r["page_id"]].split("<article>", 1)[1].split("</article>")[0]
        body = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\n", re.sub(r"\s+", " ", body)))
        lines = [" ".join(H.unescape(x).split()) for x in body.split("\n")]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


URLS = {"https://www.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/"),
        "http://blog.example.com/en/x?q=/es/": ("blog.example.com", "/en/x", "example.com/en/"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/"), "x://a.net/es/": ("a.net", "/es/", "net/es/"),
        "http://net/fr/q": ("net", "/fr/q", "net/fr/"), "http://a.net/en/": ("a.net", "/en/", None),
        "http://a.com": ("a.com", "", None), "http://a.com?x=/": ("a.com", "", None), "nothing": ("", "", None),
        None: ("", "", None), "": ("", "", None), "http://com/": ("com", "/", "com/"), "a://b://c/d": ("b:", "//c/d", None),
        "http://x.org/es/#://": ("x.org", "/es/", None), "HTTP://A.COM/EN/\nfoo": ("a.com", "/EN/\nfoo", "com/")}


def test_host_path_and_longest_rule(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string").withColumn("h", host_of(F.col("u"))).withColumn("p", path_of(F.col("u")))
    for r in df.withColumn("r", written_rule(F.col("h"), F.col("p"), RULES)).collect():
        assert (r["h"], r["p"], r["r"]) == URLS[r["u"]], r["u"]


def brute_rules(rows, min_support, min_confidence):
    n, count = len(rows), Counter()
    for toks, label in rows:
        for k in range(1, len(toks) + 1):
            for c in combinations(sorted(toks), k):
                count[c] += 1
                count[c, label] += 1
    kept = {(c, y): count[c, y] / count[c] for (c, y) in [k for k in count if isinstance(k[0], tuple)]
            if count[c, y] >= min_support * n and count[c, y] / count[c] >= min_confidence}
    return {k for k, v in kept.items()
            if not any(kept.get((tuple(x for x in k[0] if x != out), k[1]), -1) >= v for out in k[0])}


def test_mined_rules_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for _ in range(300):
        toks = rng.sample(["a", "b", "c", "d", "e", "f"], rng.randrange(1, 5))
        bad = {"a", "b"} <= set(toks) or "f" in toks
        rows.append((sorted(toks), "block" if bad or rng.random() < 0.02 else "allow"))
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = mine(df, 0.02, 0.9).cache()
    assert {(tuple(r["antecedent"]), r["verdict"]) for r in rules.collect()} == brute_rules(rows, 0.02, 0.9)
    sets = spark.createDataFrame([(["a", "b"],), (["f"],), (["c"],), (["z"],)], "tokens array<string>")
    got = {tuple(r["tokens"]): r["mined"] for r in match(sets, rules).collect()}
    assert got[("a", "b")] == "block" and got[("f",)] == "block" and ("z",) not in got


def test_judge_urls(spark):
    rows = [(i, f"https://{'bad-casino' if i % 3 == 0 else 'good'}{i % 2}.example.org/xx/{i}", "") for i in range(200)]
    rows += [(1000 + i, u, "") for i, u in enumerate(URLS)] + [(5, rows[5][1], "")]
    marks = spark.createDataFrame([(i, "block" if i % 3 == 0 else "allow") for i in range(0, 200, 2)] + [(2, "odd"), (4, "allow")],
                                  "page_id long, label string").withColumn("url", F.lit("x"))
    out = judge_urls(pages(spark, rows), marks).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] < 200:
            assert r["rule"] is None and r["verdict"] == ("block" if r["page_id"] % 3 == 0 else "allow")
        else:
            url = list(URLS)[r["page_id"] - 1000]
            assert (r["host"], r["path"], r["rule"]) == URLS[url]
            if r["rule"]:
                assert r["verdict"] == RULES[r["rule"]]
    none = judge_urls(pages(spark, rows), marks.limit(0)).filter("rule is null")
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert judge_urls(pages(spark, []), marks).count() == 0


def test_a_bad_host_far_below_a_share_of_the_urls_is_blocked(spark):
    """24 labelled block pages of one host among 6,000 urls of a long tail, and as many decided by written rules."""
    rows = [(i, f"https://site{i % 1500}.example.org/xx/{i}", "") for i in range(6000)]
    rows += [(10_000 + i, f"https://spam.tail.example.org/{'ab'[i % 2]}x/{i}", "") for i in range(40)]
    rows += [(20_000 + i, f"https://w{i % 9}.com/q/{i}", "") for i in range(6000)]
    marks = [(i, "block" if 10_000 <= i < 20_000 else "allow") for i, _, _ in rows if not 10_024 <= i < 20_000]
    marks = spark.createDataFrame(marks, "page_id long, label string").withColumn("url", F.lit("x"))
    for some in (rows, rows[:6040]):
        verdicts = {r["page_id"]: r["verdict"] for r in judge_urls(pages(spark, some), marks).collect()}
        assert {i for i, v in verdicts.items() if v == "block"} == set(range(10_000, 10_040))


def test_unlabelled_rows_are_not_learnt_from(spark, monkeypatch):
    """A page whose quality and toxicity are both unknown is no example of an allowed one."""
    from textpairs.llm import queries as Q
    from textpairs.llm import url_rules

    seen = []
    monkeypatch.setattr(url_rules, "judge_urls", lambda pages, labels: seen.append(labels) or pages.withColumns(
        {"host": F.lit(1), "path": F.lit(1), "rule": F.lit(1), "mined": F.lit(1), "verdict": F.lit(1)}))
    rows = spark.createDataFrame([(1, None, None), (2, 1, None), (3, None, 0), (4, None, 1), (5, 0, 0), (6, 1, 1), (7, 1, 0)],
                                 "doc_id long, quality int, toxic int")
    table = Q.table
    monkeypatch.setattr(Q, "table", lambda s, d, name: rows if name == "labels" else table(s, d, name))
    QUERIES["op3_url_rules"](spark, SF_MID)
    got = {r["page_id"]: r["label"] for r in seen[0].collect()}
    assert got == {1: None, 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow"}
