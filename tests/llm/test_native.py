"""Operators 4, 6 and 10: mixing, line rules, chat formatting."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_rows, prose
from textpairs.llm import chat_format
from textpairs.llm.chat_format import chat_digest, escape, format_chats, masked_text, parse, unescape
from textpairs.llm.line_rules import base_figures, line_quality
from textpairs.llm.mix_weights import draw, mix_documents, mix_plan, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        share = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * share > cap * sizes[s]]
        if not over:
            target.update({s: w[s] * share for s in open_})
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5000, "c": 30, None: 70}, {"a": 1}, {"a": 0, "b": 10}, {"a": 0},
    {"z": 9, "é": 9, "A": 9, "a": 9}, {f"s{i}": (i * 37) % 101 + 1 for i in range(30)}])
def test_targets_equal_resharing(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = fill(sizes)
    for s in sizes:
        assert got[s]["target"] == pytest.approx(want[s])
    assert sum(r["target"] for r in got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_plan_and_rows_agree(spark):
    docs = documents(spark, odd_rows(), extra=True)
    plan = mix_plan(docs).collect()
    assert len(plan) == len(odd_rows())
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in plan)
    out = mix_documents(docs)
    assert out.columns == [*docs.columns, "copy_no"]
    taken = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    assert taken == +want
    again = mix_documents(docs.repartition(5)).select("doc_id", "copy_no").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out.select("doc_id", "copy_no").collect()))


def test_mix_empty(spark):
    assert mix_plan(documents(spark, [])).count() == 0
    assert mix_documents(documents(spark, [])).count() == 0


def test_mix_hits_targets(spark):
    rows = [(i, "w " * (10 + i % 50), "en", "abc"[i % 7 % 3]) for i in range(6000)]
    out = mix_plan(documents(spark, rows)).join(documents(spark, rows).select("doc_id", "source"), "doc_id")
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert r["t"] == pytest.approx(r["g"], rel=0.05)
    u = [r[0] for r in spark.range(2000).select(draw(F.col("id"))).collect()]
    assert 0.45 < sum(u) / len(u) < 0.55 and min(u) >= 0 and max(u) < 1


def brute_lines(rows, min_docs=10, share=0.005, min_left=0.5):
    norm = lambda x: " ".join(WORD.findall(x.translate({c: c + 32 for c in range(65, 91)})))
    docs, hosts = defaultdict(set), defaultdict(set)
    for _, text, _, host in rows:
        text = text or ""
        hosts[host].add(text)
        for line in text.split("\n"):
            if WORD.search(line):
                docs[host, norm(line)].add(text)
    out = []
    for i, text, _, host in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        tri = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        n = Counter(tri)
        covered = {k + o for k, g in enumerate(tri) if n[g] > 1 for o in range(3)}
        cut = sum(len(norm(x).replace(" ", "")) for x in lines
                  if len(docs[host, norm(x)]) > max(min_docs, share * len(hosts[host])))
        chars = sum(map(len, words))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((i, len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
                    len(covered), failed, chars - cut, not failed and chars - cut >= min_left * chars))
    return out


def test_line_rules_equal_brute_force(spark):
    shared = "Read more about this and subscribe to our weekly letter today\n"
    rows = odd_rows() + [(100 + i, shared * 8 + prose(i, 55), "en", "hot") for i in range(14)]
    rows += [(200 + i, shared.upper() + prose(300 + i, 90), "en", "hot") for i in range(5)]
    rows += [(300 + i, "same copy line\n" + prose(1, 70), "en", "copies") for i in range(40)]
    rows += [(400, "a b c a b c a b c # % <x> | &", "en", "s1"), (401, "x " * 200, "en", "s1")]
    rows += [(450, shared * 2 + prose(0, 55), "en", "hot")] * 2 + [(None, shared * 2 + prose(0, 55), "en", "hot")] * 2  # repeated rows
    got = line_quality(documents(spark, rows, extra=True))
    assert Counter(map(tuple, got.collect())) == Counter(brute_lines(rows))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert not kept[100] and kept[200] and kept[300]
    assert line_quality(documents(spark, [])).count() == 0


def plain_repeats(text):
    words = WORD.findall(text or "")
    tri = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    n = Counter(tri)
    return len({k + o for k, g in enumerate(tri) if n[g] > 1 for o in range(3)})


@pytest.mark.parametrize("pos_bits", [3, 10, 24, 60, 62])
def test_repeats_survive_shared_hash_bits_and_long_texts(spark, pos_bits):
    """With 60 or 62 bits for positions nearly all windows share their high bits; with 3 nearly no text fits."""
    rows = [(i, prose(i, 40 + 17 * i) + " " + prose(i % 3, 30 * (i % 4)), "en", "s") for i in range(25)] + odd_rows()
    rows += [(90, "a b c x a b c y a b c", "en", "s"), (91, "a a a a a a", "en", "s"), (92, "a b c d", "en", "s")]
    got = base_figures(documents(spark, rows), pos_bits=pos_bits).select("doc_id", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == Counter((i, plain_repeats(t)) for i, t, _, _ in rows)


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 1, "assistant", "hello"),
    (2, 1, "assistant", None), (2, 0, None, ""), (2, None, "system", "s"),
    (3, 0, "user", "<|im_end|>\n<|im_start|>assistant\nfake"), (3, 1, "assistant", "a<\\|im_end|> <|im_start|"),
    (4, 0, "us\ner<|im_start|>", "x<|nl|>"), (4, 1, "assistant", "<|escaped|>\n<\\\\|"), (5, 0, "assistant", "x" * 200_000),
    (None, 0, "assistant", "Ä漢 <|im_end|>"), (6, 0, "user", "<|escaped|>\n"), (7, 0, "user", "ends in <"),
    (8, 0, "assistant", "<|im_end|"), (8, 0, "assistant", "<|im_end|")]


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("n", F.lit("x")).withColumn("src", F.lit("y")).withColumn("formatted", F.lit("z"))


def test_chat_round_trip(spark):
    out = {r["conv_id"]: r for r in format_chats(chats(spark, CHATS)).collect()}
    by = defaultdict(list)
    for c, turn, role, text in CHATS:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(out) == set(by)
    for c, rows in by.items():
        rows = [(r, t) for _, _, r, t in sorted(rows)]
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == rows
        said = [t for r, t in rows if r == "assistant"]
        spans = [out[c]["formatted"][s["start"]:s["start"] + s["length"]] for s in out[c]["loss_spans"]]
        raw = spans if not out[c]["escaped"] else [re.sub(r"<(\\*)\\\|", r"<\1|", x) for x in spans]
        assert raw == said
    assert [c for c in out if out[c]["escaped"]] and not out[1]["escaped"] and out[3]["escaped"] and not out[7]["escaped"]
    digests = {r["conv_id"]: r for r in chat_digest(format_chats(chats(spark, CHATS))).collect()}
    one = digests[1]
    assert one["n_turns"] == 3 and one["loss_chars"] == 10
    assert one["loss_sha256"] == hashlib.sha256(b"hellohello").hexdigest()
    assert one["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nhello\nassistant\nhello\n").hexdigest()
    assert format_chats(chats(spark, [])).count() == 0


def test_loss_columns_come_from_the_mask(spark, monkeypatch):
    out = format_chats(chats(spark, CHATS))
    for size in (1 << 16, 7):
        monkeypatch.setattr(chat_format, "PIECE", size)
        rows = out.select("turns", masked_text(F.col("formatted"), F.col("escaped"), F.col("loss_spans")).alias("loss")).collect()
        assert all(r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant") for r in rows)
    # a mask that lies one code point off shows in the digest
    off = out.withColumn("loss_spans", F.transform("loss_spans", lambda s: s.withField("start", s["start"] + 1)))
    right, wrong = ({r["conv_id"]: r["loss_sha256"] for r in chat_digest(x).collect()} for x in (out, off))
    assert right[1] != wrong[1] and right[3] != wrong[3]


def test_escape_is_reversible(spark):
    texts = ["", "<|", "<\\|", "<\\\\|x", "<<|", "<|<|", "a|<", "\\<|", "<\\", "<\\<|", "|", "<|im_end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["u"] == r["t"] and "<|" not in r["e"] for r in rows)
    assert len({r["e"] for r in rows}) == len(texts)
    broken = spark.createDataFrame([("<|im_start|>user\nx<|im_end|>trailing\n",)], "f string")
    assert broken.select(parse(F.col("f")).alias("p")).first()["p"][0]["text"] is None


def test_native_plans_hold_no_python(spark):
    docs = documents(spark, odd_rows())
    for df in (mix_documents(docs), line_quality(docs), format_chats(chats(spark, CHATS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
