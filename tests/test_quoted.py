"""Quoted files whose records cross line and block borders, and JSON id lists cut at byte ranges."""

import csv
import io as stdio
import json
import os
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textpairs.sources import io, quoted

SCHEMA = "a string, b string, c string"


@pytest.fixture()
def blocks(spark):
    """Sets the greatest size of a file block."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def small(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "0")

    yield small
    for n, v in old.items():
        spark.conf.set(n, v)


def record_ends(text, sep):
    """Line numbers after which a record ends, by reading character by character."""
    out, line, inside, start, after = [], 0, False, True, False
    for ch in text + "\n":
        if inside:
            if ch == '"':
                inside, after = False, True
            line += ch == "\n"
            continue
        if ch == '"' and (start or after):
            inside, start, after = True, False, False
            continue
        if ch == "\n":
            out.append(line)
            line += 1
        start, after = ch in (sep, "\n"), False
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', ",", "\n", "a", " "]), max_size=40).map("".join))
def test_line_states_equal_a_character_automaton(text):
    inside, ends = False, []
    for i, line in enumerate(text.split("\n")):
        inside = quoted.ends_inside(line, ",", inside)
        if not inside:
            ends.append(i)
    assert ends == record_ends(text, ",")


def _field(rng):
    return "".join(rng.choice(["a", "b", " ", '"', "\n", "x,y", "\t", "é", "1", '""', "\n\n"]) for _ in range(rng.randrange(8)))


@pytest.mark.parametrize("seed", range(4))
def test_split_reading_equals_pandas_and_the_one_task_reader(spark, tmp_dir, blocks, seed):
    rng = random.Random(seed)
    for f in range(2):
        buf = stdio.StringIO()
        w = csv.writer(buf, lineterminator="\r\n" if seed == 3 else "\n")
        w.writerow(["h1", "h\n2", "h3"])
        for i in range(30):
            w.writerow([i, _field(rng), _field(rng)])
        if f:
            buf.write('7,5" disk,ok\n8,"long' + "\nline" * 40 + '",q"u"o\n\n')
        with open(os.path.join(tmp_dir, f"f{f}.csv"), "w", newline="") as out:
            out.write(buf.getvalue())
    want = sorted(tuple(r) for f in range(2) for r in pd.read_csv(
        os.path.join(tmp_dir, f"f{f}.csv"), dtype=str, keep_default_na=False, header=0, names=["a", "b", "c"]).itertuples(index=False))
    for size in ("23b", "61b", "1m"):
        blocks(size)
        records = quoted.read_records(spark, tmp_dir, ",").filter("not first").select("record")
        got = quoted.parse_records(records, SCHEMA, ",")
        assert sorted(tuple(x or "" for x in r) for r in got.collect()) == want
    if seed != 3:  # the one-task reader keeps carriage returns of line ends in the last field
        one = spark.read.schema(SCHEMA).option("header", True).option("escape", '"').option("multiLine", True).csv(tmp_dir)
        assert sorted(map(str, one.collect())) == sorted(map(str, got.collect()))


def test_records_without_broadcast_of_the_blocks(spark, tmp_dir, blocks, monkeypatch):
    with open(os.path.join(tmp_dir, "f.csv"), "w") as f:
        f.write("a,b,c\n" + "".join(f'{i},"x\ny{i}",z\n' for i in range(50)))
    blocks("64b")
    monkeypatch.setattr(quoted, "MAX_BROADCAST_BLOCKS", 0)
    rows = io.read_examples_csv(spark, tmp_dir, SCHEMA).collect()
    assert sorted(rows) == sorted((str(i), f"x\ny{i}", "z") for i in range(50))


def test_other_blocks_in_the_second_scan_fail(spark, tmp_dir, blocks):
    with open(os.path.join(tmp_dir, "f.csv"), "w") as f:
        f.write("a,b,c\n" + "".join(f"{i},y,z\n" for i in range(200)))
    blocks("128b")
    df = io.read_examples_csv(spark, tmp_dir, SCHEMA)
    blocks("100b")
    with pytest.raises(Exception, match="other blocks"):
        df.collect()


def test_unclosed_field_and_empty_files(spark, tmp_dir, blocks):
    blocks("16b")
    with open(os.path.join(tmp_dir, "f.csv"), "w") as f:
        f.write('a,b,c\n1,2,3\n4,"open\nto the\nvery end')
    open(os.path.join(tmp_dir, "empty.csv"), "w").close()
    rows = sorted(io.read_examples_csv(spark, tmp_dir, SCHEMA).collect())
    assert len(rows) == 2 and rows[0] == ("1", "2", "3") and "to the" in rows[1].b
    only = os.path.join(tmp_dir, "only")
    os.mkdir(only)
    open(os.path.join(only, "e.csv"), "w").close()
    assert io.read_examples_csv(spark, only, SCHEMA).collect() == []


def test_scan_corpus_is_the_dialect_of_the_examples(spark, tmp_dir, blocks):
    body = 'id,premise,hypothesis,label\nx1,n/a,"two\nlines",1\nx2,"say ""hi""",b,0\n'
    for name in ("a b+c.csv", "train.csv", "notes.txt"):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(body)
    for how in (io.SPLIT, True):
        rows = sorted(map(tuple, io.scan_corpus(spark, tmp_dir, multi_line=how).collect()))
        assert rows == [("x1", None, "two\nlines", 1, "a b+c.csv"), ("x2", 'say "hi"', "b", 0, "a b+c.csv")]
    with pytest.raises(Exception, match="line break"):
        io.scan_corpus(spark, tmp_dir, multi_line=False).collect()
    names = io.read_examples_csv(spark, os.path.join(tmp_dir, "train.csv"), schema=None)
    assert names.columns == ["id", "premise", "hypothesis", "label"] and names.count() == 2


def test_json_list_of_other_writers(spark, tmp_dir, blocks):
    ids = sorted(random.Random(1).sample(range(100_000), 5000))
    path = os.path.join(tmp_dir, "kept_ids.json")
    for text in (json.dumps(ids), json.dumps(ids, indent=1), json.dumps(ids, separators=(",", ":")) + "\n"):
        with open(path, "w") as f:
            f.write(text)
        for size in ("100b", "1m"):
            blocks(size)
            got = io.read_kept_ids(spark, path, position="at").collect()
            assert sorted(map(tuple, got)) == [(x, i) for i, x in enumerate(ids)]
    assert io.read_kept_ids(spark, path).rdd.getNumPartitions() >= 1


@pytest.mark.parametrize("text,want", [("[]", []), ("[7]", [7]), (" [ -1 ,\n2 ]\n", [-1, 2])])
def test_json_list_edges(spark, tmp_dir, text, want):
    path = os.path.join(tmp_dir, "k.json")
    with open(path, "w") as f:
        f.write(text)
    assert sorted(r[0] for r in io.read_kept_ids(spark, path).collect()) == want


def test_json_list_of_other_things_fails(spark, tmp_dir):
    path = os.path.join(tmp_dir, "k.json")
    with open(path, "w") as f:
        f.write('[1, "a", 2]')
    with pytest.raises(Exception, match="whole numbers"):
        io.read_kept_ids(spark, path).collect()


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 7000])
def test_json_list_is_one_array_in_parts(spark, tmp_dir, n):
    ids = random.Random(n).sample(range(50_000), n)
    out = os.path.join(tmp_dir, "kept")
    df = spark.createDataFrame([(i,) for i in ids] + [(i,) for i in ids[:3]], "token_id int")
    io.write_kept_ids(df, out)
    parts = sorted(x for x in os.listdir(out) if x.startswith("part-"))
    text = "".join(open(os.path.join(out, x)).read() for x in parts)
    assert json.loads(text) == sorted(ids)
    assert max(map(len, text.split("\n"))) < 8000
    assert sorted(map(tuple, io.read_kept_ids(spark, out, position="at").collect())) == [(x, i) for i, x in enumerate(sorted(ids))]
