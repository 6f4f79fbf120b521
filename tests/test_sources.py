"""Fixture tests for the file dialects and sinks (S1-S12); each test writes its
own tiny files into a fresh temp folder."""

import os

import pytest

from textpairs.sources import io


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_pairs_tsv_standard_quotes(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "paws_train.tsv"),
               'id\tsentence1\tsentence2\tlabel\n'
               '1\tA cat .\t"A ""quoted"" cat ."\t1\n'
               '2\t"two\nlines"\tplain\t0\n')
    assert sorted(io.read_pairs_tsv(spark, p).collect()) == sorted(io.read_pairs_tsv(spark, p, multi_line=True).collect())
    rows = {r.id: r for r in io.read_pairs_tsv(spark, p).collect()}
    assert rows[1].sentence2 == 'A "quoted" cat .'
    assert rows[2].sentence1 == "two\nlines"
    assert rows[2].label == 0


def test_nli_tsv_quoting_off_drops_long_keeps_short(spark, tmp_dir):
    header = "gold_label\tsentence1\tsentence2\tpairID\tgenre"
    body = ['entailment\t"Quoted start\tplain\t1\tfic',
            'neutral\ta\tb\t2\tfic\tEXTRA',            # over-long: dropped
            'contradiction\tshort\tx',                 # short: null-padded
            '-\tdash\tlabel\t4\tfic']
    p = _write(os.path.join(tmp_dir, "multinli_train.txt"), "\n".join([header] + body) + "\n")
    df = io.read_nli_tsv(spark, p, on_bad="drop")
    rows = sorted(df.collect(), key=lambda r: r.sentence1)
    assert [r.sentence1 for r in rows] == ['"Quoted start', "dash", "short"]
    short = [r for r in rows if r.sentence1 == "short"][0]
    assert short.pairID is None and short.sentence2 == "x"


def test_nli_tsv_strict_fails_on_long_row(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "dev.txt"), "gold_label\tsentence1\tsentence2\tpairID\n"
                                                  "neutral\ta\tb\t2\tEXTRA\n")
    with pytest.raises(Exception):
        io.read_nli_tsv(spark, p, on_bad="fail").collect()


def test_examples_csv_labelled_and_unlabelled(spark, tmp_dir):
    a = _write(os.path.join(tmp_dir, "train.csv"), 'id,premise,hypothesis,label\nx1,"p, with comma",h,2\n')
    b = _write(os.path.join(tmp_dir, "test.csv"), 'id,premise,hypothesis\nx2,p2,h2\n')
    assert io.read_examples_csv(spark, a).collect()[0].label == 2
    t = io.read_examples_csv(spark, b, io.NLI_UNLABELLED_SCHEMA)
    from textpairs.operators.clean import with_optional_label
    assert with_optional_label(t).collect()[0].label is None
    assert with_optional_label(t, default=0).collect()[0].label == 0


def test_indexed_lines_keep_file_order_across_blocks(spark, tmp_dir):
    lines = [f"phrase number {i:05d}  with  spaces\t" for i in range(4000)]
    p = _write(os.path.join(tmp_dir, "phrases.txt"), "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # forces many blocks
    try:
        df = io.read_indexed_lines(spark, p)
        got = {r.phrase_index: r.phrase for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000
    assert all(got[i] == lines[i] for i in range(4000))


def test_write_splits_and_plain_tsv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("a b", "c", "train"), ("d", "e f", "valid")], "sentence1 string, sentence2 string, split string")
    out = os.path.join(tmp_dir, "splits")
    io.write_splits(df, out, fmt="csv")
    back = spark.read.option("header", True).csv(out)
    assert sorted((r.sentence1, r.split) for r in back.collect()) == [("a b", "train"), ("d", "valid")]
    tsv = os.path.join(tmp_dir, "plain")
    io.write_plain_tsv(df.drop("split"), tsv)
    back = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(tsv)
    assert sorted(r.sentence2 for r in back.collect()) == ["c", "e f"]
    bad = spark.createDataFrame([("a\tb",)], "s string")
    with pytest.raises(Exception):
        io.write_plain_tsv(bad, os.path.join(tmp_dir, "bad"))


def test_tokens_cache_round_trip_with_partition_pruning(spark, tmp_dir):
    df = spark.createDataFrame([([1, 2], [3], "paws", "train"), ([4], [5, 6], "quora", "valid")],
                               "input_ids array<int>, target_ids array<int>, corpus string, split string")
    out = os.path.join(tmp_dir, "cache")
    io.save_tokens(df, out)
    got = io.load_tokens(spark, out, corpus="quora", split="valid")
    assert [r.target_ids for r in got.collect()] == [[5, 6]]
    plan = got._jdf.queryExecution().executedPlan().toString()
    pruned = [x for x in plan.split("PartitionFilters: [")[1:]]
    assert pruned and "quora" in pruned[0].split("]")[0] and "valid" in pruned[0].split("]")[0], plan


def test_quoted_line_break_fails_unless_asked_for(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "b.tsv"), 'id\tsentence1\tsentence2\tlabel\n1\ta\tb\t1\n2\t"two\nlines"\tplain\t0\n')
    with pytest.raises(Exception, match="multi_line"):
        io.read_pairs_tsv(spark, p, multi_line=False).collect()
    ok = _write(os.path.join(tmp_dir, "ok.tsv"), 'id\tsentence1\tsentence2\tlabel\n1\t"a ""b"" c"\tn/a\t1\n')
    for how in (False, True, "split"):
        assert [tuple(r) for r in io.read_pairs_tsv(spark, ok, multi_line=how).collect()] == [(1, 'a "b" c', None, 1)]


def test_nli_tsv_missing_words_are_null_and_drop(spark, tmp_dir):
    from textpairs.operators.clean import clean_nli

    head = "gold_label\tsentence1\tsentence2\tpairID"
    body = ["neutral\ta\tb\t1", "neutral\ta\t\t2", "neutral\tn/a\tb\t3", "neutral\ta\tNaN\t4", "neutral\ta\tnan b\t5"]
    p = _write(os.path.join(tmp_dir, "m.txt"), "\n".join([head, *body]) + "\n")
    rows = {r.pairID: r for r in io.read_nli_tsv(spark, p).collect()}
    assert len(rows) == 5 and rows["2"].sentence2 is None and rows["3"].sentence1 is None and rows["4"].sentence2 is None
    assert sorted(r.pairID for r in clean_nli(io.read_nli_tsv(spark, p)).collect()) == ["1", "5"]
    assert io.read_nli_tsv(spark, p, null_values=()).filter("pairID = '2'").collect()[0].sentence2 == ""


def test_nli_tsv_header_is_the_first_line(spark, tmp_dir):
    """A repeated column name, and a data row that equals the header."""
    head = "gold_label\tsentence1\tsentence1\tsentence2\tpairID"
    p = _write(os.path.join(tmp_dir, "h.txt"), f"{head}\nneutral\tx\ty\tz\t1\n{head}\n")
    rows = sorted(tuple(r) for r in io.read_nli_tsv(spark, p).collect())
    assert rows == [("gold_label", "sentence1", "sentence2", "pairID"), ("neutral", "x", "z", "1")]


def test_kept_ids_round_trip(spark, tmp_dir):
    kept = spark.createDataFrame([(5, 1), (1, 0), (300, 2)], "token_id int, new_id int")
    out = os.path.join(tmp_dir, "kept")
    io.write_kept_ids(kept, out)
    assert sorted(map(tuple, io.read_kept_ids(spark, out, position="new_id").collect())) == [(1, 0), (5, 1), (300, 2)]


def test_existing_inputs_takes_names_as_they_are(spark, tmp_dir):
    for name in ("a b,c.csv", "x{1}*.csv", "plain.csv"):
        _write(os.path.join(tmp_dir, name), "id\n1\n")
    found = io.existing_inputs(spark, tmp_dir, ["x{1}*.csv", "none.csv", "a b,c.csv"])
    assert [f.rsplit("/", 1)[-1] for f in found] == ["x{1}*.csv", "a b,c.csv"]
    assert io.existing_inputs(spark, os.path.join(tmp_dir, "missing"), ["a.csv"]) == []
    with pytest.raises(Exception):
        io.existing_inputs(spark, "nosuchfs://x/y", ["a.csv"])


def test_existing_inputs_and_scan_with_deny_list(spark, tmp_dir):
    for name in ("quora_train.csv", "quora_valid.csv", "train.csv"):
        _write(os.path.join(tmp_dir, name), "id,premise,hypothesis,label\nx,p,h,1\n")
    found = io.existing_inputs(spark, tmp_dir, ["quora_train.csv", "quora_valid.csv", "quora_test.csv"])
    assert [os.path.basename(f) for f in found] == ["quora_train.csv", "quora_valid.csv"]
    scanned = io.scan_corpus(spark, tmp_dir)
    assert sorted(r.file_name for r in scanned.collect()) == ["quora_train.csv", "quora_valid.csv"]


def test_predictions_and_subsets(spark, tmp_dir):
    pred = spark.createDataFrame([(1, 2)], "vec_id long, prediction int")
    out = os.path.join(tmp_dir, "pred")
    io.write_predictions(pred, out, id_col="vec_id")
    back = spark.read.option("header", True).csv(out).collect()
    assert (back[0].id, back[0].prediction) == ("1", "2")
    a = _write(os.path.join(tmp_dir, "a.csv"), "id,premise,hypothesis,label\nx,p,h,1\n")
    b = _write(os.path.join(tmp_dir, "b.csv"), "id,premise,hypothesis,label\ny,p,h,0\n")
    sub = io.load_subsets(spark, {"train": a, "test": b})
    assert sorted((r.id, r.split) for r in sub.collect()) == [("x", "train"), ("y", "test")]


def test_corpus_from_path(spark):
    df = spark.createDataFrame([("/data/paws_final/train.tsv",), ("x",)], "p string")
    parts = io.corpus_from_path("p")
    rows = df.select(*[v.alias(k) for k, v in parts.items()]).collect()
    assert (rows[0].folder, rows[0].stem, rows[0].corpus) == ("paws_final", "train", "paws")
    assert (rows[1].folder, rows[1].file_name) == ("", "x")


def test_indexed_lines_number_each_file_on_its_own(spark, tmp_dir):
    d = os.path.join(tmp_dir, "phr")
    os.makedirs(d)
    want = {}
    for f in range(3):
        lines = [f"file {f} line {i:04d}" for i in range(700 + 300 * f)]
        _write(os.path.join(d, f"phrases_{f}.txt"), "\n".join(lines) + "\n")
        want[f] = lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = io.read_indexed_lines(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in rows:
        f = int(r.file.rsplit("_", 1)[1].split(".")[0])
        got.setdefault(f, {})[r.phrase_index] = r.phrase
    for f, lines in want.items():
        assert [got[f][i] for i in range(len(lines))] == lines
