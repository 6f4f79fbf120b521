"""The pipeline: planted cases through every stage, and each stage on its own input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_MID
from tests.llm.helpers import documents, odd_rows, prose
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_substring import brute
from textpairs.llm.quality import quality_scores
from textpairs.llm.simhash import keep_one


def test_stages_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_MID).cache()
        seen[name] = (docs, out)
        if name != "mix":
            assert out.dtypes == docs.dtypes
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring", "decontaminate", "mix"]

    before, after = seen["quality"]
    marks = spark.read.parquet(f"{SF_MID}/labels.parquet")
    good = quality_scores(before, marks).filter("predicted = 1").select("doc_id")
    assert {r[0] for r in good.collect()} == {r["doc_id"] for r in after.collect()}

    before, after = seen["near_dedup"]
    fps = [(r["doc_id"], brute_fp(r["text"])) for r in before.collect()]
    groups = brute_components(fps)
    assert {r["doc_id"] for r in after.collect()} == set(groups.values())

    before, after = seen["substring"]
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    want = dict(zip(rows, brute(rows.values())))
    assert {r["doc_id"]: r["text"].split() for r in after.collect()} == {k: " ".join(v).split() for k, v in want.items()}
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0

    before, after = seen["decontaminate"]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        if any(i in " ".join(r["text"].split()) for i in items):
            assert r["doc_id"] not in left
    assert len(left) > 0.9 * before.count()

    before, after = seen["mix"]
    assert after.columns == [*before.columns, "copy_no"]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} <= left
    assert after.agg(F.max("copy_no")).first()[0] <= 2


def test_run_equals_the_stages_in_a_row(spark):
    rows = corpus_pipeline.run(spark, SF_MID).select("doc_id", "copy_no", "text").collect()
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_MID)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, docs.select("doc_id", "copy_no", "text").collect()))


def test_near_dedup_leaves_one_row_of_each_group(spark):
    a, b, c, d = (prose(k, 80) for k in (1, 2, 3, 4))
    rows = [(1, a), (5, a), (5, b), (5, b), (1, a), (None, a), (None, c), (None, c), (None, d), (7, d), (9, c + " w9")]
    docs = documents(spark, [(i, t, "en", f"s{k}") for k, (i, t) in enumerate(rows)], extra=True).repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.dtypes == docs.dtypes
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert set(brute_components([(i, brute_fp(t)) for i, t in rows]).values()) == {1, 5, 7, 9}
    # the text b of id 5 is alone in its group, and c has a near copy under an id
    assert sorted(left) == sorted([(1, a), (5, b), (7, d), (9, c + " w9")])
    # repeated rows of the kept id stay where they are asked for
    left = sorted((r["doc_id"], r["text"]) for r in keep_one(docs).collect())
    assert left == sorted([(1, a), (1, a), (5, b), (5, b), (7, d), (9, c + " w9")])
    none = documents(spark, [(None, a, "en", "s"), (None, a, "de", "t"), (None, b, "en", "s")])
    assert sorted(r["text"] for r in keep_one(none).collect()) == sorted([a, b])


def write(spark, folder, docs, marks, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randrange(90, 160)), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, " ".join(f"{w.upper()}!!" for w in prose(i, 80).split()), "en", "s0") for i in range(60)]
    rows += [(300, rows[3][1], "en", "s1"), (301, rows[4][1] + " tail", "en", "s2")]  # exact and near copy
    passage = prose(900, 55)
    rows += [(310 + i, f"{prose(950 + i, 70)} {passage} {prose(980 + i, 70)}", "en", "s1") for i in range(3)]
    item = prose(4000, 30)
    rows += [(320, f"{prose(961, 60)} {item} {prose(962, 60)}", "en", "s2")]
    marks = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(60)]
    folder = str(tmp_path)
    write(spark, folder, documents(spark, rows), marks, [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert not ids & set(range(200, 260)) and set(range(120)) <= ids
        if name == "near_dedup":
            assert 300 not in ids and 3 in ids
        if name == "substring":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(passage not in texts[310 + i] and prose(950 + i, 70) in texts[310 + i] for i in range(3))
    assert 320 not in ids and set(range(3)) <= ids


def test_odd_rows_pass_through(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, documents(spark, odd_rows()), [(5, 1, 0)], [(1, None)])
    assert corpus_pipeline.run(spark, folder).columns[-1] == "copy_no"
    empty = str(tmp_path / "empty")
    write(spark, empty, documents(spark, []), [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_columns_of_any_name_are_kept(spark):
    """Names that the operators use for themselves come through unchanged."""
    from textpairs.llm.mix_weights import mix_documents
    from textpairs.llm.simhash import keep_one
    from textpairs.llm.substring import remove_repeats

    docs = documents(spark, odd_rows())
    names = ["__row", "__ROW_", "__drop", "__chunk", "__order", "__n", "__mix", "__of", "least", "of"]
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for out in (keep_one(docs), keep_one(docs, repeats=False), remove_repeats(docs), mix_documents(docs)):
        rows = out.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(f"own {n}" for n in names)]
