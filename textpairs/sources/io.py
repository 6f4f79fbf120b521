"""Sources and sinks.

Readers take explicit schemas (no inference).  Files split across tasks, quoted
fields with line breaks included (``quoted.py``); lists of ids are JSON arrays
that are written and read in parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpairs.functions.text import path_parts
from textpairs.operators.rank import dense_ids
from textpairs.sources.quoted import file_name, parse_records, read_records

# Schemas of the reference's corpus files.
QUORA_SCHEMA = "id long, qid1 long, qid2 long, question1 string, question2 string, is_duplicate int"
PAWS_SCHEMA = "id long, sentence1 string, sentence2 string, label int"
PAWS_INDEX_SCHEMA = "id string, qid1 long, sentence1 string, qid2 long, sentence2 string, label string"
GROUPS_SCHEMA = "paraphrase_group_index long, phrase_index long"
NLI_EXAMPLE_SCHEMA = "id string, premise string, hypothesis string, label int"
NLI_UNLABELLED_SCHEMA = "id string, premise string, hypothesis string"
PAIRS_SCHEMA = "sentence1 string, sentence2 string"
NLI_COLUMNS = ("gold_label", "sentence1", "sentence2", "pairID")
#: The words that the pandas reader takes for a missing value.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
            "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DENY_FILES = ("train.csv", "sample_submission.csv")


def missing_to_null(df: DataFrame, null_values: Sequence[str] = NA_WORDS) -> DataFrame:
    """String fields that hold a word for "missing" become null."""
    return df.select(*[F.when(~F.col(f"`{f.name}`").isin(*null_values), F.col(f"`{f.name}`")).alias(f.name)
                       if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields])


_BROKEN = "_tp_broken"
SPLIT = "split"


def _csv(spark: SparkSession, path, sep: str, multi_line: bool | str, null_values: Sequence[str], schema: str | None,
         glob: str | None = None, deny: Sequence[str] = (), with_name: bool = False) -> DataFrame:
    """Quoted, delimited files with a header; fields by position under ``schema`` (else strings by the header's names).

    ``multi_line``: ``"split"`` reads quoted fields with line breaks over many
    tasks; ``True`` does so with one task a file; ``False`` takes each line for a
    record (one scan), and a line that ends inside a quoted field then fails
    the job instead of making two wrong rows.
    """
    r = (spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
         .option("multiLine", bool(multi_line)))
    if glob:
        r = r.option("pathGlobFilter", glob)
    if not schema:
        schema = ", ".join(f"`{c}` string" for c in r.csv(path).columns)
    if multi_line == SPLIT:
        records = read_records(spark, path, sep, glob, deny).filter(~F.col("first"))
        records = records.select("record", *([file_name(F.col("file")).alias("file_name")] if with_name else []))
        return missing_to_null(parse_records(records, schema, sep), null_values)
    broken = F.col(_BROKEN)
    if multi_line:
        df = r.schema(schema).csv(path)
    else:
        df = r.schema(f"{schema}, {_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN).csv(path)
    own = file_name(F.col("_metadata.file_path"))
    if deny:
        df = df.filter(~own.isin(*deny))
    if with_name:
        df = df.withColumn("file_name", own)
    if not multi_line:
        quotes = F.length(broken) - F.length(F.replace(broken, F.lit('"'), F.lit("")))
        fine = F.when(quotes % 2 == 1, F.raise_error(F.lit("a quoted field holds a line break: set multi_line"))
                      .cast("boolean")).otherwise(F.lit(True))
        df = df.filter(fine).drop(_BROKEN)
    return missing_to_null(df, null_values)


def read_pairs_tsv(spark: SparkSession, path, schema: str = PAWS_SCHEMA, multi_line: bool | str = SPLIT,
                   null_values: Sequence[str] = NA_WORDS) -> DataFrame:
    """Tab-separated, header, standard double-quote quoting."""
    return _csv(spark, path, "\t", multi_line, null_values, schema)


def read_nli_tsv(spark: SparkSession, path, on_bad: str = "drop",
                 columns: Sequence[str] = NLI_COLUMNS, null_values: Sequence[str] = NA_WORDS) -> DataFrame:
    """Tab-separated with quoting off.

    A line is a record; fields are split on tabs.  Rows with more fields than
    the header are dropped (``on_bad='drop'``) or fail the job (``'fail'``);
    shorter rows are kept and null-padded, and fields that hold one of
    ``null_values`` are null -- the pandas behaviour.  Only ``columns`` are
    returned (all strings); of repeated names in the header the first counts.
    The header is the first line of each file, whatever it says.
    """
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"no header in {path}")
    header = first["value"].split("\t")
    # one column of whole lines; the reader skips each file's first line by its place
    lines = (spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "")
             .option("nullValue", "\x01").csv(path))
    rows = lines.select(F.split(F.col("value"), "\t", -1).alias("_f"))
    too_long = F.size("_f") > len(header)
    if on_bad == "drop":
        rows = rows.filter(~too_long)
    elif on_bad == "fail":
        rows = rows.withColumn("_f", F.when(too_long, F.raise_error(F.lit("over-long row"))).otherwise(F.col("_f")))
    else:
        raise ValueError(on_bad)
    out = rows.select(*[F.get("_f", header.index(c)).alias(c) if c in header else F.lit(None).cast("string").alias(c)
                        for c in columns])
    return missing_to_null(out, null_values)


def read_examples_csv(spark: SparkSession, path, schema: str | None = NLI_EXAMPLE_SCHEMA, multi_line: bool | str = SPLIT,
                      null_values: Sequence[str] = NA_WORDS) -> DataFrame:
    """S3: comma CSV with header (pandas dialect: double quotes, missing words null)."""
    return _csv(spark, path, ",", multi_line, null_values, schema)


def _numbered(raw: DataFrame, index: str, across: bool = False) -> DataFrame:
    """``raw`` (a file scan with its ``_metadata``) with each row's 0-based number in its file
    (``across``: in all files, one after the other by name).

    Rows of one file block arrive in file order.  A first scan counts the rows
    of each block (one row per block); the second adds the rows of the file's
    earlier blocks to the place in the own block.  Nothing is written or
    shuffled but the block counts.  Both scans must cut and pack the files
    alike (see ``quoted.read_records``); a row out of its block's range fails the job.
    """
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_tp_blk"))
    raw = raw.withColumn("_tp_mid", F.monotonically_increasing_id())
    per_block = raw.groupBy("file", "_tp_blk").agg(F.count(F.lit(1)).alias("_tp_n"), F.min("_tp_mid").alias("_tp_m0"))
    # over one row per file block
    before = Window.orderBy("file", "_tp_blk") if across else Window.partitionBy("file").orderBy("_tp_blk")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(F.col("file").alias("_tp_file"), F.col("_tp_blk").alias("_tp_oblk"), "_tp_n", "_tp_m0",
                               F.coalesce(F.sum("_tp_n").over(before), F.lit(0)).alias("_tp_off"))
    j = raw.join(offsets, (F.col("file") == F.col("_tp_file")) & (F.col("_tp_blk") == F.col("_tp_oblk")), "left")
    at = F.col("_tp_mid") - F.col("_tp_m0")
    lost = F.raise_error(F.lit("files were cut into other blocks by the second scan")).cast("long")
    number = F.when((at >= 0) & (at < F.col("_tp_n")), F.col("_tp_off") + at).otherwise(lost)
    return j.withColumn(index, number).drop("_tp_blk", "_tp_mid", "_tp_file", "_tp_oblk", "_tp_n", "_tp_m0", "_tp_off")


def read_indexed_lines(spark: SparkSession, path, index: str = "phrase_index", text: str = "phrase") -> DataFrame:
    """A text file whose 0-based line number is the key.

    Multiple files are numbered independently (``file`` column).
    """
    return _numbered(spark.read.text(path), index).select("file", index, F.col("value").alias(text))


def lines_of_column(df: DataFrame, text: str, keep: Sequence[str] = (), index: str = "line_no",
                    line: str = "line") -> DataFrame:
    """S4 over a text column: every line with its 0-based number."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias(index, line))


def write_splits(df: DataFrame, directory: str, split: str = "split", fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """One folder per split (``split=train/``…), Parquet or CSV with header, no index."""
    w = df.write.mode(mode).partitionBy(split)
    if fmt == "parquet":
        w.parquet(directory)
    elif fmt == "csv":
        w.option("header", True).option("escape", '"').csv(directory)
    else:
        raise ValueError(fmt)


def assert_plain_fields(df: DataFrame) -> DataFrame:
    """Fail the job if a string field holds a tab or a newline (unquoted TSV would corrupt)."""
    # the check wraps each string column, so it cannot be pruned away
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string":
            c = F.when(c.rlike("[\t\n\r]"), F.raise_error(F.lit(f"tab or newline in column {f.name}"))) \
                 .otherwise(c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def write_plain_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Unquoted TSV with a header row (checked first)."""
    (assert_plain_fields(df).write.mode(mode).option("sep", "\t").option("header", True)
     .option("quote", "").option("escapeQuotes", False).csv(path))


def save_tokens(df: DataFrame, directory: str, mode: str = "overwrite") -> None:
    """S7 (write): tokenised corpus as Parquet partitioned by (corpus, split)."""
    df.write.mode(mode).partitionBy("corpus", "split").parquet(directory)


def load_tokens(spark: SparkSession, directory: str, corpus: str | None = None,
                split: str | None = None) -> DataFrame:
    """S7 (read): partition pruning on corpus / split."""
    df = spark.read.parquet(directory)
    if corpus is not None:
        df = df.filter(F.col("corpus") == corpus)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df


#: Ids on one line of a list file.
IDS_A_LINE = 1000


def write_kept_ids(kept: DataFrame, path: str, name: str = "token_id") -> None:
    """S8 (write): ids as one JSON array in ascending order, over as many part files as there are tasks.

    The parts, one after the other by name, are the array; white space between
    its entries parts the lines.  A line holds up to ``IDS_A_LINE`` ids, and no
    task more than its range of them.  Repeated ids are written once.
    """
    ranked = dense_ids(kept.select(name).distinct(), name, name="_tp_at")
    chunk = F.floor(F.col("_tp_at") / IDS_A_LINE).cast("long").alias("_tp_chunk")
    lines = ranked.groupBy(chunk).agg(F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("_tp_line"))
    last = ranked.agg(F.max(F.floor(F.col("_tp_at") / IDS_A_LINE).cast("long"))).scalar()
    value = F.concat(F.when(F.col("_tp_chunk") == 0, "[").otherwise(""), F.col("_tp_line"),
                     F.when(F.col("_tp_chunk") == last, "]").otherwise(","))
    lines = lines.withColumn("value", value).repartitionByRange("_tp_chunk").sortWithinPartitions("_tp_chunk")
    if kept.isEmpty():
        lines = kept.sparkSession.range(1).select(F.lit("[]").alias("value"))
    lines.select("value").write.mode("overwrite").text(path)


def read_kept_ids(spark: SparkSession, path: str, name: str = "token_id", position: str | None = None) -> DataFrame:
    """S8 (read): the entries of a JSON array of whole numbers, one row each.

    The file may be one line of any length, as other writers leave it: it is cut
    at commas and at byte ranges, so no task holds the array or a line of it.
    ``position`` adds the 0-based place of an entry in the array, which may lie
    in several files (in order of their names).  Entries that
    are no whole numbers fail the job.
    """
    entry = F.regexp_replace("value", r"^\s*\[?\s*|\s*\]?\s*$", "")
    raw = spark.read.option("lineSep", ",").text(path).filter(entry != "")
    if position:
        raw = _numbered(raw, position, across=True)
    df = raw.select(entry.alias("_tp_e"), *([position] if position else []))
    number = F.when(F.col("_tp_e").rlike("^-?[0-9]+$"), F.col("_tp_e").cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("not a list of whole numbers: "), F.left("_tp_e", F.lit(40)))).cast("int"))
    return df.select(number.alias(name), *([position] if position else []))


def existing_inputs(spark: SparkSession, directory: str, names: Sequence[str]) -> list[str]:
    """The files of ``names`` that exist in ``directory``, in list order.

    Each name is looked up in the directory's own file system, so any
    character is taken as it is; errors of the store rise.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for name in names:
        at = path(path(directory), name)
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            found.append(fs.makeQualified(at).toString())
    return found


def scan_corpus(spark: SparkSession, directory: str, deny: Sequence[str] = DENY_FILES,
                schema: str | None = NLI_EXAMPLE_SCHEMA, multi_line: bool | str = SPLIT,
                null_values: Sequence[str] = NA_WORDS) -> DataFrame:
    """Every ``*.csv`` in a directory except a deny-list, with the file name (the dialect is that of S3)."""
    return _csv(spark, directory, ",", multi_line, null_values, schema, "*.csv", deny, with_name=True)


def write_predictions(df: DataFrame, path: str, id_col: str = "id", pred: str = "prediction") -> None:
    """``id, prediction`` CSV with a header."""
    (df.select(F.col(id_col).cast("string").alias("id"), F.col(pred).cast("int").alias("prediction"))
     .write.mode("overwrite").option("header", True).csv(path))


def load_subsets(spark: SparkSession, paths: Mapping[str, str], reader=None, split: str = "split") -> DataFrame:
    """Several subsets (train/validation/test) as one table with a split column."""
    reader = reader or (lambda p: read_examples_csv(spark, p))
    out = None
    for name, p in paths.items():
        part = reader(p).withColumn(split, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def corpus_from_path(col: Column | str = "_metadata.file_path") -> dict[str, Column]:
    """Folder, file name, stem and corpus (folder text before ``_``) of a path."""
    c = F.col(col) if isinstance(col, str) else col
    return path_parts(c)
