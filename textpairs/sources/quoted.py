"""Quoted, delimited files whose fields hold line breaks, read over many tasks.

Whether a line break ends a record depends on all quotes before it, so a task
that starts in the middle of a file cannot tell by itself.  The state between
two lines is one bit (outside or inside a quoted field), and what a stretch of
lines does to it is a function of that bit.  Such functions compose, so:

1. every file block computes its function for both possible starts (one row
   per block);
2. a prefix scan over the blocks of a file gives each block its true start:
   the last block before it that ends alike from both starts, and the parity
   of the blocks after that which swap the two;
3. every block is read again with its start known.  Records that lie whole in a
   block come out where they are; the pieces of records that cross a block
   border (at most two a block) are put together by the block they began in.

Nothing but those pieces is shuffled, and no task holds more than a block and
its open record.  Two scans of the files, and a third of the blocks that a
record crosses.

A quote opens a field only at its start; elsewhere in an unquoted field it is
text, and after a closing quote text runs on to the next separator.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpairs.session import materialise

#: Block tables of up to this many rows (of a path and a few numbers) are broadcast.
MAX_BROADCAST_BLOCKS = 500_000

#: Lines that a worker holds as Python strings at once, and characters of records that it gathers.
RUN_LINES, FOUND_CHARS = 256, 1 << 20

_OUTSIDE, _INSIDE, _CLOSING = 0, 1, 2


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether the end of a line lies inside a quoted field, by whether its start does."""
    if '"' not in line:
        return inside
    *parts, last = line.split('"')
    state = _INSIDE if inside else _OUTSIDE
    for i, text in enumerate(parts):  # each is followed by a quote
        if state == _INSIDE:
            state = _CLOSING
        elif text.endswith(sep) or not text and (state == _CLOSING or i == 0):
            state = _INSIDE  # at the start of a field, or the second of a doubled quote
        else:
            state = _OUTSIDE
    return state == _INSIDE


def file_name(path: Column) -> Column:
    """The name of a file as it is, from its path as Spark gives it (percent-encoded)."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def _lines(spark: SparkSession, path, glob: str | None = None, deny: Sequence[str] = ()) -> DataFrame:
    """``(file, blk, line)`` in file order inside a task; only line feeds part lines."""
    r = spark.read.option("lineSep", "\n")
    df = (r.option("pathGlobFilter", glob) if glob else r).text(path)
    if deny:
        df = df.filter(~file_name(F.col("_metadata.file_path")).isin(*deny))
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
                     F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list, list]]:
    """``(file, blk, further columns' first values, lines)`` of consecutive rows of one block."""
    for b in batches:
        files, blks = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        for k in range(1, b.num_rows + 1):
            if k == b.num_rows or (files[k], blks[k]) != (files[at], blks[at]):
                rest = [b.column(c)[at].as_py() for c in range(3, b.num_columns)]
                for part in range(at, k, RUN_LINES):
                    yield files[at], blks[at], rest, b.column(2).slice(part, min(RUN_LINES, k - part)).to_pylist()
                at = k


def block_functions(lines: DataFrame, sep: str) -> DataFrame:
    """``(file, blk, end0, end1, begins1)`` per block.

    ``end0`` and ``end1`` tell whether the block ends inside a field if it starts
    outside or inside; ``begins1`` whether a record begins in it if it starts inside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for file, blk, _, text in _runs(batches):
            if not out or out[-1][:2] != [file, blk]:
                if len(out) > 1000:
                    yield _rows(out)
                    out = []
                out.append([file, blk, False, True, False])
            row = out[-1]
            end0, end1, begins1 = row[2:]
            for line in text:
                begins1 = begins1 or not end1
                if '"' in line:
                    end0, end1 = ends_inside(line, sep, end0), ends_inside(line, sep, end1)
            row[2:] = end0, end1, begins1
        if out:
            yield _rows(out)

    def _rows(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), *[pa.bool_()] * 3)
        names = ["file", "blk", "end0", "end1", "begins1"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return lines.mapInArrow(run, "file string, blk long, end0 boolean, end1 boolean, begins1 boolean")


def block_starts(functions: DataFrame) -> DataFrame:
    """``(file, blk, inside, opener, crosses)``: each block's true start by a prefix scan over its file.

    ``opener`` is the block where the record that is open at the start began;
    ``crosses`` tells whether a record crosses a border of the block.
    """
    whole = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("end0") & ~F.col("end1")
    df = functions.withColumn("swaps", F.sum(swaps.cast("long")).over(whole))
    fixed = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").cast("long").alias("to"), "swaps"))
    df = df.withColumn("last", F.last(fixed, ignorenulls=True).over(before))
    so_far = F.col("swaps") - swaps.cast("long")
    bit = F.coalesce(F.col("last.to"), F.lit(0)) + so_far - F.coalesce(F.col("last.swaps"), F.lit(0))
    df = df.withColumn("inside", bit % 2 == 1)
    begins = F.when(~F.col("inside") | F.col("begins1"), F.col("blk"))
    df = df.withColumn("opener", F.last(begins, ignorenulls=True).over(before))
    end = F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0"))
    return df.select("file", "blk", "inside", "opener", (F.col("inside") | end).alias("crosses"))


def _cut(known: DataFrame, sep: str, whole: bool) -> DataFrame:
    """``(file, owner, blk, first, record)``: records that lie whole in a block, or the pieces of those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_, found, chars = None, [], [], 0

        def piece(owner: int) -> None:
            nonlocal chars
            found.append((here[0], owner, here[1], here[1] == 0 and not begun, "\n".join(open_)))
            chars += len(found[-1][-1])

        for file, blk, (inside, opener), text in _runs(batches):
            if here != (file, blk):
                if here and open_ and not whole:  # the block before ended in a field
                    piece(owner)
                here, open_, begun = (file, blk), [], False
                state, owner = inside, opener if inside else blk
                headless = inside
            for line in text:
                state = ends_inside(line, sep, state)
                open_.append(line)
                if state:
                    continue
                if headless == (not whole):
                    piece(owner)
                begun, open_, headless, owner = True, [], False, blk
                if len(found) >= 1000 or chars >= FOUND_CHARS:
                    yield _records(found)
                    found, chars = [], 0
        if here and open_ and not whole:
            piece(owner)
        yield _records(found)

    def _records(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        columns = zip(*rows) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          names=["file", "owner", "blk", "first", "record"])

    return known.mapInArrow(run, "file string, owner long, blk long, first boolean, record string")


def read_records(spark: SparkSession, path, sep: str, glob: str | None = None, deny: Sequence[str] = ()) -> DataFrame:
    """``(file, first, record)``: every record as one string, line breaks in quoted fields kept.

    ``first`` marks the first record of each file.  Empty lines outside a
    quoted field are no records.  ``glob`` and ``deny`` choose files of a folder
    by name.

    The files must be cut into the same blocks by all scans, which holds while
    ``spark.sql.files.*`` stay as they are (for inputs smaller than the block
    size times the cores, the number of cores too); a block that the first scan
    did not have fails the job.
    """
    lines = _lines(spark, path, glob, deny)
    starts = materialise(block_starts(block_functions(lines, sep)))
    few = starts.count() <= MAX_BROADCAST_BLOCKS

    def known(blocks: DataFrame, how: str) -> DataFrame:
        at = blocks.select(F.col("file").alias("_tp_f"), F.col("blk").alias("_tp_b"), "inside", "opener")
        same = (F.col("file") == F.col("_tp_f")) & (F.col("blk") == F.col("_tp_b"))
        if few:  # the lines stay where they are, in order
            df = lines.join(F.broadcast(at), same, how)
        else:
            df = lines.withColumn("_tp_mid", F.monotonically_increasing_id()).join(at, same, how)
            df = df.repartition("file", "blk").sortWithinPartitions("file", "blk", "_tp_mid")
        lost = F.raise_error(F.lit("files were cut into other blocks by the second scan")).cast("boolean")
        return df.select("file", "blk", "line", F.when(F.col("inside").isNull(), lost).otherwise(F.col("inside"))
                         .alias("inside"), "opener")

    whole = _cut(known(starts, "left"), sep, True).select("file", "first", "record")
    pieces = _cut(known(starts.filter("crosses"), "inner"), sep, False)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("blk", "record"))), lambda p: p["record"]), "\n")
    joined = pieces.groupBy("file", "owner").agg(F.bool_or("first").alias("first"), text.alias("record"))
    every = whole.unionByName(joined.select("file", "first", "record"))
    return every.filter(~F.col("record").isin("", "\r"))


def parse_records(records: DataFrame, schema: str, sep: str) -> DataFrame:
    """Fields of ``records(record, ...)`` by position; further columns of the input are kept."""
    rest = [c for c in records.columns if c != "record"]
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    own = F.from_csv(_without_return(F.col("record")), schema, options).alias("_tp_r")
    return records.select(own, *rest).select("_tp_r.*", *rest)


def _without_return(record: Column) -> Column:
    """Records of files with carriage returns before their line feeds."""
    return F.when(record.endswith("\r"), F.left(record, F.length(record) - 1)).otherwise(record)
