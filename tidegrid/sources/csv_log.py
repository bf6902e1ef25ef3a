"""Rows of CSV logs, numbered in file order, read in splits.

Spark cuts a file at line ends into blocks, each read by one task. Whether a block begins
inside a quoted field, and at which row, follows from the blocks before it:

1. A first pass tells of each block, for either state at its begin, the state at its end
   and the rows that start in it: one row a block.
2. The states and row numbers at all blocks' begins are running values over this table.
3. A second pass parses each block's rows and keeps the columns that are asked for. A row
   that goes on in further blocks comes in fragments, which are joined and parsed last.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored

#: A quoted field as a line's or field's begin opens it; group 1 is empty if it doesn't end in this line.
_OPENED = re.compile(r'(?:^|(?<=,))"(?:[^"]|"")*+("?)', re.S)
_GOES_ON = re.compile(r'(?:[^"]|"")*+("?)', re.S)
BLOCKS = "file string, block long, rows_out long, rows_in long, ends_out boolean, ends_in boolean, places array<int>"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, if it began so or not."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        m = _GOES_ON.match(line)
        if not m[1]:
            return True
        at = m.end()
    return any(not m[1] for m in _OPENED.finditer(line, at))


def blank(line: str) -> bool:
    return line in ("", "\r")


def parsed(rows: list[str]) -> Iterator[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return csv.reader(rows)


def _lines(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n", pathGlobFilter="*.csv", recursiveFileLookup=recursive)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One list a block: its key, and its lines as they come in batches."""
    key, held = None, []
    for pdf in batches:
        begins = ((pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())).to_numpy().nonzero()[0].tolist()
        for i, j in zip(begins, [*begins[1:], len(pdf)], strict=True):
            here = (pdf["file"].iloc[i], int(pdf["block"].iloc[i]))
            if here != key:
                if key is not None:
                    yield key, None
                key = here
            yield key, pdf.iloc[i:j]
    if key is not None:
        yield key, None


def _surveyed(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    states, counts, head, done, found = [False, True], [0, 0], [], False, []
    for (file, block), part in _blocks(batches):
        if part is None:
            places = _places(head, columns) if head else None
            found.append((file, block, *counts, *states, places))
            states, counts, head, done = [False, True], [0, 0], [], False
            if len(found) >= 1000:
                yield pd.DataFrame(found, columns=[c.split()[0] for c in BLOCKS.split(", ")])
                found = []
            continue
        for line in part["value"]:
            if block == 0 and not done and (head or not blank(line)):
                head.append(line)
            out, inn = states
            counts[0] += not out and not blank(line)
            counts[1] += not inn and not blank(line)
            states = [ends_inside(line, out)] * 2 if out == inn else [ends_inside(line, out), ends_inside(line, inn)]
            done = done or (bool(head) and not states[0])
    yield pd.DataFrame(found, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def _places(head: list[str], columns: list[str]) -> list[int]:
    """Where the header has each column, -1 where it hasn't; of a name that repeats the last place."""
    names = next(parsed(["\n".join(head).removeprefix("﻿")]))
    at = {n: i for i, n in enumerate(names)}
    return [at.get(c, -1) for c in columns]


def _resolved(blocks: DataFrame) -> DataFrame:
    """(file, block, inside, before, open, places): the state at each block's begin, the rows that start before it, whether it ends inside.

    A block sets the state, keeps it or turns it over: the state is the last one that was
    set, turned over as often as blocks after it did so.
    """
    over = Window.partitionBy("file").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.sum((F.col("ends_out") & ~F.col("ends_in")).cast("long"))
    rows = blocks.withColumns({"_turns": F.coalesce(turned.over(before), F.lit(0)), "_upto": turned.over(over)})
    rows = rows.withColumn("_set", F.when(F.col("ends_out") == F.col("ends_in"), (F.col("ends_out").cast("long") + F.col("_upto")) % 2))
    state = (F.coalesce(F.last("_set", ignorenulls=True).over(before), F.lit(0)) + F.col("_turns")) % 2 == 1
    rows = rows.withColumn("inside", state).withColumn("_rows", F.when(F.col("inside"), F.col("rows_in")).otherwise(F.col("rows_out")))
    return rows.select("file", "block", "inside", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("before"), F.when(F.col("inside"), F.col("ends_in")).otherwise(F.col("ends_out")).alias("open"), F.first("places", ignorenulls=True).over(Window.partitionBy("file").orderBy("block")).alias("places"))


def _cells(file: str, numbers: list[int], rows: list[str], places: list[int]) -> pd.DataFrame:
    cells = list(parsed(rows))
    out = {"_file": [file] * len(cells), "_number": numbers}
    out |= {f"_c{i}": [r[p] if 0 <= p < len(r) else None for r in cells] for i, p in enumerate(places)}
    return pd.DataFrame(out)


def _parsed_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that lie in one block."""
    number, inside, held = None, False, None
    for (file, block), part in _blocks(batches):
        if part is None:
            number, held = None, None  # a row that goes on in the next block comes in fragments
            continue
        if number is None:
            if pd.isna(part["before"].iloc[0]):
                raise RuntimeError(f"{file} was cut into other blocks in the second pass: set spark.sql.files.minPartitionNum")
            number, inside, places = int(part["before"].iloc[0]), bool(part["inside"].iloc[0]), part["places"].iloc[0]
        numbers, rows = [], []
        for line in part["value"]:
            if not inside:
                if blank(line):
                    continue
                number, held = number + 1, [line]
            elif held is not None:
                held.append(line)
            inside = ends_inside(line, inside)
            if not inside and held is not None:
                numbers.append(number)
                rows.append("\n".join(held))
                held = None
        if rows:
            yield _cells(file, numbers, rows, list(places))


FRAGMENTS = "file string, number long, block long, piece string, places array<int>"


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The begins, middles and ends of rows that lie in several blocks, and of one that its file's end cuts."""
    number, inside, first, held, found = None, False, False, [], []
    for (file, block), part in _blocks(batches):
        if part is None:
            if inside and held:
                found.append((file, number, block, "\n".join(held), places))
            if found:
                yield pd.DataFrame(found, columns=[c.split()[0] for c in FRAGMENTS.split(", ")])
            number, held, found = None, [], []
            continue
        if number is None:
            number, inside, places = int(part["before"].iloc[0]), bool(part["inside"].iloc[0]), list(part["places"].iloc[0])
            first = inside
        for line in part["value"]:
            if not inside:
                if blank(line):
                    continue
                number, held = number + 1, [line]
            else:
                held.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                if first:
                    found.append((file, number, block, "\n".join(held), places))
                first, held = False, []


def numbered_csv(spark: SparkSession, path: str, columns: list[str], recursive: bool = True, most_blocks: int = 100_000, names: tuple[str, str] = ("source_csv", "source_row_number")) -> DataFrame:
    """(source_csv, source_row_number, columns as strings) of all CSV files under ``path``; ``names`` for the first two, where a log has such columns itself.

    Each file's own header names its columns, however many; those it lacks, and cells that a
    short row lacks, are null. Cells are not trimmed. Rows are numbered from 2 in file order;
    a row ends at a line feed, with or without a carriage return, outside quotes; empty lines
    aren't rows and don't count. Quoted fields may hold commas, line breaks and doubled
    quotes; one that isn't closed goes on to the file's end, without its last line break. A header lies in its file's
    first block. Tables of up to ``most_blocks`` blocks are broadcast, larger ones joined.
    """
    if set(names) & set(columns):
        raise ValueError("a column is named as the file or the row number: give other names")
    kinds = ", ".join(["_file string", "_number long", *(f"`_c{i}` string" for i in range(len(columns)))])
    lines = _lines(spark, path, recursive)
    blocks = stored(_resolved(lines.mapInPandas(lambda b: _surveyed(b, columns), BLOCKS)), "blocks")
    n, split = blocks.agg(F.count("*"), F.coalesce(F.max((F.col("inside") | F.col("open")).cast("int")), F.lit(0))).first()
    if n <= most_blocks:
        rows = lines.join(F.broadcast(blocks), ["file", "block"], "left")
    else:
        rows = lines.withColumn("_at", F.monotonically_increasing_id()).join(blocks, ["file", "block"], "left")
        rows = rows.repartition("file", "block").sortWithinPartitions("file", "block", "_at").drop("_at")
    out = rows.mapInPandas(_parsed_blocks, kinds)
    if split:
        pieces = rows.mapInPandas(_fragments, FRAGMENTS).groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "\n").alias("row"), F.first("places").alias("places"))

        def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for file, number, row, places in zip(pdf["file"], pdf["number"], pdf["row"], pdf["places"], strict=True):
                    yield _cells(file, [number], [row], list(places))

        out = out.union(pieces.mapInPandas(join, kinds))
    return out.filter("_number > 1").toDF(*names, *columns)
