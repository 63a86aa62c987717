"""CSV files of any size and width, read in splits by many tasks.

Records may have any number of cells and line breaks inside quotes.  Spark's
text reader deals out the splits of a file and keeps each split's lines in
order; whether a line begins inside quotes depends on all lines before it.  So
a first pass finds, for each split and for both cases at its beginning, the
case at its end and how many records begin in it.  What follows from that for
each split, the case it begins with and its first record's number, is a running
sum over splits.  They are as many as the tasks of the scan, which the driver
plans anyway, so they are summed there and sent back.  In the second pass each
task parses its own records; the few that go over the end of a split are put
together from their parts.  A record's cells are one array, so width costs no
columns, and nothing is sorted or shuffled but those parts.

Quotes are relaxed: a quote inside a bare cell is a letter; a quoted cell with
text after its closing quote is kept as it is written; a quote that is never
closed is a letter, too, and its cell ends where the line's next comma is
(what follows it to the end of the file is then read by one task).

Lines end in LF, CR LF or CR.  A byte order mark at the beginning of a file is
dropped.  Empty cells are null, ``""`` is the empty text, empty cells at the
end of a record are left out, and records of empty cells alone are no rows and
aren't counted.  Text is UTF-8.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CELL = re.compile(r'"((?:[^"]++|"")*+)"(?=[,\r\n]|\Z)|("(?:[^"]++|"")*+"[^,\r\n]*+|[^,\r\n]*+)')
#: Rows and bytes of one Arrow batch of results.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
RECORDS = "file string, chain long, block long, row_index int, cells array<string>, part string"


def parse(text: str) -> list[list[str | None]]:
    """The records of a text that begins with one; empty records are empty lists."""
    out: list[list[str | None]] = []
    cells: list[str | None] = []
    at, n = 0, len(text)
    while True:
        m = _CELL.match(text, at)
        quoted, bare = m.groups()
        cells.append(quoted.replace('""', '"') if quoted is not None else bare or None)
        at = m.end()
        if at < n and text[at] == ",":
            at += 1
            continue
        while cells and cells[-1] is None:
            cells.pop()
        out.append(cells)
        if at >= n:
            return out
        at += 2 if text.startswith("\r\n", at) else 1
        if at >= n:
            return out
        cells = []


def inside_after(line: str, inside: bool) -> bool:
    """Whether the end of a line is inside quotes, if its beginning is or isn't."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False  # closed, or text follows and the cell goes on without quotes
            at = line.find(",", at)
            if at < 0:
                return False
            at += 1
        if line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(',"', at)
        if at < 0:
            return False
        inside, at = True, at + 2


def _lines(line: str) -> list[tuple[str, str]]:
    """What the text reader takes as one line, cut at carriage returns: (text, what ends it)."""
    if "\r" not in line:
        return [(line, "\n")]
    parts = line.split("\r")
    last = parts.pop()
    return [(p, "\r") for p in parts[:-1]] + ([(parts[-1], "\r\n")] if not last else [(parts[-1], "\r"), (last, "\n")])


def _splits(batches):
    """((file, block), lines) of each split in turn, a batch's share at a time, and whether it is the split's first."""
    held = None
    for batch in batches:
        files, blocks, lines = (batch.column(i) for i in range(3))
        keys = list(zip(files.to_pylist(), blocks.to_pylist()))
        lines = lines.to_pylist()
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            first = held != keys[at]
            held = keys[at]
            part = [x for line in lines[at:end] for x in _lines(line)]
            if first and held[1] == 0 and part[0][0].startswith("﻿"):
                part[0] = (part[0][0][1:], part[0][1])
            yield held, part, first
            at = end


def _survey(batches):
    """For each split and both cases at its beginning: the case at its end, and how many records begin in it."""
    names = ["file", "block", "out_ends", "in_ends", "out_records", "in_records"]
    seen: dict[tuple[str, int], list] = {}
    for key, lines, _ in _splits(batches):
        own = seen.setdefault(key, [False, True, 0, 0])
        for line, _ in lines:
            plain, filled = '"' not in line, bool(line.strip(","))
            for case in (0, 1):
                own[2 + case] += filled and not own[case]
                if not plain:
                    own[case] = inside_after(line, own[case])
    rows = [(*k, *v) for k, v in seen.items()]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)


class _Rows:
    """Results on their way into Arrow batches."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, row: tuple, size: int):
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS or self.size >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], kinds[i]) for i in range(6)], ["file", "chain", "block", "row_index", "cells", "part"])
        self.rows, self.size = [], 0
        return out


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of CSV files: (file, sheet, row_index, cells); row numbers count a file's rows from 1."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    found = lines.mapInArrow(_survey, "file string, block long, out_ends boolean, in_ends boolean, out_records long, in_records long").toArrow().to_pylist()
    begins: dict[tuple[str, int], tuple[bool, int, int]] = {}  # inside quotes?, records before, split of the record that is open
    torn: set[str] = set()
    file, inside, count, chain = None, False, 0, 0
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside, count, chain = r["file"], False, 0, 0
        begins[file, r["block"]] = (inside, count, chain)
        if inside:
            torn.add(file)
        ends, n = (r["in_ends"], r["in_records"]) if inside else (r["out_ends"], r["out_records"])
        if ends and (n or not inside):
            chain = r["block"]
        inside, count = ends, count + n
        if inside:
            torn.add(file)
    sent = spark.sparkContext.broadcast(begins)

    def read(parts: bool):
        def run(batches):
            out = _Rows()
            inside, number, chain, open_ = False, 0, 0, []

            def shut():
                """What is open at the end of a split, or goes on from the one before, is a part."""
                if open_ and parts:
                    out.add((key[0], chain, key[1], number, None, "".join(open_)), sum(map(len, open_)))
                open_.clear()

            key = None
            for nxt, share, first in _splits(batches):
                if first:
                    if key is not None:
                        shut()
                    key = nxt
                    inside, number, chain = sent.value[key]
                    carried = inside  # the first lines belong to a record of an earlier split
                for line, end in share:
                    if not inside:
                        if '"' not in line:
                            if line.strip(","):
                                number += 1
                                if not parts:
                                    cells = [c or None for c in line.split(",")]
                                    while cells[-1] is None:
                                        cells.pop()
                                    out.add((key[0], None, key[1], number, cells, None), len(line))
                            if out.full():
                                yield out.batch()
                            continue
                        number, chain, carried = number + 1, key[1], False
                    open_.append(line + end)
                    if '"' in line:
                        inside = inside_after(line, inside)
                    if not inside:
                        text = "".join(open_)
                        if carried:
                            shut()
                            carried = False
                        elif not parts:
                            out.add((key[0], None, key[1], number, parse(text.rstrip("\r\n"))[0], None), len(text))
                        open_.clear()
                    if out.full():
                        yield out.batch()
            if key is not None:
                shut()
            yield out.batch()

        return run

    whole = lines.mapInArrow(read(False), RECORDS).select("file", F.lit("CSV").alias("sheet"), "row_index", "cells")
    if not torn:
        return whole

    def join(batches):
        for batch in batches:
            out = _Rows()
            for file, number, pieces in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for cells in parse("".join(p["part"] for p in pieces)):
                    if cells:
                        out.add((file, None, None, number, cells, None), 0)
                        number += 1
            yield out.batch()

    # A condition on files alone would leave files out of the scan, which would then be split at other places.
    pieces = lines.filter(F.col("file").isin(sorted(torn)) | (F.length("value") < 0)).mapInArrow(read(True), RECORDS)
    chains = pieces.groupBy("file", "chain").agg(F.min("row_index").alias("row_index"), F.array_sort(F.collect_list(F.struct("block", "part"))).alias("pieces"))
    joined = chains.select("file", "row_index", "pieces").mapInArrow(join, RECORDS).select("file", F.lit("CSV").alias("sheet"), "row_index", "cells")
    return whole.unionByName(joined)
