"""Netlists of any size, read line by line from splits of files, with the gates that the whole text would give.

A file is not one row here: Spark reads it in splits, and a split's lines pass through a task in order. Two things go from
split to split: whether a block comment is open, and how many gates came before. A first pass finds how every split ends, for
either way it may begin; these rows, one for each split, are chained per file; two more passes count and number the gates,
each split knowing how it begins. The rows of splits, some 800,000 for 100 TB, are broadcast; lines are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelore.sources.netlists import GATE_LINE
from gatelore.sources.staging import staged

SPLITS = pa.schema([("file", pa.string()), ("split", pa.int64()), ("from_closed", pa.bool_()), ("from_open", pa.bool_()), ("last_close", pa.int64()), ("pending_closed", pa.string()), ("pending_open", pa.string()), ("carried", pa.bool_())])
SPLITS_SQL = "file string, split long, from_closed boolean, from_open boolean, last_close long, pending_closed string, pending_open string, carried boolean"
STARTS = pa.schema([("file", pa.string()), ("split", pa.int64()), ("begins_open", pa.bool_()), ("closed_later", pa.bool_()), ("last_close", pa.int64()), ("pending", pa.string())])
STARTS_SQL = "file string, split long, begins_open boolean, closed_later boolean, last_close long, pending string"
GATES_SQL = "design_id string, gid long, gate_name string, gtype string, args string"
IS_GATE, HEAD = re.compile(GATE_LINE, re.A), re.compile(r"^(\w+)\s+(\w+)\s*\((.*)\)\s*;", re.A)


class Scanner:
    """The lines of one split in turn, without comments.

    ``open`` tells whether a block comment goes on. A comment over several lines makes one line of what stands before and
    behind it, so the text before it is held (``pending``) until it closes. An opening sign counts only if a closing one
    follows somewhere: ``closed_later`` says so for what follows the split, ``last_close`` is the number of the split's last
    line with a closing sign.
    """

    def __init__(self, open_: bool, closed_later: bool, last_close: int, pending: str = ""):
        self.open, self.closed_later, self.last_close, self.pending = open_, closed_later, last_close, pending
        self.line, self.carried = -1, True  # carried: what was pending before the split still is

    def clean(self, line: str) -> str | None:
        """The line that ends here, trimmed; None within a comment."""
        self.line += 1
        at = 0
        while True:
            if self.open:
                end = line.find("*/", at)
                if end < 0:
                    return None
                self.open, at = False, end + 2
            start = line.find("/*", at)
            if start < 0 or not (self.closed_later or self.last_close > self.line or line.find("*/", start + 2) >= 0):
                break
            self.pending += line[at:start]
            # the sign that closes may not share a stroke with the one that opens
            self.open, at = True, start + 2
        text = (self.pending + line[at:]).split("//", 1)[0]
        self.pending, self.carried = "", False
        return text.replace("\r", " ").replace("\t", " ").strip(" ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], dict]]:
    """Lines in turn, in stretches of one split: its key, the lines, and the other columns of its first row."""
    for b in batches:
        files, splits, values = (b.column(c).to_pylist() for c in ("file", "split", "value"))
        cuts = [0, *(k for k in range(1, len(files)) if (files[k], splits[k]) != (files[k - 1], splits[k - 1])), len(files)]
        for x, y in zip(cuts, cuts[1:]):
            if x < y:
                yield (files[x], splits[x]), values[x:y], {c: b.column(c)[x].as_py() for c in b.schema.names}


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: whether a comment is open at its end if none or one was open at its beginning, its last line with a closing sign (or -1), and what is pending at its end."""
    found: list[list] = []
    for now, lines, _ in _runs(batches):
        if not found or found[-1][0] != now:
            # as if a closing sign followed: what comes behind a file's last one is seen to when its splits are chained
            found.append([now, Scanner(False, True, -1), Scanner(True, True, -1), -1])
        _, closed, opened, _ = found[-1]
        for line in lines:
            closed.clean(line)
            opened.clean(line)
            if "*/" in line:
                found[-1][3] = closed.line
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((*key, x.open, y.open, last, x.pending, y.pending, y.carried) for key, x, y, last in found)), SPLITS)], schema=SPLITS)


def _chain(table: pa.Table) -> pa.Table:
    """The splits of one file in order: how each begins."""
    table = table.sort_by("split")
    file, split, closed, opened, last, own, after_open, carried = (table.column(c).to_pylist() for c in SPLITS.names)
    final = max((k for k, x in enumerate(last) if x >= 0), default=-1)
    begins, texts, now, held = [], [], False, ""
    for k in range(len(split)):
        begins.append(now and k <= final)
        texts.append(held if begins[-1] else "")
        held = own[k] if not now else held + after_open[k] if carried[k] else after_open[k]
        now = opened[k] if now else closed[k]
    rows = file, split, begins, [k < final for k in range(len(split))], last, texts
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, STARTS)], schema=STARTS)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], dict, str]]:
    """Every gate line with its split and that split's first row."""
    key, scanner = None, None
    for now, lines, first in _runs(batches):
        if now != key:
            key, scanner = now, Scanner(first["begins_open"], first["closed_later"], first["last_close"], first["pending"])
        for line in lines:
            text = scanner.clean(line)
            if text is not None and IS_GATE.match(text):
                yield now, first, text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter(now for now, _, _ in _scanned(batches))
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in counts]), pa.array([s for _, s in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["file", "split", "n"])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    rows: list[tuple] = []
    for now, first, text in _scanned(batches):
        m = HEAD.match(text)
        rows.append((now[0], first["before"] + seen[now], m[2], m[1], m[3]) if m else (now[0], first["before"] + seen[now], "", "", ""))
        seen[now] += 1
        if len(rows) == 4096:
            yield _gate_rows(rows)
            rows = []
    if rows:
        yield _gate_rows(rows)


def _gate_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["design_id", "gid", "gate_name", "gtype", "args"])


def netlist_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file (its stem), split (where in the file it begins), value: the lines of every .v file, each split's in order."""
    lines = spark.read.text(folder, pathGlobFilter="*.v", recursiveFileLookup=True)
    return lines.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.v$", "").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def parse_gate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """design_id (file stem), gid, gate_name, gtype, args: as parse_gates gives of the whole texts, from splits of the files.

    The files are read three times: for comments, for the number of gates of each split, and for the gates.
    """
    lines = netlist_lines(spark, folder)
    starts = staged(lines.mapInArrow(_survey, SPLITS_SQL).groupBy("file").applyInArrow(_chain, STARTS_SQL))
    known = lines.join(F.broadcast(starts), ["file", "split"])
    counts = staged(known.mapInArrow(_count, "file string, split long, n long"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counts.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    return known.join(F.broadcast(bases), ["file", "split"]).mapInArrow(_number, GATES_SQL)
