"""Delimited files whose records span lines, read in splits of any size.

A split of a file cannot tell by itself whether it begins inside a quoted cell. But each line maps the state before it
to the state behind it, and such maps compose: one scan gives the map and the number of records of every split for both
states, a prefix over the splits of a file gives each its state and first row number, and a second scan cuts records.
Only records that cross the end of a split meet in a shuffle, by file and row number; rows are numbered without a join.
Line ends inside cells stay as they are in the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.sources.stage import staged

#: The driver holds one entry per split of such files; more splits than this (some 128 TB) are refused.
MAX_SPLITS = 1_000_000
_INSIDE = re.compile(rb'(?:[^"]|"")*')


def state_after(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """Whether the end of a line is inside a quoted cell.

    A quote opens a cell only where the cell begins; doubled quotes stand for one; what follows a closing quote up to
    the separator belongs to the cell.
    """
    if b'"' not in line:
        return inside
    at, end = 0, len(line)
    while True:
        if inside or line.startswith(b'"', at):
            at = _INSIDE.match(line, at if inside else at + 1).end()
            if at >= end:
                return True
            inside = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
        F.unix_micros("_metadata.file_modification_time").alias("mtime"), F.col("value").cast("binary").alias("line"),
    )


def _split_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], list[bytes]]]:
    """(split, lines) in order; a split (uri, block, mtime) comes in pieces, one per batch."""
    for batch in batches:
        uris, blocks, mtimes, lines = (c.to_pylist() for c in batch.columns)
        first = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (uris[i], blocks[i]) != (uris[first], blocks[first]):
                yield (uris[first], blocks[first], mtimes[first]), lines[first:i]
                first = i


def split_states(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """(uri, block, after_out, after_in, n_out, n_in): per split, the state behind it and the records that begin in it,
    if it begins outside or inside a quoted cell. Empty lines between records are no records."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int, int], list] = {}
        for split, lines in _split_lines(batches):
            out = found.setdefault(split, [False, True, 0, 0])
            for line in lines:
                solid = line not in (b"", b"\r")
                for k in (0, 1):
                    out[2 + k] += solid and not out[k]
                    out[k] = state_after(line, out[k], mark)
        columns = list(zip(*((u, b, *v) for (u, b, _), v in found.items()))) or [[]] * 6
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["uri", "block", "after_out", "after_in", "n_out", "n_in"])

    return _lines(spark, paths).mapInArrow(run, "uri string, block long, after_out boolean, after_in boolean, n_out long, n_in long")


def split_starts(states: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """(uri, block) -> (begins inside a cell, records that begin before it)."""
    rows = states.orderBy("uri", "block").limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits of files whose records span lines")
    out, uri, inside, before = {}, None, False, 0
    for r in rows:
        if r["uri"] != uri:
            uri, inside, before = r["uri"], False, 0
        out[r["uri"], r["block"]] = inside, before
        before += r["n_in"] if inside else r["n_out"]
        inside = r["after_in"] if inside else r["after_out"]
    return out


def read_records(spark: SparkSession, paths: Sequence[str], sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(uri, mtime, row, record): the records of some files as text; row counts from 0, the header, inside each file."""
    mark, starts = sep.encode(), spark.sparkContext.broadcast(split_starts(split_states(spark, paths, sep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        split, parts, inside, whole, row, size = None, [], False, True, 0, 0

        def close(complete: bool) -> None:
            """Hands out the lines gathered so far; what began before the split, or goes on behind it, is a fragment."""
            nonlocal parts, whole, size
            if parts:
                text = b"\n".join(parts)
                text = text.removesuffix(b"\r") if complete else text
                out.append((*split, row, complete and whole, text.decode(encoding, "replace")))
                size += len(text)
            parts, whole = [], True

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["uri", "block", "mtime", "row", "whole", "record"])

        for place, lines in _split_lines(batches):
            if place != split:
                close(not inside)
                split = place
                inside, row = starts.value[place[:2]]
                whole = not inside
                row -= 1  # the number of the record that is open, or of the last one closed
            for line in lines:
                if not inside:
                    if line in (b"", b"\r"):
                        continue
                    row += 1
                parts.append(line)
                inside = state_after(line, inside, mark)
                if not inside:
                    close(True)
            if size > 1 << 23 or len(out) > 10_000:
                yield batch()
                out, size = [], 0
        close(not inside)
        yield batch()

    cut = _lines(spark, paths).mapInArrow(run, "uri string, block long, mtime long, row long, whole boolean, record string")
    cut = staged(cut, "records")
    pieces = cut.where("NOT whole").groupBy("uri", "mtime", "row").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"))
    joined = pieces.select("uri", "mtime", "row", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return cut.where("whole").select("uri", "mtime", "row", "record").unionByName(joined)


def cells_of(record: Column, names: Sequence[str], sep: str = ",") -> Column:
    """A record's cells as a struct of text columns."""
    ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    return F.from_csv(record, ddl, {"sep": sep, "escape": '"', "multiLine": "true"})
