"""Runs of words that repeat with a period, found by Lyndon roots and longest common extensions.

Every run has a root that is the longest Lyndon word at its place for one of two opposite orders of the words. So each
position gives two candidates; each is extended to both sides by two suffix trees, of the words and of the words
backwards. All runs come out exactly, in time n log n.

Trees are built of stretches that can hold a run only. In a run of at least min_copies periods every window of three
words comes again and again, so a word outside such windows is in no run; this leaves out most of a plain text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.llm.common import BLANKS
from rotaspark.llm.suffix_tree import Extensions, SuffixTree

MIN_LENGTH = 6
MIN_COPIES = 4
_WINDOW = 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _lyndon_ends(rank: list[int]) -> list[int]:
    """Where the longest Lyndon word at each position ends: at the next suffix of lower rank."""
    ends, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            ends[open_.pop()] = i
        open_.append(i)
    return ends


def runs_of(symbols: list[int], min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> np.ndarray:
    """All runs of a sequence of positive integers, as sorted rows (start, length, period).

    A run is a stretch with smallest period q and a length of at least min_copies (2 or more) periods and min_length,
    which no neighbour extends.
    """
    n = len(symbols)
    if n < max(min_length, min_copies):
        return np.empty((0, 3), np.int64)
    tree = SuffixTree(symbols)
    order, least = tree.tour()
    ahead = Extensions(order, least)
    opposite = np.empty(n + 1, np.int64)
    opposite[tree.tour(descending=True)[0]] = np.arange(n + 1)
    del tree
    behind = Extensions(*SuffixTree(symbols[::-1]).tour())
    found = []
    for rank in (ahead.rank, opposite):
        i = np.arange(n)
        j = np.array(_lyndon_ends(rank[:n].tolist()))
        period = j - i
        start, end = i - behind.of(n - i, n - j), j + ahead.of(i, j)
        good = end - start >= np.maximum(min_length, min_copies * period)
        found.append(np.stack((start, end - start, period), axis=1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _stretches(words: list[bytes], min_length: int, min_copies: int) -> list[tuple[int, int]]:
    """Stretches of words outside which no run can be, from hashes; equal hashes of other words only widen them."""
    often = min(min_copies - 1, max(min_length, min_copies) - _WINDOW + 1)
    n = len(words)
    if n < max(min_length, min_copies):
        return []
    if often < 2 or min_length < _WINDOW:
        return [(0, n)]
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    window = (h[:-2] * _A ^ h[1:-1]) * _B ^ h[2:]
    ranked = np.sort(window)
    again = ranked[often - 1 :] == ranked[: ranked.size - often + 1]
    if not again.any():
        return []
    values = np.unique(ranked[often - 1 :][again])
    at = np.searchsorted(values, window)
    marked = values[np.minimum(at, values.size - 1)] == window
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).astype(np.int8)))
    return [(a, b + _WINDOW - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a > min_length - _WINDOW]


def word_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> np.ndarray:
    """The runs of a text's words, as rows (start, length, period) by start, then period."""
    found = [np.empty((0, 3), np.int64)]
    for a, b in _stretches(words, min_length, min_copies):
        number: dict[bytes, int] = {}
        rows = runs_of([number.setdefault(w, len(number) + 1) for w in words[a:b]], min_length, min_copies)
        rows[:, 0] += a
        found.append(rows)
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(batch: pa.RecordBatch, min_length: int, min_copies: int) -> pa.RecordBatch:
    sizes, offsets, rows, texts = [], [0], [], []
    for text in batch.column("_text").cast(pa.binary()).to_pylist():
        words = (text or b"").split()
        runs = word_runs(words, min_length, min_copies)
        sizes.append(len(words))
        rows.append(runs)
        offsets.append(offsets[-1] + len(runs))
        texts.append(b" ".join(collapsed(words, runs)))
    every = np.concatenate([np.empty((0, 3), np.int64), *rows])
    runs = pa.StructArray.from_arrays([pa.array(every[:, k].copy()) for k in range(3)], fields=list(_RUN))
    made = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(texts, pa.binary()).cast(pa.string())]
    names = [n for n in batch.schema.names if n != "_text"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> DataFrame:
    """All columns of docs but the text, then n_words, runs (start, length, period by start, then period), collapsed.

    Words are what stands between ASCII white space, numbered from 0. collapsed has the words that no run holds beyond
    its first period, joined by one space. A NULL or empty text has no words, no runs and an empty collapsed text; rows
    with NULL ids and repeated rows are rows like any other; columns of docs named n_words, runs, collapsed or _text
    are replaced or dropped; an empty table stays empty. A text is worked on by itself and whole: memory follows the
    longest stretch of one text in which all windows of three words are frequent.
    """
    if min_copies < 2:
        raise ValueError("a run has two copies at least")
    made = ("n_words", "runs", "collapsed")
    kept = docs.withColumn("_text", F.col(text)).drop(text, *made)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(batch, min_length, min_copies)

    return kept.mapInArrow(run, schema + "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs with a tail that repeats in about every tenth text, as the crc32 of its decimal doc_id says.

    With h the crc32 and g = h div 10: where h % 10 = 0, each word i from a = g % n on becomes word a + (i - a) % p,
    with p = 1 + (n - a) div (3 + g % 8). Texts without words and rows without a doc_id stay as they are.
    """
    h = F.crc32(F.col("row.doc_id").cast("string").cast("binary"))
    bare = F.trim("row.text", F.lit(BLANKS))
    words = F.when((F.pmod(h, F.lit(10)) == 0) & (bare != ""), F.split(bare, "[\\x20\\x09-\\x0D]+", -1))
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("first", F.pmod("g", F.size("words")))
    rows = rows.withColumn("period", 1 + F.floor((F.size("words") - F.col("first")) / (3 + F.pmod("g", F.lit(8)))))

    def place(i: Column) -> Column:
        return F.when(i < F.col("first"), i).otherwise(F.col("first") + F.pmod(i - F.col("first"), F.col("period")))

    tail = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", place(i).cast("int")))
    edited = F.when(F.col("words").isNull(), F.col("row.text")).otherwise(F.array_join(tail, " "))
    return rows.select(*[edited.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
