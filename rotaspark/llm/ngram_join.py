"""Self join of documents on the Jaccard similarity of their word 5-grams, with Bayesian candidate pruning.

1. Documents with the same set of word 5-grams form a class; only its smallest doc_id goes on.
2. Candidates share one of BANDS bands of ROWS MinHash values: a pair of similarity 0.8 is missed with probability
   (1 - 0.8**4)**32, about 5e-8. Bands with the same members are searched once.
3. The members of a band are dealt into blocks, by their number and the size of their sets, and blocks meet in cells.
   In its cell a pair's MinHash values are
   compared ROUND at a time, and the pair is dropped once the posterior probability that its similarity reaches the
   threshold is below TOLERANCE. The rest is verified exactly on the 5-gram sets. A pair that shares several bands is
   handled in the first one only.
4. A cell returns counts of links and a spanning forest, never its pairs; the forests' components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import staged
from rotaspark.llm.components import components
from rotaspark.llm.wordhash import mix, shingles

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
ROUND = 16
TOLERANCE = 1e-9
#: Members of a band that meet in one block, and 5-grams that their sets hold (8 bytes each); larger bands are dealt into
#: several blocks.
BLOCK, BLOCK_GRAMS = 1024, 1 << 23
_HASHES = BANDS * ROWS


@cache
def _multipliers() -> np.ndarray:
    return mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def minhash(grams: np.ndarray) -> np.ndarray:
    """_HASHES minima (uint32) over a set of at least one 64-bit hash."""
    least = np.full(_HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, grams.size, 2048):
        least = np.minimum(least, np.multiply.outer(grams[at : at + 2048], _multipliers()).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; keys of different bands never meet, as the band's number goes in."""
    rows = signature.astype(np.uint64).reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = mix(total + rows[:, i])
    return total.view(np.int64)


def posterior(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold) after so many matches, from a uniform prior: a Beta tail as a binomial sum."""
    n = compared + 1
    return sum(comb(n, i) * threshold**i * (1 - threshold) ** (n - i) for i in range(matches + 1))


@cache
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values the fewest matches that keep a pair."""
    return {
        n: next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance)
        for n in range(ROUND, _HASHES + 1, ROUND)
    }


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, which tell sets apart."""
    return tuple(int(x.sum().view(np.int64)) for x in (grams, mix(grams + np.uint64(1))))


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, s1, s2 (digest of the 5-gram set; NULL without words), its size and bands of every row, and its mark if docs has one."""
    marked = "mark" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = shingles(text, SHINGLE_WORDS)
                if not grams.size:
                    out.append((doc_id, None, None, None, None))
                    continue
                out.append((doc_id, *_digest(grams), grams.size, band_keys(minhash(grams))))
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), _SIGNED.types)]
                yield pa.RecordBatch.from_arrays(arrays + batch.columns[2:], _SIGNED.names + ["mark"] * marked)

    return docs.mapInArrow(run, "doc_id long, s1 long, s2 long, size long, bands array<long>" + ", mark long" * marked)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _cells(classes: DataFrame) -> DataFrame:
    """(rep, cells): the cells (key, band, i, j) of every representative that shares a band with another."""
    placed = classes.select("rep", "size", F.posexplode("bands").alias("band", "key"))
    own = F.xxhash64("rep")
    # 24-bit terms: their sum stays a long for any number of members.
    buckets = placed.groupBy("key", "band").agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(F.shiftright(own, 40)).alias("s"), F.sum("size").alias("grams"))
    buckets = buckets.where("n > 1").groupBy("n", "x", "s").agg(F.min(F.struct("band", "key")).alias("b"), F.max("grams").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least("n", F.ceil(F.col("grams") / BLOCK_GRAMS))).cast("int")
    buckets = buckets.select("b.key", "b.band", blocks.alias("blocks"))
    members = placed.join(buckets, ["key", "band"])
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cell = lambda other: F.struct(
        "key", "band", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), (mine > other).alias("second")
    )
    return members.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)).alias("cell")).select("rep", "cell.*")


def _loaded(cells: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The cells' members with their signatures, bands and 5-gram sets, computed once per representative.

    Where several texts have the representative's doc_id, the digest tells which is meant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, taken = [], []
            for at, (s1, s2, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                grams = shingles(text, SHINGLE_WORDS)
                if grams.size and _digest(grams) == (s1, s2):
                    signature = minhash(grams)
                    out.append((grams.tobytes(), signature.tobytes(), band_keys(signature).tobytes()))
                    taken.append(at)
            if out:
                own = batch.take(pa.array(taken))
                columns = [own.column(0), own.column(1), *(pa.array(x, pa.binary()) for x in zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "cells", "grams", "signature", "bands"])

    lists = cells.groupBy("rep").agg(F.collect_list(F.struct("key", "band", "i", "j", "second")).alias("cells"))
    named = lists.join(classes.select("rep", "s1", "s2"), "rep")
    rows = named.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    cell_type = "array<struct<key: bigint, band: int, i: int, j: int, second: boolean>>"
    loaded = rows.select("rep", "cells", "s1", "s2", "text").mapInArrow(
        run, f"rep long, cells {cell_type}, grams binary, signature binary, bands binary"
    )
    return loaded.select("rep", "grams", "signature", "bands", F.explode("cells").alias("c")).select(
        "c.key", "c.band", "c.i", "c.j", "c.second", "rep", "grams", "signature", "bands"
    )


class _Cell:
    """The members of one cell, first and second block apart."""

    def __init__(self, band: int) -> None:
        self.band = band
        self.rows: tuple[dict, dict] = ({}, {})

    def add(self, second: bool, rep: int, grams: bytes, signature: bytes, bands: bytes) -> None:
        self.rows[second][rep] = (np.frombuffer(grams, np.uint64), np.frombuffer(signature, np.uint32), np.frombuffer(bands, np.int64))

    def links(self, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(reps, links per rep, spanning edges) of the pairs this cell is responsible for."""
        first = self.rows[0]
        second = first if same else self.rows[1]
        reps = [np.array(list(x), np.int64) for x in (first, second)]
        members = [list(x.values()) for x in (first, second)]
        signs, bands = ([np.stack([m[k] for m in x]) if x else None for x in members] for k in (1, 2))
        counts = [np.zeros(r.size, np.int64) for r in reps]
        forest = _Forest()
        for at in range(0, reps[0].size if reps[1].size else 0, 64):
            a, b = self._pairs(bands[0][at : at + 64], bands[1], at, same)
            for n, least in least_matches(threshold, tolerance).items():
                seen = (signs[0][a, n - ROUND : n] == signs[1][b, n - ROUND : n]).sum(axis=1)
                matches = seen if n == ROUND else matches + seen
                fine = matches >= least
                a, b, matches = a[fine], b[fine], matches[fine]
            linked = _verified(members[0], members[1], a, b, threshold)
            a, b = a[linked], b[linked]
            np.add.at(counts[0], a, 1)
            np.add.at(counts[0 if same else 1], b, 1)
            for x, y in zip(reps[0][a].tolist(), reps[1][b].tolist()):
                forest.join(x, y)
        if same:
            return reps[0], counts[0], forest.edges
        return np.concatenate(reps), np.concatenate(counts), forest.edges

    def _pairs(self, mine: np.ndarray, others: np.ndarray, at: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share no band before this cell's: those are handled there."""
        open_ = np.ones((mine.shape[0], others.shape[0]), bool)
        for s in range(self.band):
            open_ &= mine[:, s, None] != others[None, :, s]
        if same:
            open_ &= np.arange(others.shape[0])[None, :] > np.arange(at, at + mine.shape[0])[:, None]
        a, b = np.nonzero(open_)
        return a + at, b


class _Forest:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[p]
            x = p
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((min(a, b), max(a, b)))


def _verified(first: list, second: list, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's exact similarity reaches the threshold.

    The sets of the chunk's rows and columns become 0/1 rows over the 5-grams that both sides hold, and one matrix
    product counts what all pairs have in common.
    """
    keep = np.zeros(a.size, bool)
    order = np.argsort(b, kind="stable")
    for part in np.array_split(order, max(1, -(-a.size // 4096))):
        if not part.size:
            continue
        left, la = np.unique(a[part], return_inverse=True)
        right, rb = np.unique(b[part], return_inverse=True)
        lsets, rsets = [first[i][0] for i in left], [second[i][0] for i in right]
        vocabulary = np.intersect1d(np.concatenate(lsets), np.concatenate(rsets))
        common = np.zeros(part.size, np.int64)
        for at in range(0, vocabulary.size, 1 << 14):
            words = vocabulary[at : at + (1 << 14)]
            dense = [_rows(sets, words) for sets in (lsets, rsets)]
            common += np.rint((dense[0] @ dense[1].T)[la, rb]).astype(np.int64)
        sizes = np.array([s.size for s in lsets])[la] + np.array([s.size for s in rsets])[rb] - common
        keep[part] = common >= threshold * sizes - 1e-9
    return keep


def _rows(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), words.size), np.float32)
    for row, s in zip(out, sets):
        at = np.searchsorted(words, s)
        at[at == words.size] = 0
        row[at[words[at] == s]] = 1
    return out


def _compared(cells: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(rep, links, other): per cell a row with a member's links, or (links NULL) an edge of the spanning forest."""

    def finish(cell: _Cell, same: bool) -> pa.RecordBatch | None:
        reps, counts, edges = cell.links(same, threshold, tolerance)
        some = counts > 0
        if not some.any():
            return None
        a, b = zip(*edges)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(reps[some]), pa.array(a, pa.int64())]),
                pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(edges), pa.int64())]),
                pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(b, pa.int64())]),
            ],
            ["rep", "links", "other"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, band, i, j, second, *row in zip(*columns):
                if (key, band, i, j) != now:
                    if cell is not None and (found := finish(cell, now[2] == now[3])) is not None:
                        yield found
                    now, cell = (key, band, i, j), _Cell(band)
                cell.add(second, *row)
        if cell is not None and (found := finish(cell, now[2] == now[3])) is not None:
            yield found

    dealt = cells.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j")
    return dealt.mapInArrow(run, "rep long, links long, other long")


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, rep_id, n_copies, n_links of every row of docs.

    Words are runs of letters, digits and characters beyond ASCII, ASCII letters lower-cased; a text of one to four
    words has one gram, all of them. rep_id is the smallest doc_id with the same 5-gram set, n_copies the rows with
    it, n_links the other representatives with similarity >= threshold, class_id the smallest doc_id that links reach.
    A NULL or empty text, or one without words, links to nothing and is its own class. Rows with a NULL doc_id take no
    part: class_id and rep_id are NULL, n_links is 0. Repeated rows are copies of each other; of several texts with one
    doc_id the one with the smallest digest stands for the id. Other columns are ignored; an empty table gives no rows.
    """
    found = _classified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold, tolerance)
    return found.drop("s1", "s2")


def _classified(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """similarity_classes of rows (doc_id, text and maybe mark), with s1, s2 and the mark."""
    signed = staged(_signatures(rows), "ngram-signatures")
    real = signed.where("doc_id IS NOT NULL AND s1 IS NOT NULL")
    one = F.min_by(F.struct("s1", "s2", "size", "bands"), F.struct("s1", "s2")).alias("v")
    single = real.groupBy("doc_id").agg(one, F.count("*").alias("n")).select("doc_id", "n", "v.*")
    classes = single.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.sum("n").alias("n_copies"), F.max("size").alias("size"), F.min_by("bands", "doc_id").alias("bands")
    )
    classes = staged(classes, "ngram-classes")
    cells = staged(_cells(classes), "ngram-cells")
    loaded = _loaded(cells, classes, rows.where("doc_id IS NOT NULL").select("doc_id", "text"))
    found = staged(_compared(loaded, threshold, tolerance), "ngram-links")
    links = found.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("n_links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = classes.drop("bands").join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    marks = [c for c in signed.columns if c == "mark"]
    members = signed.select("doc_id", *marks, *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("s1", "s2")])
    # Rows without words have keys of their own, spread over all tasks; `k0` keeps them from meeting a class.
    members = members.withColumns(
        {"k0": F.col("s1").isNotNull(), "k1": F.coalesce("s1", F.xxhash64("doc_id")), "k2": F.coalesce("s2", F.lit(0).cast("long"))}
    )
    known = known.select(F.lit(True).alias("k0"), F.col("s1").alias("k1"), F.col("s2").alias("k2"), "rep", "n_copies", "n_links", "label")
    return members.join(known, ["k0", "k1", "k2"], "left").select(
        "doc_id",
        F.coalesce("label", "rep", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("rep_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "s1", "s2", *marks,
    )


def one_per_class(docs: DataFrame) -> DataFrame:
    """One row of each class: of the smallest doc_id, once each.

    Rows without a doc_id take part under ids of their texts beyond 2**62, so they stay where no row with an id below
    that is in their class. Of rows with equal doc_id and text the one with the least other columns stays; texts of one
    doc_id with different 5-gram sets are told apart, and those with the same set count as copies.
    """
    mark = F.xxhash64("text")
    own = F.lit(2**62) + F.shiftrightunsigned(mark, 3)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), own).alias("d"), mark.alias("m"),
        F.to_json(F.struct(*others)).alias("rest") if others else F.lit("").alias("rest"),
    )
    # The window keeps one row per task before the shuffle, and the join below has the same keys.
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("d", "m").orderBy("rest"))).where("at = 1")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("doc_id"), "text", mark.alias("mark"))
    found = _classified(texts, THRESHOLD, TOLERANCE).where("doc_id = class_id")
    keep = found.groupBy(F.col("doc_id").alias("k"), "s1", "s2").agg(F.min("mark").alias("km")).select("k", "km")
    return first.join(keep, (F.col("d") == F.col("k")) & (F.col("m") == F.col("km")), "left_semi").select("row.*")
