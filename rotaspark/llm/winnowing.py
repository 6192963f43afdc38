"""Document fingerprints by winnowing: rolling k-gram hashes, the rightmost minimum of every window, with positions.

Windows that reach over an end of the text count too, so short texts have more than one fingerprint. Two texts that
share WINDOW + K - 1 code points in a row share a fingerprint.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.llm.pretokens import span_hashes
from rotaspark.llm.wordhash import code_points

K = 8
WINDOW = 32
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_FINE = 64
_RUN = 1 << 20


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints in order. A text of 1 to k-1 code points has one; an empty text none.

    Windows are worked on in runs of _RUN, so the arrays do not grow with the text.
    """
    points = code_points(text)
    if not points.size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = min(k, points.size)
    n = points.size - k + 1
    places, values = [], []
    for first in range(0, n + window - 1, _RUN):
        last = min(first + _RUN, n + window - 1)
        low, high = max(0, first - window + 1), min(n, last)
        start = np.arange(high - low, dtype=np.int64)
        grams = np.minimum(span_hashes(points[low : high + k - 1], start, start + k), _LAST - np.uint64(1))
        before, after = np.full(low - (first - window + 1), _LAST), np.full(last - high, _LAST)
        at, least = _minima(np.concatenate((before, grams, after)), window)
        places.append(at + (first - window + 1))
        values.append(least)
    at, least = np.concatenate(places), np.concatenate(values)
    fresh = np.append(True, at[1:] != at[:-1])
    return at[fresh], least[fresh]


def _minima(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the rightmost minimum of every window, by windows of doubled length."""
    least, where, reach = hashes, np.arange(hashes.size, dtype=np.int64), 1
    while reach < window:
        step = min(reach, window - reach)
        right = least[step:] <= least[:-step]
        least = np.where(right, least[step:], least[:-step])
        where = np.where(right, where[step:], where[:-step])
        reach += step
    return where, least


Bag = tuple[np.ndarray, np.ndarray]


def bag(hashes: np.ndarray) -> Bag:
    """Distinct hashes in order and how often each was chosen."""
    return np.unique(hashes, return_counts=True)


def likeness(a: Bag, b: Bag) -> float:
    """Jaccard similarity of two bags, counting repeated fingerprints; 1 if both are empty."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def as_text(positions: np.ndarray, hashes: np.ndarray) -> str:
    """Base64 of one record per fingerprint: the step from the position before (one byte) and the hash's first 4 bytes.

    Steps are shorter than the window, which may have 256 hashes at most here.
    """
    cells = np.empty((positions.size, 5), np.uint8)
    cells[:, 0] = np.diff(positions, prepend=0)
    cells[:, 1:] = (hashes >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
    return base64.b64encode(cells.tobytes()).decode("ascii")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, position, hash: the fingerprints of every whole text; NULL and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, hashes = winnow(text, k, window)
                ids = pa.array([key] * at.size, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(hashes.view(np.int64))], ["doc_id", "position", "hash"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, position long, hash long")


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most key, found among every 64th first; 0 for NULL."""
    if not splits:
        return F.lit(0)
    every = F.array(*map(F.lit, splits))
    coarse = F.size(F.filter(F.array(*map(F.lit, splits[_FINE - 1 :: _FINE])), lambda s: s <= key)) if len(splits) >= _FINE else F.lit(0)
    fine = F.size(F.filter(F.slice(every, coarse * _FINE + 1, F.lit(_FINE)), lambda s: s <= key))
    return F.when(key.isNull(), 0).otherwise(coarse * _FINE + fine)


def with_following(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, peek, doc_id, text) dealt by part and sorted, so that each row's successor is the next row.

    Parts are ranges of doc_id, cut at approximate quantiles of the ids alone. A part ends with a peek: the first
    document of the next part (of the first part, after the last). The driver holds one id and one cut per part; each
    text is shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = [i / parts for i in range(1, parts)]
    splits = rows.agg(F.percentile_approx("doc_id", cuts, 10000)).first()[0] if cuts else []
    number = _bucket(F.col("doc_id"), sorted(set(splits or [])))
    heads = rows.select(number.alias("part"), "doc_id").groupBy("part")
    heads = heads.agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("unknown")).orderBy("part").collect()
    if not heads:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("peek"), "doc_id", "text")
    before = {h["part"]: heads[i - 1]["part"] for i, h in enumerate(heads)}
    first_is_null = heads[0]["unknown"]
    known = [h["first"] for i, h in enumerate(heads) if i or not first_is_null]
    is_head = F.col("doc_id").isin(known) if known else F.lit(False)
    if first_is_null:
        is_head = F.when(F.col("doc_id").isNull(), True).otherwise(is_head)
    back = F.element_at(F.array(*[F.lit(before.get(p, 0)) for p in range(max(before) + 1)]), F.col("part") + 1)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("peek"))
    seen = F.struct(back.alias("part"), F.lit(True).alias("peek"))
    places = F.when(is_head, F.array(own, seen)).otherwise(F.array(own))
    dealt = rows.withColumn("part", number).select(F.explode(places).alias("p"), "doc_id", "text").select("p.*", "doc_id", "text")
    return dealt.repartitionById(max(before) + 1, "part").sortWithinPartitions("part", "peek", "doc_id", "text")


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness and the next document's.

    In the edited text the last quarter of the code points gives way to the first ones of the next document in
    ascending doc_id (NULL ids first, ties by text). A single document follows itself. A NULL text is empty: its
    fingerprint is '', and two empty texts are alike (1.0). Repeated rows count as documents that follow each other;
    other columns are ignored, and an empty table gives no rows.
    """
    if not 1 <= window <= 256:
        raise ValueError("the window must have 1 to 256 hashes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def result(doc_id, text: str, mine, following: str, others) -> tuple:
        size = len(text) // 4
        edited = text[: len(text) - size] + following[:size] if size else text
        at, hashes, counted = mine
        edited_at, edited_hashes = winnow(edited, k, window)
        near = likeness(counted, bag(edited_hashes))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, as_text(at, hashes), as_text(edited_at, edited_hashes), near, likeness(counted, others[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = []
            for part, peek, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if peek and waiting is None:
                    continue
                at, hashes = winnow(text, k, window)
                mine = at, hashes, bag(hashes)
                if waiting is not None:
                    out.append(result(*waiting, text, mine))
                waiting = None if peek else (doc_id, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RESULT.types)], schema=_RESULT)

    return with_following(docs, parts).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
