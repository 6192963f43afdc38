"""Interval algebra on half-open `[start, end)` pairs.

Two forms exist. The DataFrame form works for keys of any size: rows are cut
into time buckets, so a hot key is spread over its buckets. The array form works
on the few intervals of one agent-day that already sit together in a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rotaspark.functions.temporal import NTZ, last_instant


def _bucket(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast(NTZ)


def buckets(start: Column, end: Column, unit: str) -> Column:
    """Array of the time buckets touched by `[start, end)`."""
    step = F.expr(f"INTERVAL 1 {unit}")
    return F.sequence(_bucket(start, unit), _bucket(last_instant(end), unit), step)


def clip(df: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """IV-01: cut every interval to `[low, high)` and drop what is empty."""
    clipped = df.withColumn(start, F.greatest(F.col(start), low)).withColumn(
        end, F.least(F.col(end), high)
    )
    return clipped.filter(F.col(end) > F.col(start))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    unit: str = "DAY",
    how: str = "inner",
    small: bool = False,
) -> DataFrame:
    """JN-06 / JN-07 / JN-10: equal keys and overlapping spans, as an equality join.

    Both sides are repeated per touched bucket and joined on (keys, bucket).
    A pair that shares several buckets is kept in its first common one only,
    so no distinct is needed. Empty spans match nothing. The right side's
    columns must not repeat the left side's, apart from the keys.

    Sides meet by a merge join: Spark's size check sees compressed files before
    they are repeated per bucket, and would broadcast millions of such rows. A
    side that is `small` by its nature leaves the choice to Spark.
    """
    if how != "inner":
        raise ValueError("overlap_join keeps matching pairs only")
    (ls, le), (rs, re_) = left_span, right_span
    sides = []
    for df, s, e in ((left, ls, le), (right, rs, re_)):
        solid = df.filter(F.col(e) > F.col(s))
        sides.append(solid.withColumn("_bucket", F.explode(buckets(F.col(s), F.col(e), unit))))
    joined = sides[0].join(sides[1] if small else sides[1].hint("merge"), [*keys, "_bucket"])
    first_common = F.greatest(_bucket(F.col(ls), unit), _bucket(F.col(rs), unit))
    overlap = (F.col(ls) < F.col(re_)) & (F.col(re_).isNotNull()) & (F.col(le) > F.col(rs))
    return joined.filter(overlap & (F.col("_bucket") == first_common)).drop("_bucket")


def _merge_once(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return (
        df.withColumn("_fresh", fresh)
        .withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", unit: str | None = "HOUR", span: str = "MONTH"
) -> DataFrame:
    """IV-02: union of the intervals per key; touching intervals join.

    Copies of a start fold into the longest one before the first shuffle. With
    `unit`, intervals are first merged inside the bucket of their start; what is
    left is merged per `span`, given how far the key's earlier spans reach. Only
    one row per span is ever ordered over a key's whole history.
    """
    solid = df.filter(F.col(end) > F.col(start)).select(*keys, start, end)
    if unit is None:
        folded = solid.groupBy(*keys, start).agg(F.max(end).alias(end))
        return _merge_once(folded, keys, start, end)
    bucketed = solid.withColumn("_bucket", _bucket(F.col(start), unit))
    folded = bucketed.groupBy(*keys, "_bucket", start).agg(F.max(end).alias(end))
    islands = _merge_once(folded, [*keys, "_bucket"], start, end).drop("_bucket")
    return _merge_spans(islands.withColumn("_span", _bucket(F.col(start), span)), keys, start, end)


def _before(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """(keys, _span, name): the greatest value over the earlier spans of a key."""
    tops = rows.groupBy(*keys, "_span").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    return tops.select(*keys, "_span", F.max("_top").over(earlier).alias(name))


def _with(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL, and the span."""
    theirs = found.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate([*keys, "_span"])})
    same = F.lit(True)
    for i, k in enumerate([*keys, "_span"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(theirs, same, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def _merge_spans(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Islands over spans: one begins where its start is beyond what all earlier rows reach, in its span or before it."""
    inside = Window.partitionBy(*keys, "_span").orderBy(start)
    reach = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), F.col(start))
    marked = _with(rows, _before(rows, keys, F.col(end), "_carried"), keys).withColumn("_fresh", fresh)
    marked = _with(marked, _before(marked, keys, F.col("_fresh"), "_open"), keys)
    last = F.max("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    named = marked.withColumn("_island", F.coalesce(last, F.col("_open")))
    return named.groupBy(*keys, "_island").agg(F.max(end).alias(end)).select(*keys, F.col("_island").alias(start), end)


def subtract_intervals(
    spans: DataFrame,
    blocks: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    unit: str = "DAY",
) -> DataFrame:
    """IV-03: what is left of each span (one per key) after removing the blocks."""
    span = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    cut = overlap_join(
        span,
        blocks.select(*keys, F.col(start).alias("_bs"), F.col(end).alias("_be")),
        keys,
        left_span=("_s", "_e"),
        right_span=("_bs", "_be"),
        unit=unit,
    )
    inside = cut.select(
        *keys, F.greatest("_bs", "_s").alias("_bs"), F.least("_be", "_e").alias("_be")
    )
    merged = merge_intervals(inside, keys, "_bs", "_be")
    # Each span contributes a sentinel block at its end, and a first cursor.
    sentinel = span.filter("_e > _s").select(
        *keys, F.col("_e").alias("_bs"), F.col("_e").alias("_be"), F.col("_s").alias("_from")
    )
    rows = merged.withColumn("_from", F.lit(None).cast(NTZ)).unionByName(sentinel)
    order = Window.partitionBy(*keys).orderBy("_bs", "_be")
    span_start = F.max("_from").over(Window.partitionBy(*keys))
    cursor = F.coalesce(F.lag("_be").over(order), span_start)
    return (
        rows.withColumn(start, cursor)
        .withColumn(end, F.col("_bs"))
        .filter(F.col(end) > F.col(start))
        .select(*keys, start, end)
    )


def intersect_intervals(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    unit: str = "HOUR",
) -> DataFrame:
    """IV-04: pairwise intersections of two interval sets per key."""
    other = right.select(*keys, F.col(start).alias("_rs"), F.col(end).alias("_re"))
    pairs = overlap_join(
        left, other, keys, left_span=(start, end), right_span=("_rs", "_re"), unit=unit
    )
    return (
        pairs.withColumn(start, F.greatest(start, "_rs"))
        .withColumn(end, F.least(end, "_re"))
        .drop("_rs", "_re")
    )


def _cut_to_hour(df: DataFrame) -> DataFrame:
    """Cut `_s`,`_e` to the hour in `_hour`, noting which bounds are cuts."""
    lo, hi = F.col("_hour"), F.col("_hour") + F.expr("INTERVAL 1 HOUR")
    return (
        df.withColumn("_real_s", F.col("_s") >= lo)
        .withColumn("_real_e", F.col("_e") <= hi)
        .withColumn("_s", F.greatest("_s", lo))
        .withColumn("_e", F.least("_e", hi))
    )


class _Sweep:
    """Elementary pieces of one cell, from rows in order of (start, rank).

    The latest row that is still going on wins. A row that ends no later than one that started after it can never win
    again, so the stack of candidates has falling ends; the heap holds the ends of the rows that are going on. Memory
    is that of the rows that overlap, whatever their number in the cell.
    """

    def __init__(self) -> None:
        self.heap: list[tuple[int, bool]] = []
        self.stack: list[tuple[int, tuple]] = []
        self.now: int | None = None
        self.real = False
        self.open: tuple[int, bool, tuple] | None = None

    def _step(self, to: int) -> Iterator[tuple]:
        """Closes the piece that ends here, and opens the one from here on."""
        if self.open is not None:
            left, real, won = self.open
            yield left, self.now, real, self.real, won
        while self.stack and self.stack[-1][0] <= self.now:
            self.stack.pop()
        self.open = (self.now, self.real, self.stack[-1][1]) if self.stack else None
        self.now, self.real = to, False

    def _ends(self, until: int | None) -> Iterator[tuple]:
        heap = self.heap
        while heap and (until is None or heap[0][0] <= until):
            if heap[0][0] > self.now:
                yield from self._step(heap[0][0])
            self.real |= heapq.heappop(heap)[1]

    def add(self, start: int, end: int, real_start: bool, real_end: bool, payload: tuple) -> Iterator[tuple]:
        """Pieces (left, right, left is a bound, right is a bound, payload) that are complete before this row."""
        if self.now is None:
            self.now = start
        yield from self._ends(start)
        if start > self.now:
            yield from self._step(start)
        self.real |= real_start
        while self.stack and self.stack[-1][0] <= end:
            self.stack.pop()
        self.stack.append((end, payload))
        heapq.heappush(self.heap, (end, real_end))

    def finish(self) -> Iterator[tuple]:
        yield from self._ends(None)
        if self.open is not None:
            left, real, won = self.open
            yield left, self.now, real, self.real, won
        self.__init__()


def flatten_latest(
    df: DataFrame,
    keys: Sequence[str],
    rank: Sequence[str],
    payload: Sequence[str],
    start: str = "start",
    end: str = "end",
    contributor: str | None = None,
) -> DataFrame:
    """IV-05 / WN-04 / WN-05 / JN-09: overlapping rows -> exclusive segments.

    Every elementary piece between two neighbouring bounds of a key goes to the
    covering row with the greatest (start, *rank). Returns one row per key with
    `segments`, an array of struct(start, end, *payload) in time order.

    Rows are cut to hours, and the rows of a key and hour are swept in order of
    (start, *rank): n log n in their number, and only rows that overlap are
    held. Pieces that were split at an hour, not at a bound of some row, are
    joined again, because minutes are floored per elementary piece.

    `contributor` names a column whose distinct values over all rows, also those
    that win nothing, are returned as the array `contributors`.
    """
    own = list(dict.fromkeys([*payload, *([contributor] if contributor else [])]))
    rows = df.filter(F.col(end) > F.col(start)).select(
        *keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(start).alias("_start"),
        *[F.col(c).alias(f"_r{i}") for i, c in enumerate(rank)],
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(own)],
    )
    cells = _cut_to_hour(rows.withColumn("_hour", F.explode(buckets(F.col("_s"), F.col("_e"), "HOUR"))))
    ordered = cells.repartition(*keys, "_hour").sortWithinPartitions(*keys, "_hour", "_start", *[f"_r{i}" for i in range(len(rank))])
    fields = {f.name: f for f in cells.schema.fields}
    out = StructType([fields[k] for k in keys]).add("_l", NTZ).add("_r", NTZ).add("_real_l", "boolean").add("_real_r", "boolean")
    for i in range(len(own)):
        out = out.add(f"_p{i}", fields[f"_p{i}"].dataType)
    out = out.add("_piece", "boolean")
    width, seen_at = len(keys), own.index(contributor) if contributor else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, cell, seen, made, names = _Sweep(), None, set(), [], None

        def close() -> None:
            if cell is not None:
                made.extend((*cell[:-1], *p[:4], *p[4], True) for p in sweep.finish())
                made.extend((*cell[:-1], None, None, None, None, *[v if i == seen_at else None for i in range(len(own))], False) for v in seen)
                seen.clear()

        def table() -> pa.RecordBatch:
            columns = list(zip(*made)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([_arrow(c, t) for c, t in zip(columns, types)], names)

        types: list = []
        for batch in batches:
            if names is None:
                of = {f.name: f.type for f in batch.schema}
                stamp = of["_s"]
                types = [*(of[k] for k in keys), stamp, stamp, pa.bool_(), pa.bool_(), *(of[f"_p{i}"] for i in range(len(own))), pa.bool_()]
                names = [*keys, "_l", "_r", "_real_l", "_real_r", *(f"_p{i}" for i in range(len(own))), "_piece"]
            column = lambda n: batch.column(n).to_pylist()  # noqa: E731,B023
            whole = lambda n: batch.column(n).cast(pa.int64()).to_pylist()  # noqa: E731,B023
            spans = zip(whole("_s"), whole("_e"), column("_real_s"), column("_real_e"))
            values = list(zip(*(column(f"_p{i}") for i in range(len(own))))) if own else [()] * batch.num_rows
            for place, span, value in zip(zip(*(column(k) for k in keys), whole("_hour")), spans, values):
                if place != cell:
                    close()
                    cell = place
                if seen_at is not None and value[seen_at] is not None:
                    seen.add(value[seen_at])
                made.extend((*cell[:width], *p[:4], *p[4], True) for p in sweep.add(*span, value))
            if len(made) > 20_000:
                yield table()
                made = []
        if names is not None:
            close()
            yield table()

    swept = ordered.drop("_start", *[f"_r{i}" for i in range(len(rank))]).mapInArrow(run, out)
    piece = F.struct(
        F.col("_l").alias("l"), F.col("_r").alias("r"), F.col("_real_l").alias("real_l"), F.col("_real_r").alias("real_r"),
        *[F.col(f"_p{own.index(c)}").alias(c) for c in payload],
    )
    gathered = swept.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_piece"), piece))).alias("_pieces"),
        *([F.collect_set(F.when(~F.col("_piece"), F.col(f"_p{seen_at}"))).alias("contributors")] if contributor else []),
    )
    prev = lambda i: F.get(F.col("_pieces"), i - 1)
    follow = lambda i: F.get(F.col("_pieces"), i + 1)
    glued = lambda a, b: F.coalesce(
        (a["r"] == b["l"]) & ~a["real_r"] & ~b["real_l"], F.lit(False)
    )
    heads = F.filter("_pieces", lambda p, i: ~((i > 0) & glued(prev(i), p)))
    tails = F.filter("_pieces", lambda p, i: ~glued(p, follow(i)))
    segment = lambda h, t: F.struct(h["l"].alias("start"), t["r"].alias("end"), *[h[c].alias(c) for c in payload])
    return gathered.select(
        *keys,
        F.zip_with(heads, tails, segment).alias("segments"),
        *(["contributors"] if contributor else []),
    )


def _arrow(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Numbers of microseconds become timestamps, keys and payloads are as they came."""
    if pa.types.is_timestamp(kind) and any(isinstance(v, int) for v in values):
        return pa.array(values, pa.int64()).cast(kind)
    return pa.array(values, kind)


# --- array form -----------------------------------------------------------


def pair(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def array_runs(segments: Column) -> Column:
    """Merge neighbouring segments that touch; the input is exclusive and in order."""
    touches = lambda a, b: F.coalesce(a["end"] >= b["start"], F.lit(False))
    heads = F.filter(
        segments, lambda s, i: ~((i > 0) & touches(F.get(segments, i - 1), s))
    )
    tails = F.filter(segments, lambda s, i: ~touches(s, F.get(segments, i + 1)))
    return F.zip_with(heads, tails, lambda h, t: pair(h["start"], t["end"]))
