"""Mixing sources to target weights by weighted fair queueing.

Every source is one flow. Its documents are shuffled by a hash, and document copies get the virtual finish time
`words of the source up to and with this copy / target of the source`. All copies are put in the order of their
finish times and taken until the total budget is reached, so all sources reach their targets at about time 1.
A second pass over a source follows its first; there is no third. A copy that lies more beyond its source's target than
below it does not queue: what a very long document leaves of the budget is not given to the other sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import BLANKS, staged

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
PASSES = 2
#: Hash ranges per source, and ranges of virtual time per unit.
_RANGES = 4096
_TICKS = 1 << 14


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for NULL."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, passes: int = PASSES) -> DataFrame:
    """(key, source_size) -> and target: weights repeat over the sources by code point, NULL last.

    Targets share `share` of all sizes by weight and stop at `passes` times the source's size; the excess goes to the
    other sources by weight until none is above. In the order of cap / weight the sources that stop come first, so one
    running sum finds the level at which the others stand.
    """
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("key").startswith("n"), "key")))
    rows = rows.select("key", "source_size", w.alias("w"), (F.col("source_size") * passes).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    open_level = F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), "key", "level"))
    rows = rows.withColumn("open", F.min(open_level).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("open.level"), F.col("cap").cast("double")))
    return rows.select("key", "source_size", target.alias("target"))


def mixture(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = BUDGET_SHARE, passes: int = PASSES) -> DataFrame:
    """doc_id, mark, key, n_rows, size, source_size, target, taken, copies: what the mix takes of every document.

    One result row stands for the n_rows rows with that doc_id, text and source; taken counts words of one of them, and
    copies has the virtual finish time and its tick for each time that one is taken. Sizes and positions depend on the rows only, so reruns agree. NULL texts have size 0; rows of size 0 are never
    taken. Sources are split into hash ranges whose totals are summed first, so no source is gathered in one task.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), key.alias("key"), word_count(F.col("text")).alias("size"))
    rows = rows.groupBy("doc_id", "mark", "key", "size").agg(F.count("*").alias("n_rows"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "mark"))
    rows = staged(rows.withColumn("range", F.shiftrightunsigned("h", 52)), "mix-sizes")
    totals = rows.groupBy("key", "range").agg(F.sum(F.col("size") * F.col("n_rows")).alias("words"))
    targets = source_targets(totals.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, passes)
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("key", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets, "key")
    so_far = Window.partitionBy("key", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(F.col("size") * F.col("n_rows")).over(so_far)
    timed = rows.withColumn("inside", cum).join(offsets, ["key", "range"])
    timed = staged(timed.withColumn("cum", F.col("offset") + F.col("inside")).drop("offset", "inside", "range"), "mix-times")

    def place(n: int) -> Column:
        finish = (F.col("cum") + F.col("source_size") * n) / F.col("target")
        return F.struct(finish.alias("finish"), F.col("key").alias("key"), F.lit(n).alias("pass"), "h", "doc_id", "size")

    words = F.col("size") * F.col("n_rows")
    queues = lambda n: (F.col("size") > 0) & (2 * (F.col("cum") + F.col("source_size") * n) - words <= 2 * F.col("target"))
    places = F.filter(F.array(*[F.when(queues(n), place(n)) for n in range(passes)]), lambda p: p.isNotNull())
    copies = timed.select(F.explode(places).alias("p"), words.alias("words"))
    tick = F.least(F.floor(F.col("p.finish") * _TICKS), F.lit(4 * _TICKS))
    copies = copies.withColumn("tick", tick)
    sums = copies.groupBy("tick").agg(F.sum("words").alias("words"))
    upto = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("tick", "words", F.sum("words").over(upto).alias("upto"))
    budget = (totals.agg(F.sum("words")).first()[0] or 0) * share
    over = sums.where(F.col("upto") > budget).orderBy("tick").first()
    cut = None
    if over is not None:
        room = budget - (over["upto"] - over["words"])
        last = copies.where(F.col("tick") == over["tick"])
        last = last.withColumn("run", F.sum("words").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
        cut = last.where(F.col("run") <= room).agg(F.max("p").alias("p")).first()["p"]

    def taken(n: int) -> Column:
        at = place(n)
        t = F.least(F.floor(at["finish"] * _TICKS), F.lit(4 * _TICKS))
        inside = queues(n)
        if over is not None:
            before = t < F.lit(over["tick"])
            if cut is not None:
                edge = F.struct(*[F.lit(cut[k]).cast(ty).alias(k) for k, ty in _PLACE])
                before = before | ((t == F.lit(over["tick"])) & (at <= edge))
            inside = inside & before
        return F.when(inside, F.struct(at["finish"].alias("finish"), F.lit(n).alias("pass"), t.alias("tick")))

    mixed = timed.withColumn("copies", F.filter(F.array(*[taken(n) for n in range(passes)]), lambda c: c.isNotNull()))
    return mixed.select(
        "doc_id", "mark", "key", "n_rows", "size", "source_size", "target",
        (F.size("copies") * F.col("size")).cast("long").alias("taken"), "copies", "h",
    )


_PLACE = (("finish", "double"), ("key", "string"), ("pass", "int"), ("h", "bigint"), ("doc_id", "bigint"), ("size", "bigint"))


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed documents with the columns of docs: a document taken twice comes as two rows, one not taken as none.

    Rows are in the order of their virtual finish times (ties by source, pass, hash and id), over partitions that are
    ranges of it. The words per tick, a table of bounded size, give the ranges equal shares of the words. All columns
    pass through as they are, whatever their names; NULL sources are a source of their own, NULL texts are never taken,
    repeated rows are taken as often as each other, and an empty table stays empty.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = mixture(docs, seed).where(F.col("taken") > 0).select(
        F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("key").alias("k"), "h",
        (F.col("size") * F.col("n_rows")).alias("words"), F.explode("copies").alias("c"),
    )
    plan = staged(plan.select("d", "m", "k", "h", "words", "c.*"), "mix-plan")
    sums = plan.groupBy("tick").agg(F.sum("words").alias("words"))
    middle = F.sum("words").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words") / 2
    ranges = sums.select("tick", F.floor(middle * parts / F.sum("words").over(Window.partitionBy())).cast("int").alias("part"))
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), key.alias("key"),
    )
    placed = plan.join(ranges, "tick")
    joined = rows.join(placed, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("key") == F.col("k")))
    order = ["finish", "k", "pass", "h", "d"]
    return joined.select("row", "part", *order).repartitionById(parts, "part").sortWithinPartitions(*order).select("row.*")
