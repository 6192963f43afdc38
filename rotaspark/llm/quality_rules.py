"""Quality rules with adaptive thresholds per language and source.

The rules' metrics are summarised in mergeable quantile sketches: counts per metric and log-linear bin, which add up
over tasks, sources and languages in any order. Thresholds are read from the sketch of a document's language and
source, and joined back for the filter. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import BLANKS, staged

#: Metrics are integers per this many units; bins split each power of two into 2**(_BITS - 1) parts.
SCALE = 10_000
_BITS = 6
#: A limit lies in the first valley above a group's median: a stretch at least this wide that holds at most VALLEY of
#: the group. The widths tell noise from a gap; where the valley begins and ends is read from the group's quantiles.
WIDTH = {"symbols": 0.1, "dup_lines": 0.15, "repeats": 0.15, "long_words": 0.8}
VALLEY, CENTRE = 0.002, 0.5
#: As many documents' worth of its language's sketch are merged into each source's.
PRIOR_DOCUMENTS = 100
#: A source's limit is at most so many times as far from its median as its language's limit is from the language's.
BOUND = 2
_PARTS = 10**9
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
METRICS = tuple(WIDTH)


def _words(text: Column) -> Column:
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated words come from sorting a text's 3-word windows by hash beside their positions: equal neighbours mark
    repeated windows, whose union is measured in order of position. The work grows as n log n with the text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_words", _words(whole))
    words = F.col("_words")
    last = F.size(words) - 3
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    rows = rows.withColumn("_windows", F.when(last >= 1, F.sort_array(windows)))
    w = F.col("_windows")
    again = F.filter(w, lambda x, i: (x["h"] == F.get(w, i - 1)["h"]) | (x["h"] == F.get(w, i + 1)["h"]))
    rows = rows.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    rows = rows.withColumn("_lines", F.filter(F.split(whole, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.col("_again"),
        start,
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
        lambda a: a["n"],
    )
    symbols = F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))
    return rows.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def metric_columns() -> dict[str, Column]:
    """Integer metrics of a document with words; NULL without."""
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"({a} * {SCALE}) div {b}"))
    return dict(zip(METRICS, (per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("word_chars", "n_words"))))


def bin_of(value: Column) -> Column:
    """The lowest value of value's bin: its _BITS highest bits, the rest zero."""
    drop = F.greatest(F.length(F.bin(value)) - _BITS, F.lit(0))
    return value - F.pmod(value, F.pow(F.lit(2.0), drop).cast("long"))


def sketch(measures: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, bin, n): the mergeable sketch; sketches of the same metric merge by adding n per bin."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(c).alias("bin")) for m, c in metric_columns().items()])
    rows = measures.where(F.col("n_words") > 0).select(*groups, F.explode(pairs).alias("p"))
    return rows.select(*groups, "p.metric", "p.bin").groupBy(*groups, "metric", "bin").agg(F.count("*").alias("n"))


def valleys(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, centre, top) of counts (groups, metric, bin, n): the median and the limit above it.

    Going up from the median, the limit is the middle of the first two quantiles that are VALLEY apart in rank and at
    least the metric's width apart in value. What lies beyond may be any part of the group below a half: its quantiles
    move, but the valley before them stays. Where no valley comes before the end, it is a width above the last quantile.
    """
    group = Window.partitionBy(*groups, "metric")
    rank = F.sum("n").over(group.orderBy("bin")).cast("decimal(28,0)")
    ranked = counts.select(*groups, "metric", "bin", rank.alias("rank"), F.sum("n").over(group).cast("decimal(28,0)").alias("total"))
    ranked = ranked.withColumn("share", F.expr(f"(rank * {_PARTS}) div total"))
    ahead = group.orderBy("share").rangeBetween(int(VALLEY * _PARTS), Window.unboundedFollowing)
    width = F.create_map(*[F.lit(x) for m, w in WIDTH.items() for x in (m, round(w * SCALE))])[F.col("metric")]
    steps = ranked.withColumn("next", F.min("bin").over(ahead)).withColumn("width", width)
    steps = steps.where(F.col("share") >= int(CENTRE * _PARTS))
    wide = F.col("next").isNull() | (F.col("next") - F.col("bin") >= F.col("width"))
    middle = F.coalesce(F.expr("(bin + next) div 2"), F.col("bin") + F.col("width"))
    return steps.groupBy(*groups, "metric").agg(
        F.min("bin").alias("centre"), F.min(F.when(wide, F.struct("bin", middle.alias("top")))).alias("first")
    ).select(*groups, "metric", "centre", F.col("first.top").alias("top"))


def thresholds(own: DataFrame) -> DataFrame:
    """(lang_key, source_key, one column max_... per metric): the largest value that a document of the group may have.

    own is the sketch per language and source, of documents that pass the base rule. PRIOR_DOCUMENTS documents' worth
    of the language's sketch are merged into each source's, so a source with few documents is judged mostly by its
    language and a large one by itself; and a source is at most BOUND times as lenient as its language, from the median.
    """
    lang = own.groupBy("lang_key", "metric", "bin").agg(F.sum("n").alias("n"))
    whole = lang.groupBy("lang_key", "metric").agg(F.sum("n").cast("decimal(14,0)").alias("total"))
    sources = own.select("lang_key", "source_key", "metric").distinct()
    mine = own.join(whole, ["lang_key", "metric"])
    mine = mine.select("lang_key", "source_key", "metric", "bin", (F.col("n").cast("decimal(14,0)") * F.col("total")).alias("n"))
    prior = sources.join(lang, ["lang_key", "metric"]).select(
        "lang_key", "source_key", "metric", "bin", (F.col("n") * PRIOR_DOCUMENTS).cast("decimal(29,0)").alias("n")
    )
    merged = mine.unionByName(prior).groupBy("lang_key", "source_key", "metric", "bin").agg(F.sum("n").alias("n"))
    bounds = valleys(lang, ["lang_key"]).select("lang_key", "metric", ((F.col("top") - F.col("centre")) * BOUND).alias("reach"))
    tops = valleys(merged, ["lang_key", "source_key"]).join(bounds, ["lang_key", "metric"])
    top = F.least("top", F.col("centre") + F.col("reach"))
    return tops.groupBy("lang_key", "source_key").agg(
        *[F.max(F.when(F.col("metric") == m, top)).alias(f"max_{m}") for m in METRICS]
    )


def _key(name: str) -> Column:
    return F.when(F.col(name).isNull(), "n").otherwise(F.concat(F.lit("s"), name))


def _measured(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), _key("lang").alias("lang_key"), _key("source").alias("source_key"), "text")
    return staged(base_measures(rows).drop("text"), "quality-measures")


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, mark, lang_key, source_key, the base measures, base_failed and kept, of every row.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT percent of the words in repeated 3-word
    windows. kept is false for those, and where a metric is over its adaptive threshold. A NULL text has no words and
    fails. NULL languages and sources are groups of their own; rows with equal values are judged alike; an empty table
    gives no rows. Only doc_id, text, lang and source are read. Counts are added up in each task before they are
    shuffled, so a group of any size comes as a few hundred bins.
    """
    measures = _measured(docs)
    limits = thresholds(staged(sketch(measures.where(~_base_failed()), ["lang_key", "source_key"]), "quality-sketch"))
    fine = F.lit(True)
    for m, c in metric_columns().items():
        fine = fine & F.coalesce(c <= F.col(f"max_{m}"), F.lit(True))
    return measures.join(limits, ["lang_key", "source_key"], "left").select(
        *measures.columns, _base_failed().alias("base_failed"), (~_base_failed() & fine).alias("kept")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that judged keeps, with the columns of docs as they are.

    Rows are told apart by doc_id, text, lang and source, NULLs included, so repeated rows stay or go together; columns
    of any other name pass through, and an empty table stays empty.
    """
    key = ("doc_id", "mark", "lang_key", "source_key")
    good = judged(docs).where("kept").select(*[F.col(c).alias(f"k_{c}") for c in key]).distinct()
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("m"), _key("lang").alias("l"), _key("source").alias("s"),
    )
    same = F.col("d").eqNullSafe(F.col("k_doc_id")) & (F.col("m") == F.col("k_mark")) & (F.col("l") == F.col("k_lang_key")) & (F.col("s") == F.col("k_source_key"))
    return rows.join(good, same, "left_semi").select("row.*")
