"""Line de-duplication over a corpus: explode, hash, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.llm.common import BLANKS, staged

MIN_POINTS = 40
MIN_DOCS = 5
#: Parts into which the lines of one frequent key are spread.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, ASCII letters lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with the kept lines as `text`, then `n_lines` (before) and `n_dropped`.

    A key of at least min_points code points that occurs in at least min_docs documents loses all its lines except
    those of the largest doc_id holding it. A NULL or empty text is one empty line. Rows with a NULL doc_id count as
    one document, below all others; rows with one doc_id are one document, and each keeps its own lines. Columns of
    docs named n_lines or n_dropped are replaced, and so is text; all others pass through. An empty table stays empty.

    Keys travel as two 64-bit hashes. Documents are counted from distinct (key, doc_id) rows, so no key is gathered
    anywhere; the few frequent keys are copied to SALTS salts before they meet their lines. A text with lost lines is
    split once more, into a column of its own, and put together from the positions that are left, so the work is linear
    in its lines.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.xxhash64(text).alias("mark"), _lines(F.col("text")).alias("lines"))
    lines = split.select("doc_id", "mark", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_points).select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.length("key") >= min_points).select(
        "doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )
    keyed = staged(keyed, "line-keys")
    holders = keyed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    frequent = holders.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    frequent = frequent.where(F.col("n") >= min_docs).select(
        "h1", "h2", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int"))
    lost = salted.join(frequent, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = lost.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("drops"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64(text).alias("m"))
    joined = rows.join(drops, F.col("d").eqNullSafe(drops["doc_id"]) & (F.col("m") == drops["mark"]), "left")
    joined = joined.select("row", "drops", F.when(F.col("drops").isNotNull(), _lines(F.col("row.text"))).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    whole_text = F.coalesce("row.text", F.lit(""))
    n_lines = F.length(whole_text) - F.length(F.replace(whole_text, F.lit("\n"), F.lit(""))) + 1
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(rebuilt)
    return joined.select(
        *[whole.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
    )
