"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined to the template positions. A copy of a template lies on one
diagonal (word position minus template position); votes are counted per diagonal, diagonals that lie next to each other
are merged, since a copy with a word more or less moves to the next one, and the span of each merged diagonal is
verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import staged
from rotaspark.llm.license_texts import PHRASES, TEMPLATES
from rotaspark.llm.wordhash import alnum_mask, code_points, kgram_hashes, lower_ascii, word_bounds, word_hashes

K = 3
#: Diagonals at most so far apart are one copy; the shares of a template's k-grams and words that a copy must have.
DRIFT = 3
MIN_VOTES = 0.3
MIN_COVER = 0.9
#: Phrases that tell neighbouring licences apart, and what they say: a span must say what its template says, no more.
DECIDING = {
    "lesser general": "lesser", "library general": "lesser", "affero general": "affero", "sharealike": "sa",
    "noncommercial": "nc", "noderivatives": "nd", "noderivs": "nd",
}


def words_of(text: str | None) -> np.ndarray:
    points = lower_ascii(code_points(text))
    return word_hashes(points, *word_bounds(alnum_mask(points)))


def phrase_places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The word positions at which the phrase's words stand one after another."""
    n = words.size - phrase.size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    found = np.ones(n, bool)
    for i, w in enumerate(phrase):
        found &= words[i : i + n] == w
    return np.flatnonzero(found)


def said(words: np.ndarray, deciding: Sequence[tuple[str, np.ndarray]]) -> set[str]:
    """What the deciding phrases among the words say."""
    return {what for what, p in deciding if phrase_places(words, p).size}


def version_words(label: str, words: np.ndarray) -> set[int]:
    """The words of the version at the end of the label, as far as they stand among the template's words."""
    version = re.search(r"-(\d+(\.\d+)*)$", label)
    return set(words_of(version[1]).tolist()) & set(words.tolist()) if version else set()


def template_grams(spark: SparkSession, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """(gram, template, place): bounded by the words of the templates, which the library or the caller lists."""
    rows = [
        (int(g), t, p)
        for t, (_, text) in enumerate(templates)
        for p, g in enumerate(kgram_hashes(words_of(text), k).view(np.int64).tolist())
    ]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def phrase_counts(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """doc_id, mark, n_words, n_base, first_word, last_word, base (labels, sorted) of every row."""
    known = [(label, words_of(p)) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                found = [(label, phrase_places(words, p)) for label, p in known]
                places = np.concatenate([x for _, x in found])
                ends = (int(places.min()), int(places.max())) if places.size else (None, None)
                labels = sorted({label for label, x in found if x.size})
                out.append((doc_id, mark, words.size, places.size, *ends, labels))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _COUNTS.types)], schema=_COUNTS)

    return docs.mapInArrow(
        run, "doc_id long, mark long, n_words long, n_base long, first_word long, last_word long, base array<string>"
    )


_COUNTS = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [("base", pa.list_(pa.string()))]
)


def diagonal_hits(docs: DataFrame, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """doc_id, mark, template, diagonal, votes: the distinct template positions found on each diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [kgram_hashes(words_of(t), k).view(np.int64) for t in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *(g.size for g in grams)])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *grams])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["doc_id", "mark", "grams"])

    rolled = docs.mapInArrow(run, "doc_id long, mark long, grams array<long>")
    rolled = rolled.select("doc_id", "mark", F.posexplode("grams").alias("pos", "gram"))
    hits = rolled.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "gram")
    diagonal = (F.col("pos") - F.col("place")).alias("diagonal")
    return hits.groupBy("doc_id", "mark", "template", diagonal).agg(F.size(F.collect_set("place")).alias("votes"))


def candidate_spans(hits: DataFrame, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """doc_id, mark, template, at: merged diagonals with enough votes, each at its strongest (ties: first) diagonal."""
    near = Window.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= DRIFT, 0).otherwise(1)
    merged = hits.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(near))
    spans = merged.groupBy("doc_id", "mark", "template", "band").agg(
        F.sum("votes").alias("votes"), F.max_by("diagonal", F.struct("votes", -F.col("diagonal"))).alias("at")
    )
    needed = F.array(*[F.lit(max(1.0, MIN_VOTES * (words_of(t).size - k + 1))) for _, t in templates])
    return spans.where(F.col("votes") >= F.element_at(needed, F.col("template") + 1)).drop("band", "votes")


def verified_spans(docs: DataFrame, spans: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """doc_id, mark, label, template, first_word, last_word, cover: spans that hold enough of the template in order.

    cover is the number of words that an alignment finds, over the length of the template or of the aligned words,
    whichever is more, so a missing word and an extra one both count. The span searched is as long as the template and
    a quarter more on both sides. A span that lacks or adds a deciding phrase, or lacks a word of the version that the
    template's label names, is a neighbouring licence's and is left out at any cover.
    """
    deciding = [(what, words_of(p)) for p, what in DECIDING.items()]
    texts_of = [(label, words_of(t)) for label, t in templates]
    known = [(label, w.tolist(), said(w, deciding), version_words(label, w)) for label, w in texts_of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, mark, template, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                label, wanted, says, version = known[template]
                words = words_of(text)
                slack = DRIFT + len(wanted) // 4
                start = max(0, at - slack)
                span = words[start : max(0, at + len(wanted) + slack)].tolist()
                blocks = SequenceMatcher(None, span, wanted, autojunk=False).get_matching_blocks()[:-1]
                if not blocks:
                    continue
                first, last = blocks[0].a, blocks[-1].a + blocks[-1].size - 1
                cover = sum(b.size for b in blocks) / max(len(wanted), last - first + 1)
                held = words[start + first : start + last + 1]
                if cover >= MIN_COVER and said(held, deciding) == says and version <= set(held.tolist()):
                    out.append((doc_id, mark, label, template, start + first, start + last, cover))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SPANS.types)], schema=_SPANS)

    texts = docs.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "text")
    joined = spans.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    return joined.select("doc_id", "mark", "template", "at", "text").mapInArrow(
        run, "doc_id long, mark long, label string, template int, first_word long, last_word long, cover double"
    )


_SPANS = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("label", pa.string()), ("template", pa.int32())]
    + [("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]
)


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    k: int = K,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Words are runs of letters, digits and characters beyond ASCII, ASCII letters lower-cased. Phrases are counted at
    all places; labels adds those of verified template spans. score is the largest share of a template that a verified
    span covers, 1 where a phrase stands, else 0. A NULL or empty text has no words, labels '' and score 0. Rows with
    one doc_id and text share their spans and each give a row; rows of NULL doc_id are told apart by their texts. Other
    columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text"
    )
    spans = staged(candidate_spans(diagonal_hits(rows, templates, k), templates, k), "license-spans")
    found = verified_spans(rows, spans, templates).groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    found = found.agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    joined = phrase_counts(rows, phrases).join(
        found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left"
    )
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
