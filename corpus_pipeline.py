"""The corpus pipeline: five stages from raw documents to encoded, mixed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rotaspark.llm import bpe_codec, line_dedup, mixing, ngram_join, quality_rules
from rotaspark.llm.common import staged, table


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the adaptive quality rules keep.

    NULL and empty texts fail the base rule; NULL languages and sources are groups of their own; repeated rows stay or
    go together; very long texts are measured whole; other columns pass through, and an empty table stays empty.
    """
    return quality_rules.kept_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of at least 40 code points that at least five documents share, but for their last holder.

    No document goes: one that loses all its lines stays with an empty text. A NULL text stays NULL; rows without a
    doc_id are one document below all others; rows with one doc_id are one document; work is linear in the lines of a
    text; columns named n_lines or n_dropped are computed anew, others pass through; an empty table stays empty.
    """
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of every group that similar texts link.

    Of repeated rows one stays; rows without a doc_id take part under ids of their texts; NULL texts and texts without
    words are similar to nothing; other columns pass through whatever their names, and an empty table stays empty.
    """
    return ngram_join.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at 150% of their words, in the order of finish times; a document taken twice is two rows.

    A NULL source is a source of its own; NULL and empty texts have no words and are not taken; repeated rows are taken
    alike; other columns pass through, and an empty table stays empty.
    """
    return mixing.mix_documents(docs)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each document's ids and of the text decoded from them.

    A NULL or empty text has no tokens; repeated rows give repeated results; NULL ids stay NULL; other columns are
    dropped, and an empty table gives no rows.
    """
    return bpe_codec.codec_digests(docs)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's rows are written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
