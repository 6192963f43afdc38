"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.llm import (
    bpe_codec,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    oracles,
    periodic_runs,
    preferences,
    quality_rules,
    secrets,
    token_planes,
    toxicity,
    whitening,
    winnowing,
)
from rotaspark.llm.common import new_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-planes")
    token_planes.write_planes(table(spark, sf_dir, "documents"), path)
    return token_planes.document_digests(spark, path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digests(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.format_pairs(preferences.conversation_pairs(table(spark, sf_dir, "conversations")))
    joined = lambda side: F.array_join(F.transform(side, lambda s: s["text"]), "")
    run = lambda s: F.concat(F.when(s["train"], "1x").otherwise("0x"), F.length(s["text"]))
    mask = lambda side: F.array_join(F.transform(side, run), " ")
    return pairs.select(
        "conv_id", "other_id", "n_turns", "n_prompt_turns", "prompt",
        joined("chosen").alias("chosen"), joined("rejected").alias("rejected"),
        mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    named = [
        op1_token_planes,
        op2_quality_rules,
        op3_bpe_codec,
        op4_ngram_join,
        op5_toxicity,
        op6_preference_format,
        op7_line_dedup,
        op8_source_mix,
        op9_winnowing,
        op10_license_scan,
        op11_whitening,
        op12_periodic_runs,
        op13_secret_scan,
        pipeline,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": oracles.QUALITY,
        "op6_preference_format": oracles.PREFERENCES,
        "op7_line_dedup": oracles.LINE_DEDUP,
        "op13_secret_scan": oracles.SECRETS,
    }
