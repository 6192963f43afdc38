"""Token-id output as byte or bit planes.

A written set is a folder with two Parquet tables:

* `segments`: runs of whole documents in ascending doc_id order. A row holds the document ids and lengths and the ids
  in blocks of fixed size; a block's little-endian 32-bit ids are transposed into 4 byte planes or 32 bit planes, and
  each plane is compressed with zstandard by itself.
* `index`: for every segment its shard, number, id count and the count of all ids before it.

Parquet carries the planes so that every file system Spark knows can hold a set, and Spark's commit protocol keeps
exactly one copy of each segment when executors are lost.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.llm.bpe_codec import vocabulary_path

END_ID = 2
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 19
_BEFORE = (Window.unboundedPreceding, -1)
_BLOCK = pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))])
_SEGMENT = pa.schema(
    [
        ("shard", pa.int32()),
        ("segment", pa.int32()),
        ("kind", pa.string()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("blocks", pa.list_(_BLOCK)),
    ]
)
_SEGMENT_DDL = (
    "shard int, segment int, kind string, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
    "blocks array<struct<n: int, planes: array<binary>>>"
)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The raw planes of uint32 ids: 4 byte planes, or 32 bit planes with the lowest bit first."""
    cells = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [cells[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")


@cache
def _library_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    from rotaspark.llm.pretokens import IdEncoder

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    return IdEncoder(tokenizer)


def _ids_of_texts(encoder, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
    """uint32 ids of each text in turn, the end id last."""
    done, found = 0, []
    end = np.array([end_id], np.uint32)
    for i, ids in encoder.parts(texts):
        while done < i:
            yield np.concatenate([*found, end])
            done, found = done + 1, []
        found.append(ids)
    while done < len(texts):
        yield np.concatenate([*found, end])
        done, found = done + 1, []


def write_planes(
    docs: DataFrame,
    path: str,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    kind: str = "byte",
    block_ids: int = BLOCK_IDS,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encodes every whole text and writes the set to path.

    NULL texts are empty and hold the end id only; NULL doc_ids come first; rows with the same doc_id follow each other
    ordered by text. An empty table gives an empty set. Only doc_id and text are read. A segment holds whole documents
    and is closed at segment_ids, so a document longer than that fills one segment, in many blocks.
    """
    if kind not in ("byte", "bit"):
        raise ValueError(f"unknown plane kind {kind!r}")
    tokenizer_path = tokenizer_path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _library_encoder(tokenizer_path), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=3)
        doc_ids: list = []
        held: list[np.ndarray] = []
        size = segment = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            blocks = [
                {"n": b.size, "planes": [packer.compress(p) for p in to_planes(b, kind)]}
                for b in (ids[a : a + block_ids] for a in range(0, ids.size, block_ids))
            ]
            row = dict(shard=shard, segment=segment, kind=kind, n_ids=ids.size, doc_ids=doc_ids, blocks=blocks)
            return pa.RecordBatch.from_pylist([row | {"lengths": [x.size for x in held]}], _SEGMENT)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, _ids_of_texts(encoder, batch.column(1).to_pylist(), end_id)):
                doc_ids.append(key)
                held.append(ids)
                size += ids.size
                if size >= segment_ids:
                    yield close()
                    doc_ids, held, size, segment = [], [], 0, segment + 1
        if held:
            yield close()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SEGMENT_DDL).write.option("compression", "none").parquet(f"{path}/segments")
    segments = spark.read.parquet(f"{path}/segments").select("shard", "segment", "n_ids")
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    shards = shards.select("shard", F.sum("shard_ids").over(Window.orderBy("shard").rowsBetween(*_BEFORE)).alias("shard_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(*_BEFORE))
    index = segments.withColumn("inside", inside).join(shards, "shard")
    zero = F.lit(0).cast("long")
    index.select(
        "shard", "segment", "n_ids", (F.coalesce("shard_start", zero) + F.coalesce("inside", zero)).alias("first_id")
    ).write.parquet(f"{path}/index")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their place inside a segment, and the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = np.concatenate(
                    [from_planes([unpacker.decompress(p) for p in b["planes"]], b["n"], row["kind"]) for b in row["blocks"]]
                )
                raw, lengths = ids.tobytes(), np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                first = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * lengths.size, pa.int32()),
                        pa.array([row["segment"]] * lengths.size, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(first),
                        pa.array(lengths),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist())], pa.binary()),
                    ],
                    ["shard", "segment", "doc_id", "inside", "n_tokens", "ids_le"],
                )

    index = spark.read.parquet(f"{path}/index").select("shard", "segment", "first_id")
    rows = spark.read.parquet(f"{path}/segments").mapInArrow(
        run, "shard int, segment int, doc_id long, inside long, n_tokens long, ids_le binary"
    )
    return rows, index


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_le of every document of the set."""
    rows, index = _open(spark, path)
    return rows.join(index, ["shard", "segment"]).select(
        "doc_id", (F.col("first_id") + F.col("inside")).alias("start"), "n_tokens", "ids_le"
    )


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the ids read back."""
    rows, index = _open(spark, path)
    small = rows.withColumn("ids_crc32", F.crc32("ids_le")).drop("ids_le")
    return small.join(index, ["shard", "segment"]).select(
        "doc_id", (F.col("first_id") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
