"""BPE encoding and decoding by segment trees: ids of every text and the text they stand for."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces that a Python worker remembers, about 60 MB.
MEMO_PIECES = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _codec(path: str, digests: bool):
    """An encoder whose codes are ids, or what digests need of them: how many, their decimal list and their bytes."""
    from tokenizers import Tokenizer

    from rotaspark.llm.bpe_tree import TreeBpe

    table = TreeBpe(path)

    def code(ids: tuple[int, ...]) -> tuple[int, bytes, bytes]:
        return len(ids), b"".join(b"%d," % i for i in ids), b"".join(table.token_bytes[i] for i in ids)

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    return table.encoder(split, code if digests else None, MEMO_PIECES)


def _tables(group) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    if group.tables is None:
        sizes, listed, raw = zip(*group.codes)
        group.tables = np.array(sizes), listed, raw
    return group.tables


def encode_ids(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """All columns of docs and `ids` (array<int>): the ids of every whole text.

    A NULL text counts as empty and has no ids. Rows, order and other columns stay as they are; a column named `ids`
    is replaced.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, False)
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for i, group, number in codec.parts(batch.column("_text").to_pylist()):
                for x in number.tolist():
                    out[i].extend(group.codes[x])
            kept = [batch.column(n) for n in batch.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names[:-1], "ids"])

    kept = docs.drop("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.withColumn("_text", F.col(text)).mapInArrow(run, f"{schema}, ids array<int>")


def decode_ids(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns and `decoded`: the text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rotaspark.llm.bpe_tree import TreeBpe

        token_bytes = TreeBpe(path).token_bytes
        for batch in batches:
            texts = [b"".join(token_bytes[i] for i in row or ()).decode("utf-8", "replace") for row in batch.column("_ids").to_pylist()]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "decoded"])

    kept = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.withColumn("_ids", F.col(ids)).mapInArrow(run, f"{schema}, decoded string")


def codec_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again.

    A NULL or empty text has 0 tokens and the digests of the empty string; repeated rows give repeated results; other
    columns are ignored. Texts are worked on in parts, cut where a piece starts for certain (see PieceEncoder.parts), so
    memory follows the longest stretch of a text without such a place: about 60 bytes for each byte of one long piece.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, True)
        for batch in batches:
            n = batch.num_rows
            counts, ids, texts = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for i, group, number in codec.parts(batch.column(1).to_pylist()):
                sizes, listed, raw = _tables(group)
                places = number.tolist()
                ids[i].update((b"," if counts[i] else b"") + b"".join([listed[x] for x in places])[:-1])
                counts[i] += int(sizes[number].sum())
                decoded = b"".join([raw[x] for x in places])
                texts[i].update(decoded.decode("utf-8", "replace").encode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())]
                + [pa.array([h.hexdigest() for h in hs], pa.string()) for hs in (ids, texts)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
