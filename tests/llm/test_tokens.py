"""BPE codec and token planes against the tokenizers library."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rotaspark.llm import bpe_codec, pretokens, token_planes
from rotaspark.llm.bpe_tree import TreeBpe
from rotaspark.llm.common import new_path

from .support import documents, empty, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)

HARD = [
    "", " ", "  ", "\n", "a", "'s", "it's 're'll 'x ''s '  's \n's", "don't  you'd've", "!'s", "x  \n  y\n",
    "  <|endoftext|>  a<|endoftext|><|endoftext|>", "<|endoftext", "日本語 テスト 12３４ ½  x　y z", "\x1c\x85  a",
    "é ñ à'll", "😀😀 👨‍👩‍👧", "'", "''", "a'", "'sam's", "'res", "'ve", "'ll'll", " 's", "\t's", "x" * 3000,
    "ab" * 5000, "\x00\x01", "1234567 89'd9",
]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return TreeBpe(PATH).encoder(LIBRARY.pre_tokenizer.pre_tokenize_str)


def test_pieces_and_merges_match_the_library(codec):
    rng = random.Random(3)
    letters = "ab' \n\tsrevldm1!é日 　😀_"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text in texts:
        assert [i for c in codec.encode(text) for i in c] == library_ids(text), repr(text[:60])


def test_long_texts_are_cut_where_a_piece_starts(codec):
    text = "the cat  sat \n on <|endoftext|> it's " * 60_000
    ids = [i for c in codec.encode(text) for i in c]
    assert ids == library_ids(text)


def test_long_pieces_and_unbroken_texts(codec):
    rng = random.Random(4)
    blob = "".join(rng.choices("ABCDEFGHabcdefgh", k=64_000))
    texts = [blob, "a" * 64_000, "日本語。テスト" * 9_000, "x\ny's\n\n z\n" * 200_000, "é" * 3000 + "\n" + "1" * 5000]
    began = time.time()
    for text in texts:
        assert [i for c in codec.encode(text) for i in c] == library_ids(text), text[:20]
    assert time.time() - began < 20
    table = TreeBpe(PATH)
    began = time.time()
    table.encode_pieces([blob])
    assert time.time() - began < 2


def test_few_and_many_pieces_are_merged_alike():
    table, rng = TreeBpe(PATH), random.Random(5)
    pieces = ["".join(rng.choices("abcdeé日 ", k=rng.randint(1, 70))) for _ in range(900)]
    many = table.encode_pieces(pieces)
    assert [ids for p in pieces for ids in table.encode_pieces([p])] == many


def test_pieces_with_equal_hashes(codec, monkeypatch):
    text = "the cat sat on the mat, the end"
    monkeypatch.setattr(pretokens, "span_hashes", lambda points, starts, ends: np.zeros(starts.size, np.uint64))
    assert [i for c in codec.encode(text) for i in c] == library_ids(text)


class Counted:
    """The library's tokenizer, with the number of texts it was given."""

    def __init__(self):
        self.texts = 0

    def __getattr__(self, name):
        return getattr(LIBRARY, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return LIBRARY.encode_batch_fast(texts, **options)


def test_ids_by_the_library_match_it():
    rng = random.Random(6)
    letters = "ab' \n\tsrevldm1!é日 　😀_"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for memo in (500_000, 5):
        encoder = pretokens.IdEncoder(LIBRARY, memo_pieces=memo)
        for text in texts:
            assert encoder.encode(text) == library_ids(text), repr(text[:60])
        got = [[] for _ in texts]
        for i, ids in encoder.parts(texts):
            got[i].extend(ids.tolist())
        assert got == [library_ids(t) for t in texts]


def test_distinct_words_are_given_to_the_library_many_at_once():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(3, 12))) for _ in range(20_000)]
    text, tokenizer = " ".join(words), Counted()
    encoder = pretokens.IdEncoder(tokenizer)
    assert encoder.encode(text) == library_ids(text)
    given = tokenizer.texts
    assert given < 300
    assert encoder.encode(text) == library_ids(text) and tokenizer.texts == given


def test_ids_of_pieces_with_equal_hashes(monkeypatch):
    texts = ["the cat sat on the mat, the end", "a", " dog", "the mat", " cow", " a longer one"]
    for size in (np.zeros_like, lambda x: x):  # all alike; alike if as long, also as pieces seen before
        encoder = pretokens.IdEncoder(LIBRARY)
        monkeypatch.setattr(pretokens, "span_hashes", lambda points, starts, ends: size(ends - starts).astype(np.uint64))
        for text in texts * 2:
            assert encoder.encode(text) == library_ids(text)


def test_ids_where_spaces_do_not_show():
    encoder = pretokens.IdEncoder(LIBRARY)
    encoder.spaced[:] = False
    for text in HARD + ["the cat sat on  the mat"]:
        assert encoder.encode(text) == library_ids(text)


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_distinct_keys(n):
    keys = np.random.default_rng(n).integers(0, max(n // 3, 1), n, dtype=np.uint64) << np.uint64(40)
    where, number = pretokens.distinct(keys)
    values, inverse = np.unique(keys, return_inverse=True)
    assert (keys[where] == values).all() and (number == inverse).all()
    assert (keys[where][number] == keys).all()


def test_tree_merges_leftmost_lowest_rank_first():
    table = TreeBpe(PATH)
    rank = dict(zip(table.keys.tolist(), zip(table.ranks.tolist(), table.results.tolist())))
    for piece in ["aaaaaaa", "abababab", "mississippi", " the", "é" * 9]:
        ids = table.byte_ids[list(piece.encode())].tolist()
        while True:
            found = [(rank[k][0], i) for i in range(len(ids) - 1) if (k := ids[i] * table.size + ids[i + 1]) in rank]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [rank[ids[i] * table.size + ids[i + 1]][1]]
        assert table.encode_pieces([piece]) == [tuple(ids)]


def test_codec_digests(spark):
    docs = documents(spark, extra="ids")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(bpe_codec.codec_digests(docs)))
    want = []
    for r in docs.collect():
        ids = library_ids(r.text)
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), *digest))
    assert got == sorted(want)
    assert bpe_codec.codec_digests(empty(docs)).count() == 0


def test_ids_and_round_trip(spark):
    docs = documents(spark, extra="ids")
    rows = bpe_codec.decode_ids(bpe_codec.encode_ids(docs))
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    for r in rows.collect():
        assert r.ids == library_ids(r.text)
        assert r.decoded == (r.text or "")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    draw = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        planes = token_planes.to_planes(ids, kind)
        assert len(planes) == (4 if kind == "byte" else 32)
        assert (token_planes.from_planes(planes, n, kind) == ids).all()
    with pytest.raises(ValueError):
        token_planes.write_planes(None, "x", kind="nibble")


@pytest.mark.parametrize("kind,block,segment", [("byte", 1 << 16, 1 << 19), ("bit", 64, 500)])
def test_token_planes(spark, kind, block, segment):
    docs = documents(spark, extra="start")
    path = new_path(spark, "planes")
    token_planes.write_planes(docs, path, kind=kind, block_ids=block, segment_ids=segment)
    got = token_planes.document_digests(spark, path).orderBy("start").collect()
    ordered = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    start = 0
    assert len(got) == len(ordered)
    for r, g in zip(ordered, got):
        ids = [*library_ids(r.text), token_planes.END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), crc)
        start += len(ids)
    full = token_planes.read_documents(spark, path).collect()
    assert sum(len(r.ids_le) for r in full) == 4 * start


def test_token_planes_of_nothing(spark):
    path = new_path(spark, "planes")
    token_planes.write_planes(empty(documents(spark)), path)
    assert token_planes.document_digests(spark, path).count() == 0
