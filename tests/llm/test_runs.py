"""Suffix trees, extensions and periodic runs against plain versions."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from rotaspark.llm import periodic_runs
from rotaspark.llm.queries import op12_periodic_runs
from rotaspark.llm.suffix_tree import Extensions, SuffixTree

from .support import documents, empty, prose, rows_of

WORD = r"[^\x20\x09-\x0D]+"


def plain_runs(words, min_length=6, min_copies=4):
    """All stretches where words one period apart agree, periods in rising order; multiples of a found period drop out."""
    number = {}
    s = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = []
    for q in range(1, len(s) // min_copies + 1):
        same = np.concatenate(([0], (s[q:] == s[:-q]).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = b - a + q
            if length >= max(min_length, min_copies * q) and not any(
                q % p == 0 and x <= a and a + length <= x + n for x, n, p in found
            ):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    lost = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in lost]


def repetitive(rng, n):
    out = []
    while len(out) < n:
        block = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        out += block * rng.randint(1, 7) + block[: rng.randint(0, len(block))]
        if rng.random() < 0.3:
            out += [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(1, 20))]
    return out[:n]


def test_tree_and_extensions():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 40, 200):
        for letters in (1, 2, 4):
            s = [rng.randint(1, letters) for _ in range(n)]
            order, least = SuffixTree(s).tour()
            assert order.tolist() == sorted(range(n + 1), key=lambda i: s[i:])
            turned = SuffixTree(s).tour(descending=True)[0]
            assert turned.tolist() == sorted(range(n + 1), key=lambda i: [-x for x in s[i:]])
            i, j = (x.ravel() for x in np.meshgrid(range(n + 1), range(n + 1)))
            i, j = i[i != j], j[i != j]

            def common(a, b):
                k = 0
                while max(a, b) + k < n and s[a + k] == s[b + k]:
                    k += 1
                return k

            if n:
                assert Extensions(order, least).of(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_runs_are_those_of_all_periods():
    rng = random.Random(2)
    for n in range(120):
        words = repetitive(rng, n) if n % 2 else [rng.choice("ab") for _ in range(n)]
        raw = [w.encode() for w in words]
        for least, copies in ((6, 4), (2, 2), (1, 3), (10, 2)):
            want = plain_runs(words, least, copies)
            assert [tuple(r) for r in periodic_runs.word_runs(raw, least, copies).tolist()] == want, (words, least, copies)
        runs = periodic_runs.word_runs(raw)
        assert [w.decode() for w in periodic_runs.collapsed(raw, runs)] == plain_collapse(words, plain_runs(words))


def test_long_stretches_take_near_linear_time():
    rng = random.Random(3)
    block = [rng.randint(1, 50) for _ in range(5000)]
    took = []
    for copies in (5, 20):
        began = time.time()
        assert periodic_runs.runs_of(block * copies).tolist()[-1] == [0, 5000 * copies, 5000]
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1
    assert periodic_runs.runs_of([1] * 30000).tolist() == [[0, 30000, 1]]


def test_find_runs(spark):
    rng = random.Random(4)
    base = documents(spark, extra="runs")
    words = repetitive(rng, 900)
    more = [(400, " \n".join(words), "en", "a", 1, "x"), (401, "é é é é é é é é é\x1cé é", "fr", "a", 1, "x"), (400, "a b " * 9, "en", "a", 1, "x")]
    docs = base.union(spark.createDataFrame(more, base.schema)).withColumn("n_words", base.doc_id)
    got = periodic_runs.find_runs(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "runs", "collapsed"]

    def want(text):
        words = (text or "").encode().split()
        runs = plain_runs(words)
        return len(words), runs, b" ".join(plain_collapse(words, runs)).decode()

    plain = sorted((str(r.doc_id), *want(r.text)) for r in docs.collect())
    seen = sorted((str(r["doc_id"]), r["n_words"], [tuple(x.values()) for x in r["runs"]], r["collapsed"]) for r in rows_of(got))
    assert seen == plain and sum(len(r[2]) for r in seen) > 20
    assert periodic_runs.find_runs(empty(docs)).count() == 0
    with pytest.raises(ValueError, match="two copies"):
        periodic_runs.find_runs(docs, min_copies=1)


def contract(doc_id, text):
    import re

    words = re.findall(WORD, text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    a, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
    milli = None if q is None else 1000 * length // q
    return doc_id, len(runs), a, length, q, milli, sha(listed), sha(" ".join(plain_collapse(words, runs)))


def test_query_follows_its_contract(spark, tmp_path):
    got = op12_periodic_runs(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(map(tuple, got.collect())) == sorted(contract(d.doc_id, d.text) for d in docs)
    rng = random.Random(6)
    rows = [(i, " ".join(repetitive(rng, rng.randint(0, 300))) if i % 3 else prose(rng, rng.randint(0, 60))) for i in range(150)]
    rows += [(200 + i, None) for i in range(20)] + [(300 + i, "one") for i in range(20)] + [(4, rows[4][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((contract(i, t) for i, t in rows), key=str)
