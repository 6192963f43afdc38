"""Whitening against exact fractions and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rotaspark.llm import whitening
from rotaspark.llm.queries import op11_whitening

from .support import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, n string, whitened string"


def vectors(spark, n=300, d=6):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) + draw.normal(size=d)
    rows = [(i, [float(c) for c in x], 1, "x", None) for i, x in enumerate(base)]
    rows += [(1000 + i, rows[7][1], 1, "copy", "y") for i in range(40)]
    rows += [
        (7, rows[7][1], 1, "again", None),
        (None, rows[8][1], None, None, None),
        (2000, None, 1, "x", None),
        (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "x", None),
        (2002, [math.nan, 0.0, 0.0, 0.0, 0.0, 0.0], 1, "x", None),
        (2003, [0.0, -math.inf, 0.0, 0.0, 0.0, 0.0], 1, "x", None),
        (2004, [0.5, 0.5], 1, "short", None),
        (2005, [], 1, "empty", None),
        (2006, [-0.0, -0.001, 0.001, 0.0, 0.0, 0.0], 1, "zeros", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plain(table):
    """Every step again from lists of whole numbers and fractions."""
    kept = []
    for r in table.collect():
        v = r.embedding
        if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v):
            kept.append((r.vec_id, tuple(math.floor(256 * c) for c in v)))
    distinct = sorted({x for _, x in kept})
    n, d = len(distinct), 6
    sums = [sum(x[i] for x in distinct) for i in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in distinct) / n for j in range(d)] for i in range(d)]
    return kept, n, sums, np.array([[float(c) for c in row] for row in cov])


def test_whitening_is_exact(spark):
    table = vectors(spark)
    model = whitening.fit(table, components=6)
    kept, n, sums, cov = plain(table)
    assert model.n == n and list(model.sums) == sums
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(6), atol=1e-13)
    assert np.allclose(model.vectors * model.values @ model.vectors.T, cov, rtol=1e-13, atol=1e-9)
    assert np.allclose(np.sort(np.linalg.eigvalsh(cov))[::-1], model.values, rtol=1e-12)
    got = rows_of(whitening.whiten(table, model))
    assert len(got) == 6 * len(kept) and list(got[0]) == ["vec_id", *(r[0] for r in whitening._RESULT)]
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    for key, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        mine = by[key, deviation]
        want = [(np.array(x) - np.array(sums) / n) @ model.vectors[:, k] / math.sqrt(model.values[k]) for k in range(6)]
        assert np.allclose([mine[k + 1]["whitened"] for k in range(6)], want, atol=1e-10)
        assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in mine.values())
    assert abs(sum(r["explained"] for r in by[kept[0][0], next(d for k, d in by if k == kept[0][0])].values()) - 1) < 1e-12
    again = rows_of(whitening.whiten(table, whitening.fit(table.repartition(5), components=6)))
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_wide_numbers_stay_exact(spark):
    """Values beyond what sums of 64 bits hold: the sums are whole, and a deviation too large for a long is NULL."""
    rows = [(i, [float(x * 2.0**40), float(x * x - 3.0)]) for i, x in enumerate(range(-20, 21))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(table)
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    mean = [Fraction(sum(c), 41) for c in zip(*x)]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / 41) for j in range(2)] for i in range(2)]
    back = model.vectors * model.values @ model.vectors.T
    assert np.allclose(back, cov, rtol=1e-12, atol=1e-12 * cov[0][0])
    got = rows_of(whitening.whiten(table, model))
    assert len(got) == 82 and all(r["deviation"] is None for r in got if r["vec_id"] != 20)


def test_vectors_without_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.001])], "vec_id long, embedding array<double>")
    got = rows_of(whitening.whiten(same, whitening.fit(same)))
    assert len(got) == 6
    assert {(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)
    }
    line = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in rows_of(whitening.whiten(line, whitening.fit(line)))}
    assert abs(got[1, 1]["whitened"] + 1) < 1e-12 and got[1, 2]["whitened"] is None and abs(got[2, 1]["explained"] - 1) < 1e-12
    nothing = vectors(spark).where("vec_id = 2000")
    assert whitening.fit(nothing) is None and whitening.whiten(nothing, None).count() == 0
    wide = spark.createDataFrame([(1, [0.5] * 2049)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="2049 dimensions"):
        whitening.fit(wide)


def test_whitening_query(spark):
    got = op11_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 4 * 500 and {r.component for r in got} == {1, 2, 3, 4}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    x = np.array([[math.floor(256 * c) for c in r.embedding] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()])
    x = np.unique(x, axis=0)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    share = sorted({(r.component, r.explained) for r in got})
    assert np.allclose([e for _, e in share], values[:4] / values.sum(), rtol=1e-9)
