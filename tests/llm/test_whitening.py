"""Whitening against whole-number arithmetic over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import whitening as W


@pytest.mark.parametrize("bits", [1, 4, 9, 20, 33, 62])
def test_cross_products(bits):
    """Bit planes against products of Python's whole numbers."""
    rng = np.random.default_rng(bits)
    for rows, dims in ((1, 1), (63, 5), (64, 3), (200, 7)):
        x = rng.integers(-(2**bits), 2**bits, (rows, dims))
        x[:, 0] = x[0, 0]  # a constant dimension has no plane
        sums, products = W.cross_products(x)
        o = x.astype(object)
        assert sums == o.sum(0).tolist() and products == (o.T @ o).tolist()
    ends = np.array([[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1], [0, 5]])
    assert W.cross_products(ends)[1] == (ends.astype(object).T @ ends.astype(object)).tolist()
    assert all(W.whole(W.limbs(v)) == v for v in (0, -1, 2**140 + 12345, -(2**150), -(2**39)))


def brute(rows):
    """{(repr of id, values): ...} of the contract for rows (vec_id, list)."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    v = np.array([[sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit) / n**3 for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in kept:
        c = [n * x[k] - s[k] for k in range(d)]
        for k in range(min(4, d)):
            out.append((str(i), k + 1, n, sum(t * t for t in c), abs(sum(t / n * u[j, k] for j, t in enumerate(c)) / math.sqrt(e[k])), e[k] / np.trace(v)))
    return sorted(out)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6)) * [3, 2.5, 2, 1.5, 1, 0.5] + [0, 1, -1, 5, 0, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, x[i].tolist()) for i in range(40)] + [(None, x[3].tolist()), (7, (x[7] + 1e-9).tolist()), (900, [0.0] * 6), (901, [-0.0] * 6)]
    bad = [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] + [1.0] * 5), (1003, [float("inf")] + [1.0] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "dims", "deviation", "whitened", "i", "j")})
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = W.op12_embedding_whitening(spark, str(tmp_path))
    got = sorted((str(r.vec_id), r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in out.collect())
    want = brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert 0 <= out.first().identity_error < 1e-9
    signs = {r.vec_id: r.whitened for r in out.where("component = 1").collect()}
    assert signs[3] == signs[503] and signs[900] == signs[901]


def test_hard_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    none = W.learn(make([(1, None)]).limit(0))
    assert none.n == 0 and W.whiten(make([(1, [1.0])]).limit(0), none).count() == 0
    same = make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    m = W.learn(same)
    assert m.n == 1 and [list(r.whitened) for r in W.whiten(same, m).collect()] == [[], []]
    ragged = make([(i, [float(i), float(i * i % 7)]) for i in range(20)] + [(90, [1.0]), (91, []), (92, [1.0] * 3)])
    m = W.learn(ragged)
    assert m.n == 20 and W.whiten(ragged, m).count() == 20
    flat = make([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])
    m = W.learn(flat)
    assert len(m.values) == 1 and m.identity_error < 1e-9
    huge = make([(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)])
    m = W.learn(huge)
    x = [[(2**63 - 1) if i % 2 == 0 else -(2**63), 256 * i] for i in range(6)]
    s = [sum(c) for c in zip(*x)]
    want = [sum((6 * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    assert m.sums == s and [int(r.deviation) for r in W.whiten(huge, m).orderBy("vec_id").collect()] == want
    many = spark.range(0, 40000, 1, 7).select(F.col("id").alias("vec_id"), F.array(*(F.hash("id", F.lit(k)) % 1000 / 100.0 for k in range(5))).alias("embedding"))
    m = W.learn(many)
    x = np.floor(256 * np.array(many.select("embedding").toPandas().embedding.tolist())).astype(np.int64)
    x = np.unique(x, axis=0)
    assert m.n == len(x) and m.sums == x.sum(0).tolist() and m.identity_error < 1e-9
