"""Matrix operators against numpy over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import matrices as M


def test_means(spark, monkeypatch):
    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0, None]), ("a", 2, [5.0]), ("a", 2, [7.0, 8.0, 9.0]), (None, 1, [1.0]), ("b", 1, None), ("c", 1, []), ("d", 1, [None, 1.0])]
    df = spark.createDataFrame(rows, "g string, h int, v array<double>").repartition(3)
    want = {("a", 1): ([2.0, 2.0], 2), ("a", 2): ([6.0, 8.0, 9.0], 2), (None, 1): ([1.0], 1), ("c", 1): ([], 1), ("d", 1): ([None, 1.0], 1)}
    for most in (20_000, 1):
        monkeypatch.setattr(M, "GROUPS", most)
        assert {(r.g, r.h): (r.vec, r.n) for r in M.means(df, ["g", "h"], "v").collect()} == want
    assert M.means(df.limit(0), ["g"], "v").count() == 0
    many = spark.range(0, 5000, 1, 6).select((F.col("id") % 7).alias("g"), F.array((F.col("id") % 13).cast("float"), F.lit(2.0).cast("float")).alias("v"))
    got = {r.g: r.vec for r in M.means(many, ["g"], "v").collect()}
    assert all(np.allclose(got[g], [np.mean([i % 13 for i in range(5000) if i % 7 == g]), 2]) for g in range(7))


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(300, 6)), rng.normal(size=(40, 6))
    c = np.concatenate((c, c[:3]))  # ties go to the first
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [None] * 6)], "k long, v array<double>").withColumn("_x", F.lit("clash"))
    monkeypatch.setattr(M, "VALUES", 500)
    got = {r.k: r.code for r in M.nearest(df, "v", c).collect()}
    assert [got[i] for i in range(300)] == ((x[:, None] - c) ** 2).sum(2).argmin(1).tolist() and got[900] is got[901] is got[902] is None
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    got = {r.k: r.code for r in M.nearest(df, "v", unit, cosine=True).collect()}
    assert [got[i] for i in range(300)] == (x @ unit.T).argmax(1).tolist()
    monkeypatch.setattr(M, "CENTRES_BYTES", 100)
    with pytest.raises(ValueError):
        M.nearest(df, "v", c)


def test_kmeans_starts(spark):
    """Starts spread by distance find well separated groups; a start a row at most; few distinct rows give fewer centres."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 4)) * 50
    x = np.repeat(middle, 40, axis=0) + rng.normal(size=(480, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None), (998, [None] * 4)], "k long, v array<double>")
    got = np.array(M.kmeans(df, "k", "v", 12, 5, 3))
    want = x.reshape(12, 40, 4).mean(1)
    assert np.abs(got[((want[:, None] - got) ** 2).sum(2).argmin(1)] - want).max() < 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "k long, v array<double>")
    assert M.kmeans(same, "k", "v", 3, 5) == [[1.0, 2.0]] and M.kmeans(same.limit(0), "k", "v", 3, 5) == []


def test_large_codebook(spark):
    book = spark.range(8192).select(F.col("id").alias("code"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.hash("id", j) / 1e9).alias("vec"))
    rows = book.where("code % 2 = 0").select(F.col("code").alias("k"), F.transform("vec", lambda v: v * 3).alias("v"))
    new = M.update_codebook(rows, "v", book, 0.9).orderBy("code").collect()
    old = {r.code: r.vec for r in book.collect()}
    assert len(new) == 8192 and all(r.used == (r.code % 2 == 0) for r in new)
    assert all(np.allclose(r.vec, np.array(old[r.code]) * (1.2 if r.used else 1.0)) for r in new[:200])


@pytest.mark.parametrize("block", [1024, 16])
def test_contrastive_loss(spark, block):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(150, 5)), rng.normal(size=(150, 5))
    rows = [(i // 70, i, a[i].tolist(), b[i].tolist()) for i in range(150)] + [(0, 500, None, [1.0] * 5), (None, 501, [1.0] * 5, [1.0] * 5)]
    df = spark.createDataFrame(rows, "batch int, k long, l array<double>, r array<double>")
    got = {r.batch: (r.n, r.loss) for r in M.contrastive_loss(df, "batch", "k", "l", "r", 7.0, block).collect()}
    assert set(got) == {0, 1, 2}
    for g in got:
        at = slice(70 * g, min(70 * g + 70, 150))
        z = 7.0 * a[at] @ b[at].T
        lse = lambda m: np.log(np.exp(m - m.max(1, keepdims=True)).sum(1)) + m.max(1)
        want = ((lse(z) - np.diag(z)).mean() + (lse(z.T) - np.diag(z)).mean()) / 2
        assert got[g][0] == len(z) and abs(got[g][1] - want) < 1e-9
    assert M.contrastive_loss(df.limit(0), "batch", "k", "l", "r").count() == 0
