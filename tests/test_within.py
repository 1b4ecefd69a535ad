"""Order inside groups: hot groups in pieces give the rows that one window a group gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import clean, metrics, sampling, windows, within


@pytest.fixture(scope="module", params=[1_000_000, 40])
def table(spark, request):
    """(DataFrame, rows by group in order): a group of half of all rows, small ones, and a null one. The second run cuts the null one too."""
    within.PIECE_ROWS, old = request.param, within.PIECE_ROWS
    rng = np.random.default_rng(0)
    rows = [(("hot" if i % 2 else ["a", "b", None, "c", "d"][i % 5]), int(i), None if rng.random() < 0.1 else float(rng.normal()), bool(rng.random() < 0.05)) for i in rng.permutation(3000)] + [("single", 7, 1.0, True), ("none", 9, 2.0, False)]
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append(r)
    yield spark.createDataFrame(rows, "g string, i long, v double, ok boolean").repartition(5), by
    within.PIECE_ROWS = old


def test_pieces_are_small(table):
    df, by = table
    p = within.cut(df, ["g"], "i")
    sizes = {(r.g, r._p): r["count"] for r in p.rows.groupBy("g", "_p").count().collect()}
    assert p.hot and sum(g == "hot" for g, _ in sizes) >= 50 and max(n for (g, _), n in sizes.items() if g == "hot") <= 100
    assert sum(sizes.values()) == df.count()


def test_number_and_ids(table):
    df, by = table
    got = {r.i: r.n for r in within.number(df, ["g"], "i", "n").collect() if r.g not in ("single", "none")}
    assert got == {r[1]: k for g, rows in by.items() if g not in ("single", "none") for k, r in enumerate(rows)}
    ids = {r.eid for r in sampling.sequential_id(df.where("g = 'hot'"), "g", "i", "x").collect()}
    assert ids == {f"x_hot_{k:06d}" for k in range(1, 1501)}


def test_carry(table):
    df, by = table
    got = {(r.g, r.i): r.source for r in clean.next_valid_by(df, "g", "i", F.col("ok")).collect()}
    for g, rows in by.items():
        own = [r[1] for r in rows if r[3]]
        for r in rows:
            assert got[g, r[1]] == next((x for x in own if x >= r[1]), own[0] if own else None)
    a, b = df.select("g", "i", F.col("i").alias("t")), df.where("ok").select("g", (F.col("i") + 1).alias("u"))
    got = {(r.g, r.i): r.match for r in windows.asof_forward(a, b, "g", "t", "u").collect()}
    assert got == {(g, r[1]): next((x[1] + 1 for x in rows if x[3] and x[1] + 1 >= r[1]), None) for g, rows in by.items() for r in rows}


def test_running(table):
    df, by = table
    got = {(r.g, r.i): r.before_one for r in within.running_before(df.withColumn("one", F.col("ok").cast("long")), ["g"], "i", ["one"]).collect()}
    assert got == {(g, r[1]): sum(x[3] for x in rows[:k]) for g, rows in by.items() for k, r in enumerate(rows)}


@pytest.mark.parametrize("k", [1, 5, 6, 301])
def test_moving_average(table, k):
    df, by = table
    df = df.withColumn("v", F.coalesce("v", F.lit(0.0)))
    front, back = (k - 1) // 2, k - 1 - (k - 1) // 2
    out = within.moving_average(df, "g", "i", "v", k)
    assert out.columns == ["g", "i", "v", "ok", "trend", "rest"]
    got = {(r.g, r.i): (r.trend, r.rest) for r in out.collect()}
    assert len(got) == df.count()
    for g, rows in by.items():
        v = np.array([r[2] or 0.0 for r in rows])
        want = np.convolve(np.concatenate((np.repeat(v[0], front), v, np.repeat(v[-1], back))), np.ones(k) / k, "valid")
        assert np.allclose([got[g, r[1]] for r in rows], np.stack([want, v - want], 1))


def test_decompose(table):
    df, by = table
    df = df.withColumn("v", F.coalesce("v", F.lit(0.0)))
    one, two = ({(r.g, r.i): r.trend for r in within.moving_average(df, "g", "i", "v", k).collect()} for k in (3, 8))
    for r in within.decompose(df, "g", "i", "v", [3, 8]).collect():
        assert abs(r.trend - (one[r.g, r.i] + two[r.g, r.i]) / 2) < 1e-12 and abs(r.trend + r.rest - r.v) < 1e-12


@pytest.mark.parametrize("alpha", [0.0, 0.5, 0.97])
def test_exp_smooth(table, alpha):
    df, by = table
    got = {(r.g, r.i): r.smooth for r in within.exp_smooth(df, "g", "i", "v", alpha, 3.0).collect()}
    assert len(got) == df.count()
    for g, rows in by.items():
        s = 3.0
        for _, i, v, _ in rows:
            s = s if v is None else alpha * s + (1 - alpha) * v
            assert got[g, i] is None if v is None else abs(got[g, i] - s) < 1e-12
    with pytest.raises(ValueError):
        within.exp_smooth(df, "g", "i", "v", 1.0)


def test_auroc_by(table):
    df, by = table
    got = {r.g: r.auroc for r in metrics.auroc_by(df.where("v is not null"), ["g"], F.col("ok"), F.round("v", 1)).collect()}
    for g, rows in by.items():
        pos, neg = ([round(r[2] * 10) for r in rows if r[2] is not None and r[3] == y] for y in (True, False))
        if pos and neg and g == "hot":
            near = {(r.i): r.s for r in df.where("g = 'hot'").select("i", F.round("v", 1).alias("s")).collect()}
            pos, neg = (np.array([near[r[1]] for r in rows if r[2] is not None and r[3] == y]) for y in (True, False))
            assert abs(got[g] - np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))) < 1e-12
    assert got["single"] is None and got["none"] is None


def test_empty(table):
    none = table[0].limit(0)
    for out in (within.number(none, ["g"], "i", "n"), within.moving_average(none, "g", "i", "v", 3), within.exp_smooth(none, "g", "i", "v", 0.5), clean.next_valid_by(none, "g", "i", F.col("ok"))):
        assert out.count() == 0
