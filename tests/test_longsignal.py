"""Recordings in chunks against whole recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import longsignal as L
from sigspark.plans.pipelines import Harmonise, long_recording_pipeline


@pytest.fixture(scope="module")
def recordings(spark):
    rng = np.random.default_rng(0)
    x = {"long": rng.normal(size=(2, 5300)), "odd": rng.normal(size=(3, 401)), "short": rng.normal(size=(2, 7)), "one": rng.normal(size=(1, 1))}
    df = spark.createDataFrame([(k, [f"c{i}" for i in range(len(v))], v.tolist()) for k, v in x.items()] + [("none", ["c0"], None), ("empty", [], [])], "rec_id string, ch_names array<string>, signal array<array<double>>")
    return df, x


def whole(chunks):
    out = {}
    for r in chunks.orderBy("rec_id", "chunk").collect():
        out.setdefault(r.rec_id, []).append(np.array(r.signal))
    return {k: np.concatenate(v, 1) for k, v in out.items()}


@pytest.mark.parametrize("size", [16, 100, 10_000])
def test_filter_any_chunk_size(recordings, size):
    df, x = recordings
    chunks = L.chunked(df, size)
    assert all(np.array_equal(v, x[k]) for k, v in whole(chunks).items())
    taps = L.band_taps(100.0, 2.0, 20.0)
    out = L.fir_filter(chunks, size, taps)
    assert set(out.columns) == set(chunks.columns) and {len(r.ch_names) for r in out.where("rec_id = 'odd'").collect()} == {3}
    got = whole(out)
    assert got.keys() == x.keys()
    for k, v in x.items():
        p = L.reflected(v, len(taps) // 2, len(taps) // 2)
        want = np.stack([np.convolve(c, taps, "valid") for c in p])
        assert np.abs(got[k] - want).max() < 1e-9 and np.abs(L.filter_array(v, taps) - want).max() < 1e-9


def test_many_tasks(spark, recordings):
    """A recording of 332 chunks is 332 groups, dealt over the tasks."""
    chunks = L.chunked(recordings[0].where("rec_id = 'long'"), 16)
    out = L.fir_filter(chunks, 16, np.ones(3) / 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tasks = L.fir_filter(chunks, 16, np.ones(3) / 3).select(F.spark_partition_id().alias("t")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out.count() == 332 and tasks >= 50


def test_responses():
    fs, t = 200.0, np.arange(4000) / 200
    band, notch = L.band_taps(fs, 5, 30), L.notch_taps(fs)
    gain = lambda taps, f: abs(L.filter_array(np.cos(2 * np.pi * f * t)[None], taps)[0, 1000:3000]).max()
    assert gain(band, 15) == pytest.approx(1, abs=0.01) and gain(band, 2) < 0.01 and gain(band, 45) < 0.01
    assert gain(notch, 50) < 0.01 and gain(notch, 60) < 0.01 and gain(notch, 40) == pytest.approx(1, abs=0.01)
    assert len(L.notch_taps(80.0)) == 1
    for bad in ((30, 5), (5, 100)):
        with pytest.raises(ValueError):
            L.band_taps(fs, *bad)


@pytest.mark.parametrize("up,down", [(2, 1), (1, 2), (3, 4), (5, 3)])
def test_resample(spark, up, down):
    n, fs = 1237, 100.0
    tone = lambda t: np.sin(2 * np.pi * 7 * t) + 0.5 * np.cos(2 * np.pi * 11.3 * t)
    df = spark.createDataFrame([("r", [tone(np.arange(n) / fs).tolist()])], "rec_id string, signal array<array<double>>")
    got = {}
    for size in (60, 600, 6000):
        out = L.resample(L.chunked(df, size), size, up, down)
        got[size] = whole(out)["r"]
        assert {r.n for r in out.collect()} == {got[size].shape[1]} == {-(-n * up // down)}
    assert np.abs(got[60] - got[6000]).max() < 1e-9 and np.abs(got[600] - got[6000]).max() < 1e-9
    want = tone(np.arange(got[60].shape[1]) / fs * down / up)
    assert np.abs(got[60][0, 100:-100] - want[100:-100]).max() < 2e-3
    with pytest.raises(ValueError):
        L.resample(df, 7, 1, 2)


def test_pipeline(spark):
    rng = np.random.default_rng(1)
    fs, n = 64.0, 64 * 40 + 20
    x = rng.normal(size=(3, n))
    x[0, 640:704] += 50 * np.sin(np.arange(64) / 3)
    df = spark.createDataFrame([("a", ["C1", "c2", "x"], x.tolist()), ("b", ["C1", "c2", "x"], x[:, :64].tolist())], "rec_id string, ch_names array<string>, signal array<array<double>>")
    how = Harmonise(fs, 1.0, 20.0, notch=False, drop=("X",), target=("C2", "C1"), rename=F.upper, resample=32)
    samples, log = long_recording_pipeline(L.chunked(df, 128), 128, how, 1.0, 20.0)
    y = L.filter_array(x[[1, 0]], L.band_taps(fs, 1.0, 20.0))
    z = whole(L.resample(L.chunked(spark.createDataFrame([("a", y.tolist())], "rec_id string, signal array<array<double>>"), 10_000), 10_000, 1, 2))["a"]
    cut = z[:, : 40 * 32].reshape(2, 40, 32)
    kept = [e for e in range(40) if np.ptp(cut[:, e], axis=1).max() <= 20]
    assert 30 < len(kept) < 40
    got = {r.epoch: np.array(r.eeg) for r in samples.collect()}
    assert sorted(got) == kept
    for e in kept:
        c = cut[:, e]
        assert np.allclose(got[e], (c - c.mean(1, keepdims=True)) / c.std(1, keepdims=True), atol=1e-9)
    assert {(r.rec_id, r.remain, r.total) for r in log.collect()} == {("a", len(kept), 40), ("b", 0, 0)}
