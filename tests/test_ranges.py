"""Files read by ranges: arrays of every order and form against numpy, bad files, streams, many tasks of one file, recordings."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.sources import ranges


def put(rows):
    """Arrays by (name, member) of rows as numpy would give them."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.member, r.row, r.start)):
        key = (r.path.rsplit("/", 1)[1], r.member)
        out.setdefault(key, (list(r.shape), []))[1].extend(r["values"])
    return {k: np.array(v).reshape(s) for k, (s, v) in out.items()}


@pytest.mark.parametrize("part_bytes", [1, 200, 1 << 20])
def test_arrays_as_numpy_reads_them(spark, tmp_path, part_bytes, monkeypatch):
    rng = np.random.default_rng(0)
    made = {
        "plain": rng.normal(size=(3, 25)), "turned": np.asfortranarray(rng.normal(size=(3, 25))), "deep": np.asfortranarray(rng.normal(size=(2, 3, 4, 11))),
        "cube": rng.normal(size=(2, 3, 8)), "label": np.array(4), "line": np.arange(17, dtype=">i4"), "half": rng.normal(size=(2, 5)).astype("f2"), "yes": np.array([True, False]), "none": np.zeros((0, 4)),
    }
    np.savez(tmp_path / "a b.npz", **made)
    np.savez_compressed(tmp_path / "small.npz", **made)
    np.save(tmp_path / "one.npy", made["turned"])
    (tmp_path / "in").mkdir()
    np.savez(tmp_path / "in" / "deep.npz", signal=made["plain"])
    for pattern in ("*.npz", "*.npy"):
        found = ranges.files(spark, str(tmp_path), pattern)
        rows = ranges.arrays(found, 8, part_bytes, 4).collect()
        assert all(r.error is None and len(r["values"]) <= 8 and r.start // 8 == (r.start + len(r["values"]) - 1) // 8 for r in rows)
        got = put(rows)
        if pattern == "*.npy":
            assert list(got) == [("one.npy", "")] and np.array_equal(got["one.npy", ""], made["turned"])
            continue
        want = {(f, m): v for f in ("a b.npz", "small.npz") for m, v in made.items() if v.size} | {("deep.npz", "signal"): made["plain"]}
        assert got.keys() == want.keys()
        assert all(got[k].shape == want[k].shape and np.array_equal(got[k], want[k].astype(float)) for k in want)


def test_columns_first_in_small_groups(spark):
    """A layout by columns whose pieces are cut so that a group stays small."""
    from unittest.mock import patch

    x = np.asfortranarray(np.arange(7 * 23.0).reshape(7, 23))
    with patch.object(ranges, "GROUP", 20):
        lay = ranges._Layout([7, 23], True, 8)
        flat, at = x.ravel("F"), 0

        def take(n):
            nonlocal at
            at += n
            return flat[at - n : at]

        got, most = np.full((7, 23), np.nan), 0
        for u in range(lay.units):
            assert lay.first(u) == at
            rows = lay.rows_of(u, take)
            most = max(most, sum(len(v) for _, _, v in rows))
            for r, s, v in rows:
                got[r, s : s + len(v)] = v
        assert np.array_equal(got, x) and most <= 21


def test_bad_files_are_rows(spark, tmp_path):
    np.savez(tmp_path / "good.npz", signal=np.ones((2, 3)))
    np.savez(tmp_path / "words.npz", signal=np.array(["a"]))
    (tmp_path / "no.npz").write_bytes(b"no")
    (tmp_path / "empty.npz").write_bytes(b"")
    np.save(tmp_path / "whole.npy", np.arange(100.0))
    whole = (tmp_path / "whole.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-8])
    np.savez_compressed(tmp_path / "broken.npz", signal=np.random.default_rng(1).normal(size=5000))
    raw = bytearray((tmp_path / "broken.npz").read_bytes())
    raw[len(raw) // 2] ^= 255
    (tmp_path / "broken.npz").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "other.npz", "w") as z:
        z.writestr("readme.txt", "x")
    npz = ranges.arrays(ranges.files(spark, str(tmp_path), "*.npz"), 1000).collect()
    assert sorted({r.path.rsplit("/", 1)[1] for r in npz if r.error}) == ["broken.npz", "no.npz", "words.npz"]
    assert {r.path.rsplit("/", 1)[1] for r in npz if not r.error} >= {"good.npz"}
    npy = ranges.arrays(ranges.files(spark, str(tmp_path), "*.npy")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in npy if r.error] == ["cut.npy"] and len(npy) == 2
    assert ranges.arrays(ranges.files(spark, str(tmp_path), "*.none")).count() == 0


def test_one_file_is_many_tasks(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(4, 100_000))
    np.savez(tmp_path / "long.npz", signal=x)
    read = ranges.arrays(ranges.files(spark, str(tmp_path), "*.npz"), 1000, 50_000, 16)
    assert read.where("error is null").select(F.spark_partition_id().alias("p")).distinct().count() > 10
    for size in (5000, 5300):  # of whole pieces, and of cut ones
        got = {r.chunk: r for r in ranges.array_chunks(read, size).collect()}
        assert len(got) == -(-100_000 // size) and all(r.n == 100_000 for r in got.values())
        assert np.array_equal(np.concatenate([np.array(got[k].signal) for k in sorted(got)], 1), x)


def test_stream_of_archives(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    np.savez(src / "a.npz", signal=np.full((2, 4), 1.0))

    def run():
        read = ranges.arrays(ranges.files(spark, str(src), "*.npz", streaming=True), 3)
        read.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(read.schema).parquet(str(tmp_path / "out"))
        return out.where("error is null").count(), out.where("error is not null").count()

    assert run() == (4, 0)
    np.savez(src / "b.npz", signal=np.full((1, 4), 2.0))
    (src / "c.npz").write_bytes(b"no")
    assert run() == (6, 1)  # a file is read once


def test_recordings_of_any_format(spark, tmp_path):
    """Interleaved 16-bit samples after a header line; a file without one is a row with error."""
    rng, want = np.random.default_rng(3), {}
    for name, n in (("r1", 1000), ("r2", 37)):
        want[name] = rng.integers(-99, 99, (2, n))
        (tmp_path / f"{name}.raw").write_bytes(f"2 {n}\n".encode() + want[name].T.astype("<i2").tobytes())
    (tmp_path / "bad.raw").write_bytes(b"?\n")

    def describe(f, path):
        line = f.read(100).split(b"\n")[0]
        channels, n = map(int, line.split())
        yield {"rec_id": path.rsplit("/", 1)[1], "ch_names": [f"c{i}" for i in range(channels)], "fs": 100.0, "n": n, "at": len(line) + 1}

    def read(f, d, start, stop):
        f.seek(d["at"] + 4 * start)
        return np.frombuffer(f.read(4 * (stop - start)), "<i2").reshape(-1, 2).T

    rows = ranges.recordings(ranges.files(spark, str(tmp_path), "*.raw"), describe, read, 64, 2, 8).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["bad.raw"]
    for name, x in want.items():
        own = sorted((r for r in rows if r.rec_id == f"{name}.raw"), key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(-(-x.shape[1] // 64))) and np.array_equal(np.concatenate([np.array(r.signal) for r in own], 1), x)


def test_archives_written_and_read(spark, tmp_path):
    df = spark.range(0, 1000, 1, 3).select("id", F.array(F.col("id") * 0.5, F.lit(1.0)).alias("x"), F.lit("no").alias("word"))
    at = str(tmp_path / "out")
    assert ranges.write_npz(df, at, ["id", "x"], 150) == 1000
    files = sorted((tmp_path / "out").glob("*"))
    assert all(f.suffix == ".npz" for f in files) and len(files) == 9
    ids = np.concatenate([np.load(f)["id"] for f in files])
    assert sorted(ids) == list(range(1000)) and all(np.array_equal(np.load(f)["x"][:, 0], np.load(f)["id"] / 2) for f in files)
    assert ranges.write_npz(df.limit(0), str(tmp_path / "none"), ["id"]) == 0
    for bad in (["word"], ["gap"]):
        with pytest.raises(Exception, match="null|numbers"):
            ranges.write_npz(df.withColumn("gap", F.when(F.col("id") > 5, 1)), str(tmp_path / "bad"), bad)
