"""Whitening of integer vectors by exact cross-products from bit planes.

Entries are shifted by their dimension's least value in a block of rows, so that they are numbers of a few bits. Bit b of dimension d over
64 rows is one word; the product of two dimensions summed over those rows is the sum of 2^(b + c) times the ones that planes (d, b)
and (e, c) have in common. A block gives whole numbers, its shifts are multiplied back in as whole numbers, and blocks of all tasks are
added as such: nothing is rounded before the covariance, n * sum(x x') - S S', is divided for its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows of a block; words of a plane are 64 of them.
BLOCK = 1 << 14
#: Whole numbers travel as LIMBS signed parts of BITS bits each, so that sums of up to 2^22 of them fit in a long.
BITS, LIMBS = 40, 5
#: An eigenvalue below this share of the largest, times the dimensions, is rounding.
RANK = 4 * np.finfo(float).eps


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the bit planes of y (rows, dimensions; unsigned) that have a one, with the dimension and the bit of each."""
    rows, dims = y.shape
    words, dim, bit = [], [], []
    padded = np.zeros((dims, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = y.T
    for b in range(int(y.max(initial=0)).bit_length()):
        plane = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(bool), axis=1).view(np.uint64)
        some = np.flatnonzero(plane.any(1))
        words.append(plane[some])
        dim.append(some)
        bit.append(np.full(len(some), b))
    if not words:
        return np.zeros((0, padded.shape[1] // 64), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(dim), np.concatenate(bit)


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of the columns of x (rows, dimensions; long) and of the products of any two, as Python's whole numbers."""
    rows, dims = x.shape
    low = x.min(0)
    words, dim, bit = planes(x.astype(np.uint64) - low.astype(np.uint64))  # wraps to the right difference
    order = np.argsort(dim, kind="stable")
    words, dim, bit = words[order], dim[order], bit[order]
    some, begin = np.unique(dim, return_index=True)  # dimensions that vary, and their first planes
    wide = 2 * int(bit.max(initial=0)) + 2 + rows.bit_length() > 62
    power = np.array([1 << int(b) for b in bit], object if wide else np.int64)
    product = np.zeros((dims, dims), power.dtype)
    for p in range(len(words)):
        k = np.searchsorted(some, dim[p])
        common = np.bitwise_count(words[begin[k] :] & words[p]).sum(1, dtype=np.int64)
        product[dim[p], some[k:]] += power[p] * np.add.reduceat(common * power[begin[k] :], begin[k:] - begin[k])
    product = (product + np.triu(product, 1).T).astype(object)
    ones = np.zeros(dims, object)
    if len(words):
        ones[some] = np.add.reduceat(np.bitwise_count(words).sum(1, dtype=np.int64) * power, begin)
    shift = low.astype(object)
    outer = np.outer(shift, ones)
    return list(ones + rows * shift), (product + outer + outer.T + rows * np.outer(shift, shift)).tolist()


def limbs(v: int) -> list[int]:
    """v as LIMBS parts, the last signed."""
    return [(v >> (BITS * k)) & ((1 << BITS) - 1) for k in range(LIMBS - 1)] + [v >> (BITS * (LIMBS - 1))]


def whole(parts) -> int:
    return sum(int(p) << (BITS * k) for k, p in enumerate(parts))


_LONG = 2**63


def quantised(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(256 * c) of all entries end to end, bounds of the rows, and which rows are neither null nor hold null or non-finite
    entries. Beyond a long's range stands its end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    entry = column.flatten()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(size)))
    bad = entry.is_null().to_numpy(zero_copy_only=False)
    value = entry.fill_null(0).to_numpy(zero_copy_only=False)
    bad = bad | ~np.isfinite(value)
    ok = column.is_valid().to_numpy(zero_copy_only=False).copy()
    ok &= np.diff(np.concatenate(([0], np.cumsum(bad)))[bounds]) == 0
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(256 * np.where(bad, 0, value))
    inside = np.abs(scaled) < _LONG
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled > 0, _LONG - 1, -_LONG)), bounds, ok


def packed(x: np.ndarray) -> bytes:
    """A vector of longs in the least width that holds it; equal vectors have equal bytes."""
    for kind in ("<i2", "<i4"):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind).tobytes() + kind[2:].encode()
    return x.astype("<i8").tobytes() + b"8"


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Vectors of one length, as (rows, dimensions)."""
    return np.array([np.frombuffer(r[:-1], "<i" + r[-1:].decode()).astype(np.int64) for r in rows])


@dataclass
class Whitening:
    """n vectors with sums, the largest components (columns of directions, by falling eigenvalue), their eigenvalues, and the trace."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    directions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as longs where they fit, else as Python's whole numbers."""
        most = max(abs(int(x.min(initial=0))), int(x.max(initial=0)))
        if self.n * most + max(map(abs, self.sums), default=0) < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / max(self.n, 1)) @ self.directions / np.sqrt(self.values)


def components(n: int, sums: list[int], products: list[list[int]], most: int) -> Whitening:
    """The largest components of the covariance over n vectors. Those without variance are left out."""
    s = np.array(sums, object)
    exact = n * np.array(products, object).reshape(len(sums), len(sums)) - np.outer(s, s)
    covariance = np.array([[v / (n * n) for v in row] for row in exact.tolist()], float).reshape(len(sums), len(sums))
    value, direction = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[:most]
    order = order[value[order] > max(value.max(initial=0), 0) * RANK * len(sums)]
    trace = sum(exact[d, d] for d in range(len(sums))) / (n * n)
    return Whitening(n, list(sums), direction[:, order], value[order], float(trace))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        rows = batch.column(0).to_pylist()
        for k in range(0, len(rows), BLOCK):
            yield unpacked(rows[k : k + BLOCK])


def learn(vectors: DataFrame, most: int = 4) -> Whitening:
    """The whitening of the distinct quantised vectors of vectors(embedding), fitted on all of them.

    Vectors that are null or hold null or non-finite entries are left out, and so are those whose length isn't the most frequent one
    among distinct vectors (of several, the largest). Equal vectors count once. Only sums by pair of dimensions come to the driver."""
    scratch = Scratch(vectors.sparkSession, "whitening")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, bounds, ok = quantised(batch.column(0))
            rows = [packed(entry[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(ok).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array((bounds[1:] - bounds[:-1])[ok], pa.int64())], ["x", "dims"])

    plain = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
    fit = scratch.save(plain.mapInArrow(pack, "x binary, dims long").distinct(), "fit")
    sizes = fit.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not sizes or not sizes[0]["dims"]:
        return Whitening(n=int(sizes[0]["count"]) if sizes else 0)
    n, dims = int(sizes[0]["count"]), int(sizes[0]["dims"])
    fit = fit.where(F.col("dims") == dims).select("x")
    upper = [(i, j) for i in range(-1, dims) for j in range(max(i, 0), dims)]  # i = -1: the sums
    left, right = (pa.array([p[k] for p in upper], pa.int32()) for k in (0, 1))
    names = [f"l{k}" for k in range(LIMBS)]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper), object)
        for x in _rows_of(batches):
            sums, products = cross_products(x)
            total += np.array(sums + [products[i][j] for i, j in upper[dims:]], object)
        if total.any():
            parts = np.array([limbs(int(v)) for v in total], np.int64)
            yield pa.RecordBatch.from_arrays([left, right, *(pa.array(parts[:, k]) for k in range(LIMBS))], ["i", "j", *names])

    parts = fit.mapInArrow(scatter, "i int, j int, " + ", ".join(f"{c} long" for c in names)).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names))
    sums, products = [0] * dims, [[0] * dims for _ in range(dims)]
    for r in parts.collect():
        v = whole(r[c] for c in names)
        if r["i"] < 0:
            sums[r["j"]] = v
        else:
            products[r["i"]][r["j"]] = products[r["j"]][r["i"]] = v
    model = components(n, sums, products, most)
    k = len(model.values)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for x in _rows_of(batches):
            z = model.whitened(model.centred(x))
            total += z.T @ z
            first += z.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel(), *first]], pa.list_(pa.float64()))], ["v"])

    if k:
        got = fit.mapInArrow(second, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        v = np.zeros(k * k + k)
        for r in got:
            v[r["pos"]] = r["v"]
        mean = v[k * k :] / n
        model.identity_error = float(np.abs(v[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Per row of vectors(vec_id, embedding) that the model's rules keep: vec_id, whitened (its values on the components), deviation
    (the sum over dimensions of (n * x - S)^2, exact, as text).

    Null and repeated vec_ids give results like others; an empty table, or a model without vectors, an empty one. Where all vectors are
    equal there is no component, and whitened is empty. Other columns are not looked at."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dims, kind = len(m.sums), pa.list_(pa.float64())
        for batch in batches:
            entry, bounds, ok = quantised(batch.column(1))
            at = np.flatnonzero(ok & (np.diff(bounds) == dims))
            x = entry[(bounds[at][:, None] + np.arange(dims))]
            c = m.centred(x)
            wide = c.dtype == object or int(np.abs(c).max(initial=0)) ** 2 * max(dims, 1) >= 2**63
            deviation = ((c.astype(object) if wide else c) ** 2).sum(1)
            z = m.whitened(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(z), kind), pa.array(list(map(str, deviation.tolist())), pa.string())], ["vec_id", "whitened", "deviation"])

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.where("embedding is not null").mapInArrow(run, "vec_id long, whitened array<double>, deviation string")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten() of embeddings, a row for each of its four largest components. A deviation beyond a long is null."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = learn(vectors, 4)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    out = whiten(vectors, model).select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"))
    return out.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).cast("double").alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
