"""Sums, assignments and losses over many vectors as matrix work inside tasks: what is shuffled is a row for each group and task, not one for each
component or pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rnd import uniform
from ..sources.shared import saved

#: Groups that a task sums before it hands them on, values of a block of distances, and most bytes of centres that tasks get.
GROUPS, VALUES, CENTRES_BYTES = 20_000, 1 << 22, 1 << 29

_PART = "_sum array<double>, _count array<long>, _rows long, _long long"


def lengths(column: pa.Array) -> np.ndarray:
    """Numbers of entries, -1 for a null vector."""
    return column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def filled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as (rows, longest) with zeros for what is missing or null, and where there is a value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entry = column.flatten()
    known = entry.is_valid().to_numpy(zero_copy_only=False)
    x, has = np.zeros((len(size), int(size.max(initial=0)))), np.zeros((len(size), int(size.max(initial=0))), bool)
    inside = np.arange(x.shape[1]) < size[:, None]
    x[inside] = np.where(known, entry.fill_null(0).to_numpy(zero_copy_only=False), 0)
    has[inside] = known
    return x, has


class _Sums:
    """Sums and counts by component for groups numbered from 0."""

    def __init__(self):
        self.total, self.count = np.zeros((0, 0)), np.zeros((0, 0), np.int64)
        self.rows, self.longest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, code: np.ndarray, x: np.ndarray, has: np.ndarray, size: np.ndarray) -> None:
        shape = (max(int(code.max(initial=-1)) + 1, len(self.rows)), max(x.shape[1], self.total.shape[1]))
        grow = [(0, shape[0] - len(self.rows)), (0, shape[1] - self.total.shape[1])]
        self.total, self.count = np.pad(self.total, grow), np.pad(self.count, grow)
        self.rows, self.longest = np.pad(self.rows, grow[0]), np.pad(self.longest, grow[0])
        order = np.argsort(code, kind="stable")
        which, begin = np.unique(code[order], return_index=True)
        if len(which):
            self.total[which, : x.shape[1]] += np.add.reduceat(x[order], begin, axis=0)
            self.count[which, : x.shape[1]] += np.add.reduceat(has[order].astype(np.int64), begin, axis=0)
            self.rows[which] += np.diff(np.append(begin, len(code)))
            self.longest[which] = np.maximum(self.longest[which], np.maximum.reduceat(size[order], begin))

    def arrays(self, keep: np.ndarray) -> list[pa.Array]:
        return [pa.array(list(self.total[keep]), pa.list_(pa.float64())), pa.array(list(self.count[keep]), pa.list_(pa.int64())), pa.array(self.rows[keep]), pa.array(self.longest[keep])]


def _combined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vec (means by component, null where there is no value) and n (rows) of partial sums."""
    kinds = dict(parts.dtypes)

    def run(t: pa.Table) -> pa.Table:
        x, _ = filled(t.column("_sum"))
        c, _ = filled(t.column("_count"))
        longest = int(t.column("_long").to_numpy().max())
        total, count = x.sum(0)[:longest], c.sum(0)[:longest]
        mean = pa.array(total / np.maximum(count, 1), mask=count == 0)
        vec = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), mean)
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "vec": vec, "n": pa.array([int(t.column("_rows").to_numpy().sum())], pa.int64())})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "vec array<double>", "n long"])
    return parts.groupBy(*keys).applyInArrow(run, schema)


def means(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, vec and n: the mean by component of each group's vectors, nulls passed over, and its rows with a vector. Every task sums its rows by group
    first, so a row for each group and task is shuffled at most (more where a task sees over GROUPS groups)."""
    plain = df.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_x"))
    kinds = dict(plain.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        sums = _Sums()

        def flush() -> pa.RecordBatch:
            told = list(names)
            first = [pa.array([t[i] for t in told], schema.field(i).type) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*first, *sums.arrays(np.arange(len(told)))], [*keys, "_sum", "_count", "_rows", "_long"])

        schema = None
        for batch in batches:
            schema = batch.schema
            groups = zip(*(batch.column(i).to_pylist() for i in range(len(keys))))
            code = np.array([names.setdefault(g, len(names)) for g in groups], np.int64)
            sums.add(code, *filled(batch.column(len(keys))), lengths(batch.column(len(keys))))
            if len(names) > GROUPS:
                yield flush()
                names, sums = {}, _Sums()
        if names:
            yield flush()

    parts = plain.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _PART]))
    return _combined(parts, keys)


def _matrix(centres: list[list[float]] | np.ndarray) -> np.ndarray:
    c = np.asarray(centres, float)
    if c.nbytes > CENTRES_BYTES:
        raise ValueError(f"centres of {c.nbytes} bytes, over {CENTRES_BYTES}: cut them to blocks and keep the best of each")
    return c


def _nearest(x: np.ndarray, c: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, the first on ties, and the squared distance to it (1 - cosine), in blocks."""
    if cosine:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    code, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    square = (c**2).sum(1)
    rows = max(1, VALUES // max(1, len(c)))
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        d = -part @ c.T if cosine else square - 2 * part @ c.T
        k = d.argmin(1)
        code[a : a + rows] = k
        diff = part - c[k]
        least[a : a + rows] = 1 + d[np.arange(len(part)), k] if cosine else (diff**2).sum(1)
    return code, least


def nearest(df: DataFrame, vector: str, centres: list[list[float]] | np.ndarray, cosine: bool = False) -> DataFrame:
    """df with code: the number of the nearest centre, the first on ties; null for null vectors, those with nulls and those of another length. The
    centres go to the executors once, as one matrix of at most CENTRES_BYTES."""
    shared = df.sparkSession.sparkContext.broadcast(_matrix(centres))
    carried = df.select(F.struct(*df.columns).alias("_row"), F.col(vector).cast("array<double>").alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x, has = filled(batch.column(1))
            ok = (has.sum(1) == c.shape[1]) & (lengths(batch.column(1)) == c.shape[1])
            code = np.zeros(len(x), np.int64)
            if ok.any():
                code[ok] = _nearest(x[ok, : c.shape[1]], c, cosine)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.astype(np.int32), mask=~ok)], ["_row", "code"])

    schema = carried.select("_row").withColumn("code", F.lit(None).cast("int")).schema
    return carried.mapInArrow(run, schema).select("_row.*", "code")


def _assigned(vectors: DataFrame, centres: np.ndarray, cosine: bool) -> DataFrame:
    """code, vec, n: means of the vectors of each centre that has any; one pass, and a row for each task and centre is shuffled."""
    shared = vectors.sparkSession.sparkContext.broadcast(_matrix(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sums = shared.value, _Sums()
        for batch in batches:
            x, has = filled(batch.column(0))
            ok = (has.sum(1) == c.shape[1]) & (lengths(batch.column(0)) == c.shape[1])
            if ok.any():
                sums.add(_nearest(x[ok, : c.shape[1]], c, cosine)[0], x[ok, : c.shape[1]], has[ok, : c.shape[1]], np.full(ok.sum(), c.shape[1]))
        keep = np.flatnonzero(sums.rows)
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), *sums.arrays(keep)], ["code", "_sum", "_count", "_rows", "_long"])

    return _combined(vectors.mapInArrow(run, f"code int, {_PART}"), ["code"])


def _starts(vectors: DataFrame, key: str, k: int, seed: int, cosine: bool, rounds: int = 5) -> np.ndarray:
    """k starts by oversampling: each round takes rows by their squared distance to what was taken, some 2 k of them expected, and the taken rows,
    weighted by the rows nearest to them, are cut to k one after the other by weight and distance."""
    taken = np.array([r["_x"] for r in vectors.orderBy(uniform(seed, key), key).limit(1).collect()])
    for r in range(rounds):
        c = taken

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, _ = filled(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_nearest(x, c, cosine)[1])], [key, "_x", "_d"])

        told = saved(vectors.mapInArrow(far, f"`{key}` {dict(vectors.dtypes)[key]}, _x array<double>, _d double"), "starts")
        cost = told.agg(F.sum("_d").alias("s")).first()["s"]
        if not cost:
            break
        more = told.where(uniform(f"{seed}.{r}", key) * cost < 2 * k * F.col("_d")).select("_x").collect()
        taken = np.concatenate((taken, np.array([m["_x"] for m in more]).reshape(-1, taken.shape[1])))
    taken = np.unique(taken, axis=0)
    weight = np.zeros(len(taken))
    for r in _assigned(vectors.select("_x"), taken, cosine).select("code", "n").collect():
        weight[r["code"]] = r["n"]
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())] if len(taken) else []
    while len(chosen) < min(k, len(taken)):
        p = weight * _nearest(taken, taken[chosen], cosine)[1].clip(0)
        p[chosen] = 0
        left = np.setdiff1d(np.arange(len(taken)), chosen)
        chosen.append(int(rng.choice(len(taken), p=p / p.sum())) if p.sum() > 0 else int(left[0]))
    return taken[chosen]


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 10, seed: int = 0, cosine: bool = False, starts: str = "spread") -> list[list[float]]:
    """At most k centres after Lloyd rounds; an empty cluster keeps its centre. starts: spread (oversampled by distance), or seeded (the first k rows by
    a hash of key). A round is one pass; only sums by centre come to the driver. Vectors must have one length; null ones, and those
    with nulls, are passed over."""
    ok = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda v: v.isNull())
    vectors = saved(df.where(ok).select(key, F.col(vector).cast("array<double>").alias("_x")), "vectors")
    if starts == "seeded":
        from ..functions.rnd import md5_key

        c = np.array([r["_x"] for r in vectors.orderBy(md5_key(seed, key), key).limit(k).collect()])
    else:
        c = _starts(vectors, key, k, seed, cosine)
    for _ in range(rounds if len(c) else 0):
        new = c.copy()
        for r in _assigned(vectors.select("_x"), c, cosine).collect():
            new[r["code"]] = r["vec"]
        if cosine:
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if (new == c).all():
            break
        c = new
    return c.tolist()


def update_codebook(df: DataFrame, vector: str, codebook: DataFrame, decay: float, cosine: bool = True) -> DataFrame:
    """(code, used, vec) of codebook(code, vec): the rows of df nearest to each code, and its moving average decay * vec + (1 - decay) * their mean; a
    code that nothing chose keeps its vector. Ties go to the first code by order."""
    rows = codebook.select("code", F.col("vec").cast("array<double>").alias("vec")).orderBy("code").collect()
    c = _matrix([r["vec"] for r in rows])
    unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) if cosine else c
    got = {r["code"]: r for r in _assigned(df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("_x")), unit, cosine).collect()}
    made = [(r["code"], int(got[i]["n"]) if i in got else 0, (decay * c[i] + (1 - decay) * np.array(got[i]["vec"])).tolist() if i in got else c[i].tolist()) for i, r in enumerate(rows)]
    kind = dict(codebook.dtypes)["code"]
    return df.sparkSession.createDataFrame(made, f"code {kind}, used long, vec array<double>")


def contrastive_loss(df: DataFrame, batch: str, key: str, left: str, right: str, scale: Column | float = 1.0, block: int = 1024) -> DataFrame:
    """(batch, n, loss): symmetric cross entropy of each batch's scaled products left x right, true pairs on the diagonal. Blocks of rows meet blocks of
    columns as one matrix product; each hands on the largest value and the sum of exponentials of its rows and columns, which are merged: no
    pair is written. Null vectors leave their row out."""
    known = df.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(batch).isNotNull())
    rows = known.select(F.col(batch).alias("b"), F.col(key).alias("k"), F.col(left).cast("array<double>").alias("l"), F.col(right).cast("array<double>").alias("r"), (F.lit(scale) if not isinstance(scale, Column) else scale).cast("double").alias("s"))
    counts = known.groupBy(F.col(batch).alias("b")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).alias("p"))
    rows = rows.join(counts.hint("merge"), "b").withColumn("i", F.pmod(F.xxhash64("k"), F.col("p")))
    across = F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1))
    a = rows.select("b", "k", "s", "l", "i", across.alias("j"))
    c = rows.select(*(F.col(x).alias(y) for x, y in (("b", "b"), ("k", "k"), ("r", "r"), ("i", "j"))), across.alias("i"))
    kind = dict(known.dtypes)[key]

    def score(x: pa.Table, y: pa.Table) -> pa.Table:
        names = ["b", "k", "side", "top", "sum", "own"]
        if not len(x) or not len(y):
            return pa.table([pa.array([], t) for t in (x.schema.field("b").type, x.schema.field("k").type, pa.int32(), pa.float64(), pa.float64(), pa.float64())], names)
        z = filled(x.column("l"))[0] @ filled(y.column("r"))[0].T * x.column("s").to_numpy()[:, None]
        at = {k: i for i, k in enumerate(y.column("k").to_pylist())}
        own = np.array([z[i, at[k]] if k in at else np.nan for i, k in enumerate(x.column("k").to_pylist())])
        out = []
        for side, (t, m) in enumerate(((x, z), (y, z.T))):
            top = m.max(1)
            mine = own if side == 0 else np.full(len(m), np.nan)
            out.append(pa.table([t.column("b"), t.column("k"), pa.array(np.full(len(m), side, np.int32)), pa.array(top), pa.array(np.exp(m - top[:, None]).sum(1)), pa.array(mine, mask=np.isnan(mine))], names))
        return pa.concat_tables(out)

    states = a.groupBy("b", "i", "j").cogroup(c.groupBy("b", "i", "j")).applyInArrow(score, f"b {dict(rows.dtypes)['b']}, k {kind}, side int, top double, sum double, own double")
    merged = states.groupBy("b", "k", "side").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "sum")).alias("parts"), F.max("own").alias("own"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["sum"] * F.exp(p["top"] - F.col("top")))
    per = merged.select("b", "side", (F.col("top") + F.log(total)).alias("lse"), "own")
    out = per.groupBy("b").agg((F.count("*") / 2).cast("long").alias("n"), ((F.sum("lse") - 2 * F.sum("own")) / F.count("*")).alias("loss"))
    return out.select(F.col("b").alias(batch), "n", "loss")
