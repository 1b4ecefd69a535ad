"""Near duplicates of embeddings: inverted lists with product-quantised residuals, and exact rerank.

1. Equal vectors are one class; its smallest vec_id stands for it.
2. A coarse quantiser and residual codebooks are fitted on a bounded sample. Every class goes to the list of its
   nearest centroid, with the codes of its residual (one byte a subspace) and the length of the coding error.
3. Neighbouring lists are packed into blocks of bounded size, and a list beyond it is cut into several, so a list of a
   third of all vectors is many small tasks. Every class goes to the pair of its own block with each block of a list
   that can hold a link of it: one whose centroid is no farther than the list's radius and the largest distance of a
   link, and whose side of the plane between both centroids is no farther than that distance. Neither loses a link.
   A smaller share of that distance at the plane probes fewer lists, at some loss (see embedding_links).
4. In a pair of blocks entries are ranked by asymmetric distance (table look-ups of the exact query against the codes);
   an entry is dropped only if that distance less its coding error exceeds the largest distance of a link, which loses
   no link. What stays is judged by the exact cosine in double precision. A pair of blocks returns one row a vector: its
   links counted, and its component within the pair; pairs of vectors are never written out. Components of the
   pairs of blocks join into those of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch

LIST_SIZE = 200
MOST_LISTS = 4096
SAMPLE = 20_000
SUB = 8
#: Most rows of a block. A table is cut into some 16 blocks at least, unless they would be smaller than LIST_SIZE.
BLOCK = 4096


def _nearest(x: np.ndarray, c: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest rows of c for each row of x, nearest first."""
    d = (c**2).sum(1) - 2 * (x @ c.T)
    if k == 1:
        return d.argmin(1)[:, None]
    near = np.argpartition(d, k - 1, 1)[:, :k] if k < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)
    return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = np.concatenate([_nearest(x[i : i + 4096], c)[:, 0] for i in range(0, len(x), 4096)])
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Quantiser:
    """Coarse centroids (lists x width) and residual codebooks (subspaces x 256 x SUB)."""

    width: int
    coarse: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        coarse = kmeans(sample, min(lists, len(sample)))
        rest = sample - coarse[_nearest(sample, coarse)[:, 0]]
        parts = rest.reshape(len(rest), -1, SUB)
        books = np.stack([kmeans(np.ascontiguousarray(parts[:, s]), min(256, len(rest))) for s in range(parts.shape[1])])
        return cls(sample.shape[1], coarse, books)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the coding error) of unit vectors."""
        own = _nearest(unit, self.coarse)[:, 0]
        rest = (unit - self.coarse[own]).reshape(len(unit), -1, SUB)
        codes = np.stack([_nearest(np.ascontiguousarray(rest[:, s]), b)[:, 0] for s, b in enumerate(self.books)], 1).astype(np.uint8)
        made = np.stack([b[codes[:, s]] for s, b in enumerate(self.books)], 1)
        return own, codes, np.sqrt(((rest - made) ** 2).sum((1, 2)))

    def norms(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared lengths of coded entries."""
        made = np.stack([b[codes[:, s]] for s, b in enumerate(self.books)], 1).reshape(len(codes), -1)
        return ((self.coarse[lists] + made) ** 2).sum(1)

    def distances(self, unit: np.ndarray, lists: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Asymmetric distances of exact unit queries to coded entries, with their norms()."""
        some, at = np.unique(lists, return_inverse=True)
        out = np.take((unit @ self.coarse[some].T).astype(np.float32), at, 1)
        parts = unit.reshape(len(unit), -1, SUB)
        for s, b in enumerate(self.books):
            out += np.take((parts[:, s] @ b.T).astype(np.float32), codes[:, s], 1)
        out *= -2
        out += (1 + norms).astype(np.float32)
        return np.sqrt(np.maximum(out, 0, out=out), out=out)


@dataclass
class Layout:
    """Which blocks a list fills (first, and how many: parts), and how far its entries are from its centroid at most."""

    coarse: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def pack(cls, coarse: np.ndarray, sizes: np.ndarray, radius: np.ndarray, most: int) -> Layout:
        """Blocks of at most about most rows: lists one after the other, each beside its nearest still left."""
        norms, left = (coarse**2).sum(1), np.ones(len(coarse), bool)
        first, parts = np.zeros(len(coarse), np.int64), np.maximum(1, -(-sizes // most))
        block, filled, at = 0, 0, 0
        for _ in range(len(coarse)):
            left[at] = False
            if filled and filled + sizes[at] > most:
                block, filled = block + 1, 0
            first[at] = block
            block, filled = (block, filled + sizes[at]) if parts[at] == 1 else (block + parts[at], 0)
            at = int(np.where(left, norms - 2 * (coarse @ coarse[at]), np.inf).argmin())
        return cls(coarse, radius, first, parts)

    def targets(self, unit: np.ndarray, own: np.ndarray, reach: float, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, block): every block that may hold a vector within reach of the row's, by its lists' radii and by the
        planes between their centroids and the row's own (the nearest), no farther than that share of reach."""
        norms = (self.coarse**2).sum(1)
        squares = np.maximum((unit**2).sum(1)[:, None] + norms - 2 * (unit @ self.coarse.T), 0)
        gaps = np.sqrt(np.maximum(norms[own][:, None] + norms - 2 * (self.coarse[own] @ self.coarse.T), 0))
        may = np.sqrt(squares) - self.radius <= reach
        may &= squares - squares[np.arange(len(own)), own][:, None] <= 2 * share * reach * gaps + 1e-6
        hit = np.zeros((len(unit), int((self.first + self.parts).max())), bool)
        row, near = np.nonzero(may)
        for k in range(int(self.parts.max())):
            some = self.parts[near] > k
            hit[row[some], self.first[near[some]] + k] = True
        return np.nonzero(hit)


def _units(raw: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to a multiple of SUB."""
    flat = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(raw), -1)
    unit = flat / np.linalg.norm(flat / np.abs(flat).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(flat).max(1, keepdims=True)
    return np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, new[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable(vector: Column, width: int) -> Column:
    """True for a vector of that length without null, NaN or infinite components that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def reach_of(least: float) -> float:
    """Largest distance of two unit vectors of cosine least, and a margin for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-3


def block_links(blocks: DataFrame, q: Quantiser, least: float) -> DataFrame:
    """(node, label, links) of each pair of blocks (lo, hi): links counts the other vectors, copies included, whose cosine
    with the node is at least least; label is the smallest node of its component in the pair."""
    shared = blocks.sparkSession.sparkContext.broadcast(q)
    reach = reach_of(least)
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("links", pa.int64())])

    def run(pair: pa.Table) -> pa.Table:
        q = shared.value
        pair = pair.combine_chunks()
        lo, hi, block = pair.column("lo")[0].as_py(), pair.column("hi")[0].as_py(), pair.column("block").to_numpy()
        qs, es = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        if not len(qs) or not len(es):
            return schema.empty_table()
        ids, copies = pair.column("rep").to_numpy(), pair.column("m").to_numpy()
        unit = _units(pair.column("embedding").combine_chunks(), q.width)
        codes = np.frombuffer(b"".join(pair.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[es]
        error, lists = pair.column("error").to_numpy()[es], pair.column("list").to_numpy()[es]
        norms = q.norms(lists, codes)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for k in range(0, len(qs), 512):
            part = qs[k : k + 512]
            near = q.distances(unit[part], lists, codes, norms) - error <= reach
            near &= part[:, None] != es
            i, j = np.nonzero(near)
            for c in range(0, len(i), 1 << 17):
                x, y = part[i[c : c + (1 << 17)]], es[j[c : c + (1 << 17)]]
                good = (unit[x] * unit[y]).sum(1) >= least
                x, y = x[good], y[good]
                links += np.bincount(x, copies[y], len(ids)).astype(np.int64)
                if lo != hi:
                    links += np.bincount(y, copies[x], len(ids)).astype(np.int64)
                apart = root[x] != root[y]
                if apart.any():
                    root = _labels(len(ids), root[x[apart]], root[y[apart]])[root]
        some = np.flatnonzero(links)
        least_id = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least_id, root, ids)
        return pa.Table.from_arrays([pa.array(ids[some]), pa.array(least_id[root[some]]), pa.array(links[some])], schema=schema)

    return blocks.groupBy("lo", "hi").applyInArrow(run, "node long, label long, links long")


def embedding_links(vectors: DataFrame, least: float = 0.95, share: float = 1.0) -> DataFrame:
    """Per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    share: how far from the plane between two lists, as a share of a link's largest distance, vectors still meet the other
    list. 1 is exact. Less is for tables too large for that: a link is lost if its step across the plane is a larger share
    of it; where links point anywhere in d dimensions, shares have a standard deviation of 1 / sqrt(d).

    Vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors of another
    length than the most common one (ties: the longer). Rows of one vec_id and equal embedding count once as partners
    and each give a result. A row without vec_id links with nothing: its component_id is null and kept true.
    Ties need no rule: a component's smallest vec_id stays. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    common = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = common["n"] if common else 1
    good = usable(F.col("embedding"), length) & F.col("vec_id").isNotNull()
    hashes = [F.when(good, F.xxhash64(F.lit(i), "embedding")).alias(f"h{i}") for i in (1, 2)]
    hashed = rows.select("vec_id", "embedding", *hashes)
    classes = scratch.save(
        hashed.where("h1 is not null").select("h1", "h2", "vec_id", "embedding").dropDuplicates(["h1", "h2", "vec_id"]).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.any_value("embedding").alias("embedding")),
        "classes",
    )
    n = classes.count()
    width = -(-length // SUB) * SUB
    if n:
        sample = classes.select("rep", "embedding").orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").toArrow()
        q = Quantiser.fit(_units(sample.column(0).combine_chunks(), width), min(MOST_LISTS, max(1, n // LIST_SIZE)))
        shared = spark.sparkContext.broadcast(q)

        def index(batches):
            for batch in batches:
                if batch.num_rows:
                    unit = _units(batch.column(2), width)
                    own, codes, error = shared.value.encode(unit)
                    away = np.sqrt(((unit - shared.value.coarse[own]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(away)], ["rep", "m", "embedding", "list", "code", "error", "away"])

        kind = dict(classes.dtypes)["embedding"]
        entries = scratch.save(classes.select("rep", "m", "embedding").mapInArrow(index, f"rep long, m long, embedding {kind}, list int, code binary, error double, away double"), "entries")
        sizes, radius = np.zeros(len(q.coarse), np.int64), np.zeros(len(q.coarse))
        for r in entries.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # at most MOST_LISTS rows
            sizes[r["list"]], radius[r["list"]] = r["n"], r["away"]
        layout = spark.sparkContext.broadcast(Layout.pack(q.coarse, sizes, radius, min(BLOCK, max(LIST_SIZE, -(-n // 16)))))
        reach = reach_of(least)

        def place(batches):
            for whole in batches:
                for k in range(0, whole.num_rows, 1024):
                    batch, told = whole.slice(k, 1024), layout.value
                    own = batch.column(3).to_numpy()
                    block = told.first[own] + batch.column(6).to_numpy() % told.parts[own]
                    row, other = told.targets(_units(batch.column(2), width), own, reach, share)
                    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(block, pa.int32()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(other, pa.int32()))], ["rep", "m", "embedding", "list", "code", "error", "block", "others"])

        columns = ["rep", "m", "embedding", "list", "code", "error"]
        dealt = F.pmod(F.xxhash64("rep"), F.lit(1 << 31)).alias("dealt")
        placed = entries.select(*columns, dealt).mapInArrow(place, f"rep long, m long, embedding {kind}, list int, code binary, error double, block int, others array<int>")
        told = placed.select(*columns, "block", F.explode("others").alias("other"))
        blocks = told.select(*columns, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        found = scratch.save(block_links(blocks, q, least), "found")
    else:
        found = spark.createDataFrame([], "node long, label long, links long")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct(), scratch, "c")
    named = classes.select("h1", "h2", "m", F.col("rep").alias("node")).join(links.hint("merge"), "node", "left").join(label.hint("merge"), "node", "left")
    named = scratch.save(named.select("h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "named")
    scratch.drop("entries", "found")
    out = hashed.select("vec_id", "h1", "h2").join(named.hint("merge"), ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embedding_links() of embeddings at cosine 0.95, exact."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)
