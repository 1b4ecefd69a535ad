"""Prototypes and cosine retrieval."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.rnd import md5_key
from ..sources.shared import saved
from . import matrices
from .ordered import small

#: Galleries up to this many rows are broadcast whole; larger ones are scored in blocks.
BROADCAST_ROWS = 20_000
#: Galleries beyond this many rows are scored in blocks by nearest(): there the products cost less than rows a pair.
NEAREST_ROWS = 1_000
#: Values of vectors in a block, and pairs (or products) that a task holds at once.
BLOCK, PAIRS = 1 << 19, 1 << 18


def class_prototypes(df: DataFrame, label: str = "label", vector: str = "embedding", normalize: bool = True, by: list[str] | None = None) -> DataFrame:
    """One mean vector per class (per class and by), scaled to length 1 unless normalize is false."""
    out = matrices.means(df, [*(by or []), label], vector).drop("n")
    return out.withColumn("vec", vec.l2_normalize("vec")) if normalize else out


def similarity_join(queries: DataFrame, gallery: DataFrame, qvec: str, gvec: str, on: list[str] | None = None, method: str = "auto") -> DataFrame:
    """All (query, gallery) pairs, within equal keys on, with their cosine in sim: null where a vector is null, holds a null, or
    both differ in length. Null keys match nothing. Both methods give the same rows.

    broadcast: one copy of the gallery at every executor, for galleries of at most BROADCAST_ROWS (checked by auto).
    blocked: rows of both sides are gathered into chunks and each query chunk meets each gallery chunk; no side is
    broadcast. For the best k use nearest(), which never makes all pairs' rows.
    """
    if method == "auto":
        method = "broadcast" if gallery.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "blocked"
    if method == "broadcast":
        q = queries.withColumn("_qn", vec.l2_normalize(qvec))
        g = F.broadcast(gallery.withColumn("_gn", vec.l2_normalize(gvec)))
        both = q.join(g, on) if on else q.crossJoin(g)
        return both.withColumn("sim", vec.dot("_qn", "_gn")).drop("_qn", "_gn")
    return _blocked(queries, gallery, qvec, gvec, on or [])


def _vectors(column: pa.Array) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Unit rows of the vectors of each length that have all their values, every vector's length (-1 for the rest) and place among those of its length.
    Sums are taken in order, as Spark takes them, so that equal vectors have equal cosines in every block and by both methods."""
    flat = column.flatten()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = size.cumsum()
    holes = np.concatenate([[0], flat.is_null().to_numpy(zero_copy_only=False).cumsum()])
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False) & (holes[ends] == holes[ends - size]), size, -1)
    values = pc.fill_null(flat.cast(pa.float64(), safe=False), 0.0).to_numpy(zero_copy_only=False)
    units, place = {}, np.zeros(len(column), np.int64)
    for width in np.unique(length[length >= 0]).tolist():
        at = np.flatnonzero(length == width)
        x = np.empty((len(at), width))
        for k in range(0, len(at), 1024):
            v = values[(ends[at[k : k + 1024]] - width)[:, None] + np.arange(width)]
            x[k : k + 1024] = v / np.maximum(np.sqrt((v * v).cumsum(1)[:, -1:].sum(1, keepdims=True)), 1e-12)
        units[width], place[at] = x, np.arange(len(at))
    return units, length, place


def _firsts(units: dict[int, np.ndarray], length: np.ndarray, place: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of rows at, in order, the first k of each vector: no later copy is among a query's k best."""
    kept = [at[length[at] < 0][:k]]
    for width, x in units.items():
        mine = at[length[at] == width]
        bits = np.ascontiguousarray(x[place[mine]]).view(np.uint64)
        with np.errstate(over="ignore"):
            mark = (bits * (2 * np.arange(width, dtype=np.uint64) + 1) ** 5).sum(1, dtype=np.uint64)
        order = np.argsort(mark, kind="stable")
        new = np.ones(len(order), bool)  # rows of one mark and other bits are not copies
        new[1:] = (mark[order][1:] != mark[order][:-1]) | (bits[order][1:] != bits[order][:-1]).any(1)
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        kept.append(mine[order[nth < k]])
    return np.sort(np.concatenate(kept))


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit rows, each summed in order."""
    out, step = np.zeros(len(i)), max(1, PAIRS // max(1, x.shape[1]))
    for k in range(0, len(i) if x.shape[1] else 0, step):
        at = slice(k, k + step)
        out[at] = (x[i[at]] * y[j[at]]).cumsum(1)[:, -1]
    return out


def _scores(q: pa.Array, g: pa.Array, keep: list[tuple[np.ndarray, int]] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine, whether it is known) of all pairs of two blocks' vectors, or of the k best of each query among each set of gallery rows in keep, ties
    by their order: as Spark orders, NaN above all and unknown ones last. No more than PAIRS scores are held at once."""
    (x, nx, px), (y, ny, py) = _vectors(q), _vectors(g)
    found = []
    for columns, k in keep or [(np.arange(len(g)), len(g))]:
        if k < len(columns):
            columns = _firsts(y, ny, py, columns, k)
        step = max(1, PAIRS // max(1, len(columns)))
        sides = {width: (at := np.flatnonzero(ny[columns] == width), y[width][py[columns[at]]].T) for width in x.keys() & y.keys()} if k < len(columns) else {}
        for start in range(0, len(q), step):
            rows = np.arange(start, min(start + step, len(q)))
            if k < len(columns):  # products of matrices tell which pairs come into question
                s = np.full((len(rows), len(columns)), -np.inf)
                for width, (at, m) in sides.items():
                    mine = np.flatnonzero(nx[rows] == width)
                    product = x[width][px[rows[mine]]] @ m
                    if np.isnan(product.sum()):
                        product[np.isnan(product)] = np.inf
                    if product.shape == s.shape:
                        s = product
                    else:
                        s[np.ix_(mine, at)] = product
                i, j = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k, None] - 1e-9)
            else:
                i, j = np.indices((len(rows), len(columns))).reshape(2, -1)
            width = nx[rows[i]]
            known, s = (width == ny[columns[j]]) & (width >= 0), np.full(len(i), -np.inf)
            for w in np.unique(width[known]).tolist():
                at = np.flatnonzero(known & (width == w))
                s[at] = _cosines(x[w], y[w], px[rows[i[at]]], py[columns[j[at]]])
            if k < len(columns):
                order = np.lexsort((j, np.where(np.isnan(s), -np.inf, -s), i))
                best = order[np.arange(len(order)) - np.searchsorted(i, np.arange(len(rows)))[i[order]] < k]
                i, j, s, known = i[best], j[best], s[best], known[best]
            found.append((rows[i], columns[j], s, known))
    return tuple(np.concatenate(c) for c in zip(*found))


def _blocked(queries: DataFrame, gallery: DataFrame, qvec: str, gvec: str, on: list[str], keep: Callable[[pa.StructArray], list[tuple[np.ndarray, int]]] | None = None, tie: list[str] | None = None, most: int = 1, rows: int | None = None) -> DataFrame:
    """Pairs by blocks, each a matrix product in slices; with keep, a query's best among the sets of gallery rows that it tells, most in all, ties by the tie
    columns. A block has about BLOCK values of vectors and returns four times as many, so a task's memory does not depend on the tables' size."""
    told = [df.agg(F.count("*").alias("n"), F.max(F.size(v)).alias("width")).first() for df, v in ((queries, qvec), (gallery, gvec))]
    width = max(1, *(t["width"] or 1 for t in told))
    returned = max(256, min(PAIRS // 4, 4 * BLOCK // width))
    its = rows or (max(16, min(8192, BLOCK // width)) if keep else int(returned**0.5))
    mine = rows or (max(1, min(its, returned // max(1, most))) if keep else its)
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = [max(1, -(-t["n"] // size)) for t, size in zip(told, (mine, its))]
    n[0] = max(n[0], min(-(-told[0]["n"] // 1024), -(-tasks // n[1])))

    def side(df: DataFrame, mine: str, its: int, other: str, others: int, order: list[str]) -> DataFrame:
        row = F.struct(*df.columns)
        known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in on), F.lit(True))
        chunked = df.where(known).withColumn(mine, F.pmod(F.xxhash64(row), F.lit(its)).cast("int"))
        place = F.row_number().over(Window.partitionBy(*on, mine).orderBy(*order)) if order else F.lit(0)
        return chunked.select(*on, row.alias("row"), mine, place.alias("place")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    keys = [*on, "i", "j"]
    parts = max(tasks, min(n[0] * n[1], 2000))  # fixed, as blocks take time by their pairs, not by their bytes
    left = side(queries, "i", n[0], "j", n[1], []).drop("place").withColumnRenamed("row", "q").repartition(parts, *keys)
    right = side(gallery, "j", n[1], "i", n[0], [c for c in tie or [] if c in gallery.columns]).withColumnRenamed("row", "g").repartition(parts, *keys)
    q_type, g_type = left.schema["q"].dataType.simpleString(), right.schema["g"].dataType.simpleString()

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"q": a.column("q").slice(0, 0), "g": b.column("g").slice(0, 0), "sim": pa.array([], pa.float64())})
        qs, gs = a.column("q").combine_chunks(), b.column("g").combine_chunks()
        gs = gs.take(pa.array(np.argsort(b.column("place").to_numpy(), kind="stable")))
        i, j, s, known = _scores(qs.field(qvec), gs.field(gvec), keep and keep(gs))
        return pa.table({"q": qs.take(pa.array(i)), "g": gs.take(pa.array(j)), "sim": pa.array(s, mask=~known)})

    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"q {q_type}, g {g_type}, sim double")
    return out.select("q.*", *(F.col(f"g.{c}") for c in gallery.columns if c not in on), "sim")


def topk(scored: DataFrame, query: list[str], k: int | Column, tie: list[str]) -> DataFrame:
    """The k best rows of each query with rank from 1; ties by the tie columns."""
    w = Window.partitionBy(*query).orderBy(F.col("sim").desc(), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, gallery: DataFrame, qvec: str, gvec: str, k: int, query: list[str], tie: list[str], on: list[str] | None = None, method: str = "auto") -> DataFrame:
    """topk() of similarity_join(). Beyond NEAREST_ROWS gallery rows each block keeps its k best of every query, copies or not, so what
    is ranked is k rows a block, not all pairs."""
    if method == "auto":
        method = "broadcast" if gallery.limit(NEAREST_ROWS + 1).count() <= NEAREST_ROWS else "blocked"
    if method == "broadcast":
        return topk(similarity_join(queries, gallery, qvec, gvec, on, method), query, k, tie)
    return topk(_blocked(queries, gallery, qvec, gvec, on or [], lambda rows: [(np.arange(len(rows)), k)], tie, k), query, k, tie)


def topk_by_type(queries: DataFrame, gallery: DataFrame, only: str, k: int, qvec: str, gvec: str, query: list[str], type_col: str, tie: list[str]) -> DataFrame:
    """Top k within one type; an unknown type gives no rows."""
    return nearest(queries, gallery.where(F.col(type_col) == only), qvec, gvec, k, query, tie)


def topk_by_candidates(queries: DataFrame, gallery: DataFrame, candidates: DataFrame, k: int, qvec: str, gvec: str, query: list[str], label: str, tie: list[str]) -> DataFrame:
    """Top k among gallery rows whose label is a candidate; unknown candidates are passed over, none left gives no rows."""
    return nearest(queries, gallery.join(small(candidates.select(label).distinct()), label, "left_semi"), qvec, gvec, k, query, tie)


def topk_with_type_quota(queries: DataFrame, gallery: DataFrame, k: int, fill: str, qvec: str, gvec: str, query: list[str], type_col: str, tie: list[str], method: str = "auto") -> DataFrame:
    """The best row of every type, then the next best of the type fill until max(k, number of types) rows. Beyond BROADCAST_ROWS gallery rows a block
    keeps no more of a query than the best of each type and those that can still fill up."""
    types = gallery.select(type_col).distinct().count()
    need = max(k, types) - types + 1

    def keep(rows: pa.StructArray) -> list[tuple[np.ndarray, int]]:
        kinds = np.array([str(v) for v in rows.field(type_col).to_pylist()])
        return [(np.flatnonzero(kinds == kind), need if kind == str(fill) else 1) for kind in np.unique(kinds)]

    if method == "auto":
        method = "broadcast" if gallery.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "blocked"
    scored = similarity_join(queries, gallery, qvec, gvec, method=method) if method == "broadcast" else _blocked(queries, gallery, qvec, gvec, [], keep, tie, max(k, types))
    per_type = scored.withColumn("_t", F.row_number().over(Window.partitionBy(*query, type_col).orderBy(F.col("sim").desc(), *tie)))
    best = (F.col("_t") == 1).cast("int")
    fits = (F.col("_t") == 1) | ((F.col(type_col) == fill) & (F.col("_t") <= need))
    return per_type.where(fits).withColumn("part", 1 - best).drop("_t")


def own_rank(queries: DataFrame, gallery: DataFrame, qvec: str, gvec: str, query: str, label: str, cls: str, method: str = "auto") -> DataFrame:
    """(query, label, rank): the place of each query's own class among all gallery rows, one a class, by cosine and then class: one more than the rows
    ahead of it, which are counted block by block. No pair is written and nothing is sorted. Queries whose label is no class, or
    whose vector is null or holds nulls, have no place."""
    told = saved(gallery.select(F.col(cls).alias("c"), F.col(gvec).cast("array<double>").alias("g")), "gallery")
    own = told.select(F.col("c").alias("_c"), F.col("g").alias("_own"))
    clean = ~F.exists(qvec, lambda v: v.isNull())
    q = queries.select(F.col(query).alias("q"), F.col(label).alias("l"), F.col(qvec).cast("array<double>").alias("v")).where(clean).join(small(own), F.col("l") == F.col("_c")).drop("_c")
    kinds = dict(q.dtypes)

    def ahead(x: np.ndarray, own: np.ndarray, mine: list, g: np.ndarray, names: list) -> np.ndarray:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        x, g = unit(x), unit(g)
        s, at = x @ g.T, (x * unit(own)).sum(1)[:, None]
        same = np.abs(s - at) < 1e-12
        rank = {c: i for i, c in enumerate(sorted({*mine, *names}))}
        place, its = np.array([rank[c] for c in names]), np.array([rank[c] for c in mine])[:, None]
        return np.where(place == its, False, np.where(same, place < its, s > at)).sum(1)

    names = ["q", "l", "n"]
    if method == "auto":
        method = "broadcast" if told.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "blocked"
    if method == "broadcast":
        rows = told.collect()
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r["g"] for r in rows], float), [r["c"] for r in rows]))

        def run(batches):
            g, classes = shared.value
            for b in batches:
                for k in range(0, b.num_rows, 1024):
                    t = b.slice(k, 1024)
                    n = ahead(np.array(t.column("v").to_pylist(), float), np.array(t.column("_own").to_pylist(), float), t.column("l").to_pylist(), g, classes)
                    yield pa.RecordBatch.from_arrays([t.column("q"), t.column("l"), pa.array(n.astype(np.int64))], names)

        out = q.mapInArrow(run, f"q {kinds['q']}, l {kinds['l']}, n long")
    else:
        rows = 2048
        parts = max(1, -(-told.count() // rows)), max(1, -(-queries.count() // rows))
        left = q.withColumn("j", F.pmod(F.xxhash64("q"), F.lit(parts[1]))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[0] - 1).cast("long"))))
        right = told.withColumn("i", F.pmod(F.xxhash64("c"), F.lit(parts[0]))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[1] - 1).cast("long"))))

        def count(t: pa.Table, g: pa.Table) -> pa.Table:
            n = np.zeros(len(t), np.int64)
            if len(t) and len(g):
                n = ahead(np.array(t.column("v").to_pylist(), float), np.array(t.column("_own").to_pylist(), float), t.column("l").to_pylist(), np.array(g.column("g").to_pylist(), float), g.column("c").to_pylist())
            return pa.table({"q": t.column("q"), "l": t.column("l"), "n": pa.array(n)})

        out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(count, f"q {kinds['q']}, l {kinds['l']}, n long").groupBy("q", "l").agg(F.sum("n").alias("n"))
    return out.select(F.col("q").alias(query), F.col("l").alias(label), (F.col("n") + 1).cast("int").alias("rank"))


def retrieve(queries: DataFrame, gallery: DataFrame, k: int, qvec: str, gvec: str, query: list[str], type_col: str, label: str, tie: list[str], only: str | None = None, candidates: DataFrame | None = None, fill: str | None = None) -> DataFrame:
    """Each query's hits with their rank: among candidates where they are given, else of the type only, else the best of every type filled up by the type
    fill. All by one column rank: hits of the first part ahead, by cosine and tie."""
    if candidates is not None:
        return topk_by_candidates(queries, gallery, candidates, k, qvec, gvec, query, label, tie)
    if only is not None:
        return topk_by_type(queries, gallery, only, k, qvec, gvec, query, type_col, tie)
    if fill is None:
        return nearest(queries, gallery, qvec, gvec, k, query, tie)
    quota = topk_with_type_quota(queries, gallery, k, fill, qvec, gvec, query, type_col, tie)
    return quota.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy("part", F.col("sim").desc(), *tie))).drop("part")


def recommended_k(n: Column, share: float = 0.25, most: int = 420, jitter: Column | None = None) -> Column:
    """A share of n, at most most; jitter, in [0, 1), moves it by up to a tenth to either side."""
    k = F.least(F.floor(n * share), F.lit(most)).cast("long")
    return k if jitter is None else F.floor(k * (0.9 + 0.2 * jitter)).cast("long")


def logits(sim: Column, scale: float) -> Column:
    """Similarities times exp(scale), at most 100."""
    return sim * F.least(F.exp(F.lit(float(scale))), F.lit(100.0))


def image_index(index: Column, n_classes: int, train: bool = True, classes: int | None = None, pictures: bool = False) -> Column:
    """Row of the image and text features of sample index: in train samples four in a row share one, ten images a class (one with chosen pictures); in test
    samples classes go round. classes: the number of chosen ones."""
    k = classes or n_classes
    if train:
        return F.floor(F.pmod(index, F.lit(k * (1 if pictures else 10) * 4)) / 4).cast("long")
    return F.pmod(F.pmod(index, F.lit(k * 80)), F.lit(n_classes)).cast("long")


def label_text(hits: DataFrame, query: list[str], type_col: str, label: str, seed: int) -> DataFrame:
    """Each query's hits as text: one line a type with its labels joined by " | " in rank order, types in seeded order."""
    lines = hits.groupBy(*query, type_col).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(label).cast("string").alias("l")))).alias("a"))
    line = F.concat(F.lit("If task is "), F.col(type_col).cast("string"), F.lit(": "), F.array_join(F.transform("a", lambda s: s["l"]), " | "))
    keyed = lines.select(*query, F.struct(md5_key(seed, *query, type_col).alias("o"), line.alias("t")).alias("s"))
    return keyed.groupBy(*query).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("context"))
