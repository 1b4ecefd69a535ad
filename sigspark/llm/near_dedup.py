"""Near duplicates of texts by MinHash bands, with sequential Bayesian pruning and exact verification.

1. Each text's set of word shingles becomes its size, a 128-bit digest and a MinHash signature, in one pass.
   Texts of equal sets are one class; its smallest doc_id stands for it from here on.
2. Bands of the signature put class representatives into buckets. Each bucket's members are paired with its smallest
   member only, so a bucket of any size makes no more pairs than it has members.
3. Signature batches of a pair are compared one after another; a pair is pruned as soon as the posterior chance
   that its similarity reaches the threshold, given the matches so far and a uniform prior, is below the miss probability.
4. Each text's likeliest survivor is verified on the full sets; these links give first components.
5. Buckets whose members are still in several components are compared across components: in blocks of bounded size by
   size and signature alone, and those texts that have a survivor there in smaller blocks, verified on the full sets. So
   only links that change no component are left unlooked at, and no text is copied before its signature had a partner.

A bucket of many members is dealt over several tasks wherever members meet their bucket's row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .textblock import NOT_SPACE, Chunk, SpanHashes, chunks, mix, shingles, words

BANDS, ROWS = 25, 5
N_HASHES = BANDS * ROWS
BATCH = 25
#: Most members of a block of signatures; most texts and, but for a single text, shingles of half a block of texts. The latter bound
#: memory; packs are as large as they let them be, since each pair of packs is a copy of its texts.
BLOCK, TEXTS, SHINGLES = 2048, 2048, 1 << 20
#: A bucket is dealt over several tasks from SPLIT members on, or more where over MOST_SPLIT buckets could have as many.
SPLIT, MOST_SPLIT = 256, 20_000
_A = mix(np.arange(N_HASHES, dtype=np.uint64), 21) | np.uint64(1)
_B = mix(np.arange(N_HASHES, dtype=np.uint64), 22)


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows end to end, and the bounds of each row's."""
    w = words(chunk, NOT_SPACE)
    h, begin = shingles(SpanHashes(chunk).of(w.start, w.end), w.first, size)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[begin[:-1][begin[:-1] < len(h)]] = True
    return h[keep], np.concatenate(([0], np.cumsum(keep)))[begin]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, d1, d2, sig) per row: set size, digest, and MinHash values; sig is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                sets, bound = shingle_sets(chunk, size)
                n = np.diff(bound)
                some = np.flatnonzero(n)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sig: list[bytes | None] = [None] * len(n)
                if len(some):
                    at = bound[some]
                    d1[some] = np.add.reduceat(mix(sets, 31), at)
                    d2[some] = np.add.reduceat(mix(sets, 32), at)
                    values = np.empty((len(some), N_HASHES), "<u4")
                    for j in range(N_HASHES):
                        values[:, j] = np.minimum.reduceat(((sets * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), at)
                    for k, r in enumerate(some.tolist()):
                        sig[r] = values[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(chunk)), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sig, pa.binary())],
                    ["doc_id", "n", "d1", "d2", "sig"],
                )

    return _plain(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, matches below which the posterior chance of the threshold is under miss) after each batch."""
    s = (np.arange(4000) + 0.5) / 4000
    out = []
    for n in range(BATCH, N_HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        p = np.exp(log - log.max(1, keepdims=True))
        chance = p[:, s >= threshold].sum(1) / p.sum(1)
        out.append((n, int(np.argmax(chance >= miss))))
    return out


def prune(a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the row pairs of two signature matrices that no batch prunes, and their matches."""
    left, count, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in least:
        count = count + (a[left, done:n] == b[left, done:n]).sum(1)
        stay = count >= m
        left, count, done = left[stay], count[stay], n
    return left, count


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, N_HASHES)


def survivors(pairs: DataFrame, reps: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b, matches) of the pairs (a, b) that neither their sets' sizes nor sequential comparison prune."""
    least = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep, count = prune(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(count, pa.int64())], ["a", "b", "matches"])

    left, right = (reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    full = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    full = full.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")
    return full.mapInArrow(run, "a long, b long, matches long")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets that aren't empty."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for chunk in chunks(column):
            h, bound = shingle_sets(chunk, size)
            out += [h[i:j] for i, j in zip(bound[:-1].tolist(), bound[1:].tolist())]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                good = [alike(x, y, percent) for x, y in zip(sets(part.column(2)), sets(part.column(3)))]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in part.columns[:2]], ["a", "b"])

    left, right = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    full = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(run, "a long, b long")


def _block_pairs(block: pa.Table, sig: np.ndarray, allowed, percent: int, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of a block's rows (rep, component, n) of different components that sizes and signatures leave over and
    that share no band before the block's own, and their matches. allowed(x): rows that may be x's partners."""
    comp, n, band = block.column("component").to_numpy(), block.column("n").to_numpy(), block.column("band")[0].as_py()
    bands = sig.reshape(-1, BANDS, ROWS)
    left, right, same = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in range(len(comp)):
        y = np.flatnonzero(allowed(x) & (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
        if len(y):
            keep, count = prune(np.broadcast_to(sig[x], (len(y), N_HASHES)), sig[y], least)
            y = y[keep]
            mine = (bands[y] == bands[x]).all(2).argmax(1) == band
            left.append(np.full(int(mine.sum()), x))
            right.append(y[mine])
            same.append(count[mine])
    return np.concatenate(left), np.concatenate(right), np.concatenate(same)


def _packs(n: np.ndarray, texts: int, shingles_: int) -> np.ndarray:
    """The pack of each row, in order: at most so many rows, and so many shingles in all but for a single row."""
    out, pack, rows, size = np.zeros(len(n), np.int64), 0, 0, 0
    for i, k in enumerate(n.tolist()):
        if rows and (rows == texts or size + k > shingles_):
            pack, rows, size = pack + 1, 0, 0
        out[i], rows, size = pack, rows + 1, size + k
    return out


IN_BLOCK = "bucket long, band int, i long, j long, p long, q long, side int, rep long, component long, n long, chunk long"


def block_candidates(blocks: DataFrame, percent: int, miss: float) -> DataFrame:
    """IN_BLOCK rows: the members of each block of signatures that have a partner there, in pairs (p, q) of packs (sides 0
    and 1) in which one has."""
    least, most = least_matches(percent / 100, miss), (TEXTS, SHINGLES)
    names = ["bucket", "band", "i", "j", "p", "q", "side", "rep", "component", "n", "chunk"]

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        rep, side = block.column("rep").to_numpy(), block.column("chunk").to_numpy()
        i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        x, y, _ = _block_pairs(block, _matrix(block.column("sig")), (lambda k: rep > rep[k]) if i == j else (lambda k: side > side[k]), percent, least)
        some = np.unique(np.concatenate((x, y)))
        pack = np.full(len(rep), -1)
        pack[some] = _packs(block.column("n").to_numpy()[some], *most)
        rows, p, q, half = [np.zeros(0, np.int64)], [], [], []
        for a, b in sorted(set(zip(np.minimum(pack[x], pack[y]).tolist(), np.maximum(pack[x], pack[y]).tolist()))):
            for s, part in enumerate((a, b) if a != b else (a,)):
                mine = some[pack[some] == part]
                rows.append(mine)
                p += [a] * len(mine)
                q += [b] * len(mine)
                half += [s] * len(mine)
        at = pa.array(np.concatenate(rows))
        told = [block.column(c).take(at) for c in ("bucket", "band", "i", "j")] + [pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(half, pa.int32())]
        return pa.table([*told, *(block.column(c).take(at) for c in ("rep", "component", "n", "chunk"))], names)

    return blocks.groupBy("bucket", "i", "j").applyInArrow(run, IN_BLOCK)


def block_links(blocks: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """(a, b): verified links of IN_BLOCK rows with sig and text. Likeliest pairs first; pairs whose components the block has
    joined already are passed over, so a block returns fewer links than it has members."""
    least = least_matches(percent / 100, miss)

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        rep, comp, half, chunk = (block.column(c).to_numpy() for c in ("rep", "component", "side", "chunk"))
        one, lone = block.column("p")[0].as_py() == block.column("q")[0].as_py(), block.column("i")[0].as_py() == block.column("j")[0].as_py()

        def allowed(k: int) -> np.ndarray:
            other = (rep > rep[k]) if one else (half > half[k])
            return other if lone else other & (chunk != chunk[k])

        x, y, count = _block_pairs(block, _matrix(block.column("sig")), allowed, percent, least)
        some, at = np.unique(np.concatenate((x, y)), return_inverse=True)
        sets = []
        for part in chunks(block.column("text").combine_chunks().take(pa.array(some))):
            h, bound = shingle_sets(part, size)
            sets += [h[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
        root = {int(c): int(c) for c in comp}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b = [], []
        for k in np.argsort(-count, kind="stable").tolist():
            p, q = top(int(comp[x[k]])), top(int(comp[y[k]]))
            if p != q and alike(sets[at[k]], sets[at[len(x) + k]], percent):
                root[max(p, q)] = min(p, q)
                a.append(int(rep[x[k]]))
                b.append(int(rep[y[k]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("bucket", "i", "j", "p", "q").applyInArrow(run, "a long, b long")


def salt(limit: int) -> Column:
    """Which of its bucket's tasks a member goes to; m: the bucket's members."""
    return F.when(F.col("m") > limit, F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / limit))).otherwise(F.lit(0)).cast("int")


def salts(limit: int) -> Column:
    return F.sequence(F.lit(0), F.when(F.col("m") > limit, F.ceil(F.col("m") / limit) - 1).otherwise(F.lit(0)).cast("int"))


def across(members: DataFrame, reps: DataFrame, texts: DataFrame, label: DataFrame, limit: int, size: int, percent: int, miss: float, scratch: Scratch) -> DataFrame:
    """(a, b): verified links between the components of each bucket, by blocks of its members. A pair is looked at in the
    first band it shares and nowhere else."""
    named = members.join(label.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("bucket", "band", "rep", "m", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("bucket").agg(F.max("m").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    mixed = mixed.select("bucket", F.explode(salts(limit)).alias("salt"))
    cut = named.withColumn("salt", salt(limit)).join(mixed.hint("merge"), ["bucket", "salt"]).withColumn("k", F.ceil(F.col("m") / BLOCK)).withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "rep"), "k"))
    blocks = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("bucket", "band", "rep", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    found = scratch.save(block_candidates(blocks.join(reps.select("rep", "n", "sig").hint("merge"), "rep"), percent, miss), "candidates")
    carried = reps.select("rep", "sig").join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    return block_links(found.join(carried.hint("merge"), "rep"), size, percent, miss)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts without words, have no shingles and link with nothing. A text of fewer words than
    a shingle has one: its whole sequence. Very long texts are looked at whole. Rows of one doc_id are one document of the
    graph, with the links of all its texts. A row without doc_id can't be named in a component: component_id is null
    and kept true. Ties need no rule: a component's smallest doc_id stays. An empty table gives an empty result. Other
    columns are not looked at.
    miss: the chance at which a pair is pruned; links of banding are missed at (1 - s^5)^25, under 5e-5 from s = 0.8.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sigs = scratch.save(signatures(docs, size), "sigs")
    reps = scratch.save(sigs.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "reps")
    rows = 4 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substr(F.col("sig"), j * rows + 1, F.lit(rows))))
    buckets = reps.select("rep", F.posexplode(band).alias("band", "bucket"))
    counted = buckets.groupBy("bucket").agg(F.count("*").alias("m"), F.min("rep").alias("pivot"), F.max("rep").alias("last"))
    shared = scratch.save(counted.where("pivot <> last").select("bucket", "m", "pivot"), "shared")
    limit = max(SPLIT, -(-BANDS * reps.count() // MOST_SPLIT))
    large = F.broadcast(shared.where(F.col("m") > limit).select("bucket", "m"))  # fewer than MOST_SPLIT rows
    dealt = buckets.join(large, "bucket", "left").select("rep", "band", "bucket", salt(limit).alias("salt"))
    pivots = shared.select("bucket", "m", "pivot", F.explode(salts(limit)).alias("salt"))
    members = scratch.save(dealt.join(pivots.hint("merge"), ["bucket", "salt"]).drop("salt"), "members")
    texts = scratch.save(_plain(docs).join(members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id"), "texts")
    pairs = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    live = scratch.save(survivors(pairs, reps, percent, miss), "live")
    first = live.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b")
    links = scratch.save(verified(first, texts, size, percent), "links1")
    label = components(links, scratch, "c1")
    late = scratch.save(across(members, reps, texts, label, limit, size, percent, miss, scratch), "links2")
    if late.limit(1).count():
        label = components(links.union(late), scratch, "c2")
    scratch.drop("shared", "members", "live", "texts", "candidates")
    named = reps.select("n", "d1", "d2", "rep").join(label.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n", "d1", "d2").join(named.hint("merge"), ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those of a near-duplicate component that are not its smallest doc_id; all columns stay.

    Of rows of a kept doc_id with equal texts (nulls too) one stays, the first by a hash of all columns; different texts under one
    kept doc_id all stay. Rows without doc_id, and null, empty and wordless texts, stay. Very long texts are looked at
    whole. An empty table gives an empty one.
    """
    kept = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.struct(*docs.columns).alias("_row"))
    text = F.col("_row.text").cast("string")
    once = rows.join(kept.hint("merge"), "_id", "left_semi").groupBy("_id", F.xxhash64(text), F.xxhash64(F.lit(1), text)).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.select("_row.*").unionByName(docs.where("doc_id is null"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of documents, on shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
