"""Document fingerprints by spot signatures: chains of content words behind anchors.

Anchors are the corpus's own common words, so that they fit its languages: those found in at least SHARE of all documents, the ANCHORS most
frequent of them. Texts of rare words would have few spots, so one word in SPARE is an anchor too, chosen by its hash. A signature is the
hash of an anchor and of the CHAIN words without common ones that follow it; the first words of a text are one as well. A text's fingerprint is
the set of its signatures. Two of them are compared by Jaccard, in partitions by set length: a pair whose lengths, or whose common
signatures so far, leave the least likeness asked for out of reach is not looked at further.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblock import ALNUM, CHUNK_BYTES, Chunk, SpanHashes, chunks, mix, words

SHARE, ANCHORS, SPARE, CHAIN = 0.01, 128, 16, 3
#: Documents a bucket of the order by doc_id is meant for, and most buckets.
ROWS, BUCKETS = 1000, 1 << 16


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lowered words (letters, digits, all beyond ASCII) of all rows, and each row's first one (and the end)."""
    w = words(chunk, ALNUM)
    return SpanHashes(chunk).of(w.start, w.end), w.first


def _per_document(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(rows, words of each row once, all rows together) chunk by chunk."""
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            h, first = word_hashes(chunk)
            row = np.repeat(np.arange(len(chunk), dtype=np.uint64), np.diff(first))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            yield len(chunk), h[new]


class _Counts:
    """Counts of hashes as sorted arrays, merged by the million."""

    def __init__(self):
        self.names, self.n, self.held, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        self.size += len(h)
        if self.size > 1 << 21:
            self.merge()

    def merge(self) -> None:
        names, at = np.unique(np.concatenate((self.names, *self.held)), return_inverse=True)
        self.n = np.bincount(at, np.concatenate((self.n, np.ones(self.size, np.int64))), len(names)).astype(np.int64)
        self.names, self.held, self.size = names, [], 0


def common_words(docs: DataFrame, share: float = SHARE, most: int = ANCHORS) -> np.ndarray:
    """Hashes (sorted) of the words found in at least share of all rows of docs(text), the most frequent of them by documents, ties by hash.

    A word of that share overall has it in one task at least: a first pass gives the words that have it somewhere (at most words a
    document / share of each task), a second one counts those in all documents. Null and empty texts count as documents."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, _Counts()
        for n, h in _per_document(batches):
            total += n
            counts.add(h)
        counts.merge()
        yield pa.RecordBatch.from_arrays([pa.array(counts.names[counts.n >= share * total].astype(np.int64))], ["word"])

    # Counted once a task, in a table of the words that are common somewhere: its size follows 1 / share, not the documents.
    seen = texts.mapInArrow(frequent, "word long").distinct().collect()
    names = np.sort(np.array([r["word"] for r in seen], np.int64).astype(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, np.zeros(len(names) + 1, np.int64)
        for rows, h in _per_document(batches):
            total += rows
            if len(names):
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                n[:-1] += np.bincount(at[names[at] == h], minlength=len(names))
        n[-1] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.append(names.astype(np.int64), 0)), pa.array(np.arange(len(n)) == len(names)), pa.array(n)], ["word", "all", "n"])

    got = texts.mapInArrow(count, "word long, all boolean, n long").groupBy("word", "all").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in got if r["all"])
    ranked = sorted((-r["n"], r["word"] % (1 << 64)) for r in got if not r["all"] and r["n"] >= share * total and r["n"])
    return np.sort(np.array([w for _, w in ranked[:most]], np.uint64))


def signatures(chunk: Chunk, common: np.ndarray) -> list[np.ndarray]:
    """The sorted 32-bit signatures of each row."""
    h, first = word_hashes(chunk)
    rows, n = len(chunk), len(h)
    is_common = np.zeros(n, bool)
    if len(common) and n:
        is_common = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    row = np.repeat(np.arange(rows), np.diff(first))
    content = np.flatnonzero(~is_common)
    anchor = np.flatnonzero(is_common | (mix(h, 11) % np.uint64(SPARE) == 0))
    begin = np.searchsorted(content, anchor, "right")  # the first content word behind each anchor
    ok = begin + CHAIN <= len(content)
    anchor, begin = anchor[ok], begin[ok]
    ok = row[content[begin + CHAIN - 1]] == row[anchor] if len(begin) else np.zeros(0, bool)
    anchor, begin = anchor[ok], begin[ok]
    value = mix(h[anchor], 12)
    for k in range(CHAIN):
        value = mix(value * np.uint64(3) + h[content[begin + k]], 13)
    some = np.flatnonzero(np.diff(first))
    opening = mix(np.ones(len(some), np.uint64), 14)
    for k in range(CHAIN):
        at = first[some] + k
        inside = at < first[some + 1]
        opening = mix(opening * np.uint64(3) + np.where(inside, h[np.minimum(at, n - 1)] if n else 0, np.uint64(k)), 13)
    key = np.concatenate(((row[anchor].astype(np.uint64) << np.uint64(32)) | (value >> np.uint64(32)), (some.astype(np.uint64) << np.uint64(32)) | (opening >> np.uint64(32))))
    key = np.unique(key)
    cut = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(32))
    out = [key[a:b].astype(np.uint32) for a, b in zip(cut[:-1], cut[1:])]
    for r in np.flatnonzero(np.diff(first) == 0).tolist():  # no word: the text itself, unless it is blank
        text = chunk.data[chunk.offsets[r] : chunk.offsets[r + 1]].tobytes().strip()
        if text:
            out[r] = np.frombuffer(hashlib.blake2b(text, digest_size=4).digest(), "<u4")
    return out


def chunk_of(texts: list[bytes]) -> Chunk:
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return Chunk(0, len(texts), np.frombuffer(b"".join(texts), np.uint8), offsets, np.zeros(len(texts), bool))


def spelt(sigs: np.ndarray) -> str:
    """A fingerprint as text."""
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def unspelt(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many numbers each a and b share."""
    pair = [np.repeat(np.arange(len(x), dtype=np.uint64) << np.uint64(32), [len(s) for s in x]) for x in (a, b)]
    left, right = (p | np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.uint64) for p, x in zip(pair, (a, b)))
    both = np.intersect1d(left, right, assume_unique=True)
    return np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(a))


def pruned_jaccard(a: list[np.ndarray], b: list[np.ndarray], least: float = 0.0) -> np.ndarray:
    """Likeness of each pair of sorted sets; 0 where it is below least. Two empty sets are alike.

    Pairs are taken by partitions of set length, which are bounded by powers of two; unlike lengths are out at once. The rest are compared on the
    lower half of all hashes first, and only those that can still reach least on the upper one."""
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.where((n == 0) & (m == 0), 1.0, 0.0)
    low, high = np.minimum(n, m), np.maximum(n, m)
    live = np.flatnonzero((low > 0) & (low >= least * high))
    level = np.frexp(high.astype(float))[1]
    half = np.uint32(1 << 31)
    for k in np.unique(level[live]).tolist():
        part = live[level[live] == k]
        x, y = [np.searchsorted(a[i], half) for i in part], [np.searchsorted(b[i], half) for i in part]
        shared = _common([a[i][:c] for i, c in zip(part, x)], [b[i][:c] for i, c in zip(part, y)])
        reach = shared + np.minimum(n[part] - x, m[part] - y)
        go = np.flatnonzero(reach >= least * (n[part] + m[part] - reach))
        shared = shared[go] + _common([a[part[g]][x[g] :] for g in go], [b[part[g]][y[g] :] for g in go])
        part = part[go]
        got = shared / (n[part] + m[part] - shared)
        out[part] = np.where(got >= least, got, 0.0)
    return out


def fingerprints(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, n_spots, fingerprint) of each row of docs(doc_id, text): the number of its signatures, and their set as text.

    Null, empty and blank texts have none; a text without words has one, of itself. Rows without doc_id and repeated rows each give a
    result, an empty table an empty one, and other columns are not looked at. Texts are taken whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                sigs = signatures(chunk, common)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array([len(s) for s in sigs], pa.int64()), pa.array([spelt(s) for s in sigs])], ["doc_id", "n_spots", "fingerprint"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_spots long, fingerprint string")


def compare(pairs: DataFrame, left: str, right: str, least: float = 0.8) -> DataFrame:
    """pairs with near: the likeness of the fingerprints in two columns, 0 below least, null where one is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
            near: list = [None] * len(a)
            for i, v in zip(at, pruned_jaccard([unspelt(a[i]) for i in at], [unspelt(b[i]) for i in at], least).tolist()):
                near[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.float64())], ["_row", "near"])

    carried = pairs.select(F.struct(*pairs.columns).alias("_row"), F.col(left).alias("_left"), F.col(right).alias("_right"))
    out = carried.mapInArrow(run, carried.select("_row").withColumn("near", F.lit(None).cast("double")).schema)
    return out.select("_row.*", "near")


_LEAST = -(1 << 63)


def places(ids: np.ndarray, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Buckets in the order of ids; an id that holds several cuts is dealt by hash over the buckets between them, in its order."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    part = ((h.astype(np.float64) / 2.0**64 + 0.5).clip(0, 1) * (high - low + 1)).astype(np.int64)
    return np.where(high - low >= 2, np.minimum(low + part, high), high)


def edited_fingerprints(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Fingerprints of each text of docs(doc_id, text) and of its edited text, whose last third is the begin of the next document's, and
    the likeness of the first to the second and to the next document's.

    The order is descending by doc_id, then by the text's hash, nulls last; the first document follows the last one, and a document alone follows
    itself. Rows are cut to ordered buckets, each also gets the next one's first row, and every bucket is one sorted pass. Null texts
    are empty. Repeated rows each give a result, an empty table an empty one, and other columns are not looked at."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.coalesce("doc_id", F.lit(_LEAST))
    n = docs.count()
    parts = min(BUCKETS, n // ROWS)
    cuts = np.zeros(0, np.int64)
    if parts > 1:
        got = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("k")).agg(F.percentile_approx("k", [k / parts for k in range(1, parts)], max(10_000, 10 * parts)).alias("c")).first()
        cuts = np.array(got["c"], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(places(k, h, cuts)), batch.column(0), batch.column(1)], ["b", "k", "h"])

    # One row a bucket, of at most BUCKETS.
    firsts = plain.select(key.alias("k"), "h").mapInArrow(place, "b long, k long, h long").groupBy("b").agg(F.max(F.struct("k", "h")).alias("top")).collect()
    firsts = sorted(((r["b"], r["top"]["k"], r["top"]["h"]) for r in firsts), reverse=True)
    halo = {f[1:]: firsts[i - 1][0] for i, f in enumerate(firsts)}  # of the first bucket: the last one's number

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            k, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            b = places(k, h, cuts)
            ids, text = batch.column(0), batch.column(2).cast(pa.binary())
            size = text.value_lengths() if hasattr(text, "value_lengths") else pa.compute.binary_length(text)
            raw = [codec.compress(t.as_buffer()).to_pybytes() for t in text]
            more = [i for i, x in enumerate(zip(k.tolist(), h.tolist())) if x in halo]
            at = pa.array([*range(len(k)), *more], pa.int64())
            to = np.concatenate((b, np.array([halo[int(k[i]), int(h[i])] for i in more], np.int64)))
            flag = np.arange(len(at)) >= len(k)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(flag), ids.take(at), batch.column(1).take(at), batch.column(3).take(at), size.take(at).cast(pa.int64()), pa.array(raw, pa.binary()).take(at)], ["b", "halo", "doc_id", "k", "h", "size", "raw"])

    dealt = plain.select("doc_id", key.alias("k"), "text", "h").mapInArrow(deal, "b long, halo boolean, doc_id long, k long, h long, size long, raw binary")
    ordered = dealt.repartition("b").sortWithinPartitions("b", "halo", F.desc("k"), F.desc("h"), "raw")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        codec = pa.Codec("zstd")
        for batch in batches:
            b, flag, ids, size = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
            for i, raw in enumerate(batch.column(6)):
                yield b[i], flag[i], ids[i], codec.decompress(raw.as_buffer(), size[i]).to_pybytes() if size[i] else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(group: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            """Results of all but the last of consecutive documents."""
            raw = [t for _, t in group]
            text = [t.decode() for t in raw]
            edited = []
            for t, after in zip(text, text[1:]):
                k = len(t) // 3
                edited.append((t[: len(t) - k] + after[:k]).encode())
            own, new = signatures(chunk_of(raw), common), signatures(chunk_of(edited), common)
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in group[:-1]], pa.int64()), pa.array([len(t) for t in text[:-1]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array([spelt(s) for s in own[:-1]]),
                 pa.array([spelt(s) for s in new]), pa.array(pruned_jaccard(own[:-1], new)), pa.array(pruned_jaccard(own[:-1], own[1:]))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        group, held, bucket = [], 0, None
        for b, is_halo, doc_id, text in rows_of(batches):
            if b != bucket:
                group, held, bucket = [], 0, b
            elif not group:
                continue  # the bucket is done; further copies of its halo row
            group.append((doc_id, text))
            held += len(text)
            if is_halo or held > CHUNK_BYTES and len(group) > 1:
                yield finish(group)
                group, held = ([], 0) if is_halo else (group[-1:], len(text))

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_fingerprints() of documents with anchors that are common in them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return edited_fingerprints(docs, common_words(docs))
