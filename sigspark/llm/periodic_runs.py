"""Periodic runs of words: stretches that repeat a block of q words at least twice, and texts with each run cut to its first block.

Every task works on whole texts, as numbers of their words. Longest common extensions come from a difference cover: of every
31 places the 6 of COVER are sampled, so that two places always have a shift at which both are samples; only the sampled suffixes are
sorted (by blocks of 31 words, then by doubling their ranks), and the common prefix of two samples is a range minimum over
those of neighbours in that order, by a sparse table. An extension compares words up to the shift and asks the table beyond it.

Runs are enumerated over a harmonic grid: for each period q the places 0, q, 2q, ..., as a run of period q and at least 2q words
holds such a place and the one q later. Where both hold the same word, the extensions to either side give the whole run. The grid
has n/1 + n/2 + ... places, so a text of n words costs n log n. The structure is built for those texts alone in which some comparison
reaches a sample.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblock import chunks

#: A perfect difference set: every number but 0 modulo CYCLE is the difference of exactly one pair of COVER.
CYCLE, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words compared before a sample is asked, at least; fewer in common on both sides are no run.
FEW = 6
LEAST = 12
#: Places of the grid looked at together, and bytes of a text taken to words together.
GRID, PIECE = 1 << 21, 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@lru_cache(None)
def shifts() -> np.ndarray:
    """[a, b]: the least shift from FEW on that takes places of remainders a and b to samples."""
    member = np.isin(np.arange(CYCLE), COVER)
    both = np.stack([np.outer(np.roll(member, -d), np.roll(member, -d)) for d in range(FEW, FEW + CYCLE)])
    return (FEW + both.argmax(0)).astype(np.int64)


class Samples:
    """Common prefixes of the sampled suffixes of a sequence of numbers from 0."""

    def __init__(self, seq: np.ndarray):
        n, width = len(seq), len(COVER)
        at = (np.arange(0, n, CYCLE)[:, None] + np.array(COVER)).reshape(-1)
        self.at = at = at[at < n]
        self.slot = np.full(CYCLE, -1, np.int64)
        self.slot[list(COVER)] = np.arange(width)
        self.m = m = len(at)
        # Ranks of the first CYCLE words: several words to a number. Past the end stands 0, which is less than any word.
        padded = np.concatenate((seq + 1, np.zeros(2 * CYCLE, seq.dtype))).astype(np.int64)
        bits = int(padded.max(initial=1)).bit_length()
        per = max(1, 62 // bits)
        keys = []
        for c in range(0, CYCLE, per):
            key = np.zeros(m, np.int64)
            for t in range(c, min(c + per, CYCLE)):
                key = (key << bits) | padded[at + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        levels = [rank]
        while m and levels[-1].max() < m - 1:
            step = CYCLE << (len(levels) - 1)
            key = levels[-1] * (m + 1) + self.rank_at(levels[-1], at + step, n) + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], key[order[1:]] != key[order[:-1]])))
            levels.append(rank)
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        a, b = at[order[:-1]], at[order[1:]]
        same = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = self.rank_at(levels[k], a + same, n), self.rank_at(levels[k], b + same, n)
            same += np.where((x == y) & (x >= 0), CYCLE << k, 0)
        same += matched(padded, a + same, b + same, np.full(len(a), CYCLE))
        self.least = [np.concatenate(([0], same))]  # [k][r]: least of the 2^k common prefixes from rank r on
        while 2 << (len(self.least) - 1) <= m:
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last, np.concatenate((last[half:], last[-1:].repeat(half)))))
        self.table = np.stack(self.least)

    def rank_at(self, ranks: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Ranks of the suffixes from sampled places on, -1 past the end."""
        inside = place < n
        k = place // CYCLE * len(COVER) + self.slot[place % CYCLE]
        return np.where(inside, ranks[np.where(inside, k, 0)], -1)

    def common(self, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        """Common prefixes of the suffixes from sampled places i and j (unlike) on; 0 past the end."""
        x, y = self.rank_at(self.rank, i, n), self.rank_at(self.rank, j, n)
        ok = (x >= 0) & (y >= 0)
        low, high = np.minimum(x, y)[ok] + 1, np.maximum(x, y)[ok]
        out = np.zeros(len(i), np.int64)
        k = np.frexp((high - low + 1).astype(float))[1] - 1
        out[ok] = np.minimum(self.table[k, low], self.table[k, high - (1 << k) + 1])
        return out


def matched(seq: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are the same, up to most. seq must not end within them."""
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for t in range(int(most.max(initial=0))):
        live = live[most[live] > t]
        live = live[seq[i[live] + t] == seq[j[live] + t]]
        if not len(live):
            break
        out[live] = t + 1
    return out


class Extensions:
    """How far the words from places i and j on agree, forwards; sections between bounds are texts, and no agreement leaves one."""

    def __init__(self, seq: np.ndarray, bounds: np.ndarray):
        # Past each text stands a number of its own, so that nothing agrees beyond it; the whole ends with a cycle of those.
        texts, size = len(bounds) - 1, int(seq.max(initial=-1)) + 1
        self.bounds, self.shift = bounds, shifts()
        self.place = np.arange(len(seq)) + np.repeat(np.arange(texts), np.diff(bounds))
        self.seq = np.concatenate((np.zeros(len(seq) + texts, np.int64), size + texts + np.arange(2 * (CYCLE + FEW))))
        self.seq[self.place] = seq
        self.seq[bounds[1:] + np.arange(texts)] = size + np.arange(texts)
        self.size = size

    def __call__(self, i: np.ndarray, j: np.ndarray, text: np.ndarray) -> np.ndarray:
        """i, j: places; text: that of each pair."""
        x, y = self.place[i], self.place[j]
        most = self.shift[x % CYCLE, y % CYCLE]
        out = matched(self.seq, x, y, most)
        far = np.flatnonzero(out == most)
        if len(far):
            out[far] += self.beyond(x[far] + most[far], y[far] + most[far], text[far])
        return out

    def beyond(self, x: np.ndarray, y: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Agreement from samples on: sorted are the suffixes of the texts asked for alone."""
        which = np.unique(text)
        begin = self.bounds[which] + which
        begin -= begin % CYCLE  # places keep their remainders
        stop = self.bounds[which + 1] + which + 1
        room = -(-(stop - begin) // CYCLE) * CYCLE
        to = np.cumsum(room) - room
        total = int(room.sum())
        part = self.size + len(self.bounds) + np.arange(total)  # every gap has a number of its own
        source = np.arange(total) - np.repeat(to - begin, room)
        own = (source >= np.repeat(self.bounds[which] + which, room)) & (source < np.repeat(stop - 1, room))
        part[own] = self.seq[source[own]]
        move = (to - begin)[np.searchsorted(which, text)]
        return Samples(np.unique(part, return_inverse=True)[1]).common(x + move, y + move, total)


def find_runs(seq: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(text, start, length, period) of every run of at least max(least, 2 * period) words of the texts seq[bounds[t]:bounds[t + 1]],
    ordered by text, start and period; places count from each text's begin."""
    forth, n = Extensions(seq, bounds), len(seq)
    back = Extensions(seq[::-1], n - bounds[::-1])
    size = np.diff(bounds)
    periods = np.where(size >= least, size // 2, 0)
    texts = len(size)
    before = np.concatenate(([0], np.cumsum(periods)))
    found = []
    done, most = 0, int(before[-1])
    while done < most:
        pair = np.arange(done, min(most, done + GRID))
        text = np.searchsorted(before, pair, "right") - 1
        q = pair - before[text] + 1
        points = (size[text] - 1) // q
        stop = max(1, int(np.searchsorted(np.cumsum(points), GRID, "right")))
        text, q, points = text[:stop], q[:stop], points[:stop]
        done += stop
        total = int(points.sum())
        which = np.repeat(np.arange(stop), points)
        i = bounds[text[which]] + (np.arange(total) - np.repeat(np.cumsum(points) - points, points)) * q[which]
        hit = np.flatnonzero(seq[i] == seq[i + q[which]])
        i, text, q = i[hit], text[which[hit]], q[which[hit]]
        need = np.maximum(least - q, q)
        j = i + q
        f = forth(i, j, text)
        b = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > bounds[text])  # from the words before both places backwards
        b[inner] = back(n - i[inner], n - j[inner], texts - 1 - text[inner])
        ok = f + b >= need
        start, end = (i - b)[ok], (j + f)[ok]
        found.append(np.unique(np.stack([text[ok], start - bounds[text[ok]], end - start, q[ok]], 1), axis=0))
    if not found:
        return np.zeros((0, 4), np.int64)
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    # Of one stretch with several periods all are multiples of the smallest, whose run it is.
    first = np.concatenate(([True], (every[1:, :3] != every[:-1, :3]).any(1))) if len(every) else np.zeros(0, bool)
    every = every[first]
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def numbered(data: bytes, names: dict[bytes, int]) -> np.ndarray:
    """The words of a text by their numbers in names, which grows; at most PIECE bytes (and a word) become words at a time."""
    out, at = [], 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE) if len(data) - at > PIECE else None
        stop = cut.start() if cut else len(data)
        out.append(np.array([names.setdefault(w, len(names)) for w in data[at:stop].split()], np.int32))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run (start, length, period) contains after its first period words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string()), ("collapsed_sha256", pa.string())])


def periodic_runs(docs: DataFrame, least: int = LEAST, texts: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, runs (start, length, period, in words, ordered by start and period) of at least
    max(least, 2 * period) words, collapsed (the words, one space between them, without those that a run contains after its first
    period; null unless texts), and the SHA-256 of collapsed.

    Words are stretches without white space (\\x20, \\x09 to \\x0D). A null or empty text, or one of white space, has no run and
    an empty collapsed text. Rows without doc_id and repeated rows each give a result, an empty table an empty one, and other columns are
    not looked at. Whole texts are searched: one of n words takes about n log n time and 100 n bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                names: dict[bytes, int] = {}
                seqs = [numbered(chunk.data[a:b].tobytes(), names) for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:])]
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
                found = find_runs(np.concatenate(seqs).astype(np.int64), bounds, least)
                at = np.searchsorted(found[:, 0], np.arange(len(seqs) + 1))
                spelt = list(names)
                runs, left, digests = [], [], []
                for t, seq in enumerate(seqs):
                    mine = found[at[t] : at[t + 1], 1:]
                    if len(mine):
                        seq = seq[kept_words(len(seq), mine)]
                    digest, parts = hashlib.sha256(), []
                    for k in range(0, len(seq), 1 << 16):
                        part = (b" " if k else b"") + b" ".join([spelt[w] for w in seq[k : k + (1 << 16)].tolist()])
                        digest.update(part)
                        if texts:
                            parts.append(part)
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in mine.tolist()])
                    left.append(b"".join(parts).decode() if texts else None)
                    digests.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(runs, _OUT.field(1).type), pa.array(left, pa.string()), pa.array(digests)], schema=_OUT)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string, collapsed_sha256 string")


def folded(doc_id: Column, text: Column) -> Column:
    """The contract's texts: where crc32(doc_id) ends in 0, words from a on repeat with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def fold(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # An array of one binds the words, so that they are split once a text.
    again = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, fold(w)).otherwise(F.lit(""))), 0)
    return F.when(text.isNotNull() & (h % 10 == 0), again).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """periodic_runs() of documents, a tenth of which is made periodic first, as numbers and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", folded(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs(docs, texts=False)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.select("*", best.alias("_best"))
    length, start, period = F.col("_best.length"), -F.col("_best.start"), -F.col("_best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
