"""Language of texts by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a text's vector bundles (adds) the vectors of all its n-grams, and a language's
prototype those of all its training texts. A text takes the language whose prototype has the largest cosine with it.

Every letter has a vector of its own, made from its code point; every run of other signs is one boundary. Training
bundles the n-grams of all training rows inside the tasks; only a language's sums, one number a dimension, are added up in
Spark and come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblock import mix

DIMENSIONS = 512
SEED = 52
UNKNOWN = "und"
PART_CHARS = 1 << 20
#: n-gram vectors kept by a task before it starts afresh, and the most languages that prototypes are made for.
KEPT_GRAMS, MOST_LANGUAGES = 1 << 15, 10_000
#: Bits of a code point in an n-gram's number.
BITS = 21

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    if not _tables:
        _tables.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _tables[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter trigrams (the middle is a letter, the others may be boundaries, 0) of lower-cased texts end to end, as three
    code points in one number, and the bounds of each text's."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_letters()[points], points, 0).astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    ends = np.cumsum([1 + len(t) for t in low])  # the \n after each text
    place = np.cumsum(keep)
    c = c[keep]
    middle = np.flatnonzero(c[1:-1]) + 1
    grams = (c[middle - 1] << (2 * BITS)) | (c[middle] << BITS) | c[middle + 1]
    bound = np.concatenate(([0], np.searchsorted(middle, place[ends] - 1)))
    return grams, bound


class Space:
    """Vectors of n-grams, made when first asked for; the latest ones are kept."""

    def __init__(self, seed: int = SEED, dimensions: int = DIMENSIONS):
        self.seed, self.dimensions = seed, dimensions
        self.reset()

    def reset(self) -> None:
        self.grams = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dimensions), np.float32)

    def letters(self, points: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 for each code point."""
        which = points[:, None].astype(np.uint64) * np.uint64(self.dimensions) + np.arange(self.dimensions, dtype=np.uint64)
        return 1 - 2 * (mix(which, self.seed) >> np.uint64(63)).astype(np.int8)

    def make(self, grams: np.ndarray) -> np.ndarray:
        mask = (1 << BITS) - 1
        a, b, c = (self.letters(grams >> k & mask) for k in (2 * BITS, BITS, 0))
        return (np.roll(a, 2, 1) * np.roll(b, 1, 1) * c).astype(np.float32)

    def _places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.grams, grams), max(0, len(self.grams) - 1))
        return at, self.grams[at] == grams if len(self.grams) else np.zeros(len(grams), bool)

    def bundle(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum of n times each distinct gram's vector, whole numbers in double precision."""
        out = np.zeros(self.dimensions)
        for k in range(0, len(grams), 4096):
            some, times = grams[k : k + 4096], n[k : k + 4096]
            at, known = self._places(some)
            if not known.all():
                new = some[~known]
                if len(self.grams) + len(new) > KEPT_GRAMS:
                    self.reset()
                    new = some
                both = np.concatenate((self.grams, new))
                order = np.argsort(both, kind="stable")
                self.grams, self.vectors = both[order], np.concatenate((self.vectors, self.make(new)))[order]
                at, _ = self._places(some)
            out += times.astype(np.float64) @ self.vectors[at]
        return out


_kept: list[Space] = []


def _space() -> Space:
    """A worker process's vectors, kept from task to task."""
    if not _kept:
        _kept.append(Space())
    return _kept[0]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in lists of about PART_CHARS, with the row of each list's first."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if held and size + len(text) > PART_CHARS:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def bundles(train: DataFrame) -> DataFrame:
    """(lang, dimension, v): the bundle of each language, over all rows of train(lang, text). A task's rows of a language are
    one bundle before they leave it, so a language of a third of all rows is no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = _space(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in _parts(batch.column(1)):
                grams, bound = trigrams(texts)
                by: dict[str, list[np.ndarray]] = {}
                for lang, a, b in zip(langs[first:], bound[:-1].tolist(), bound[1:].tolist()):
                    by.setdefault(lang, []).append(grams[a:b])
                for lang, mine in by.items():
                    v = space.bundle(*np.unique(np.concatenate(mine), return_counts=True)).astype(np.int64)
                    total[lang] = total[lang] + v if lang in total else v
                if len(total) > MOST_LANGUAGES:
                    raise ValueError(f"over {MOST_LANGUAGES} languages")
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(range(len(v)), pa.int32()), pa.array(v)], ["lang", "dimension", "v"])

    return train.select("lang", "text").mapInArrow(run, "lang string, dimension int, v long").groupBy("lang", "dimension").agg(F.sum("v").alias("v"))


@dataclass
class Prototypes:
    """Unit vectors of languages, in order of their names."""

    langs: list[str]
    matrix: np.ndarray


def identify(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """(doc_id, lang_pred, score) per row of docs(doc_id, text). score: the best cosine, at least 0.

    A null text, one without a letter, and any text where no language was learned, are und with score 0; ties go to the first
    name. Repeated rows each give a result. A very long text is bundled whole, its distinct n-grams by the thousand. An
    empty table gives an empty result. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, space = shared.value, _space()
        for batch in batches:
            for first, texts in _parts(batch.column(1)):
                grams, bound = trigrams(texts)
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist())):
                    if b > a and p.langs:
                        v = space.bundle(*np.unique(grams[a:b], return_counts=True))
                        cosine = p.matrix @ v / max(float(np.linalg.norm(v)), 1e-12)
                        best = int(np.argmax(cosine))
                        names[i], scores[i] = p.langs[best], min(1.0, max(0.0, float(cosine[best])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn(train: DataFrame) -> Prototypes:
    """Prototypes of the languages of train(lang, text), MOST_LANGUAGES at most (more are an error); rows with a null in either
    are left out. Repeated rows count as often as they occur."""
    good = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    packed = bundles(good).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dimension", "v"))).alias("a")).select("lang", F.transform("a", lambda s: s["v"]).alias("v"))
    rows = packed.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    v = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), DIMENSIONS)
    return Prototypes([r["lang"] for r in rows], v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))


def remainder(doc_id, m: int):
    """crc32(doc_id as text) mod m; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of documents by what four fifths of them teach; held_out marks the fifth that doesn't."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = learn(docs.where(remainder("doc_id", 5) != 0))
    out = identify(docs, prototypes)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
