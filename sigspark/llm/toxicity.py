"""Toxic spans and document scores by a linear-chain conditional random field.

Labels mark documents; the field is trained on labelled tokens. A bounded sample of labelled documents gives word and
word-prefix features that stand out in toxic ones (a test against chance over both classes); a toxic document's tokens that carry
one are labelled toxic, all others clean. The field has two states, weights for the selected features, a bias, and transitions,
and is fitted by quasi-Newton steps to the optimum of the exact log-likelihood (forward-backward over segments of all tokens of the sample's texts;
equal segments, such as those without a feature, are one with a weight).

Scoring streams every token of every text. Tokens without a selected feature all have the same potentials, so a
stretch of n of them is the n-th power of one 2 x 2 matrix: forward and backward run over the other tokens alone, and
the marginals are those of the whole chain. A document's score is a logistic function, fitted on a part of the sample
that chose no feature, of the expected number of toxic tokens among those with features.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ascent import least
from .scratch import Scratch
from .textblock import ALNUM, Chunk, SpanHashes, Words, chunks, mix, words

#: Most labelled documents of each class in the sample; their texts are taken whole, whatever their length.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 5000
PREFIXES = (4, 5, 6)
SEGMENT = 24
TABLE = 1 << 20


def token_features(chunk: Chunk, w: Words) -> np.ndarray:
    """Feature hashes of each token: its whole word, and its first 4, 5 and 6 bytes (0 where it is shorter)."""
    spans = SpanHashes(chunk)
    size = w.end - w.start
    out = np.zeros((len(w.start), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = spans.of(w.start, w.end)
    for j, k in enumerate(PREFIXES, 1):
        at = np.flatnonzero(size >= k)
        out[at, j] = mix(spans.of(w.start[at], w.start[at] + k), 60 + k)
    return out


@dataclass
class Field:
    """Selected features (sorted hashes), their weights for the toxic state, bias, transition scores and the logistic
    function of a document's evidence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    slope: float
    offset: float

    def ids(self, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Index of each feature, or -1."""
        out = np.full(hashes.shape, -1, np.int32)
        if len(self.features):
            flat, into = hashes.reshape(-1), out.reshape(-1)
            at = np.flatnonzero(table[(flat & np.uint64(TABLE - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.features, flat[at]), len(self.features) - 1)
            hit = self.features[place] == flat[at]
            into[at[hit]] = place[hit]
        return out

    def table(self) -> np.ndarray:
        out = np.zeros(TABLE, bool)
        out[(self.features & np.uint64(TABLE - 1)).astype(np.int64)] = True
        return out

    def scores_of(self, ids: np.ndarray) -> np.ndarray:
        """Emission score of the toxic state for tokens with feature ids (rows, -1 for none)."""
        return self.bias + np.where(ids >= 0, np.append(self.weights, 0)[ids], 0).sum(1)

    def plain_power(self):
        """Normalised powers of a featureless token's transition-and-emission matrix."""
        base = np.exp(self.transitions) * np.exp([0.0, self.bias])

        @lru_cache(None)
        def power(n: int) -> np.ndarray:
            if n == 0:
                return np.eye(2)
            half = power(n // 2)
            m = half @ half @ base if n % 2 else half @ half
            return m / m.max()

        return power

    def marginals(self, at: np.ndarray, score: np.ndarray, n: int, power) -> np.ndarray:
        """P(toxic) of tokens at (positions in a text of n tokens) with emission scores; the rest carry no feature."""
        step = np.exp(self.transitions)
        k = len(at)
        emit = np.stack([np.ones(k), np.exp(np.clip(score, -50, 50))], 1)
        fore, back = np.zeros((k, 2)), np.ones((k, 2))
        # The first token has no transition into it: its state comes from a uniform start.
        if at[0] == 0:
            a = emit[0].copy()
        else:
            a = (np.array([1.0, np.exp(self.bias)]) @ power(int(at[0]) - 1)) @ step * emit[0]
        fore[0] = a / a.sum()
        for i in range(1, k):
            a = fore[i - 1] @ power(int(at[i] - at[i - 1]) - 1) @ step * emit[i]
            fore[i] = a / a.sum()
        b = power(n - 1 - int(at[-1])) @ np.ones(2)
        back[-1] = b / b.sum()
        for i in range(k - 2, -1, -1):
            b = power(int(at[i + 1] - at[i]) - 1) @ step @ (emit[i + 1] * back[i + 1])
            back[i] = b / b.sum()
        p = fore * back
        return p[:, 1] / p.sum(1)


def evidence(p: np.ndarray) -> float:
    """Log of the expected number of toxic tokens, of marginals p."""
    return float(np.log(0.01 + p.sum()))


def fit_chain(x: np.ndarray, y: np.ndarray, valid: np.ndarray, times: np.ndarray, n_features: int, ridge: float = 0.3, bound: float = 1e-3):
    """Weights, bias and transitions of the largest penalised likelihood, where no slope is above bound. x: feature ids (segments,
    tokens, features, -1 for none); y: labels; valid: tokens that exist; times: how often each segment occurs; ridge: the penalty,
    half of it times the squares of weights and transitions, beside the log-likelihood of all tokens."""
    slots = np.where(x >= 0, x, n_features)
    n, length = y.shape
    pair = valid[:, 1:]
    often = np.broadcast_to(times[:, None], pair.shape)[pair]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), often)
    count = np.bincount(slots.reshape(-1), np.repeat((valid * times[:, None]).reshape(-1), x.shape[2]), n_features + 1)[:-1]

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias, trans = np.append(v[:n_features], 0), v[n_features], v[n_features + 1 :].reshape(2, 2)
        score = bias + w[slots].sum(2)
        top = np.maximum(score, 0)  # taken out of both states of a token, so that nothing overflows
        emit = np.exp(np.stack([-top, score - top], 2))
        high = trans.max()
        step = np.exp(trans - high)
        fore, back = np.zeros((n, length, 2)), np.ones((n, length, 2))
        norm = emit[:, 0].sum(1, keepdims=True)
        fore[:, 0] = emit[:, 0] / norm
        log_z = np.log(norm[:, 0]) + np.where(valid, top, 0).sum(1) + pair.sum(1) * high
        for i in range(1, length):
            a = np.where(valid[:, i, None], fore[:, i - 1] @ step * emit[:, i], fore[:, i - 1])
            norm = a.sum(1, keepdims=True)
            fore[:, i] = a / norm
            log_z += np.where(valid[:, i], np.log(norm[:, 0]), 0)
        for i in range(length - 2, -1, -1):
            b = (emit[:, i + 1] * back[:, i + 1]) @ step.T
            b = np.where(valid[:, i + 1, None], b, 1.0)
            back[:, i] = b / b.sum(1, keepdims=True)
        p = fore * back
        p = p[..., 1] / p.sum(2)
        joint = fore[:, :-1, :, None] * step * (emit[:, 1:] * back[:, 1:])[:, :, None, :]
        joint = joint[pair] / joint[pair].sum((1, 2), keepdims=True)
        gap = np.where(valid, y - p, 0) * times[:, None]
        g_w = np.bincount(slots.reshape(-1), np.repeat(gap.reshape(-1), x.shape[2]), n_features + 1)[:-1] - ridge * w[:-1]
        g_t = seen - np.tensordot(often, joint, 1) - ridge * trans
        told = times @ (np.where(valid, y * score, 0).sum(1) - log_z) + (seen * trans).sum() - ridge / 2 * ((w**2).sum() + (trans**2).sum())
        return -told, -np.concatenate((g_w, [gap.sum()], g_t.ravel()))

    total = max(1.0, float(times @ valid.sum(1)))
    start = np.concatenate((np.zeros(n_features), [-1.0], np.zeros(4)))
    v = least(loss, start, bound, np.concatenate((ridge + 0.1 * count, np.full(5, ridge + 0.1 * total))), memory=200)
    return v[:n_features], float(v[n_features]), v[n_features + 1 :].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.5) -> tuple[float, float]:
    """Slope (not negative) and offset of P(y = 1) = logistic(slope * x + offset)."""
    if not len(y):
        return 1.0, 0.0
    b = np.array([1.0, 0.0])
    a = np.stack([x, np.ones(len(x))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        b = b + np.linalg.solve(h, a.T @ (y - p) - ridge * (b - np.array([1.0, 0.0])))
    return max(float(b[0]), 0.0), float(b[1])


def copy_keys(words_of: np.ndarray, bands: int = 6, rows: int = 4) -> set[tuple]:
    """MinHash bands of a text's words. A copied text's rare words would look like signs of its label, so the fit takes
    only texts that share no band with an earlier one."""
    low = [int(mix(words_of, 70 + j).min()) if len(words_of) else 0 for j in range(bands * rows)]
    return {(b, *low[b * rows : (b + 1) * rows]) for b in range(bands)}


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, label, features of its tokens) of each row (text, toxic), chunk by chunk."""
    first = 0
    for batch in batches:
        toxic = batch.column(1).to_pylist()
        for chunk in chunks(batch.column(0)):
            w = words(chunk, ALNUM)
            h = token_features(chunk, w)
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist()), chunk.first):
                yield first + i, toxic[i], h[a:b]
        first += batch.num_rows


class Tally:
    """Counts of features, kept as sorted arrays and merged by the million."""

    def __init__(self):
        self.names, self.counts, self.held, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, names: np.ndarray) -> None:
        self.held.append(names)
        self.size += len(names)
        if self.size > 1 << 20:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate((self.names, *self.held))
        weight = np.concatenate((self.counts, np.ones(self.size, np.int64)))
        self.names, at = np.unique(every, return_inverse=True)
        self.counts = np.bincount(at, weight, len(self.names)).astype(np.int64)
        self.held, self.size = [], 0
        return self.names, self.counts


def select_features(by_class: list[tuple[np.ndarray, np.ndarray]], n1: int, n0: int) -> np.ndarray:
    """Features (sorted) of which more texts are toxic than chance would give. by_class: (features, texts that have them)
    of toxic and of clean texts; n1, n0: numbers of those texts."""
    names, a = by_class[0]  # a feature that no toxic text has can't be picked
    n = a.copy()
    if len(by_class[1][0]):
        at = np.minimum(np.searchsorted(by_class[1][0], names), len(by_class[1][0]) - 1)
        n += np.where(by_class[1][0][at] == names, by_class[1][1][at], 0)
    share, rate = n1 / (n1 + n0), a / n
    # Log of the chance (Chernoff's bound) that so many of a feature's texts are toxic, against as many features.
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = n * (rate * np.log(rate / share) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0))
    return names[(chance >= np.log(len(names) + len(by_class[1][0])) - 2) & (rate >= 0.8) & (names != 0)]


def no_field() -> Field:
    return Field(np.zeros(0, np.uint64), np.zeros(0), -4.0, np.zeros((2, 2)), 1.0, 0.0)


def choose(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, dict[int, bool]]:
    """The features that mark toxic texts of the sample (text, toxic), and the texts used: those without copies before them; true
    for the fifth that is kept for the logistic function."""
    use: dict[int, bool] = {}
    seen: set[tuple] = set()
    tallies, n = (Tally(), Tally()), [0, 0]
    for i, toxic, x in _texts(batches):
        keys = copy_keys(np.unique(x[:, 0]))
        if not seen.intersection(keys):
            use[i] = len(use) % 5 == 4
            if not use[i]:
                tallies[1 - toxic].add(np.unique(x))
                n[1 - toxic] += 1
        seen.update(keys)
    return (select_features([t.merge() for t in tallies], *n) if all(n) else np.zeros(0, np.uint64)), use


def fit(batches: Iterable[pa.RecordBatch], features: np.ndarray, use: dict[int, bool]) -> Field:
    """A field over choose()'s features, from the same sample."""
    field = no_field()
    field.features, field.weights = features, np.zeros(len(features))
    if not len(features):
        return field
    table, width = field.table(), 1 + len(PREFIXES)
    plain, proof = np.zeros(SEGMENT + 1), []  # numbers of segments without a feature, by length
    rows: dict[bytes, int] = {}
    for i, toxic, x in _texts(batches):
        if i not in use or not len(x):
            continue
        got = field.ids(x, table)
        hot = np.flatnonzero((got >= 0).any(1))
        if use[i]:
            proof.append((hot, got[hot], len(x), toxic))
            continue
        whole, rest = divmod(len(got), SEGMENT)
        mine = np.unique(hot // SEGMENT)
        plain[SEGMENT] += whole
        plain[rest] += rest > 0
        for s in mine.tolist():
            part = np.full((SEGMENT, width), -1, np.int32)
            length = min(SEGMENT, len(got) - s * SEGMENT)
            part[:length] = got[s * SEGMENT : s * SEGMENT + length]
            plain[length] -= 1
            key = bytes([length, toxic]) + part.tobytes()
            rows[key] = rows.get(key, 0) + 1
    for length in np.flatnonzero(plain).tolist():
        rows[bytes([length, 0]) + np.full((SEGMENT, width), -1, np.int32).tobytes()] = int(plain[length])
    if rows:
        xs = np.stack([np.frombuffer(k[2:], np.int32).reshape(SEGMENT, width) for k in rows])
        lens, toxic = (np.array([k[j] for k in rows]) for j in (0, 1))
        ys = ((xs >= 0).any(2) & (toxic == 1)[:, None]).astype(np.int64)
        valid = np.arange(SEGMENT) < lens[:, None]
        field.weights, field.bias, field.transitions = fit_chain(xs, ys, valid, np.array(list(rows.values()), float), len(features))
    power = field.plain_power()
    found = [evidence(field.marginals(hot, field.scores_of(ids), n, power) if len(hot) else np.zeros(0)) for hot, ids, n, _ in proof]
    field.slope, field.offset = fit_logistic(np.array(found), np.array([y for *_, y in proof]))
    return field


def learn(docs: DataFrame, labels: DataFrame) -> Field:
    """A field fitted on at most SAMPLE_TOXIC and SAMPLE_CLEAN documents of labels(doc_id, toxic), the first by a hash of
    doc_id, with their whole texts. The bounded sample is read in one task, twice; only the field comes to the driver.

    A doc_id labelled twice takes the larger label; nulls in either column are left out, and so are other labels than 0
    and 1. Of several texts of one doc_id the first by hash is taken, null texts are passed over, and copies within the sample
    count once. An empty table, or labels of one class only, gives a field without features.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.save(known, "labels")
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    ids = F.broadcast(known.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_CLEAN)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(ids, "doc_id")
    one = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = scratch.save(one, "sample").repartition(1).sortWithinPartitions(order, "doc_id").select("text", "toxic")

    def told(f) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(batches))], pa.binary())], ["made"])

        made = rows.mapInArrow(run, "made binary").collect()
        return pickle.loads(bytes(made[0]["made"])) if made else None

    chosen = told(choose)
    field = told(lambda batches: fit(batches, *chosen)) if chosen else None
    scratch.drop("labels", "sample")
    return field or no_field()


class Scorer:
    """A field at work in one task."""

    def __init__(self, field: Field):
        self.f, self.table, self.power = field, field.table(), field.plain_power()
        self.none = evidence(np.zeros(0))

    def logistic(self, x):
        return 1 / (1 + np.exp(-np.clip(self.f.slope * x + self.f.offset, -40, 40)))

    def rows(self, chunk: Chunk, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, places of its tokens with features among the chunk's, their marginals) of each row that has one."""
        ids = self.f.ids(token_features(chunk, w), self.table)
        hot = np.flatnonzero((ids >= 0).any(1))
        emit = self.f.scores_of(ids[hot])
        row = np.searchsorted(w.first, hot, "right") - 1
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], row, [-2]))))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            r = int(row[a])
            first = int(w.first[r])
            yield r, hot[a:b], self.f.marginals(hot[a:b] - first, emit[a:b], int(w.first[r + 1]) - first, self.power)


def toxicity(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, score, predicted, and spans: code points (end exclusive) of tokens whose
    marginal is at least 0.5.

    Null and empty texts, and those without a feature, have the score of no evidence. Repeated rows each give a result. A score
    equal to the threshold is toxic. A very long text is scored whole; its stretches without features cost nothing each.
    An empty table gives an empty result. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                w = words(chunk, ALNUM)
                found = np.full(len(chunk), scorer.none)
                spans: list[list[dict]] = [[] for _ in range(len(chunk))]
                for r, at, p in scorer.rows(chunk, w):
                    found[r] = evidence(p)
                    bad = np.flatnonzero(p >= 0.5)
                    if len(bad):
                        o = chunk.offsets[r]
                        points = np.concatenate(([0], np.cumsum((chunk.data[o : chunk.offsets[r + 1]] & 0xC0) != 0x80)))
                        spans[r] = [{"start": int(points[w.start[at[k]] - o]), "end": int(points[w.end[at[k]] - o]), "p": float(p[k])} for k in bad]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(scorer.logistic(found)), pa.array(spans, pa.list_(span))], ["doc_id", "score", "spans"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def reject_toxic(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that toxicity() predicts toxic, by each row's own text; all columns stay, whatever their names, in
    one pass over the texts. Null and empty texts are no evidence, repeated rows go or stay together, rows without doc_id are
    judged as well, and an empty table gives an empty one."""
    carried = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = np.full(len(chunk), scorer.none)
                for r, _, p in scorer.rows(chunk, words(chunk, ALNUM)):
                    found[r] = evidence(p)
                keep = pa.array(scorer.logistic(found) < threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)).filter(keep)], ["_row"])

    return carried.mapInArrow(run, carried.select("_row").schema).select("_row.*")


def held_out(doc_id: str):
    """crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity() of documents by a field that learns from labels of rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    field = learn(docs, labels)
    out = toxicity(docs, field, 0.3)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", spans.alias("spans"))
