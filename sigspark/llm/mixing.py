"""Mixing documents to target domain weights, by soft membership.

A classifier fitted on a bounded sample of the labelled table gives every document a posterior over domains. Document rates are
the least-squares solution, over rates in [low, high], of: expected tokens of each domain (rate x tokens x posterior,
summed over all documents) equal its target share of the token budget; of several, the one nearest to rates of 1.

Projected gradient steps move all rates against the gradient, a document's posteriors times the domains' gaps, and project
them to [low, high]. The steps are added up before they are projected, so all of them are one number a domain (its
multiplier), and a document's rate follows from those and its posteriors: no state of the table's size is kept or sent. Each
round is one aggregate over all documents in Spark. Steps are scaled by the curvature of the documents strictly between
the bounds, with a line search, until the gradient settles: plain steps of one size leave rare domains short of targets.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ascent import least
from .scratch import Scratch
from .textblock import NOT_SPACE, SpanHashes, chunks, words

BUCKETS = 1 << 16
#: Most labelled documents of each domain in the sample; their texts are taken whole, whatever their length.
SAMPLE_ROWS = 2000


@dataclass
class Classifier:
    """Multinomial logistic model: mean-scaled sums of hashed word weights. weights: BUCKETS x domains."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Row by row; first: bounds of the rows' words."""
        n = np.diff(first)
        sums = np.zeros((len(n), len(self.domains)))
        some = np.flatnonzero(n)
        if len(some):
            for k in range(len(self.domains)):
                sums[some, k] = np.add.reduceat(self.weights[:, k][bucket], first[some])
        z = self.bias + sums / np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _buckets(chunk) -> tuple[np.ndarray, np.ndarray]:
    w = words(chunk, NOT_SPACE)
    return (SpanHashes(chunk).of(w.start, w.end) % np.uint64(BUCKETS)).astype(np.int32), w.first


def fit(rows: Iterable[pa.RecordBatch], domains: list[str], decay: float = 1e-4, bound: float = 1e-5) -> Classifier:
    """A classifier of rows (text, domain), all read once; a text stays as its buckets and how often each occurs. Its weights
    have the least mean logistic loss plus decay / 2 times their squares, to a slope of bound. Domains without a row have a prior
    of next to nothing."""
    names, buckets, times = [], [], []
    for batch in rows:
        names += batch.column(1).to_pylist()
        for chunk in chunks(batch.column(0)):
            bucket, first = _buckets(chunk)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                which, n = np.unique(bucket[a:b], return_counts=True)
                buckets.append(which)
                times.append(n)
    y, k = np.array([domains.index(n) for n in names], np.int64), len(domains)
    model = Classifier(domains, np.zeros((BUCKETS, k)), np.log((np.bincount(y, minlength=k) + 1e-6) / (len(y) + k * 1e-6)))
    if not names:
        return model
    counts = np.array([len(b) for b in buckets])
    words_of = np.array([n.sum() for n in times])
    bucket = np.concatenate(buckets)
    scale = np.concatenate(times) / np.repeat(np.sqrt(np.maximum(words_of, 1)), counts)
    row = np.repeat(np.arange(len(y)), counts)
    some, begin = np.flatnonzero(counts), (np.cumsum(counts) - counts)[counts > 0]
    hot = np.eye(k)[y]
    used, at = np.unique(bucket, return_inverse=True)
    order = np.argsort(at, kind="stable")  # by bucket, for the gradient
    row_by, scale_by, bucket_begin = row[order], scale[order], np.searchsorted(at[order], np.arange(len(used)))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w = v.reshape(k, -1)
        z = np.tile(model.bias, (len(y), 1))
        if len(some):
            for c in range(k):
                z[some, c] += np.add.reduceat(w[c][at] * scale, begin)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        total = p.sum(1, keepdims=True)
        gap = ((p / total - hot) / len(y)).T.copy()
        g = np.stack([np.add.reduceat(gap[c][row_by] * scale_by, bucket_begin) if len(used) else gap[c][:0] for c in range(k)]) + decay * w
        return float((np.log(total[:, 0]) - (z * hot).sum(1)).mean() + decay / 2 * (w**2).sum()), g.ravel()

    spread = np.bincount(at, scale**2, len(used)) / len(y) / 4
    model.weights[used] = least(loss, np.zeros(len(used) * k), bound, np.tile(decay + spread, k), memory=40).reshape(k, -1).T
    return model


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> Classifier:
    """A classifier fitted on at most SAMPLE_ROWS documents of each domain of labelled(doc_id, domain), the first by a hash of
    doc_id, with their whole texts. The bounded sample is fitted in one task; only the weights come to the driver.

    A document labelled twice takes the first domain by name; other domains and null ids are left out. Of several texts of
    one doc_id the first by hash is taken; null texts are passed over.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    order = F.xxhash64(F.lit("mixing"), "doc_id")
    known = scratch.save(labelled.where("doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")).where(F.col("domain").isin(domains)), "labels")
    ids = None
    for d in domains:
        part = known.where(F.col("domain") == d).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    one = texts.groupBy("doc_id").agg(F.max("domain").alias("domain"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = scratch.save(one, "sample").repartition(1).sortWithinPartitions(order, "doc_id").select("text", "domain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(batches, domains))], pa.binary())], ["made"])

    made = rows.mapInArrow(run, "made binary").collect()
    scratch.drop("labels", "sample")
    return pickle.loads(bytes(made[0]["made"])) if made else fit([], domains)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ...) per row: white-space tokens of the whole text, and its posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{d}" for d in model.domains]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                bucket, first = _buckets(chunk)
                p = shared.value.posteriors(bucket, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(np.diff(first), pa.int64()), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", "n_tokens", *names])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, ", ".join(["doc_id long", "n_tokens long", *(f"`{n}` double" for n in names)]))


#: Weight of the squared distance from rates of 1 beside the squared gaps: a target's miss by it is this times its multiplier.
NEARNESS = 1e-6
#: A domain's share of tokens that misses its target by more than this, since the bounds leave no more, is warned of.
MISSED = 0.01


def _rate(multipliers: np.ndarray, domains: list[str], low: float, high: float) -> tuple[Column, Column]:
    """A document's rate, and whether it lies strictly between low and high."""
    free = sum((F.lit(float(x)) * F.col(f"p_{d}") for x, d in zip(multipliers, domains)), F.lit(1.0))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), free)), (free > low) & (free < high)


def fit_rates(members: DataFrame, targets: dict[str, float], budget: float = 1.0, low: float = 0.0, high: float = 4.0, rounds: int = 200, close: float = 1e-5) -> DataFrame:
    """members with rate. targets: shares by domain (scaled to add up to 1); budget: total tokens wanted, as a multiple
    of what there is. Ends when the dual's gradient, a share of all tokens for each domain, is below close; raises an
    error if it isn't after that many rounds. Targets out of reach are met as nearly as low and high let them, and a warning
    gives the shares reached."""
    domains = list(targets)
    want = np.array([targets[d] for d in domains]) / max(sum(targets.values()), 1e-12) * budget
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    weight = F.col("n_tokens") / F.lit(float(max(total, 1)))
    upper = list(zip(*np.triu_indices(len(domains))))
    left = rounds

    def slope(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient at the multipliers, and its own slope (the curvature)."""
        nonlocal left
        if left == 0:
            raise RuntimeError(f"rates did not settle in {rounds} rounds")
        left -= 1
        rate, free = _rate(at, domains, low, high)
        told = members.select(weight.alias("_w"), rate.alias("_r"), free.cast("double").alias("_f"), *(F.col(f"p_{d}").alias(f"_{i}") for i, d in enumerate(domains)))
        row = told.agg(*(F.sum(F.col("_w") * F.col("_r") * F.col(f"_{i}")) for i in range(len(domains))), *(F.sum(F.col("_w") * F.col("_f") * F.col(f"_{i}") * F.col(f"_{j}")) for i, j in upper)).first()
        bend = np.zeros((len(domains), len(domains)))
        for (i, j), x in zip(upper, row[len(domains) :]):
            bend[i, j] = bend[j, i] = x
        return NEARNESS * at + np.array(row[: len(domains)]) - want, bend + NEARNESS * np.eye(len(domains))

    at = np.zeros(len(domains))
    gap, bend = slope(at) if total else (np.zeros(len(domains)), None)
    while np.abs(gap).max() >= close:
        step = -np.linalg.solve(bend, gap)
        before, short, long, size = abs(gap @ step), 0.0, np.inf, 1.0
        while True:
            # The slope along the step rises with its size; one of at most half the first slope is near the lowest point.
            gap, bend = slope(at + size * step)
            along = gap @ step
            if abs(along) <= 0.5 * before or np.abs(gap).max() < close:
                break
            short, long = (short, size) if along > 0 else (size, long)
            size = 2 * size if long == np.inf else float(np.sqrt(short * long)) if short else long / 8
        at = at + size * step
    short = gap - NEARNESS * at
    if total and np.abs(short).max() > MISSED:
        warnings.warn(f"rates in [{low}, {high}] reach {dict(zip(domains, np.round(want + short, 4).tolist()))} of the tokens, not {dict(zip(domains, np.round(want, 4).tolist()))}", stacklevel=2)
    return members.withColumn("rate", _rate(at, domains, low, high)[0])


def uniform(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 32)) / F.lit(float(1 << 32))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **how) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, p_<domain> ..., rate and copies, the rate rounded up or down by a
    hash of the doc_id so that its mean is the rate.

    Null and empty texts have no tokens, the prior's posterior and a rate by it. Repeated rows are documents of their own. A
    document labelled twice takes the first domain by name. Very long texts count whole. Without labels, or with an empty
    table, the posteriors are the prior's and the fit does what it can with them. Other columns are not looked at.
    """
    model = learn(docs, labelled, list(targets))
    members = Scratch(docs.sparkSession, "mixing").save(memberships(docs, model), "members")
    out = fit_rates(members, targets, **how)
    return out.withColumn("copies", F.floor(F.col("rate") + uniform(F.coalesce("doc_id", F.lit(0)), 6)).cast("int"))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels(doc_id, quality, toxic): toxic, good or plain."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("plain").alias("domain"))


#: The query's target shares of tokens.
TARGETS = {"good": 0.85, "plain": 0.10, "toxic": 0.05}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed() of documents by the domains of labels, to TARGETS."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


def repeat_by_rate(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **how) -> DataFrame:
    """docs with each row as often as its copies say; all columns stay, whatever their names.

    Rows of one doc_id, and those without one, are repeated alike, as often as the largest of their copies says. Null and empty
    texts are repeated as their prior's rate says (with low of 1 at least once). Ties need no rule. Very long texts are weighed
    whole. Without labels or targets all rows follow the prior; an empty table gives an empty one.
    """
    copies = mixed(docs, labelled, targets, **how).groupBy("doc_id").agg(F.max("copies").alias("_copies")).withColumnRenamed("doc_id", "_id")
    copies = Scratch(docs.sparkSession, "mixing").save(copies, "copies")
    told = docs.select(F.struct(*docs.columns).alias("_row")).join(copies.hint("merge"), F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")))
    return told.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
