"""Spot signatures against sets of word chains."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import spotsigs as S
from sigspark.llm import textblock

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def seq(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def common_of(texts):
    n = Counter(w for t in texts for w in set(seq(t)))
    picked = sorted((-c, textblock.text_hash(w), w) for w, c in n.items() if c >= S.SHARE * len(texts))[: S.ANCHORS]
    return {w for *_, w in picked}


def spots(t, common):
    w = seq(t)
    if not w:
        return {("text", (t or "").strip(" \t\n\r\x0b\x0c"))} if (t or "").strip(" \t\n\r\x0b\x0c") else set()
    out = {("begin", *w[: S.CHAIN])}
    for i, x in enumerate(w):
        chain = list(itertools.islice((w[j] for j in range(i + 1, len(w)) if w[j] not in common), S.CHAIN))
        if len(chain) == S.CHAIN and (x in common or int(textblock.mix(np.array([textblock.text_hash(x)], np.uint64), 11)[0]) % S.SPARE == 0):
            out.add((x, *chain))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    stop = ["the", "of", "and", "le", "der", "ß"]
    make = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.4 else f"w{rng.integers(3000)}" for _ in range(n))
    out = [(int(i), make(int(n)) + ".") for i, n in enumerate(rng.integers(1, 200, 150), 10)]
    out += [(1, None), (2, ""), (3, " \n\t"), (4, "!!!"), (5, "???"), (6, "one"), (7, "One, two"), (8, "é😀 the 中文 of x y z w"), (9, make(30000))]
    out += [(None, make(50)), (None, make(60)), (500, out[3][1]), (500, out[4][1]), (500, out[3][1]), (501, out[3][1].replace("w", "W")), (-7, "the end of it all is here")]
    return out


def want_of(rows):
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)
    texts = [(i, t or "") for i, t in rows]
    return sorted(texts, key=key, reverse=True), common_of([t for _, t in texts])


@pytest.mark.parametrize("per_bucket", [1000, 7])
def test_edited(spark, rows, monkeypatch, per_bucket):
    monkeypatch.setattr(S, "ROWS", per_bucket)
    monkeypatch.setattr(S, "CHUNK_BYTES", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("b", "k", "h", "halo", "raw", "size", "near")}).repartition(5)
    common = S.common_words(df)
    order, names = want_of(rows)
    assert common.tolist() == sorted(textblock.text_hash(w) for w in names) and {"the", "der", "ß"} <= names
    got = S.edited_fingerprints(df, common).collect()
    hashes = {r.text or "": r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(order, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        a, b, c = (spots(x, names) for x in (t, e, after))
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(a, b), 6), round(jaccard(a, c), 6)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 6), round(r.near_next, 6)) for r in got) == sorted(want)
    text = {i: t or "" for i, t in rows if i not in (None, 500)}
    by = {text[r.doc_id].translate(LOW): r.fingerprint for r in got if r.doc_id in text}
    assert by[text[13].translate(LOW)] == next(r.fingerprint for r in got if r.doc_id == 501)
    plain = {(str(r.doc_id), r.fingerprint) for r in S.fingerprints(df, common).collect()}
    assert plain == {(str(r.doc_id), r.fingerprint) for r in got}


def test_small(spark):
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    none = make([(1, "a")]).limit(0)
    assert len(S.common_words(none)) == 0 and S.edited_fingerprints(none, S.common_words(none)).count() == 0 and S.fingerprints(none, S.common_words(none)).count() == 0
    one = S.edited_fingerprints(make([(3, "abcdef")]), np.zeros(0, np.uint64)).first()
    assert (one.n_chars, one.edited_sha256, one.near_next) == (6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)
    hot = make([(None, f"text number {i} of many") for i in range(200)] + [(7, str(i)) for i in range(300)])
    S_rows, S.ROWS = S.ROWS, 20
    try:
        out = S.edited_fingerprints(hot, np.zeros(0, np.uint64)).toPandas()
    finally:
        S.ROWS = S_rows
    assert len(out) == 500 and out.doc_id.isna().sum() == 200
    cuts = np.array([0, 5, 5, 5, 9])
    h = np.array([-(2**63), 0, 2**63 - 1], np.int64)
    assert S.places(np.array([-1, 0, 3, 9, 10]), np.zeros(5, np.int64), cuts).tolist() == [0, 1, 1, 5, 5] and S.places(np.array([5, 5, 5]), h, cuts).tolist() == [1, 3, 4]


def test_pruned_jaccard(spark):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 32, int(n)).astype(np.uint32)) for n in rng.integers(0, 300, 80)] + [np.zeros(0, np.uint32)] * 2
    a, b = [], []
    for s in sets:
        for cut in (0, 3, 50):
            a.append(s)
            b.append(np.unique(np.concatenate((s[cut:], rng.integers(0, 1 << 32, cut).astype(np.uint32)))))
    exact = np.array([jaccard(set(x.tolist()), set(y.tolist())) for x, y in zip(a, b)])
    for least in (0.0, 0.3, 0.8, 1.0):
        assert np.allclose(S.pruned_jaccard(a, b, least), np.where(exact >= least, exact, 0))
    pairs = spark.createDataFrame([(S.spelt(x), S.spelt(y)) for x, y in zip(a, b)] + [(None, "")], "one string, two string").withColumn("_left", F.lit(1))
    got = S.compare(pairs, "one", "two", 0.8).collect()
    assert len(got) == len(a) + 1 and sum(r.near is None for r in got) == 1
    assert all(abs(r.near - (j if (j := jaccard(set(S.unspelt(r.one).tolist()), set(S.unspelt(r.two).tolist()))) >= 0.8 else 0)) < 1e-12 for r in got if r.one is not None)
