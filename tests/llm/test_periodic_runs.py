"""Periodic runs against a search of every period at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import periodic_runs as P


def brute(w, least=12):
    """(start, length, period) of all runs of a list of words."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def contract(doc_id, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_cover():
    """Every two places meet at samples, after at most a cycle of words beyond the few."""
    s = P.shifts()
    a, b = np.mgrid[0 : P.CYCLE, 0 : P.CYCLE]
    assert np.isin((a + s) % P.CYCLE, P.COVER).all() and np.isin((b + s) % P.CYCLE, P.COVER).all() and s.max() < P.FEW + P.CYCLE


@pytest.mark.parametrize("seed", range(6))
def test_find_runs(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, k, int(n)).tolist() for k in (1, 2, 3, 50) for n in (0, 1, 11, 12, 13, 40, 250)]
    unit = rng.integers(0, 9, 37).tolist()
    texts += [unit * 9, unit[:5] + unit * 4 + [77] + unit * 3, [1, 2] * 60 + [1] + [2, 1] * 50, unit + [100] + unit + [101] + unit]
    monkeypatch.setattr(P, "GRID", [1 << 21, 500][seed % 2])
    seq = np.array([x for t in texts for x in t], np.int64)
    got = P.find_runs(seq, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    want = [(i, *r) for i, t in enumerate(texts) for r in brute(t)]
    assert list(map(tuple, got.tolist())) == want


def test_common_extensions():
    """Agreement of all pairs of places of a text with long repeats."""
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 4, 90)
    seq = np.concatenate([unit, unit, unit[:41], [9], unit, [3] * 70])
    e = P.Extensions(seq, np.array([0, 200, len(seq)]))
    i, j = (x.ravel() for x in np.triu_indices(len(seq), 1))
    same = np.searchsorted([200], i, "right") == np.searchsorted([200], j, "right")
    i, j = i[same], j[same]
    ends = np.where(i < 200, 200, len(seq))

    def agree(a, b, end):
        k = 0
        while b + k < end and seq[a + k] == seq[b + k]:
            k += 1
        return k

    assert e(i, j, (i >= 200).astype(int)).tolist() == [agree(*x) for x in zip(i.tolist(), j.tolist(), ends.tolist())]


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 64)
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 30, n))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "a " * 40), (5, "a " * 40), (None, "é ü " * 9), (6, "x y " * 7 + "\x1c " * 13), (7, "w" * 5000), (8, prose(6000)), (8, "other text")]
    unit = prose(25)
    rows += [(9, f"begin {unit} {unit} end"), (10, f"{unit}\n{unit}\t{unit} {prose(10)}"), (11, "ab " * 11), (12, "ab " * 12)]
    rows += [(int(i), prose(int(n))) for i, n in enumerate(rng.integers(0, 400, 150), 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "_best", "start")}).repartition(3)
    out = P.periodic_runs(df).collect()
    want = sorted((str(i), str([list(r) for r in brute(words_of(t))])) for i, t in rows)
    assert sorted((str(r.doc_id), str([list(x) for x in r.runs])) for r in out) == want
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in out)
    assert {r.collapsed for r in out if r.doc_id == 12} == {"ab"} and {len(r.collapsed) for r in out if r.doc_id == 11} == {32}
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.integers(0, 300, int(n))) + ["", "\n\n"][i % 2]) for i, n in enumerate(rng.integers(0, 300, 400))]
    rows += [(None, "a b"), (500, None), (501, ""), (502, " " * 9), (7, rows[7][1])]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r[0]), str(tuple(r[1:]))) for r in P.op11_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), str(contract(i, t))) for i, t in rows)
