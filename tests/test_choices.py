"""Choices of classes without all pairs, and benchmarks made of them."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import choices
from sigspark.plans import benchmarks


def test_drawn_sets(spark):
    """Distinct numbers below n, and every pair of six as often as any other."""
    df = spark.range(3000).select("id", *(choices.drawn(F.lit(n).cast("long"), k, 5, "id").alias(f"d{i}") for i, (n, k) in enumerate([(6, 2), (6, 6), (3, 9), (0, 2), (5, 0), (10**12, 4)])))
    rows = df.collect()
    assert all(len(set(r.d0)) == 2 and set(r.d0) <= set(range(6)) and sorted(r.d1) == list(range(6)) and sorted(r.d2) == [0, 1, 2] and r.d3 == r.d4 == [] and len(set(r.d5)) == 4 for r in rows)
    n = Counter(tuple(sorted(r.d0)) for r in rows)
    assert len(n) == 15 and sum((v - 200) ** 2 / 200 for v in n.values()) < 45
    again = df.select("d0").repartition(7).collect()
    assert Counter(tuple(r.d0) for r in again) == Counter(tuple(r.d0) for r in rows)


def test_negatives(spark):
    q = spark.createDataFrame([(i, ["a", "b", "z", None][i % 4]) for i in range(400)], "q long, label string")
    classes = spark.createDataFrame([(c,) for c in "abcdea"] + [(None,)], "class string")
    got = {}
    for r in choices.negatives(q, classes, "q", "label", 3, 1).collect():
        got.setdefault((r.q, r.label), []).append(r["class"])
    assert len(got) == 300 and all(len(set(v)) == 2 and label not in v for (_, label), v in got.items())
    assert set(Counter(x for (_, label), v in got.items() if label == "a" for x in v)) == set("bcde")
    assert choices.negatives(q, classes, "q", "label", 99, 1).count() == 100 * 4 + 100 * 4 + 100 * 5
    assert choices.negatives(q, classes.limit(0), "q", "label", 3, 1).count() == 0
    varied = q.withColumn("k", (F.col("q") % 3 + 1).cast("int"))
    assert choices.negatives(varied, classes, "q", "label", F.col("k"), 1).count() == sum(i % 3 for i in range(400) if i % 4 != 3)


def test_a_million_classes(spark):
    """No row meets more classes than it draws."""
    classes = spark.range(1_000_000).select(F.col("id").alias("class"))
    q = spark.range(0, 1_000_000, 1000).select("id", F.col("id").alias("label"))
    got = choices.negatives(q, classes, "id", "label", 4, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = got.collect()
    assert len(rows) == 3000 and all(r["class"] != r.label for r in rows) and np.mean([r["class"] for r in rows]) == pytest.approx(500_000, rel=0.05)


def test_kway(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(9, 5))
    protos = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "class int, vec array<double>")
    q = spark.createDataFrame([(i, i % 9, (vectors[i % 9] + 0.8 * rng.normal(size=5)).tolist()) for i in range(90)] + [(900, 77, [0.0] * 5)], "q long, label int, v array<double>")
    hits = {(r.k, r.q): r.rank for r in choices.kway_hits(q, protos, [1, 9, 50], "q", "label", "v", 3).collect()}
    assert len(hits) == 270 and all(hits[1, i] == 1 for i in range(90))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for r in q.where("q < 90").collect():
        s = unit @ np.array(r.v)
        assert hits[9, r.q] == hits[50, r.q] == 1 + (s > s[r.label]).sum()


def test_benchmark(spark):
    items = spark.createDataFrame([(i, f"n{i % 7}") for i in range(50)] + [(99, None)], "k long, name string")
    out = benchmarks.build_mcq(items, "k", "name", [2, 7], 40, 1, ["Q?"], "x").collect()
    assert sorted(r.id for r in out) == [f"x_{c}_{i:06d}" for c in (2, 7) for i in range(1, 41)]
    for r in out:
        names = {p.strip()[1]: p.strip()[3:] for p in r.question[2:].split(" (") for p in [" (" + p] if p.strip() != "("}
        assert r.name == f"n{r.k % 7}" and names[r.correct] == r.name and len(set(names.values())) == r.option_number
    assert benchmarks.build_mcq(items.limit(0), "k", "name", [2], 40, 1, ["Q?"], "x").count() == 0
    said = spark.createDataFrame([("d", "Q (A)x (B)y", "A", "(A)"), ("d", "Q (A)x (B)y", "B", "(A)"), ("d", "Q (A)y (B)x", "B", "(B)"), ("e", "Q (A)x (B)y", "A", "none"), ("e", "Q (A)x (B)y", "A", None)], "dataset string, question string, correct string, output string")
    cells = spark.createDataFrame([("d",), ("e",), ("f",)], "dataset string")
    got = {r.dataset: tuple(r)[1:] for r in benchmarks.score_mcq(said, ["dataset"], ["d"], cells=cells).collect()}
    assert got == {"d": (3, 2 / 3, 0.5, 0.5), "e": (2, 0.0, 0.0, 0.0), "f": (0, None, None, None)}
