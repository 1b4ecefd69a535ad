"""Preparation of conversations: orders, padding and the whole job."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sigspark.functions import text as X
from sigspark.operators import instruct
from sigspark.plans.preparation import MARK_ID, Preparation, prepare

md5 = lambda *k: hashlib.md5("|".join(map(str, k)).encode()).hexdigest()


@pytest.mark.parametrize("n_image,n_text", [(50, 37), (64, 32), (5, 3), (0, 40), (40, 0)])
def test_modality_order(spark, n_image, n_text):
    rows = [(i, i < n_image, i * 37 % 23) for i in range(n_image + n_text)]
    df = spark.createDataFrame(rows, "k long, image boolean, n long")
    got = sorted((r.megabatch, r.place, r.k) for r in instruct.modality_order(df, "k", "n", F.col("image"), 16, 3).collect())
    kinds, tail = [], []
    for m in (True, False):
        mine = sorted((r for r in rows if r[1] == m), key=lambda r: md5(3, r[0]))
        cut = [sorted(mine[a : a + 16], key=lambda r: (-r[2], r[0])) for a in range(0, len(mine), 16)]
        if n_image and n_text:
            tail += cut.pop()
        kinds += [(md5(3, str(m).lower(), b), c) for b, c in enumerate(cut)]
    batches = [c for _, c in (sorted(kinds) if n_image and n_text else kinds)] + ([sorted(tail)] if tail else [])
    assert got == [(b, p, r[0]) for b, c in enumerate(batches) for p, r in enumerate(c)]


def test_uneven_chunks_in_turn(spark):
    df = spark.createDataFrame([(i, 5, 0, i) for i in range(7)], "k long, n int, megabatch long, place int")
    assert {r.k: r.chunk for r in instruct.even_chunks(df, "k", "n", 3).collect()} == {i: i % 3 for i in range(7)}


def test_padding(spark):
    rows = [(1, 1, list(range(100, 112)) + [-200]), (1, 2, [-200, 1]), (1, 3, list(range(20, 32))), (2, 4, [5, 0, 6, 0]), (2, 5, [7]), (3, 6, [])]
    df = spark.createDataFrame([(b, k, i, [-100 if x < 10 else x for x in i]) for b, k, i in rows], "b int, k int, ids array<int>, labels array<int>")
    got = {r.k: r for r in instruct.pad_batch(df, "b", "k", "ids", "labels", 0, 12, -200).collect()}
    assert got[1].ids == [*range(100, 110), -200] and got[2].ids == [-200, 1] + [0] * 9 and got[3].ids == list(range(20, 31)) and {len(got[k]["mask"]) for k in (1, 2, 3)} == {11}
    assert got[4]["mask"] == [True] * 4 and got[5]["mask"] == [True, False, False, False] and got[5].labels == [-100] * 4 and got[6].ids == []
    ends = {r.k: r["mask"] for r in instruct.pad_batch(df, "b", "k", "ids", "labels", 0, 12, -200, pad_ends=True).collect()}
    assert ends[4] == [True, False, True, True] and ends[5] == [True, True, False, False] and ends[2] == [True, True, True] + [False] * 8 and ends[3] == [True] * 11


def test_text_parts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.strip_placeholder(F.lit("a <image>"), F.lit(True), wrap=("<s>", "</s>"))) == "<s><image></s>\na"
    assert [one(X.ask_with(F.lit(t), c, F.lit(f))) for t, c, f in (("q <image>", F.lit("ctx"), True), ("q <image>", F.lit("ctx"), False), ("q", F.lit("ctx"), True), ("q <image>", F.lit(None).cast("string"), True))] == ["<image>\nq. ctx", "q. ctx <image>\n", "q. ctx", "q <image>"]


def test_whole_job(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"c{c} t{t}" + (" <image>" if t == 0 and c % 2 else "") if (c, t) != (4, 2) else None, f"p/{c}" if c % 2 else None) for c in range(60) for t in range(4)]
    rows += [(100, 0, "assistant", "not human", None), (101, 0, "assistant", "dropped", None), (101, 1, "user", "kept", None)]
    df = spark.createDataFrame(rows, "conv long, turn int, role string, text string, image string").withColumn("place", F.lit("clash"))
    contexts = spark.createDataFrame([(c, f"ctx{c}") for c in range(60)], "conv long, context string")
    how = Preparation(keyword="p/7", train=1.0, context_rate=1.0, wrap=("[", "]"), system="S", megabatch=8, longest=40, seed=1)
    out = {r.conv: r for r in prepare(df, how, contexts).collect()}
    assert set(out) == {c for c in range(60) if c != 7} | {101}
    for c, r in out.items():
        image = c < 60 and c % 2 == 1
        assert len(r.ids) == len(r.labels) == len(r["mask"]) == max(len(q.ids) for q in out.values() if q.megabatch == r.megabatch)
        assert sum(r["mask"]) == (1 if c == 101 else 6 if c == 4 else 8 + 2 * image)
        assert (f"c{c} t0. ctx{c}" in r.prompt) == ("[<image>]" in r.prompt) == image and r.prompt.startswith("S###user: ")
        assert sum(x != instruct.IGNORE for x in r.labels) == (0 if c == 101 else 4)
    wide = {r.conv: r for r in prepare(df, Preparation(train=1.0, images_only=True, megabatch=8)).collect()}
    assert set(wide) == {c for c in range(60) if c % 2} and all(MARK_ID in r.ids for r in wide.values())
    held = prepare(df, Preparation(train=0.9, split="test", megabatch=8)).count() + prepare(df, Preparation(train=0.9, megabatch=8)).count()
    assert held == 61 and prepare(df.limit(0), Preparation()).count() == 0
