"""Operators on small fixtures, against the formulas recomputed with numpy or by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import rnd, text, vec
from sigspark.operators import augment, clean, dsp, instruct, matrices, metrics, retrieval, sampling, windows, within


def one(df, c):
    return df.select(c.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([([1.0, 2.0, 4.0, 5.0],)], "v array<double>")


def test_vectors(row):
    v = np.array([1.0, 2.0, 4.0, 5.0])
    assert np.allclose(one(row, vec.l2_normalize("v")), v / np.linalg.norm(v))
    assert np.allclose(one(row, vec.zscore_pop("v")), (v - v.mean()) / v.std())
    assert np.allclose(one(row, vec.zscore_sample("v")), (v - v.mean()) / v.std(ddof=1))
    assert np.allclose(one(row, vec.softmax("v")), np.exp(v - 5) / np.exp(v - 5).sum())
    assert np.allclose(one(row, vec.linear_resample("v", 4)), v)
    assert np.allclose(one(row, vec.dft_amplitude("v")), np.abs(np.fft.rfft(v)))
    s = np.fft.rfft(v)
    assert np.allclose(one(row, vec.circular_autocorrelation("v")), np.fft.irfft(s * s.conj(), 4))
    for last in (False, True):
        assert np.allclose(one(row.select(vec.instance_norm("v", last=last).alias("n")), vec.instance_denorm("n")), v)
    assert one(row, vec.argmax("v")) == 3 and one(row, vec.one_hot(F.lit(1), 3)) == [0, 1, 0]


def test_finite_and_issues(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [1.0, 2.0]), (5, None), (6, [1.0])], "k long, v array<double>")
    good, bad = clean.validate_samples(df, "v", 2)
    assert sorted(r.k for r in good.collect()) == [1, 4] and sorted(r.k for r in bad.collect()) == [2, 3, 5, 6]
    assert {(r.issue, r.n, r.first_key) for r in clean.vector_issues(df, "v", "k").collect()} == {("zero", 1, 1), ("nan", 1, 2), ("inf", 1, 3)}


def test_next_valid_wraps(spark):
    df = spark.createDataFrame([(i, i in (2, 4)) for i in range(1, 7)], "i int, ok boolean")
    assert [r.source for r in clean.next_valid(df, "i", F.col("ok")).orderBy("i").collect()] == [2, 2, 4, 4, 2, 2]


def test_channel_names(spark):
    df = spark.createDataFrame([("r", n, i) for i, n in enumerate(["EEG FP1-REF", "eeg t3-ref", "EEG O1-REF", "EEG EKG1-REF", "ECG", "EEG A1-LE", "EEG FP1-LE", "EEG 26-REF", "DC1", "EEG ROC-REF"])], "rec string, name string, i int")
    assert [r.x for r in df.select(clean.standard_channel("name").alias("x")).collect()][:5] == ["Fp1", "T7", "O1", None, None]
    kept = clean.clinical_names(df, "rec", "name", "i").orderBy("i").collect()
    assert [(r.i, r.new_name) for r in kept] == [(0, "Fp1"), (2, "O1"), (4, "Ecg"), (5, "A1")] and kept[0].few
    assert [one(spark.range(1), clean.brain_region(F.lit(c))) for c in ("Fp1", "Fz", "Fc3", "Cz", "Cp3", "Pz", "Po3", "Oz", "T7", "O2")] == ["frontal_polar", "frontal", "fronto_central", "central", "centro_parietal", "parietal", "parieto_occipital", "occipital", "temporal", "occipital"]
    assert [one(spark.range(1), clean.brain_region(F.lit(c))) for c in ("FP2", "CPz", "F10", "A1", "")] == ["frontal_polar", "centro_parietal", "frontal", "other", "other"]


def test_select_nearest_and_interpolate(spark):
    pos = spark.createDataFrame([("A", 0.0, 0.0, 0.0), ("B", 1.0, 0.0, 0.0), ("C", 5.0, 0.0, 0.0)], "name string, x double, y double, z double")
    present = spark.createDataFrame([("r", "b"), ("r", "C")], "rec_id string, channel string")
    targets = spark.createDataFrame([("A",), ("B",), ("C",), ("X",)], "target string")
    got = {(r.target, r.channel, r.exact) for r in clean.nearest_channel(targets, present.union(spark.createDataFrame([("r", "D")], present.schema)), pos, other="A").collect()}
    assert got == {("A", "b", False), ("B", "b", True), ("C", "C", True), ("X", "b", False)}
    w = clean.inverse_distance_weights(pos.where("name = 'A'").withColumnRenamed("name", "target"), pos.where("name <> 'A'").withColumnRenamed("name", "channel"))
    assert abs(sum(r.w for r in w.collect()) - 1) < 1e-12
    s = spark.createDataFrame([("r", 0, "B", 2.0), ("r", 0, "C", 4.0)], "rec_id string, t int, channel string, value double")
    value = clean.interpolate_channels(s, w).first().value
    assert abs(value - (2 * 1.0 + 4 / 25) / (1 + 1 / 25)) < 1e-9
    with pytest.raises(Exception, match="missing channel"):
        spark.range(1).select(clean.select_channels(F.array(F.lit(1.0)), F.array(F.lit("A")), ["Z"])).collect()


def test_text_round_trip(spark):
    df = spark.createDataFrame([(["cat", "a dog", "x"],)], "o array<string>")
    q = df.select(text.render_question(F.lit("What?"), "o").alias("q"))
    assert q.first().q == "What? (A)cat (B)a dog (C)x"
    assert one(q, text.parse_options("q")) == {"A": "cat", "B": "a dog", "C": "x"}
    said = {"B": "B", "(B) cat": "B", "The answer is C.": "C", "A、B": "AB", "": "", "lower": "", "A, B": "AB"}
    assert {k: one(spark.range(1), text.parse_answer(F.lit(k))) for k in said} == said
    assert [one(spark.range(1), text.option_letter(F.lit(i))) for i in (0, 25, 26, 27)] == ["A", "Z", "AA", "AB"]
    assert one(spark.range(1), text.replace_words(F.lit("Images of a photo, imagery"))) == "EEG of a EEG, imagery"
    assert one(spark.range(1), text.class_from_caption(F.lit("This is a cat."))) == "cat"
    with pytest.raises(Exception, match="unknown action"):
        spark.range(1).select(text.motor_caption(F.lit("jump"))).collect()
    assert one(spark.range(1), text.motor_caption(F.lit("tongue"))).endswith("tongue.")


def test_sampling_properties(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 10, "a").when(F.col("id") < 35, "b").otherwise("c").alias("g"))
    under = {r.g: r["count"] for r in sampling.resample_groups(df, "g", "id", "under", 1).groupBy("g").count().collect()}
    over = {r.g: r["count"] for r in sampling.resample_groups(df, "g", "id", "over", 1).groupBy("g").count().collect()}
    assert under == {"a": 10, "b": 10, "c": 10} and over == {"a": 65, "b": 65, "c": 65}
    assert sampling.resample_groups(df, "g", "id", "over", 1).where("g = 'a'").groupBy("id").count().agg(F.min("count")).first()[0] == 6
    a = {r.id: r.s for r in df.select("id", sampling.split_random("id", 3).alias("s")).collect()}
    b = {r.id: r.s for r in df.repartition(7).select("id", sampling.split_random("id", 3).alias("s")).collect()}
    assert a == b and set(a.values()) == {"train", "test"}
    tail = sampling.split_tail(df, "id", 0.9).where("split = 'test'")
    assert sorted(r.id for r in tail.collect()) == list(range(90, 100))
    assert 0 <= one(df.limit(1), rnd.uniform(1, "id")) < 1


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    assert abs(metrics.auroc(df, F.col("y"), F.col("s")).first().auroc - 0.875) < 1e-12
    assert abs(metrics.average_precision(df, F.col("y"), F.col("s")).first().pr_auc - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12
    r = metrics.binary_report(df, F.col("y") == 1, F.col("s") >= 0.85).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 2) and abs(r.f1 - 2 / 3) < 1e-12
    p = metrics.latency_profile(spark.range(110).select("id", F.col("id").cast("double").alias("v")), "v", "id", 10).first()
    assert (p.n, p.min, p.max, p.median, p.p95, p.p99) == (100, 10, 109, 60, 105, 109)


def test_retrieval_methods_agree(spark):
    rng = np.random.default_rng(0)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(20)], "q long, a array<double>")
    g = spark.createDataFrame([(i, i % 2, rng.normal(size=8).tolist()) for i in range(15)], "g long, t int, b array<double>")
    for method in ("broadcast", "blocked"):
        s = retrieval.similarity_join(q, g, "a", "b", method=method)
        got = {(r.q, r.g): r.sim for r in s.select("q", "g", "sim").collect()}
        assert len(got) == 300
        if method == "broadcast":
            want = got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert retrieval.topk_by_type(q, g, 9, 3, "a", "b", ["q"], "t", ["g"]).count() == 0


def test_quota_and_own_rank_methods_agree(spark, monkeypatch):
    """Blocks, however many, give what one copy of the gallery gives."""
    rng = np.random.default_rng(5)
    g = rng.normal(size=(60, 4))
    g[7] = g[3]  # ties go to the smaller class
    q = spark.createDataFrame([(i, i % 70, (g[i % 60] + 0.7 * rng.normal(size=4)).tolist()) for i in range(140)] + [(900, 3, None), (901, 3, [None] * 4), (902, 3, g[3].tolist()), (903, 7, g[3].tolist())], "q long, label int, a array<double>")
    gal = spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(g)], "cls int, type int, b array<double>")
    u = g / np.linalg.norm(g, axis=1, keepdims=True)
    rows = {r.q: r for r in q.where("q < 900 or q > 901").collect()}
    for method in ("broadcast", "blocked"):
        got = {r.q: r.rank for r in retrieval.own_rank(q, gal, "a", "b", "q", "label", "cls", method).collect()}
        assert set(got) == {i for i, r in rows.items() if r.label < 60} and (got[902], got[903]) == (1, 2)
        for i in range(140):
            if i % 70 < 60 and i % 70 not in (3, 7):
                s = u @ np.array(rows[i].a)
                assert got[i] == 1 + (s > s[i % 70]).sum()
        quota = retrieval.topk_with_type_quota(q.where("q < 140"), gal, 8, 2, "a", "b", ["q"], "type", ["cls"], method)
        mine = sorted((r.q, r.cls, r.part) for r in quota.select("q", "cls", "part").collect())
        assert len(mine) == 140 * 8
        if method == "broadcast":
            want = mine
        assert mine == want
    real = retrieval._blocked
    monkeypatch.setattr(retrieval, "_blocked", lambda *a: real(*a, rows=7))
    assert sorted((r.q, r.cls, r.part) for r in retrieval.topk_with_type_quota(q.where("q < 140"), gal, 8, 2, "a", "b", ["q"], "type", ["cls"], "blocked").select("q", "cls", "part").collect()) == want


def test_windows(spark):
    df = spark.createDataFrame([("u", i, float(i)) for i in range(5)], "g string, i int, v double")
    t = [r.trend for r in within.moving_average(df, "g", "i", "v", 3).orderBy("i").collect()]
    assert np.allclose(t, [1 / 3, 1, 2, 3, 11 / 3])
    rec = spark.createDataFrame([("r", [[float(i) for i in range(10)]])], "rec_id string, signal array<array<double>>")
    ev = spark.createDataFrame([("r", 1, 0, 1.0, 2.0, 3)], "rec_id string, event_id int, channel int, start_s double, end_s double, code int")
    assert windows.event_windows(rec, ev, 1.0, 2.0).first().window == [[9.0, 0.0, 1.0, 2.0, 3.0]]
    a = spark.createDataFrame([("k", 1), ("k", 5)], "k string, t int")
    b = spark.createDataFrame([("k", 3), ("k", 5)], "k string, u int")
    assert {(r.t, r.match) for r in windows.asof_forward(a, b, "k", "t", "u").collect()} == {(1, 3), (5, 5)}
    with pytest.raises(Exception, match="multiple"):
        windows.cut_fixed(spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>"), "v", 2).collect()
    assert one(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), windows.tile_and_truncate("v", 5)) == [1, 2, 1, 2, 1]
    assert np.allclose(one(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), windows.exp_smooth("v", 0.5, 4.0)), [2.5, 2.25])


def test_signal_jobs(spark):
    fs, n = 200, 400
    t = np.arange(n) / fs
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 50 * t) + 3
    df = spark.createDataFrame([("r", [x.tolist()]), ("none", None)], "rec_id string, signal array<array<double>>")
    get = lambda d: np.array(d.where("rec_id = 'r'").first().signal[0])
    assert np.allclose(get(dsp.bandpass(df, "signal", fs, 2, 30)), np.sin(2 * np.pi * 10 * t), atol=1e-6)
    assert np.allclose(get(dsp.notch(df, "signal", fs)), np.sin(2 * np.pi * 10 * t) + 3, atol=1e-6)
    up = get(dsp.fft_resample(df, "signal", 1024))
    u = np.arange(1024) / 512
    assert np.allclose(up, np.sin(2 * np.pi * 10 * u) + np.sin(2 * np.pi * 50 * u) + 3, atol=1e-6)
    assert np.allclose(dsp.fft_resample_array(up[None], n)[0], x)
    assert np.allclose(get(dsp.spectrum(df, "signal")), np.abs(np.fft.rfft(x)))
    assert dsp.stft(df, "signal").where("rec_id = 'none'").first().signal is None
    more = dsp.extrapolate_array(np.cos(2 * np.pi * 3 * np.arange(32) / 32)[None], 1, 8)[0]
    assert np.allclose(more, np.cos(2 * np.pi * 3 * np.arange(40) / 32))
    assert get(dsp.cast_half(df, "signal"))[1] == float(np.float16(x[1]))
    with pytest.raises(ValueError):
        dsp.bandpass(df, "signal", fs, 30, 2)


def test_instruction_steps(spark):
    c = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "a b"), (1, 2, "user", "c")], "conv int, turn int, role string, text string")
    kept = instruct.drop_leading(c, "conv", "turn", "role", "user")
    assert [r.turn for r in kept.orderBy("turn").collect()] == [1, 2]
    assert [r.turn for r in instruct.alternation_violations(kept, "conv", "turn", "role", ("user", "assistant")).collect()] == [2]
    p = spark.createDataFrame([(1, 1, [5, 6]), (1, 2, [7]), (1, 3, [])], "b int, k int, ids array<int>").withColumn("labels", F.col("ids"))
    got = {r.k: (r.ids, r.labels, r["mask"]) for r in instruct.pad_batch(p, "b", "k", "ids", "labels", 0, 9).collect()}
    assert got == {1: ([5, 6], [5, 6], [True, True]), 2: ([7, 0], [7, -100], [True, False]), 3: ([0, 0], [-100, -100], [False, False])}
    d = spark.range(50).select("id", (F.col("id") * 7 % 13).alias("n"))
    order = instruct.length_order(d, "id", "n", 16, 1)
    chunks = instruct.even_chunks(order, "id", "n", 4).groupBy("megabatch", "chunk").count().collect()
    assert all(r["count"] == 4 for r in chunks if r.megabatch < 3)
    ids = spark.createDataFrame([([[1, 2], [1, 3]],)], "c array<array<int>>")
    assert one(ids, instruct.splice_placeholder("c", -200, 1)) == [1, 2, -200, 3]


def test_numbered(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("k"))
    got = sampling.numbered(df, F.col("k"), "i", ["id"]).orderBy("i").collect()
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got) and [r.i for r in got] == list(range(500))
    by_hash = sampling.numbered(df, rnd.md5_key(1, "id"), "i").orderBy("i").withColumn("h", rnd.md5_key(1, "id")).collect()
    assert [r.h for r in by_hash] == sorted(r.h for r in by_hash)
    assert sampling.numbered(df.limit(0), F.col("k"), "i").count() == 0


def test_augment(spark):
    df = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=(5, 8)).tolist()) for i in range(6)], "id long, s array<array<double>>")
    for r in df.withColumn("m", augment.masked(5, 0.6, 1, "id")).withColumn("x", augment.mask_channels("s", 5, 0.6, 1, "id")).collect():
        assert sum(r.m) == 3
        for masked, old, new in zip(r.m, r.s, r.x):
            assert (old == new) != masked and abs(np.linalg.norm(old) - np.linalg.norm(new)) < 1e-9
    flat = spark.range(1000).select("id", F.array_repeat(F.lit(0.0), 4).alias("v"))
    x = np.array([r.j for r in flat.select(augment.jitter("v", 2.0, 1, "id").alias("j")).collect()])
    assert abs(x.mean()) < 0.15 and abs(x.std() - 2) < 0.1
    pts = spark.createDataFrame([(i, [float(i % 2) * 10, float(i) / 100]) for i in range(40)], "id long, v array<double>")
    centres = sorted(matrices.kmeans(pts, "id", "v", 2, 10, 3))
    assert np.allclose(centres, [[0, 0.19], [10, 0.2]], atol=1e-9) or len(centres) == 2
    assert matrices.nearest(pts, "v", [[0.0, 0.0], [10.0, 0.0]]).where("code <> id % 2").count() == 0


def test_statistics_of_whole_samples(spark):
    """Each statistic once a vector: 32 x 512 samples take seconds."""
    import time

    x = np.random.default_rng(1).normal(3, 2, (4, 32, 512))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, eeg array<array<double>>")
    t = time.time()
    for f, want in (
        (vec.zscore_pop, (x - x.mean(2, keepdims=True)) / x.std(2, keepdims=True)),
        (lambda c: vec.scale_std(c), x / x.std(2, ddof=1, keepdims=True)),
        (lambda c: vec.instance_norm(c)["values"], (x - x.mean(2, keepdims=True)) / np.sqrt(x.var(2, keepdims=True) + 1e-5)),
    ):
        got = np.array([r.e for r in df.select("k", F.transform("eeg", f).alias("e")).orderBy("k").collect()])
        assert np.allclose(got, want)
    assert time.time() - t < 60


@pytest.mark.parametrize("fan", [None, 4])
def test_running_sums_by_buckets(spark, monkeypatch, fan):
    from sigspark.operators import ordered

    if fan:
        monkeypatch.setattr(ordered, "FAN", fan)
    rng = np.random.default_rng(2)
    rows = [(float(v), int(rng.integers(5)), int(rng.integers(1, 9))) for v in rng.normal(size=3000)] + [(None, 1, 2), (float("inf"), 3, 4)]
    got = ordered.running(spark.createDataFrame(rows, "k double, p long, n long").repartition(5), "k", ["p", "n"]).collect()
    p = n = 0
    for k, a, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        r = next(x for x in got if x.k == k)
        assert (r.before_p, r.before_n) == (p, n)
        p, n = p + a, n + b
    score, y = rng.normal(size=2000), rng.integers(0, 2, 2000)
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)], "s double, y int")
    a, b = score[y == 1], score[y == 0]
    assert abs(metrics.auroc(df, F.col("y"), F.col("s")).first().auroc - (a[:, None] > b).mean()) < 1e-9
    order = y[np.argsort(-score)]
    want = (np.cumsum(order) / np.arange(1, 2001))[order == 1].mean()
    assert abs(metrics.average_precision(df, F.col("y"), F.col("s")).first().pr_auc - want) < 1e-9


def test_both_ways_of_similarity_agree(spark):
    """Null, ragged and short vectors, null keys and ties."""
    rng = np.random.default_rng(3)
    q = [(i, i % 2, rng.normal(size=4).tolist()) for i in range(30)] + [(90, 0, None), (91, None, [1.0, 0.0, 0.0, 0.0]), (92, 1, [1.0, None, 0.0, 0.0]), (93, 1, [1.0, 2.0]), (94, 0, [0.0] * 4)]
    g = [(i, i % 2, rng.normal(size=4).tolist()) for i in range(40)] + [(90, 0, None), (91, None, [1.0, 0.0, 0.0, 0.0]), (92, 1, [3.0, 1.0]), (93, 0, g0 := [0.5] * 4), (94, 0, g0)]
    qs, gs = spark.createDataFrame(q, "q long, t int, v array<double>"), spark.createDataFrame(g, "g long, t int, w array<double>")
    for on in (None, ["t"]):
        g_on = gs if on else gs.withColumnRenamed("t", "u")
        rows = [{(r.q, r.g): r.sim for r in retrieval.similarity_join(qs, g_on, "v", "w", on, m).collect()} for m in ("broadcast", "blocked")]
        rows.append({(r.q, r.g): r.sim for r in retrieval._blocked(qs, g_on, "v", "w", on or [], rows=7).collect()})
        for other in rows[1:]:
            assert rows[0].keys() == other.keys()
            assert all((a is None) == (other[k] is None) and (a is None or abs(a - other[k]) < 1e-12) for k, a in rows[0].items())
        best = [{(r.q, r.rank, r.g) for r in retrieval.nearest(qs, g_on, "v", "w", 5, ["q"], ["g"], on, m).collect()} for m in ("broadcast", "blocked")]
        assert best[0] == best[1]


def test_blocks_keep_k_of_copies(spark, monkeypatch):
    """Copies, multiples and unknown vectors tie: a block keeps k rows of a query, and ranks are those of one copy of the gallery."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 6))
    vectors = [base[0]] * 150 + [base[1] * s for s in np.linspace(0.1, 3, 60)] + [base[2], base[3]] + [[float("nan")] * 6] * 5 + [None] * 20 + [[1.0, 2.0]] * 5
    rng.shuffle(ids := list(range(len(vectors))))
    g = spark.createDataFrame([(i, i % 3, None if v is None else list(map(float, v))) for i, v in zip(ids, vectors)], "g long, t int, w array<double>")
    queries = [(i, (base[i % 4] + 0.01 * rng.normal(size=6)).tolist()) for i in range(40)] + [(90, None), (91, [float("nan")] * 6), (92, [3.0, 1.0]), (93, base[0].tolist())]
    q = spark.createDataFrame(queries, "q long, v array<double>")
    kept, blocked = [], retrieval._blocked

    def spied(*a):
        out = blocked(*a)
        kept.append(out.count())
        return out

    def rows(df, *more):
        return sorted((r.q, r.g, str(r.sim), *(r[c] for c in more)) for r in df.collect())

    monkeypatch.setattr(retrieval, "_blocked", spied)
    best = [rows(retrieval.nearest(q, g, "v", "w", 5, ["q"], ["g"], None, m), "rank") for m in ("broadcast", "blocked")]
    quota = [rows(retrieval.topk_with_type_quota(q, g, 6, 1, "v", "w", ["q"], "t", ["g"], m), "part") for m in ("broadcast", "blocked")]
    assert best[0] == best[1] and len(best[0]) == 44 * 5 and quota[0] == quota[1] and len(quota[0]) == 44 * 6
    assert kept == [44 * 5, 44 * 6]
    monkeypatch.setattr(retrieval, "_blocked", lambda *a: blocked(*a, rows=50))
    assert rows(retrieval.nearest(q, g, "v", "w", 5, ["q"], ["g"], None, "blocked"), "rank") == best[0]


def test_memory_of_blocks():
    """Scores are held in slices, whatever the size of the blocks."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 8))
    x[1000:] = x[:1] * np.linspace(1, 2, 2000)[:, None]
    column = pa.array(x.tolist())
    tracemalloc.start()
    i, j, s, _ = retrieval._scores(column, column, [(np.arange(3000), 2)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == 6000 and most < 50e6  # all scores: 72 MB
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.sort(u @ u.T, axis=1)[:, :-3:-1], s.reshape(-1, 2))


def test_seeded_ranks(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(400)], "k long, g int")
    got = sampling.seeded_rank(df, ["g"], "k", 5).collect()
    import hashlib

    for g in (None, 0, 1, 2):
        mine = sorted((hashlib.md5(f"5|{r.k}".encode()).hexdigest(), r._r, r._n) for r in got if r.g == g)
        assert [r for _, r, _ in mine] == list(range(1, len(mine) + 1)) and {n for *_, n in mine} == {len(mine)}


def test_even_chunks_and_kmeans_brute(spark):
    rows = [(i, int((i * 7919) % 97), i // 40, (i * 13) % 40) for i in range(160)]
    df = spark.createDataFrame(rows, "k long, n int, megabatch long, place int")
    got = {r.k: r.chunk for r in instruct.even_chunks(df, "k", "n", 4).collect()}
    for m in range(4):
        totals, counts = [0] * 4, [0] * 4
        for k, n, _, _ in sorted((r for r in rows if r[2] == m), key=lambda r: r[3]):
            c = min((c for c in range(4) if counts[c] < 10), key=lambda c: (totals[c], c))
            assert got[k] == c
            totals[c] += n
            counts[c] += 1
    x = np.random.default_rng(4).normal(size=(200, 3))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    import hashlib

    c = x[sorted(range(200), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest())[:4]]
    for _ in range(5):
        of = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.stack([x[of == j].mean(0) if (of == j).any() else c[j] for j in range(4)])
    assert np.allclose(matrices.kmeans(vectors, "k", "v", 4, 5, 1, starts="seeded"), c)


def test_named_forms(spark):
    """Strict labels, unknown methods, windows of a trial's part, JSON of turns, and a jittered k."""
    df = spark.createDataFrame([("a cat",), ("a dog",)], "c string")
    assert [r.x for r in df.select(text.label_by_words("c", [("cat", 1), ("dog", 2)], strict=True).alias("x")).collect()] == [1, 2]
    with pytest.raises(Exception, match="no label for caption: a dog"):
        df.select(text.label_by_words("c", [("cat", 1)], strict=True)).collect()
    with pytest.raises(ValueError):
        vec.normalize_signal("s", "other")
    rows = spark.createDataFrame([("u", i) for i in range(50)] + [("v", i) for i in range(3)], "g string, i int").withColumnRenamed("i", "o")
    got = {}
    for r in windows.part_windows(rows, "g", "o", 0.2, 0.9, 10, 7).collect():
        got.setdefault((r.g, r.window), []).append((r.i, r.o))
    assert {k: sorted(v) for k, v in got.items()} == {("u", w): [(j, 10 + 7 * w + j) for j in range(10)] for w in range(4)}
    turns = spark.createDataFrame([([("user", 'say "hi"'), ("bot", None)],)], "t array<struct<role:string,text:string>>")
    import json

    assert json.loads(one(turns, text.turns_state("t", F.lit("s"), ["user", "bot"]))) == {"system": "s", "roles": ["user", "bot"], "messages": [["user", 'say "hi"'], ["bot", None]]}
    assert [one(spark.range(1), retrieval.recommended_k(F.lit(n), jitter=F.lit(j))) for n, j in ((400, 0.0), (400, 0.999), (10_000, 0.25))] == [90, 109, 399]
