"""Sources, sinks, pipelines and streams on files that the tests write."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.plans import pipelines
from sigspark.schema import dim_dataset, dim_label
from sigspark.sources import store
from sigspark.streaming import jobs


def samples(spark, dataset, split, n, length=4):
    rows = [(dataset, split, i, [[float(i)] * length] * 2, [0.5], "c" * 300, i % 2, None) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, split string, row_idx long, eeg array<array<double>>, feature array<double>, caption string, label int, image_path string")


def test_epochs_of_the_older_store(spark, tmp_path):
    path = str(tmp_path / "epochs")
    third = spark.createDataFrame([("a", [[1 / 3] * 4] * 2)] * 3, "dataset string, eeg array<array<double>>")
    assert store.append_epochs(third, path, 2, 4) == 3 and store.append_epochs(third, path, 2, 4) == 6
    assert spark.read.parquet(path).first().eeg[1] == [float(np.float16(1 / 3))] * 4
    with pytest.raises(Exception, match="wrong shape"):  # one value more is no fit here
        store.append_epochs(third, path, 2, 3)
    assert spark.read.parquet(path).count() == 6


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    for d, n in (("a", 5), ("b", 3)):
        store.append_samples(samples(spark, d, "train", n, 5), path, 2, 4)
        store.append_samples(samples(spark, d, "test", n), path, 2, 4)
    got = store.read_samples(spark, path, "train", exclude=["b"])
    assert got.count() == 5 and all(len(r.eeg[0]) == 4 and len(r.caption) == 192 for r in got.collect())
    assert store.read_samples(spark, path, "test", limit=2).count() == 4
    assert store.get_row(store.read_samples(spark, path, "test"), "a", 3).first().row_idx == 3
    with pytest.raises(Exception, match="rows found"):
        store.get_row(store.read_samples(spark, path, "test"), "a", 99).collect()
    store.drop_partition(spark, path, "a")
    assert store.read_samples(spark, path, "train").count() == 3
    with pytest.raises(ValueError):
        store.drop_partition(spark, path, "nope")
    with pytest.raises(Exception, match="wrong shape"):
        store.append_samples(samples(spark, "c", "train", 1, 9), path, 2, 4)


def test_readers(spark, tmp_path):
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "x.npz", signal=np.ones((2, 3)), label=4)
    (tmp_path / "npz" / "broken.npz").write_bytes(b"no")
    good, bad = store.read_npz(spark, str(tmp_path / "npz"))
    assert [(r.signal, r.label) for r in good.collect()] == [([[1.0] * 3] * 2, 4)] and bad.count() == 1
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "s1.rec").write_text("0,1.5,2.5,3\n1,2.0,3.0,6\n")
    a = store.read_annotations(spark, str(tmp_path / "rec"))
    assert {(r.rec_id, r.code) for r in a.collect()} == {("s1", 3), ("s1", 6)}
    assert [r.stem for r in store.list_files(spark, str(tmp_path), "*.rec").collect()] == ["s1"]
    lines = spark.createDataFrame([("n1 big red cat, dog, fish",), ("n2 one,two",), ("",)], "value string")
    assert {(r.key, r.name) for r in store.class_mapping(lines).collect()} == {("n1", "dog"), ("n2", "one")}
    assert store.templates(lines).count() == 2
    conv = [{"id": "1", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}]
    (tmp_path / "c.json").write_text(json.dumps(conv))
    assert [r.role for r in store.explode_conversations(store.read_conversations(spark, str(tmp_path / "c.json"))).orderBy("turn").collect()] == ["human", "gpt"]
    q = spark.createDataFrame([("1", "p", ' What "x"?\n(A)y ', "A", 2)], "id string, eegpath string, question string, correct_answer string, option_number int")
    store.write_mcq(q, str(tmp_path / "mcq"))
    assert store.read_mcq(spark, str(tmp_path / "mcq")).first().question == ' What "x"?\n(A)y '
    files = spark.createDataFrame([("/d/00002_b/1.jpg",), ("/d/00001_aard_vark/2.jpg",), ("/d/00001_aard_vark/1.jpg",)], "path string")
    assert [(r.class_idx, r.description, r.img_idx) for r in store.image_catalogue(files).orderBy("class_idx", "img_idx").collect()] == [(0, "aard_vark", 0), (0, "aard_vark", 1), (1, "b", 0)]


def test_cache_and_log(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for force in (False, False, True):
        assert store.cached(spark, str(tmp_path / "w"), make, force).count() == 3
    assert len(calls) == 2
    cache = spark.createDataFrame([("a", 1)], "k string, feature int")
    out = store.embed_with_cache(spark.createDataFrame([("a",), ("bb",), ("bb",)], "k string"), "k", cache, F.length)
    assert sorted((r.k, r.feature) for r in out.collect()) == [("a", 1), ("bb", 2), ("bb", 2)]
    log = spark.createDataFrame([(4,)], "idx long")
    assert [r.idx for r in store.append_log(spark.range(2), log, "id").orderBy("id").collect()] == [5, 6]
    assert [r.idx for r in store.append_log(spark.range(2), None, "id").orderBy("id").collect()] == [0, 1]
    assert dim_label(spark).where("dataset = 'TUEV'").count() == 6 and dim_dataset(spark).count() == 12


def test_recording_and_event_pipelines(spark):
    fs, rng = 100, np.random.default_rng(1)
    good = rng.normal(size=(2, 3000)).tolist()
    flat = np.zeros((2, 3000)).tolist()
    df = spark.createDataFrame([("good", ["A", "B"], good), ("flat", ["A", "B"], flat)], "rec_id string, ch_names array<string>, signal array<array<double>>")
    how = pipelines.Harmonise(fs=fs, low=1, high=40, target=("B", "A"))
    s, log = pipelines.recording_pipeline(df, how)
    rows = {r.rec_id: (r.remain, r.total, r.drop_rate) for r in log.collect()}
    assert rows == {"good": (30, 30, 0.0), "flat": (0, 0, 100.0)}
    eeg = np.array(s.where("epoch = 3").first().eeg)
    assert eeg.shape == (2, 100) and np.allclose(eeg.mean(1), 0) and np.allclose(eeg.std(1), 1)
    ev = spark.createDataFrame([("good", 1, 0, 10.0, 11.0, 3), ("good", 2, 0, 10.0, 12.0, 3)], "rec_id string, event_id int, channel int, start_s double, end_s double, code int")
    out = pipelines.event_pipeline(df, ev, pipelines.Harmonise(fs=fs, low=1, high=40, resample=128), 1).collect()
    assert len(out) == 5 and {r.label for r in out} == {2} and all(len(r.signal[0]) == 128 for r in out)
    assert pipelines.rejected_events(ev).count() == 1
    bad = spark.createDataFrame([("x", ["A"], [[1.0] * 150])], "rec_id string, ch_names array<string>, signal array<array<double>>")
    with pytest.raises(Exception, match="sampling rate"):
        pipelines.filter_pipeline(bad, how).collect()
    done = pipelines.build_store({"ok": lambda: df, "no": lambda: 1 / 0}, lambda n, d: d.count())
    assert done["ok"] == "ok" and done["no"].startswith("ZeroDivisionError")


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", i % 2) for i in range(40)]
    batch = spark.createDataFrame(rows, "id long, ts string, k long").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.read_files(spark, str(tmp_path / "in"), batch.schema, per_batch=1)
    q = jobs.ingest(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: (b.where("id % 10 <> 0"), b.where("id % 10 = 0")), str(tmp_path / "bad"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 36 and spark.read.parquet(str(tmp_path / "bad")).count() == 4
    totals = jobs.split_totals(stream(), "id", 42).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    totals.awaitTermination(120)
    from sigspark.operators.sampling import split_random

    want = {r.split: r["count"] for r in batch.groupBy(split_random("id", 42).alias("split")).count().collect()}
    assert {r.split: r.n for r in spark.table("totals").collect()} == want
    one = jobs.read_files(spark, str(tmp_path / "in"), batch.schema, per_batch=100)
    w = jobs.sliding_epochs(one, "ts", ["k"], "id", "10 seconds", None, "0 seconds").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    twin = batch.groupBy("k", F.window("ts", "10 seconds").alias("w")).agg(F.count("*").alias("n")).collect()
    got = {(r.k, r.start): r.n for r in spark.table("w").collect()}
    assert got and all(got[(r.k, r.w.start)] == r.n for r in twin if (r.k, r.w.start) in got)
    live = jobs.liveness(jobs.read_files(spark, str(tmp_path / "in"), batch.schema, per_batch=100), "k", "ts", 1).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    live.awaitTermination(120)
    assert {r.k for r in spark.table("live").where("alive").collect()} == {0, 1}


def test_caption_prototypes(spark):
    from sigspark.plans.reports import caption_prototypes

    labels = spark.createDataFrame([("a", 0, "x"), ("a", 1, "yy"), ("b", 0, "x")], "dataset string, label_id int, caption string")
    out = caption_prototypes(labels, lambda c: F.array(F.length(c)))
    assert sorted((r.dataset, r.label_id, r.feature) for r in out.collect()) == [("a", 0, [1]), ("a", 1, [2]), ("b", 0, [1])]


def test_loader_hook(spark, tmp_path):
    import numpy as np
    from sigspark.plans import pipelines

    for i in range(3):
        (tmp_path / f"r{i}.txt").write_text(" ".join(str(i + k) for k in range(4)))
    (tmp_path / "bad.txt").write_text("x")
    (tmp_path / "long.txt").write_text("1 " * 500)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    load = lambda path, content: [(path.rsplit("/", 1)[1], ["a"], 100.0, np.array([[float(v) for v in content.split()]]))]
    good, bad = pipelines.load_recordings(files, load, most_bytes=100)
    assert sorted((r.rec_id, r.signal[0][1]) for r in good.collect()) == [("r0.txt", 1.0), ("r1.txt", 2.0), ("r2.txt", 3.0)]
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["bad.txt", "long.txt"]


def test_encoder_hook(spark):
    """A fixed projection, loaded once a task and asked once a key."""
    import numpy as np
    from sigspark.plans import pipelines

    def make():
        w = np.arange(6.0).reshape(2, 3)
        return lambda xs: np.array(xs) @ w

    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", [0.0, 1.0]), ("c", None), (None, [1.0, 1.0])], "k string, x array<double>")
    got = [(r.k, r.feature) for r in pipelines.encode(df, "k", "x", make).collect()]
    assert sorted(got, key=str) == sorted([("a", [6.0, 9.0, 12.0]), ("a", [6.0, 9.0, 12.0]), ("b", [3.0, 4.0, 5.0]), ("c", None), (None, None)], key=str)


def test_harmonise_hooks(spark):
    from pyspark.sql import functions as F
    from sigspark.plans import pipelines

    df = spark.createDataFrame([(["EEG A", "EEG B"], [[1.0, 2.0], [3.0, 4.0]])], "ch_names array<string>, signal array<array<double>>")
    how = pipelines.Harmonise(fs=2.0, target=("b",), rename=lambda c: F.lower(F.substring_index(c, " ", -1)), filter=lambda d: d.withColumn("signal", F.transform("signal", lambda ch: F.transform(ch, lambda v: v * 10))))
    assert pipelines.filter_pipeline(df, how).first().signal == [[30.0, 40.0]]


def test_training_view_and_metric_report(spark):
    from pyspark.sql import functions as F
    from sigspark.plans import pipelines

    store = spark.range(300).select(F.col("id").alias("k"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("dataset"), F.when(F.col("id") % 10 == 9, "test").otherwise("train").alias("split"), (F.col("id") % 4 == 0).cast("int").alias("label"), F.array(F.col("id") * 1.0, F.lit(2.0), F.lit(5.0)).alias("feature"))
    view = pipelines.training_view(store, "k", pipelines.View(exclude=("d2",), limit=40, required=("feature",), strategy="over", methods={"train": "zscore_pop"})).collect()
    n = {x: sum(r.label == x for r in view) for x in (0, 1)}
    assert n[0] == n[1] and {r.dataset for r in view} == {"d0", "d1"} and {r.split for r in view} == {"train"} and len({r.k for r in view}) == 80
    assert all(abs(sum(r.feature)) < 1e-9 for r in view)
    table = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 0, 0, 0.2), ("a", 1, 0, 0.4), ("b", 2, 2, 0.5), ("b", 1, 2, 0.5)], "dataset string, label int, predicted int, score double")
    got = {(r.dataset, r.metric): r.value for r in pipelines.metric_report(table, {"a": ["accuracy", "roc_auc", "pr_auc"], "b": ["balanced_accuracy", "f1_weighted", "cohen_kappa"]}).collect()}
    assert abs(got["a", "accuracy"] - 2 / 3) < 1e-9 and got["a", "roc_auc"] == 1.0 and got["b", "balanced_accuracy"] == 0.5 and len(got) == 6
    try:
        pipelines.metric_report(table, {"a": ["nope"]})
        raise AssertionError
    except ValueError:
        pass


def test_interaction_log(spark, tmp_path):
    import json

    from pyspark.sql import functions as F
    from sigspark.streaming import jobs

    day = 86400
    rows = [(10.0, "chat"), (10.0, "chat"), (20.0, "vote"), (day + 5.0, "chat"), (3 * day + 5.0, "chat"), (30.0, "chat")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join([json.dumps({"tstamp": t, "type": k, "model": "m", "ip": "1"}) for t, k in rows] + ["not json"]))
    assert jobs.read_interactions(spark, str(tmp_path / "log")).count() == 6
    out = jobs.interaction_counts(jobs.read_interactions(spark, str(tmp_path / "log"), streaming=True), "time", ["type"])
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.type, str(r.day)[:10], r.n) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {("chat", "1970-01-01", 2), ("vote", "1970-01-01", 1), ("chat", "1970-01-02", 1)}


def test_flush_size_and_expiry(spark, tmp_path):
    from pyspark.sql import functions as F
    from sigspark.streaming import jobs

    src = str(tmp_path / "in")
    spark.range(1000).select("id", F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 5 + F.when(F.col("id") > 500, 10).otherwise(0)).alias("user")).coalesce(1).write.parquet(src)
    stream = lambda: jobs.read_files(spark, src, spark.read.parquet(src).schema)
    jobs.ingest(stream(), str(tmp_path / "store"), str(tmp_path / "c1"), lambda b: (b, None), rows_per_file=300).awaitTermination()
    sizes = sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "store")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
    assert sizes == [100, 300, 300, 300]
    out = jobs.liveness(stream().select("user", "ts"), "user", "ts", 600, "10 seconds")
    out.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/live/b{i}")).outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/live/*").collect()
    assert {(r.user, r.alive) for r in jobs.latest(spark.read.schema(out.schema).parquet(f"{tmp_path}/live/*"), "user").collect()} == {*((u, False) for u in range(5)), *((u, True) for u in range(10, 15))}
    assert "Python" not in out._jdf.queryExecution().analyzed().toString()
    assert {r.user for r in rows if not r.alive} == set(range(5)) and {r.user for r in rows if r.alive} == {*range(5), *range(10, 15)}


def test_log_goes_on(spark):
    from pyspark.sql import functions as F
    from sigspark.sources import store

    df = spark.range(50).select(F.timestamp_seconds(F.col("id") * 97 % 50).alias("time"))
    first = store.append_log(df, None, "time")
    again = store.append_log(df, first, "time").orderBy("time").collect()
    assert [r.idx for r in again] == list(range(50, 100))


def test_totals_without_scans(spark, tmp_path):
    path = str(tmp_path / "store")
    samples(spark, "old", "train", 4).write.partitionBy("dataset", "split").parquet(path)  # a store older than its log
    assert store.append_samples(samples(spark, "a", "train", 5, 5), path, 2, 4) == 9
    assert store.append_samples(samples(spark, "a", "test", 0), path, 2, 4) == 9
    with pytest.raises(Exception, match="wrong shape"):
        store.append_samples(samples(spark, "c", "train", 1, 9), path, 2, 4)
    assert store.stored_rows(spark, path) == 9 == spark.read.parquet(path).count()
    store.drop_partition(spark, path, "old")
    assert store.stored_rows(spark, path) == 5 and store.read_samples(spark, path, "train").count() == 5
    checked = samples(spark, "b", "train", 2)
    checked.write.mode("append").partitionBy("dataset", "split").parquet(path)  # rows that no line tells of
    assert store.stored_rows(spark, path) == 5 and store.stored_rows(spark, path, recount=True) == 7 == store.stored_rows(spark, path)
    assert store.stored_rows(spark, str(tmp_path / "nowhere")) == 0


def test_spells_seen_again_and_late(spark, tmp_path):
    """Three files in turn: a key ends, is seen again, and a late row joins a stretch that is still open."""
    src = tmp_path / "in"
    at = lambda xs: spark.createDataFrame([(k, s) for k, s in xs], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = []
    for i, xs in enumerate(([("a", 0), ("a", 5), ("b", 3)], [("a", 100), ("b", 97)], [("a", 93), ("c", 300), (None, 301)])):
        at(xs).coalesce(1).write.mode("append").parquet(str(src))
        stream = jobs.read_files(spark, str(src), at(xs).schema)
        out = jobs.spells(stream, "k", "ts", 20, "10 seconds")
        out.writeStream.foreachBatch(lambda b, j: got.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    told = sorted((r.k, int(r.first_seen.timestamp()), int(r.last_seen.timestamp()), r.n) for r in got)
    assert told == [("a", 0, 5, 2), ("a", 93, 100, 2), ("b", 3, 3, 1), ("b", 97, 97, 1)]


def test_store_audit(spark):
    from sigspark.plans.reports import store_audit

    unit = lambda i: [1.0 if j == i else 0.0 for j in range(8)]
    rows = [(i, "thingEEG" if i < 4 else "x", [[float(i), 1.0, 2.0]], unit(i), "p" if i < 3 else "", unit(i)) for i in range(8)]
    rows[5] = (5, "x", [[1.0, 1.0, 1.0]], [2.0 * v for v in unit(5)], "p", unit(6))  # flat, of norm 2, with a path, and not its own
    rows += [(8, "x", None, unit(0), None, unit(0)), (9, "x", [[1.0]], [float("nan")], None, None), (10, None, [[1.0, 2.0]], unit(0), None, None), (11, "x", [[]], unit(0), "", None)]
    df = spark.createDataFrame(rows, "k long, dataset string, eeg array<array<double>>, feature array<double>, image_path string, fresh array<double>")
    got = {r.dataset: r.asDict() for r in store_audit(df, "k", "fresh", others=50).collect()}
    assert got["thingEEG"] | {"mean": 0, "std": 0} == {"dataset": "thingEEG", "n": 4, "bad": 0, "mean": 0, "std": 0, "flat": 0, "off_norm": 0, "path_wrong": 1, "asked": 4, "not_own": 0}
    x = got["x"]
    assert (x["n"], x["bad"], x["flat"], x["off_norm"], x["path_wrong"], x["asked"], x["not_own"]) == (7, 3, 1, 1, 1, 4, 1)
    values = np.array([[4, 1, 2], [1, 1, 1], [6, 1, 2], [7, 1, 2]], float)
    assert abs(x["mean"] - values.mean()) < 1e-12 and abs(x["std"] - values.std()) < 1e-12
    assert got[None]["asked"] == 0 and got[None]["n"] == 1
    assert store_audit(df.limit(0), "k", "fresh").count() == 0 and store_audit(df, "k").columns == ["dataset", "n", "bad", "mean", "std", "flat", "off_norm", "path_wrong"]
