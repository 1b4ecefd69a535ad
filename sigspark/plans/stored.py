"""Queries through the store, whole jobs and hooks: each writes what it makes of a table below the shared folder, reads it back,
and is held against the SQL of what should be there."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean
from ..sources import ranges, store
from ..sources.shared import saved, shared_folder
from . import pipelines
from .pipelines import Harmonise
from .registry import Tables, query
from .reports import build_prototypes, caption_prototypes
from .streams import _X, _filtered, _signal, _values
from .tables import hashed
from .vectors import R, _long

_STORED = "SELECT *, 'd' || (vec_id % 3) AS dataset, CASE WHEN vec_id % 10 = 9 THEN 'test' ELSE 'train' END AS split FROM embeddings"


def _samples(t: Tables) -> DataFrame:
    """Embeddings as samples of three datasets, 4 channels and 16 values."""
    split = F.when(F.col("vec_id") % 10 == 9, "test").otherwise("train")
    signal = _signal(t).withColumnRenamed("signal", "eeg")
    return signal.withColumn("dataset", F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string"))).withColumn("split", split).withColumn("caption", F.repeat(F.lit("c"), (F.col("vec_id") % 400).cast("int")))


@query("s5_append_samples", f"WITH {_X} SELECT vec_id, c::INT AS channel, i::INT AS pos, round(x, 6) + 0.0 AS v, least(vec_id % 400, 192)::INT AS n_caption FROM x WHERE i < 15 AND vec_id % 3 <> 1 AND vec_id % 10 <> 9")
def _(t):
    """Two appends, one spare value cut off; the train split of all datasets but one is read."""
    at = shared_folder(t.spark, "samples")
    for odd in (0, 1):
        store.append_samples(_samples(t).where(F.pmod("vec_id", F.lit(2)) == odd), at, 4, 15)
    kept = store.read_samples(t.spark, at, "train", exclude=["d1"]).select("vec_id", F.col("eeg").alias("signal"), F.length("caption").alias("n_caption"))
    long = kept.select("vec_id", "n_caption", F.posexplode("signal").alias("channel", "ch")).select("vec_id", "n_caption", "channel", F.posexplode("ch").alias("pos", "x"))
    return long.select("vec_id", "channel", "pos", (F.round("x", 6) + 0.0).alias("v"), "n_caption")


@query("s6_append_epochs", f"WITH {_X}, s AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE pow(2, greatest(floor(log2(abs(x))), -14) - 10) END AS step FROM x) SELECT vec_id, c::INT AS channel, i::INT AS pos, round(round_even(x / step, 0) * step, 6) + 0.0 AS v, (SELECT count(*) FROM embeddings)::BIGINT AS total FROM s")
def _(t):
    """Two appends of epochs in half precision; total is what the second one reports."""
    at = shared_folder(t.spark, "epochs")
    epochs = _samples(t).select("vec_id", "dataset", "eeg")
    for odd in (0, 1):
        total = store.append_epochs(epochs.where(F.pmod("vec_id", F.lit(2)) == odd), at, 4, 16)
    return _values(t.spark.read.parquet(at).select("vec_id", F.col("eeg").alias("signal"))).withColumn("total", F.lit(total).cast("long"))


@query("s8_drop_partition", f"SELECT dataset, split, count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS ids FROM ({_STORED}) WHERE dataset <> 'd2' AND NOT (dataset = 'd0' AND split = 'test') GROUP BY ALL")
def _(t):
    """A whole dataset and one split of another are deleted from the store."""
    at = shared_folder(t.spark, "samples")
    store.append_samples(_samples(t), at, 4, 16)
    store.drop_partition(t.spark, at, "d2")
    store.drop_partition(t.spark, at, "d0", "test")
    return t.spark.read.parquet(at).groupBy("dataset", "split").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("s5_stored_rows", f"SELECT (SELECT count(*) FROM embeddings)::BIGINT AS appended, (SELECT count(*) FROM ({_STORED}) WHERE dataset <> 'd2' AND NOT (dataset = 'd0' AND split = 'test'))::BIGINT AS kept")
def _(t):
    """The log's totals after two appends, and after two partitions were dropped."""
    at = shared_folder(t.spark, "samples")
    for odd in (0, 1):
        appended = store.append_samples(_samples(t).where(F.pmod("vec_id", F.lit(2)) == odd), at, 4, 16)
    store.drop_partition(t.spark, at, "d2")
    store.drop_partition(t.spark, at, "d0", "test")
    return t.embeddings.limit(1).select(F.lit(appended).cast("long").alias("appended"), F.lit(store.stored_rows(t.spark, at)).cast("long").alias("kept"))


@query("s9_list_files", "SELECT '.parquet' AS kind, count(DISTINCT label)::BIGINT AS folders, true AS some_bytes FROM embeddings")
def _(t):
    """Files of a table written by label, listed without their contents."""
    at = shared_folder(t.spark, "files")
    t.embeddings.write.partitionBy("label").parquet(f"{at}/t")
    files = store.list_files(t.spark, at, "*.parquet")
    folder = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("kind")).agg(F.count_distinct(folder).alias("folders"), F.bool_and(F.col("length") > 0).alias("some_bytes"))


_QUOTED = "'\"' || lang || '\", ' || chr(10) || source || ' ' || left(text, 40)"


@query("s16_mcq_files", f"SELECT doc_id::VARCHAR AS id, source AS eegpath, md5({_QUOTED}) AS question, lang AS correct_answer, (doc_id % 4)::INT AS option_number FROM documents")
def _(t):
    """Questions with quotes, commas and line ends, written as CSV and read back."""
    at = shared_folder(t.spark, "mcq")
    made = F.concat(F.lit('"'), "lang", F.lit('", \n'), "source", F.lit(" "), F.left("text", F.lit(40)))
    store.write_mcq(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("eegpath"), made.alias("question"), F.col("lang").alias("correct_answer"), (F.col("doc_id") % 4).alias("option_number")), f"{at}/mcq")
    return store.read_mcq(t.spark, f"{at}/mcq").withColumn("question", F.md5("question"))


@query("s17_prototype_files", "SELECT count(DISTINCT label)::BIGINT AS n, true AS not_empty, true AS named, true AS width_ok, true AS total_ok FROM embeddings")
def _(t):
    at = shared_folder(t.spark, "protos")
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec"))
    store.write_prototypes(build_prototypes({"first": first}), f"{at}/protos")
    return store.check_prototypes(t.spark.read.parquet(f"{at}/protos"), 64, first.count())


@query("s19_cached_weights", "SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT label, count(*)::BIGINT AS n FROM embeddings GROUP BY label)")
def _(t):
    """Made once; the second call gets the table that is there, a forced one makes it anew."""
    from ..operators.metrics import group_weights

    at = shared_folder(t.spark, "weights") + "/table"
    store.cached(t.spark, at, lambda: t.embeddings.select("label").limit(0))
    store.cached(t.spark, at, lambda: group_weights(t.embeddings, "label"), force=True)
    return store.cached(t.spark, at, lambda: t.embeddings.select("label").limit(0)).select("label", "n", R("weight").alias("weight"))


@query("p15_reject_flat", """SELECT vec_id, list_aggregate(embedding[41:55]::DOUBLE[], 'stddev_pop') < 0.11 OR list_aggregate(embedding[2:11]::DOUBLE[], 'stddev_pop') < 0.11 AS flat FROM embeddings""")
def _(t):
    """Signals of seven overlapping channels of 16 values."""
    e = F.col("embedding").cast("array<double>")
    df = t.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda c: F.slice(e, c * 8 + 1, F.lit(16))).alias("signal"))
    return df.select("vec_id", clean.reject_flat(df, "signal", floor=0.11).alias("flat"))


_PLACES = "p AS (SELECT event_type AS k, avg(value) AS x, avg(user_id) AS y, count(*)::DOUBLE AS z FROM events GROUP BY 1)"


@query("p21_nearest_channel", f"""WITH {_PLACES}, h AS (SELECT DISTINCT user_id AS rec_id, event_type AS channel FROM events WHERE value > 40 AND event_type <> 'view'),
q AS (SELECT t.k AS target, CASE WHEN t.k = 'error' THEN o.x ELSE t.x END AS x, CASE WHEN t.k = 'error' THEN o.y ELSE t.y END AS y, CASE WHEN t.k = 'error' THEN o.z ELSE t.z END AS z FROM p t, p o WHERE o.k = 'click'),
s AS (SELECT rec_id, target, channel, channel = target AS exact, CASE WHEN channel = 'error' THEN 1e300 ELSE pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) END AS d FROM h JOIN p ON p.k = channel, q)
SELECT rec_id, target, channel, exact FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, target ORDER BY exact DESC, d, channel) AS r FROM s) WHERE r = 1""")
def _(t):
    """Users as recordings and event types as channels, whose places are statistics of theirs; error has no place, so its
    target stands where click does, and view is missing everywhere."""
    places = t.events.groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("x"), F.avg("user_id").alias("y"), F.count("*").cast("double").alias("z"))
    present = t.events.where("value > 40 and event_type <> 'view'").select(F.col("user_id").alias("rec_id"), F.col("event_type").alias("channel")).distinct()
    return clean.nearest_channel(saved(places.select(F.col("name").alias("target")), "targets"), present, saved(places.where("name <> 'error'"), "places"), "click")


_NAMES = ["EEG FP1-REF", "eeg t3-ref", "EEG O2-REF", "EEG CZ-REF", "EEG T1-REF", "FP2", "Fc3", "CPz", "Oz", "X1"]


@query("p17_w12_channel_names", "SELECT event_id, n.new_name, n.region FROM events JOIN (VALUES (0, 'Fp1', 'other'), (1, 'T7', 'other'), (2, 'O2', 'other'), (3, 'Cz', 'other'), (4, NULL, 'other'), (5, NULL, 'frontal_polar'), (6, NULL, 'fronto_central'), (7, NULL, 'centro_parietal'), (8, NULL, 'occipital'), (9, NULL, 'other')) n(i, new_name, region) ON event_id % 10 = i")
def _(t):
    """Ten channel names dealt over the events."""
    name = F.get(F.array(*(F.lit(n) for n in _NAMES)), (F.col("event_id") % 10).cast("int"))
    return t.events.select("event_id", name.alias("name")).select("event_id", clean.standard_channel("name").alias("new_name"), clean.brain_region("name").alias("region"))


def _recordings(t: Tables) -> DataFrame:
    """Embeddings as recordings of one channel."""
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select(F.col("vec_id").cast("string").alias("rec_id"), F.array(F.lit("c0")).alias("ch_names"), F.array(e).alias("signal"))


_BARE = {"low": None, "high": None, "notch": False}


@query("d8_filter_pipeline", f"SELECT vec_id, CASE channel WHEN 2 THEN 0 ELSE 1 END::INT AS channel, pos, v FROM ({_filtered('(0.5 - 0.5 * cos(pi() * least(greatest(k - 0.5, 0), 1))) * (0.5 - 0.5 * cos(pi() * least(greatest(6.5 - k, 0), 1))) * CASE WHEN k = 3 THEN 0 ELSE 1 END')}) WHERE channel IN (0, 2)")
def _(t):
    """Renamed channels, one dropped, band filter, an own step (a notch), two channels in target order."""
    from ..operators import dsp

    df = _signal(t).withColumn("ch_names", F.array(*(F.lit(f"c{i}") for i in range(4))))
    how = Harmonise(16.0, 1.0, 6.0, notch=False, drop=("C1",), target=("C2", "C0"), rename=F.upper, steps=[lambda d: dsp.notch(d, "signal", 16.0, (3.0,))])
    return _values(pipelines.filter_pipeline(df, how))


_EPOCHS = """e AS (SELECT vec_id, f, j, embedding[f * 3 + j + 1]::DOUBLE AS x FROM embeddings, range(0, 21) a(f), range(0, 3) b(j)),
g AS (SELECT vec_id, f, max(x) - min(x) <= 0.3 AND stddev_pop(x) >= 1e-8 AS kept, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY ALL),
n AS (SELECT vec_id, count(*) FILTER (kept) AS k, count(*) AS n FROM g GROUP BY vec_id)"""


@query("d9_recording_log", f"""WITH {_EPOCHS} SELECT vec_id::VARCHAR AS rec_id, CASE WHEN k <= 1 THEN 0 ELSE k END::BIGINT AS remain, CASE WHEN k <= 1 THEN 0 ELSE n END::BIGINT AS total, CASE WHEN k <= 1 THEN 0 ELSE n - k END::BIGINT AS "drop",
round(CASE WHEN k <= 1 THEN 100 ELSE (n - k) * 100.0 / n END, 6)::DOUBLE AS drop_rate FROM n""")
def _(t):
    """Embeddings as recordings of one channel, cut to 21 epochs of three values; too large ones are dropped."""
    log = pipelines.recording_pipeline(_recordings(t), Harmonise(1.0, **_BARE), 3.0, 0.3)[1]
    return log.select("rec_id", F.col("remain").cast("long"), F.col("total").cast("long"), F.col("drop").cast("long"), R("drop_rate").alias("drop_rate"))


@query("d9_recording_samples", f"WITH {_EPOCHS} SELECT vec_id::VARCHAR AS rec_id, f::INT AS epoch, j::INT AS pos, round((x - m) / s, 6) + 0.0 AS v FROM e JOIN g USING (vec_id, f) JOIN n USING (vec_id) WHERE kept AND k > 1")
def _(t):
    samples = pipelines.recording_pipeline(_recordings(t), Harmonise(1.0, **_BARE), 3.0, 0.3)[0]
    return _long(samples.withColumn("eeg", F.get("eeg", 0)), "eeg", "rec_id", "epoch")


@query("d10_event_pipeline", f"""WITH e AS (SELECT vec_id, v.* FROM embeddings, (VALUES (0, 0.5, 1.5, 3), (1, 5.0, 6.0, 1), (3, 7.3, 8.3, 2)) v(event_id, start_s, end_s, code)),
w AS (SELECT vec_id, event_id, code, p AS piece, i AS pos, embedding[((ceil(start_s * 8)::BIGINT - 16 + p * 8 + i + 128) % 64) + 1]::DOUBLE AS x FROM e JOIN embeddings USING (vec_id), range(0, 5) a(p), range(0, 8) b(i))
SELECT vec_id::VARCHAR AS rec_id, event_id, piece::INT AS piece, pos::INT AS pos, code - 1 AS label, CASE WHEN {hashed(7, "vec_id || ':' || event_id || ':' || piece")} < 0.9 THEN 'train' ELSE 'test' END AS split, round(x, 6) + 0.0 AS v FROM w""")
def _(t):
    """Three events a recording of one second, and one of another length that is left out; windows wrap round the ends."""
    timed = F.array(*(F.struct(F.lit(i).alias("event_id"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s"), F.lit(c).alias("code")) for i, a, b, c in ((0, 0.5, 1.5, 3), (1, 5.0, 6.0, 1), (2, 1.0, 3.0, 1), (3, 7.3, 8.3, 2))))
    events = saved(t.embeddings.select(F.col("vec_id").cast("string").alias("rec_id"), F.inline(timed)), "events")
    made = pipelines.event_pipeline(_recordings(t), events, Harmonise(8.0, **_BARE), 7)
    return _long(made.withColumn("signal", F.get("signal", 0)), "signal", "rec_id", "event_id", "piece", "label", "split")


@query("d11_inference_samples", "WITH x AS (SELECT vec_id, pos, x, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM (SELECT vec_id, unnest(range(0, 64))::INT AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id::VARCHAR AS rec_id, pos, round((x - m) / s, 6) + 0.0 AS v FROM x WHERE pos < 50")
def _(t):
    made = pipelines.inference_samples(_recordings(t), Harmonise(1.0, **_BARE), 50)
    return _long(made.withColumn("signal", F.get("signal", 0)), "signal", "rec_id")


@query("c1_build_store", f"SELECT dataset, split, count(*)::BIGINT AS n, 'd0 ok, d1 ok, d2 failed' AS told FROM ({_STORED}) WHERE dataset <> 'd2' GROUP BY ALL")
def _(t):
    """Three datasets' jobs, one of which fails on its shape and leaves the others alone."""
    at = shared_folder(t.spark, "build")
    all_ = _samples(t)
    jobs = {d: (lambda d=d: all_.where(F.col("dataset") == d)) for d in ("d0", "d1", "d2")}
    told = pipelines.build_store(jobs, lambda name, df: store.append_samples(df, at, 4, 12 if name == "d2" else 16))
    line = ", ".join(f"{d} {'ok' if m == 'ok' else 'failed'}" for d, m in sorted(told.items()))
    return t.spark.read.parquet(at).groupBy("dataset", "split").agg(F.count("*").alias("n")).withColumn("told", F.lit(line))


@query("a5_caption_prototypes", "SELECT DISTINCT vec_id % 3 AS dataset, label AS label_id, 'class ' || label AS caption, ('class ' || label).length()::DOUBLE AS f0, ascii(right(label::VARCHAR, 1))::DOUBLE AS f1 FROM embeddings")
def _(t):
    """Each distinct caption is embedded once, by its length and last character."""
    labels = t.embeddings.select((F.col("vec_id") % 3).alias("dataset"), F.col("label").alias("label_id"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("caption")).distinct()
    made = caption_prototypes(labels, lambda c: F.array(F.length(c).cast("double"), F.ascii(F.right(c, F.lit(1))).cast("double")))
    return made.select("dataset", "label_id", "caption", F.get("feature", 0).alias("f0"), F.get("feature", 1).alias("f1"))


_COUNTED = ", ".join(f"(length(text) - length(replace(text, '{a}', '')) + 2 * (length(text) - length(replace(text, '{b}', ''))))::DOUBLE AS f{i}" for i, (a, b) in enumerate(("ae", "io", "ts")))


@query("h6_encode", f"SELECT doc_id, {_COUNTED} FROM documents")
def _(t):
    """A fixed projection of letter counts, loaded once a task, of each distinct text once."""

    def make():
        weights = np.array([[1, 0, 0], [2, 0, 0], [0, 1, 0], [0, 2, 0], [0, 0, 1], [0, 0, 2]], np.float64)
        return lambda texts: np.array([[x.count(c) for c in "aeiots"] for x in texts], np.float64) @ weights

    made = pipelines.encode(t.documents.select("doc_id", "text", F.md5("text").alias("key")), "key", "text", make)
    return made.select("doc_id", *(F.get("feature", i).alias(f"f{i}") for i in range(3)))


@query("h5_load_recordings", f"WITH {_X} SELECT vec_id::VARCHAR AS rec_id, c::INT AS channel, i::INT AS pos, 16.0::DOUBLE AS fs, round(x, 6) + 0.0 AS v FROM x")
def _(t):
    """Files of recordings, loaded one by one from their bytes by the given function."""
    at = shared_folder(t.spark, "recordings")
    _signal(t).write.parquet(f"{at}/files")

    def load(path: str, content: bytes):
        for row in pq.read_table(io.BytesIO(content)).to_pylist():
            yield str(row["vec_id"]), ["c0", "c1", "c2", "c3"], 16.0, np.asarray(row["signal"])

    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{at}/files")
    good, _ = pipelines.load_recordings(files, load)
    long = good.select("rec_id", "fs", F.posexplode("signal").alias("channel", "ch")).select("rec_id", "fs", "channel", F.posexplode("ch").alias("pos", "x"))
    return long.select("rec_id", "channel", "pos", "fs", (F.round("x", 6) + 0.0).alias("v"))


_SCORED = "SELECT event_type, user_id % 2 AS label, (value > 10)::INT AS predicted, value + 10 * (user_id % 2) AS score FROM events"


@query("h8_metric_report", f"""WITH s AS ({_SCORED}), c AS (SELECT event_type, label, avg((label = predicted)::INT) AS a FROM s GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0 AS r FROM s WHERE event_type = 'view')
SELECT event_type AS dataset, 'accuracy' AS metric, round(avg((label = predicted)::INT), 6) AS value FROM s WHERE event_type IN ('click', 'view') GROUP BY event_type
UNION ALL SELECT event_type, 'balanced_accuracy', round(avg(a), 6) FROM c WHERE event_type = 'click' GROUP BY event_type
UNION ALL SELECT event_type, 'roc_auc', round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) FROM k GROUP BY event_type""")
def _(t):
    df = t.events.select(F.col("event_type").alias("dataset"), (F.col("user_id") % 2).alias("label"), (F.col("value") > 10).cast("int").alias("predicted"), (F.col("value") + 10 * (F.col("user_id") % 2)).alias("score"))
    made = pipelines.metric_report(df, {"click": ["accuracy", "balanced_accuracy"], "view": ["accuracy", "roc_auc"]})
    return made.withColumn("value", R("value"))


@query("s10_npz_ranges", "SELECT vec_id, pos::INT AS pos, round(x::DOUBLE, 6) + 0.0 AS v, n::BIGINT AS n FROM (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding) AS x FROM embeddings), (SELECT count(*) AS n FROM embeddings)")
def _(t):
    """Vectors written as archives and read by ranges of a few rows; ids and vectors are members of their own, met by row."""
    at = shared_folder(t.spark, "npz")
    n = ranges.write_npz(t.embeddings, at, ["vec_id", "embedding"], 150)
    read = saved(ranges.arrays(ranges.files(t.spark, at, "*.npz"), 50, 4096, 16), "arrays")
    ids = read.where("member = 'vec_id'").select("path", "start", F.posexplode("values").alias("i", "id")).select("path", (F.col("start") + F.col("i")).alias("row"), F.col("id").cast("long").alias("vec_id"))
    parts = read.where("member = 'embedding'").select("path", "row", "start", "values")
    long = parts.join(ids.hint("merge"), ["path", "row"]).select("vec_id", "start", F.posexplode("values").alias("i", "x"))
    return long.select("vec_id", (F.col("start") + F.col("i")).cast("int").alias("pos"), (F.round("x", 6) + 0.0).alias("v"), F.lit(n).cast("long").alias("n"))


@query("h5_recording_ranges", f"WITH {_X}, s AS (SELECT vec_id // 100 AS rec, c, row_number() OVER (PARTITION BY vec_id // 100, c ORDER BY vec_id, i) - 1 AS k, x FROM x) SELECT rec::VARCHAR AS rec_id, c::INT AS channel, (k // 100)::BIGINT AS chunk, count(*)::BIGINT AS n, round(sum(x), 6) + 0.0 AS v, round(sum(x * (k % 100)), 5) + 0.0 AS w FROM s GROUP BY ALL")
def _(t):
    """Recordings of 100 vectors each, written one file a recording, and read through a describing and a reading function; a
    chunk of 100 samples reaches over several vectors."""
    at = shared_folder(t.spark, "recordings")
    _signal(t).select(F.floor(F.col("vec_id") / 100).alias("rec"), "vec_id", "signal").groupBy("rec").applyInArrow(lambda key, rows: _interleaved(at, key, rows), "rec long").count()

    def describe(f, path):
        n = f.size() // 32
        yield {"rec_id": path.rsplit("/", 1)[1].removesuffix(".raw"), "ch_names": ["a", "b", "c", "d"], "fs": 16.0, "n": n}

    def read(f, d, start, stop):
        f.seek(32 * start)
        return np.frombuffer(f.read(32 * (stop - start)), "<f8").reshape(-1, 4).T

    chunks = ranges.recordings(ranges.files(t.spark, at, "*.raw"), describe, read, 100, 3, 16)
    long = chunks.select("rec_id", "chunk", F.posexplode("signal").alias("channel", "ch")).select("rec_id", "chunk", "channel", F.posexplode("ch").alias("k", "x"))
    return long.groupBy("rec_id", "channel", "chunk").agg(F.count("*").alias("n"), (F.round(F.sum("x"), 6) + 0.0).alias("v"), (F.round(F.sum(F.col("x") * F.col("k")), 5) + 0.0).alias("w"))


def _interleaved(folder: str, key: tuple, rows: pa.Table) -> pa.Table:
    """A recording of the query's own as a file of doubles, all channels of a sample together, vectors by id."""
    system, at = ranges.located(folder)
    signal = np.concatenate([np.array(s) for s in rows.sort_by("vec_id")["signal"].to_pylist()], 1)
    with system.open_output_stream(f"{at}/{key[0].as_py()}.raw") as out:
        out.write(signal.T.astype("<f8").tobytes())
    return pa.table({"rec": pa.array([key[0].as_py()], pa.int64())})
