"""Streams run to their end over the events table, each held against the SQL of its batch twin; and jobs without SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment, dsp, matrices
from ..operators.sampling import split_random
from ..sources.shared import shared_folder
from ..streaming import jobs
from .registry import Tables, query
from .tables import hashed


def _events(t: Tables) -> DataFrame:
    schema = t.events.schema
    df = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{t.folder}/events.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _append(t: Tables, out: DataFrame) -> DataFrame:
    at = shared_folder(t.spark, "stream")
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{at}/out")


@query("z5_stream_tumbling", "SELECT event_type, start, count(*)::BIGINT AS n, round(sum(value), 6) AS v FROM (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY event_type, start")
def _(t):
    """Closed windows only: those whose end the watermark has passed."""
    out = jobs.sliding_epochs(_events(t), "ts", ["event_type"], "value", "1 hour", None, "10 minutes")
    return _append(t, out).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("v", 6).alias("v"))


@query("z4_stream_sliding", "SELECT event_type, w AS start, count(*)::BIGINT AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) WHERE w + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def _(t):
    out = jobs.sliding_epochs(_events(t), "ts", ["event_type"], "value", "2 hours", "1 hour", "10 minutes")
    return _append(t, out).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("z1_stream_ingest", f"SELECT CASE WHEN {hashed(42, 'event_id')} < 0.9 THEN 'train' ELSE 'test' END AS split, event_type, count(*)::BIGINT AS n FROM events WHERE value >= 1 GROUP BY ALL")
def _(t):
    """Micro-batches validated, split and appended; the bad rows go to a side table."""
    at = shared_folder(t.spark, "stream")

    def prepare(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        ok = F.coalesce(F.col("value") >= 1, F.lit(False))
        return batch.where(ok).withColumn("split", split_random("event_id", 42)), batch.where(~ok)

    jobs.ingest(_events(t), f"{at}/store", f"{at}/state", prepare, f"{at}/bad").awaitTermination()
    return t.spark.read.parquet(f"{at}/store").groupBy("split", "event_type").agg(F.count("*").alias("n"))


_G = "sqrt(-2 * ln(greatest({u}, 1e-12))) * cos(2 * pi() * {v})"


def _gauss(seed: int, key: str) -> str:
    return _G.format(u=hashed(f"{seed}a", key), v=hashed(f"{seed}b", key))


@query("n8_jitter_scale_shift", f"SELECT vec_id, pos::INT AS pos, round(x + 0.1 * {_gauss(1, 'vec_id, pos')}, 6) + 0.0 AS jitter, round(x * (1 + 0.1 * {_gauss(2, 'vec_id')}), 6) + 0.0 AS scale, round(x + 0.1 * {_gauss(3, 'vec_id')}, 6) + 0.0 AS shift FROM (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings)")
def _(t):
    made = t.embeddings.select("vec_id", F.arrays_zip(augment.jitter("embedding", 0.1, 1, "vec_id").alias("jitter"), augment.scale("embedding", 0.1, 2, "vec_id").alias("scale"), augment.shift("embedding", 0.1, 3, "vec_id").alias("shift")).alias("z"))
    return made.select("vec_id", F.posexplode("z").alias("pos", "s")).select("vec_id", "pos", *((F.round(f"s.{c}", 6) + 0.0).alias(c) for c in ("jitter", "scale", "shift")))


@query("n9_mask_choice", "SELECT vec_id, c::INT AS channel, row_number() OVER (PARTITION BY vec_id ORDER BY md5(concat_ws('|', '4', vec_id, c))) <= 4 AS masked FROM embeddings, range(0, 8) r(c)")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode(augment.masked(8, 0.6, 4, "vec_id")).alias("channel", "masked"))


def _signal(t: Tables) -> DataFrame:
    """Embeddings as signals of 4 channels and 16 values."""
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(e, c * 16 + 1, F.lit(16))).alias("signal"))


def _values(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("signal").alias("channel", "ch")).select("vec_id", "channel", F.posexplode("ch").alias("pos", "x")).select("vec_id", "channel", "pos", (F.round("x", 6) + 0.0).alias("v"))


_X = "x AS (SELECT vec_id, c, i, embedding[c * 16 + i + 1]::DOUBLE AS x FROM embeddings, range(0, 4) a(c), range(0, 16) b(i))"


def _filtered(gain: str) -> str:
    """SQL of 16 values a channel with each frequency k from 0 to 8 times a gain: a circular convolution with the gains' own
    inverse transform, by the definition."""
    return f"""WITH g AS (SELECT k, {gain} AS g FROM range(0, 9) r(k)),
h AS (SELECT m, sum(CASE WHEN k IN (0, 8) THEN g ELSE 2 * g END * cos(2 * pi() * k * m / 16)) / 16 AS h FROM g, range(0, 16) r(m) GROUP BY m), {_X}
SELECT vec_id, c::INT AS channel, t::INT AS pos, round(sum(x * h), 6) + 0.0 AS v FROM x, range(0, 16) r(t), h WHERE m = (t - i + 16) % 16 GROUP BY ALL"""


def _bins(of: str, value: str) -> str:
    """SQL of value over re and im of each channel's bins; of: rows (vec_id, c, f, n, j, size, x), value j of size in frame f."""
    return f"""WITH {_X}, y AS ({of}),
s AS (SELECT vec_id, c, f, k, sum(x * cos(2 * pi() * k * j / size)) AS re, sum(x * sin(2 * pi() * k * j / size)) AS im, max(size) AS size FROM y, range(0, 9) r(k) WHERE k <= size / 2 GROUP BY ALL)
SELECT vec_id, c::INT AS channel, (f * (size / 2 + 1) + k)::INT AS pos, round({value}, 6) + 0.0 AS v FROM s"""


@query("d3_fft_resample", f"""WITH {_X}, h AS (SELECT t, i, (1 + 2 * (SELECT sum(cos(2 * pi() * k * (t / 32.0 - i / 16.0))) FROM range(1, 8) r(k)) + cos(16 * pi() * (t / 32.0 - i / 16.0))) / 16 AS h FROM range(0, 32) a(t), range(0, 16) b(i))
SELECT vec_id, c::INT AS channel, t::INT AS pos, round(sum(x * h), 6) + 0.0 AS v FROM x JOIN h USING (i) GROUP BY ALL""")
def _(t):
    return _values(dsp.fft_resample(_signal(t), "signal", 32))


@query("d1_bandpass", _filtered("(0.5 - 0.5 * cos(pi() * least(greatest(k - 0.5, 0), 1))) * (0.5 - 0.5 * cos(pi() * least(greatest(6.5 - k, 0), 1)))"))
def _(t):
    return _values(dsp.bandpass(_signal(t), "signal", 16.0, 1.0, 6.0))


@query("d2_notch", _filtered("CASE WHEN k = 3 THEN 0 ELSE 1 END"))
def _(t):
    return _values(dsp.notch(_signal(t), "signal", 16.0, (3.0,)))


_FRAMES = """SELECT vec_id, c, f, j, 8 AS size, x * (0.5 - 0.5 * cos(2 * pi() * j / 8)) AS x FROM range(0, 5) a(f), range(0, 8) b(j), x
WHERE i = CASE WHEN f * 4 + j < 4 THEN 4 - f * 4 - j WHEN f * 4 + j > 19 THEN 34 - f * 4 - j ELSE f * 4 + j - 4 END"""


@query("d5_stft", _bins(_FRAMES, "sqrt(re * re + im * im)").replace("size / 2", "size // 2"))
def _(t):
    return _values(dsp.stft(_signal(t), "signal", 8, 4))


@query("a32_spectrum_db", _bins("SELECT vec_id, c, 0 AS f, i AS j, 16 AS size, x FROM x", "10 * log10(re * re + im * im + 1e-10)").replace("size / 2", "size // 2"))
def _(t):
    return _values(dsp.spectrum(_signal(t), "signal", "db"))


@query("p24_cast_half", f"WITH {_X}, s AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE pow(2, greatest(floor(log2(abs(x))), -14) - 10) END AS step FROM x) SELECT vec_id, c::INT AS channel, i::INT AS pos, round(round_even(x / step, 0) * step, 6) + 0.0 AS v FROM s")
def _(t):
    """Half precision has 11 significant bits: steps of 2^-10 of the leading power of two, halves to even."""
    return _values(dsp.cast_half(_signal(t), "signal"))


@query("n9_mask_channels", f"""WITH {_X}, m AS (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY md5(concat_ws('|', '4', vec_id, c)), c) <= 2 AS masked FROM embeddings, range(0, 4) r(c)),
n AS (SELECT *, {_gauss(4, "vec_id, c, i")} AS g FROM x), s AS (SELECT vec_id, c, sqrt(sum(x * x)) / greatest(sqrt(sum(g * g)), 1e-12) AS f FROM n GROUP BY ALL)
SELECT vec_id, c::INT AS channel, i::INT AS pos, round(CASE WHEN masked THEN g * f ELSE x END, 6) + 0.0 AS v FROM n JOIN s USING (vec_id, c) JOIN m USING (vec_id, c)""")
def _(t):
    return _values(_signal(t).withColumn("signal", augment.mask_channels("signal", 4, 0.6, 4, "vec_id")))


def _lloyd(k: int, rounds: int) -> str:
    """SQL of Lloyd rounds from the first k vectors by a hash of their key; an empty cluster keeps its centre."""
    steps = f"""c0 AS (SELECT row_number() OVER (ORDER BY md5(concat_ws('|', '1', vec_id)), vec_id) - 1 AS code, embedding::DOUBLE[] AS c FROM embeddings QUALIFY code < {k})"""
    for r in range(rounds + 1):
        steps += f""", a{r} AS (SELECT vec_id, arg_min(code, (d, code)) AS code FROM (SELECT vec_id, code, list_distance(embedding::DOUBLE[], c) AS d FROM embeddings, c{r}) GROUP BY vec_id),
m{r} AS (SELECT code, list(m ORDER BY pos) AS c FROM (SELECT code, pos, avg(v) AS m FROM (SELECT code, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings JOIN a{r} USING (vec_id)) GROUP BY ALL) GROUP BY code),
c{r + 1} AS (SELECT code, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (code))"""
    return f"WITH {steps} SELECT code::INT AS code, count(*)::BIGINT AS n FROM a{rounds} GROUP BY code"


@query("a31_kmeans", _lloyd(8, 3))
def _(t):
    centres = matrices.kmeans(t.embeddings, "vec_id", "embedding", 8, 3, 1, starts="seeded")
    return matrices.nearest(t.embeddings, "embedding", centres).groupBy("code").agg(F.count("*").alias("n"))


@query("z6_stream_interactions", "SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(DISTINCT ts)::BIGINT AS n FROM events GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(t):
    """Days that the watermark has closed, each moment and type once."""
    out = jobs.interaction_counts(_events(t), "ts", ["event_type"], "1 hour")
    return _append(t, out).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def _batches(t: Tables, out: DataFrame, mode: str) -> DataFrame:
    """Every micro-batch's rows of a stream run to its end, with its number."""
    at = shared_folder(t.spark, "stream")
    out.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).option("basePath", f"{at}/out").parquet(f"{at}/out/*").withColumn("batch", F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1).cast("int"))


@query("z7_stream_liveness", "SELECT user_id, max(ts) AS last_seen, max(ts) + INTERVAL 1 DAY < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS expired FROM events GROUP BY user_id")
def _(t):
    """A user expires when the watermark has passed the last time seen by a day."""
    rows = _append(t, jobs.liveness(_events(t).select("user_id", "ts"), "user_id", "ts", 86400, "10 minutes"))
    return jobs.latest(rows, "user_id").select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), (~F.col("alive")).alias("expired"))


@query("z7_stream_spells", """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
s AS (SELECT user_id, ts, sum((b IS NULL OR ts > b + INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts, b NULLS FIRST ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*)::BIGINT AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(t):
    """Users seen, expired after six hours and seen again: each stretch that has ended."""
    out = _append(t, jobs.spells(_events(t).select("user_id", "ts"), "user_id", "ts", 6 * 3600, "10 minutes"))
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")), "n")


@query("z2_ingest_totals", "SELECT count(*) FILTER (value >= 1)::BIGINT AS rows, count(*) FILTER (value < 1 OR value IS NULL)::BIGINT AS bad_rows FROM events")
def _(t):
    """Rows counted as the micro-batches were written."""
    at = shared_folder(t.spark, "stream")
    ok = F.coalesce(F.col("value") >= 1, F.lit(False))
    jobs.ingest(_events(t), f"{at}/store", f"{at}/state", lambda b: (b.where(ok), b.where(~ok)), f"{at}/bad").awaitTermination()
    return jobs.ingested(t.spark, f"{at}/store").agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"))


@query("z8_stream_totals", f"SELECT CASE WHEN {hashed(42, 'event_id')} < 0.9 THEN 'train' ELSE 'test' END AS split, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(t):
    """The totals after the last micro-batch."""
    out = _batches(t, jobs.split_totals(_events(t), "event_id", 42), "complete")
    return out.groupBy("split").agg(F.max_by("n", "batch").alias("n"))
