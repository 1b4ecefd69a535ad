"""Queries over recordings in chunks: the vectors of a label, in order, are a recording of one channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import longsignal, within
from ..operators.ordered import small
from . import pipelines
from .registry import Tables, query

_SIZE, _FS = 64, 16.0


def _chunks(t: Tables) -> DataFrame:
    sizes = t.embeddings.groupBy("label").agg((F.count("*") * _SIZE).alias("n"))
    rows = within.number(t.embeddings, ["label"], "vec_id", "chunk").join(small(sizes), "label")
    return rows.select(F.col("label").cast("string").alias("rec_id"), "chunk", "n", F.array(F.lit("c0")).alias("ch_names"), F.array(F.col("embedding").cast("array<double>")).alias("signal"))


def _values(df: DataFrame, size: int) -> DataFrame:
    flat = df.select("rec_id", "chunk", F.posexplode(F.get("signal", 0)).alias("_i", "x"))
    return flat.select("rec_id", (F.col("chunk") * size + F.col("_i")).alias("place"), (F.round("x", 6) + 0.0).alias("v"))


def _signal(reach: int) -> str:
    """SQL of the recordings with odd reflections of reach values beyond their ends: e(rec_id, i, x), and n(rec_id, n, ...)."""
    return f"""s AS (SELECT label::VARCHAR AS rec_id, r * 64 + j AS i, embedding[j + 1]::DOUBLE AS x FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings), range(0, 64) a(j)),
n AS (SELECT rec_id, count(*) AS n, arg_min(x, i) AS head, arg_max(x, i) AS tail FROM s GROUP BY 1),
e AS (SELECT * FROM s UNION ALL SELECT rec_id, -i, 2 * head - x FROM s JOIN n USING (rec_id) WHERE i BETWEEN 1 AND {reach} UNION ALL SELECT rec_id, 2 * (n - 1) - i, 2 * tail - x FROM s JOIN n USING (rec_id) WHERE i BETWEEN n - 1 - {reach} AND n - 2)"""


def _sinc(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 1 ELSE sin(pi() * ({x})) / (pi() * ({x})) END"


def _low_pass(edge: float, half: int) -> str:
    """SQL of taps p(k, h) of a low pass filter."""
    w = f"({_sinc(f'{2 * edge / _FS!r} * k')}) * (0.54 + 0.46 * cos(pi() * k / {half}))"
    return f"(SELECT k, {w} / sum({w}) OVER () AS h FROM range({-half}, {half + 1}) r(k))"


def _filtered(low: float, high: float, half: int, stop: bool) -> str:
    """SQL of f(rec_id, place, x): e filtered by the difference of two low pass filters, or by what that leaves."""
    band = "a.h - b.h"
    tap = f"CASE WHEN k = 0 THEN 1 ELSE 0 END - ({band})" if stop else band
    return f"""{_signal(half)}, h AS (SELECT k, {tap} AS h FROM {_low_pass(high, half)} a JOIN {_low_pass(low, half)} b USING (k)),
f AS (SELECT rec_id, i + k AS place, sum(x * h) AS x FROM e JOIN n USING (rec_id), h WHERE i + k BETWEEN 0 AND n - 1 GROUP BY ALL)"""


@query("d1_long_bandpass", f"WITH {_filtered(1.0, 6.0, 27, False)} SELECT rec_id, place, round(x, 6) + 0.0 AS v FROM f")
def _(t):
    return _values(longsignal.fir_filter(_chunks(t), _SIZE, longsignal.band_taps(_FS, 1.0, 6.0)), _SIZE)


@query("d2_long_notch", f"WITH {_filtered(3 - 3 / 400 - 0.5, 3 + 3 / 400 + 0.5, 27, True)} SELECT rec_id, place, round(x, 6) + 0.0 AS v FROM f")
def _(t):
    return _values(longsignal.fir_filter(_chunks(t), _SIZE, longsignal.notch_taps(_FS, (3.0,))), _SIZE)


_BESSEL = "list_sum(list_transform(range(0, 40), lambda m: pow({x} / 2, 2 * m) / pow(gamma(m + 1), 2)))"


@query("d3_long_resample", f"""WITH {_signal(22)}, w AS (SELECT p, k, 0.75 * ({_sinc("0.75 * (p / 3.0 - k)")}) * {_BESSEL.format(x="(10 * sqrt(greatest(1 - pow((p / 3.0 - k) / 23, 2), 0)))")} AS h FROM range(0, 3) a(p), range(-22, 23) b(k)),
h AS (SELECT p, k, h / sum(h) OVER (PARTITION BY p) AS h FROM w), o AS (SELECT rec_id, unnest(range(0, (n * 3 + 3) // 4)) AS place FROM n)
SELECT rec_id, place, round(sum(x * h), 6) + 0.0 AS v FROM o JOIN h ON p = (place * 4) % 3 JOIN e USING (rec_id) WHERE i = (place * 4) // 3 + k GROUP BY ALL""")
def _(t):
    """From 16 to 12 Hz."""
    return _values(longsignal.resample(_chunks(t), _SIZE, 3, 4), _SIZE * 3 // 4)


_LONG = f"""WITH {_filtered(1.0, 6.0, 27, False)}, g AS (SELECT rec_id, place // 16 AS epoch, max(x) - min(x) <= 0.42 AND stddev_pop(x) >= 1e-8 AS kept, avg(x) AS m, stddev_pop(x) AS s FROM f GROUP BY ALL),
c AS (SELECT rec_id, count(*) FILTER (kept) AS k, count(*) AS n FROM g GROUP BY 1)"""


@query("d9_long_recording_samples", f"{_LONG} SELECT rec_id, epoch, place % 16 AS place, round((x - m) / s, 6) + 0.0 AS v FROM f JOIN g ON f.rec_id = g.rec_id AND place // 16 = epoch JOIN c ON c.rec_id = f.rec_id WHERE kept AND k > 1".replace("SELECT rec_id, epoch, place", "SELECT f.rec_id, epoch, place"))
def _(t):
    how = pipelines.Harmonise(_FS, 1.0, 6.0, notch=False)
    samples = pipelines.long_recording_pipeline(_chunks(t), _SIZE, how, 1.0, 0.42)[0]
    return samples.select("rec_id", "epoch", F.posexplode(F.get("eeg", 0)).alias("place", "x")).select("rec_id", "epoch", F.col("place").cast("long").alias("place"), (F.round("x", 6) + 0.0).alias("v"))


@query("d9_long_recording_log", f"{_LONG} SELECT rec_id, k AS remain, n AS total, n - k AS \"drop\", round((n - k) * 100.0 / n, 6)::DOUBLE AS drop_rate FROM c WHERE k > 1")
def _(t):
    how = pipelines.Harmonise(_FS, 1.0, 6.0, notch=False)
    log = pipelines.long_recording_pipeline(_chunks(t), _SIZE, how, 1.0, 0.42)[1]
    return log.where("remain > 1").select("rec_id", "remain", "total", "drop", F.round("drop_rate", 6).alias("drop_rate"))
