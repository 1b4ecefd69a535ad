"""Segmentation, smoothing, event windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from . import within
from .ordered import small


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slices(x: Column | str, size: int, hop: int | None = None, pad: bool = False) -> Column:
    """Windows of size values every hop (size by default); pad repeats the last value by one hop first."""
    hop = hop or size
    c = _c(x)
    if pad:
        c = F.concat(c, F.array_repeat(F.element_at(c, -1), hop))
    n = F.floor((F.size(c) - size) / hop)
    return F.when(F.size(c) >= size, F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.slice(c, (i * hop + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def cut_fixed(df: DataFrame, vector: str, size: int, strict: bool = True) -> DataFrame:
    """One row a slice of size values: column piece from 0 and the slice; strict: a length that isn't a multiple is an error."""
    c = F.col(vector)
    if strict:
        c = F.when(F.size(c) % size == 0, c).otherwise(F.raise_error(F.lit("length isn't a multiple of the slice size")))
    return df.select("*", F.posexplode(slices(c.cast("array<double>"), size)).alias("piece", "slice"))


def cut_choice(x: Column | str, size: int, u: Column | None = None) -> Column:
    """The first size values, or those from a start picked by u in [0, 1)."""
    c = _c(x)
    start = F.lit(1) if u is None else F.floor(u * (F.size(c) - size + 1)).cast("int") + 1
    return F.slice(c, start, F.lit(size))


def tile_and_truncate(x: Column | str, length: int) -> Column:
    """The series repeated until it is long enough, cut to length."""
    c = _c(x)
    return F.slice(F.flatten(F.array_repeat(c, F.ceil(F.lit(length) / F.size(c)).cast("int"))), 1, length)


def exp_smooth(x: Column | str, alpha: float, first: float = 0.0) -> Column:
    """Running s = alpha * s + (1 - alpha) * x of a vector, from s = first: weights (1 - alpha) * alpha^j and alpha^(t + 1) * first. Rows of
    a table go through within.exp_smooth."""
    c = _c(x).cast("array<double>")
    zero = F.array().cast("array<double>")
    return F.aggregate(c, F.struct(F.lit(first).alias("s"), zero.alias("out")), lambda a, v: F.struct((a["s"] * alpha + v * (1 - alpha)).alias("s"), F.concat(a["out"], F.array(a["s"] * alpha + v * (1 - alpha))).alias("out")), lambda a: a["out"])


def event_windows(samples: DataFrame, events: DataFrame, fs: float, pad_s: float = 2.0, circular: bool = True) -> DataFrame:
    """Circular slices around events. samples(rec_id, signal array of channels); events(rec_id, event_id, channel, start_s,
    end_s, code). Start is the first sample at or after onset, end the first at or after offset; the slice runs pad_s
    before to pad_s after, wrapping round the ends."""
    n = F.size(F.get("signal", 0))
    first = F.ceil(F.col("start_s") * fs).cast("int")
    last = F.ceil(F.col("end_s") * fs).cast("int")
    pad = int(pad_s * fs)
    both = events.hint("merge").join(samples, "rec_id").withColumn("_n", n).withColumn("_a", first - pad).withColumn("_z", last + pad)
    at = F.sequence(F.col("_a"), F.col("_z") - 1)
    take = F.transform("signal", lambda ch: F.transform(at, lambda i: F.get(ch, F.pmod(i, F.col("_n")) if circular else i)))
    return both.withColumn("window", take).drop("_n", "_a", "_z", "signal")


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str) -> DataFrame:
    """left with match: the first right_time at or after left_time of the same key. One sort of both sides together, no
    pairs: rows are put in one order, hot keys in pieces, and the next right time carried back."""
    a = left.select(key, F.struct(*left.columns).alias("_row"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"))
    b = right.select(key, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"))
    nxt = F.when(F.col("_side") == 1, F.col("_t"))
    return within.carry_back(a.unionByName(b), [key], "_t", nxt, "match", ["_side"]).where("_side = 0").select("_row.*", "match")


def range_join(events: DataFrame, samples: DataFrame, key: str, start: str, stop: str, time: str, bucket_s: int) -> DataFrame:
    """Samples with start <= time < stop of each event of the same key: both are cut to time buckets and joined on key and
    bucket, so no event meets samples far from it."""
    sec = lambda c: F.unix_timestamp(c.cast("timestamp"))
    a = events.withColumn("_b", F.explode(F.sequence(F.floor(sec(F.col(start)) / bucket_s), F.floor(sec(F.col(stop)) / bucket_s))))
    b = samples.withColumn("_b", F.floor(sec(F.col(time)) / bucket_s))
    joined = a.hint("merge").join(b, [key, "_b"])
    return joined.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(stop))).drop("_b")


def part_windows(df: DataFrame, trial: str, order: str, low: float, high: float, size: int, stride: int) -> DataFrame:
    """Rows of trial_part() in each window that holds them: window (from 0) of size rows every stride ones from the part's begin, and i, their place in it.
    A part's end that fills no window is left out."""
    told = within.number(df, [trial], order, "t")
    sizes = saved(df.groupBy(trial).agg(F.count("*").alias("_n")), "sizes")
    told = told.join(small(sizes), trial).withColumn("_a", F.floor(F.col("_n") * low)).withColumn("_len", F.floor(F.col("_n") * high) - F.col("_a"))
    u = F.col("t") - F.col("_a")
    last = F.floor((F.col("_len") - size) / stride)
    first = F.greatest(F.ceil((u - size + 1) / stride), F.lit(0))
    to = F.least(F.floor(u / stride), last)
    ok = (u >= 0) & (u < F.col("_len")) & (F.col("_len") >= size) & (first <= to)
    rows = told.where(ok).withColumn("window", F.explode(F.sequence(first, to)))
    return rows.withColumn("i", u - F.col("window") * stride).drop("_n", "_a", "_len")


def trial_part(df: DataFrame, trial: str, order: str, low: float, high: float) -> DataFrame:
    """Rows of each trial from share low to share high of its length, with t from 0."""
    w = Window.partitionBy(trial)
    told = df.withColumn("t", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return told.where((F.col("t") >= F.floor(F.col("_n") * low)) & (F.col("t") < F.floor(F.col("_n") * high))).drop("_n")
