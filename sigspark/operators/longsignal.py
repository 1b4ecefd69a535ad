"""Filters, resampling and epochs of recordings of any length, which are tables of chunks.

A chunk row is (rec_id, chunk, n, signal, ...): signal holds the samples from chunk * size on of all channels, size of them but for the
recording's last chunk, and n is the recording's number of samples. A filter's reach is finite, so a chunk needs no more than the
samples within that reach of it: neighbours send it slices (overlap-save), and every chunk is a group of its own whatever recording it
is of. Beyond a recording's ends its signal goes on as its odd reflection, and as zeros where that is used up. Results do not
depend on the size of chunks."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dsp import SIGNAL


def chunked(df: DataFrame, size: int, signal: str = "signal") -> DataFrame:
    """Chunk rows of df(rec_id, signal, ...), whose signals are whole; other columns stay on each chunk. Null and empty signals have none."""
    n = F.size(F.get(signal, 0)).cast("long")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    cut = F.transform(starts, lambda k: F.transform(signal, lambda ch: F.slice(ch, k * size + 1, F.lit(size))))
    rest = [c for c in df.columns if c not in ("rec_id", signal)]
    return df.select("rec_id", *rest, n.alias("n"), F.posexplode(cut).alias("chunk", "signal")).withColumn("chunk", F.col("chunk").cast("long"))


def low_pass_taps(fs: float, edge: float, half: int) -> np.ndarray:
    """A sinc cut at half samples to either side by a Hamming window, with gain 1 at 0 Hz."""
    k = np.arange(-half, half + 1)
    h = 2 * edge / fs * np.sinc(2 * edge / fs * k) * (0.54 + 0.46 * np.cos(np.pi * k / max(half, 1)))
    return h / h.sum()


def band_taps(fs: float, low: float | None = None, high: float | None = None, width: float | None = None, stop: bool = False) -> np.ndarray:
    """Taps of a zero-phase band filter; stop: of what it takes away. width: Hz from pass to stop, by default a quarter of each edge, but at
    least 2 Hz and at most the edge or what is left to the Nyquist frequency."""
    if low is not None and high is not None and low >= high:
        raise ValueError("the low edge must be below the high edge")
    if width is None:
        widths = [] if low is None else [min(max(low / 4, 2.0), low)]
        widths += [] if high is None else [min(max(high / 4, 2.0), fs / 2 - high)]
        width = min(widths, default=fs)
    if width <= 0:
        raise ValueError("edges must lie between 0 and the Nyquist frequency")
    half = ceil(3.3 / width * fs / 2)
    one = np.zeros(2 * half + 1)
    one[half] = 1
    taps = (one if high is None else low_pass_taps(fs, high, half)) - (0 if low is None else low_pass_taps(fs, low, half))
    return one - taps if stop else taps


def notch_taps(fs: float, lines: tuple[float, ...] = (50.0, 60.0), width: float = 1.0) -> np.ndarray:
    """Taps that take away the line frequencies below the Nyquist frequency, each line / 200 Hz wide and width Hz to either side."""
    out = np.ones(1)
    for line in lines:
        if line + line / 400 + width / 2 < fs / 2:
            out = np.convolve(out, band_taps(fs, line - line / 400 - width / 2, line + line / 400 + width / 2, width, stop=True))
    return out


def reflected(x: np.ndarray, left: int, right: int) -> np.ndarray:
    """x (channels x time) with left and right values more: 2 * end - mirrored value, and zeros beyond those."""
    a, z = min(left, x.shape[1] - 1), min(right, x.shape[1] - 1)
    head = 2 * x[:, :1] - x[:, a:0:-1]
    tail = 2 * x[:, -1:] - x[:, -2 : -2 - z : -1] if z else x[:, :0]
    return np.pad(np.concatenate((head, x, tail), 1), ((0, 0), (left - a, right - z)))


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Sums of taps over x (channels x time) where they lie inside of it."""
    n = 1 << (x.shape[1] + len(taps) - 2).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, n, axis=1) * np.fft.rfft(taps, n), n, axis=1)
    return y[:, len(taps) - 1 : x.shape[1]]


def filter_array(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """A whole signal filtered, for short ones and tests."""
    half = len(taps) // 2
    return convolved(reflected(x, half, half), taps)


def resample_array(x: np.ndarray, up: int, down: int, first: int, outputs: range, reach: int) -> np.ndarray:
    """Values at places j * down / up, j in outputs, of the signal whose places from first on are x; reach: places used to either side."""
    cutoff = min(1.0, up / down)
    out = np.empty((len(x), len(outputs)))
    j = np.arange(outputs.start, outputs.stop)
    base, phase = j * down // up, j * down % up
    k = np.arange(-reach, reach + 1)
    windows = np.lib.stride_tricks.sliding_window_view(x, 2 * reach + 1, axis=1)
    for p in np.unique(phase).tolist():
        u = p / up - k
        h = cutoff * np.sinc(cutoff * u) * np.i0(10 * np.sqrt(np.clip(1 - (u / (reach + 1)) ** 2, 0, None))) / np.i0(10)
        mine = phase == p
        out[:, mine] = windows[:, base[mine] - reach - first] @ (h / h.sum())
    return out


def map_chunks(chunks: DataFrame, size: int, reach: int, f: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """Each chunk's signal replaced by f(x, begin, end): x holds the samples from begin - reach to end + reach, reflected beyond the
    recording's ends; begin and end: the chunk's own. Slices of neighbours travel, not whole chunks; other columns stay."""
    rest = [c for c in chunks.columns if c not in ("rec_id", "chunk", "n", "signal")]
    begin = F.col("chunk") * size
    stop = F.least(begin + size, F.col("n"))
    last = F.floor((F.col("n") - 1) / size)
    to = F.sequence(F.greatest(F.floor((begin - reach) / size), F.lit(0)), F.least(F.floor((stop - 1 + reach) / size), last))
    told = chunks.select("rec_id", "chunk", "n", F.col("signal").cast(SIGNAL).alias("signal"), F.struct(*rest, F.lit(True).alias("_own")).alias("_rest"), F.explode(to).alias("_to"))
    low, high = F.greatest(F.col("_to") * size - reach, begin), F.least((F.col("_to") + 1) * size + reach, stop)
    own = F.col("_to") == F.col("chunk")
    sent = told.select("rec_id", "_to", "n", F.when(own, F.col("_rest")).alias("_rest"), low.alias("_from"), F.transform("signal", lambda ch: F.slice(ch, (low - begin + 1).cast("int"), (high - low).cast("int"))).alias("signal"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_from")
        chunk, n = t.column("_to")[0].as_py(), t.column("n")[0].as_py()
        begin, end = chunk * size, min((chunk + 1) * size, n)
        parts = []
        for s in t.column("signal").combine_chunks():
            channels = s.values
            parts.append(channels.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(channels), -1))
        x = np.concatenate(parts, 1)
        low = max(0, begin - reach)
        x = reflected(x, low - (begin - reach), end + reach - min(n, end + reach))
        if x.shape[1] != end - begin + 2 * reach:
            raise ValueError(f"recording {t.column('rec_id')[0].as_py()} lacks chunks beside chunk {chunk}")
        y = f(x, begin, end)
        mine = t.filter(t.column("_rest").is_valid())
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(np.ascontiguousarray(y).ravel()))
        signal = pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), values)
        return pa.table({"rec_id": mine.column("rec_id"), "chunk": mine.column("_to"), "n": mine.column("n"), "_rest": mine.column("_rest"), "signal": signal})

    sent = sent.withColumns({"_to": F.col("_to").cast("long"), "n": F.col("n").cast("long"), "_from": F.col("_from").cast("long")})
    schema = sent.select("rec_id", F.col("_to").alias("chunk"), "n", "_rest", "signal").schema
    out = sent.groupBy("rec_id", "_to").applyInArrow(run, schema)
    return out.select("rec_id", "chunk", "n", "signal", *(F.col(f"_rest.{c}").alias(c) for c in rest))


def fir_filter(chunks: DataFrame, size: int, taps: np.ndarray) -> DataFrame:
    """Every channel filtered by zero-phase taps (an odd number of them)."""
    if len(taps) % 2 == 0:
        raise ValueError("taps must be odd in number")
    return map_chunks(chunks, size, len(taps) // 2, lambda x, begin, end: convolved(x, taps))


def resample(chunks: DataFrame, size: int, up: int, down: int, zeros: int = 16) -> DataFrame:
    """Chunks at up / down times the rate: of size * up / down samples, which must be whole. Values are sums over zeros zero crossings of a
    sinc to either side, cut off at the lower Nyquist frequency by a Kaiser window."""
    if size * up % down:
        raise ValueError("size * up must be a multiple of down")
    made = size * up // down
    reach = ceil(zeros * max(1.0, down / up))
    total = lambda n: -(-n * up // down)

    def f(x: np.ndarray, begin: int, end: int) -> np.ndarray:
        first = begin // size * made
        return resample_array(x, up, down, begin - reach, range(first, first + total(end - begin)), reach)

    out = map_chunks(chunks, size, reach, f)
    return out.withColumn("n", F.ceil(F.col("n") * up / down).cast("long"))


def epochs(chunks: DataFrame, size: int, length: int) -> DataFrame:
    """(rec_id, epoch, eeg, ...): epochs of length samples; size must be a multiple of it. What is left at a recording's end is no epoch."""
    if size % length:
        raise ValueError("chunks must be whole epochs")
    n = F.floor(F.size(F.get("signal", 0)) / length).cast("int")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform("signal", lambda ch: F.slice(ch, i * length + 1, F.lit(length)))))
    rest = [c for c in chunks.columns if c not in ("rec_id", "chunk", "n", "signal")]
    return chunks.select("rec_id", *rest, "chunk", F.posexplode(cut).alias("_i", "eeg")).select("rec_id", (F.col("chunk") * (size // length) + F.col("_i")).alias("epoch"), "eeg", *rest)
