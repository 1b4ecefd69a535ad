"""Filters, resampling and spectra over array columns, as Arrow-batched numpy jobs.

A signal column holds array<array<double>> (channels x time). Batches are cut by rows, and a row's work depends on
nothing outside it, so partitions and lost executors change nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNAL = "array<array<double>>"


def map_signal(df: DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """column replaced by f(channels x time) of each row; null stays null. Ragged channels are handled one by one. Values go
    from Arrow's buffers to numpy and back; no value becomes a Python object."""
    plain = df.withColumn(column, F.col(column).cast(SIGNAL))
    at = plain.columns.index(column)

    def made(signals: pa.ListArray) -> pa.Array:
        outer = signals.offsets.to_numpy()
        channels = signals.values
        inner, values = channels.offsets.to_numpy(), channels.values.to_numpy(zero_copy_only=False)
        rows, sizes, flat = [0], [], []
        for a, b, good in zip(outer[:-1].tolist(), outer[1:].tolist(), signals.is_valid().to_pylist()):
            lens = np.diff(inner[a : b + 1]) if good else ()
            parts = ()
            if len(lens) and (lens == lens[0]).all():
                parts = f(values[inner[a] : inner[b]].reshape(b - a, -1))
            elif len(lens):
                parts = [f(values[i:j][None])[0] for i, j in zip(inner[a:b].tolist(), inner[a + 1 : b + 1].tolist())]
            rows.append(rows[-1] + len(parts))
            sizes += [len(p) for p in parts]
            flat += list(parts)
        out = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0), pa.float64()))
        offsets = pa.array(rows, pa.int32(), mask=np.append(~signals.is_valid().to_numpy(zero_copy_only=False), False)) if signals.null_count else pa.array(rows, pa.int32())
        return pa.ListArray.from_arrays(offsets, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                new = made(part.column(at))
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

    return plain.mapInArrow(run, plain.schema)


def _gain(x: np.ndarray, gain: np.ndarray) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(x, axis=1) * gain, x.shape[1], axis=1)


def band_gain(n: int, fs: float, low: float | None, high: float | None, width: float = 1.0) -> np.ndarray:
    """Real gain (no phase) of each rfft bin: raised-cosine edges width Hz wide around the band [low, high]."""
    f = np.fft.rfftfreq(n, 1 / fs)
    edge = lambda d: 0.5 - 0.5 * np.cos(np.pi * np.clip(d / width + 0.5, 0, 1))
    g = np.ones(len(f))
    if low is not None:
        g *= edge(f - low)
    if high is not None:
        g *= edge(high - f)
    return g


def bandpass(df: DataFrame, column: str, fs: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Zero-phase band filter in the frequency domain; either edge may be left out, low must be below high."""
    if low is not None and high is not None and low >= high:
        raise ValueError("the low edge must be below the high edge")
    return map_signal(df, column, lambda x: _gain(x, band_gain(x.shape[1], fs, low, high)))


def notch(df: DataFrame, column: str, fs: float, lines: tuple[float, ...] = (50.0, 60.0), q: float = 30.0) -> DataFrame:
    """Zero-phase notches at line frequencies below the Nyquist frequency, each line / q Hz wide or a bin if that is wider."""

    def f(x: np.ndarray) -> np.ndarray:
        freq = np.fft.rfftfreq(x.shape[1], 1 / fs)
        g = np.ones(len(freq))
        for line in lines:
            if line < fs / 2:
                half = max(line / q / 2, fs / x.shape[1] / 2)
                g[np.abs(freq - line) <= half] = 0
        return _gain(x, g)

    return map_signal(df, column, f)


def fft_resample_array(x: np.ndarray, m: int) -> np.ndarray:
    n = x.shape[1]
    if n == m:
        return x
    s = np.fft.rfft(x, axis=1)
    k = min(n, m)
    out = np.zeros((len(x), m // 2 + 1), complex)
    out[:, : k // 2 + 1] = s[:, : k // 2 + 1]
    if k % 2 == 0:  # the bin at the lower Nyquist frequency stands for both its signs
        out[:, k // 2] *= 2.0 if m < n else 0.5
    return np.fft.irfft(out, m, axis=1) * (m / n)


def fft_resample(df: DataFrame, column: str, m: int) -> DataFrame:
    """Every channel to m samples in the Fourier domain."""
    return map_signal(df, column, lambda x: fft_resample_array(x, m))


def spectrum(df: DataFrame, column: str, kind: str = "amplitude", norm: str | None = None) -> DataFrame:
    """amplitude, phase or power in dB (10 log10(|.|^2 + 1e-10)) of rfft; norm: None, ortho or forward."""
    made = {"amplitude": np.abs, "phase": np.angle, "db": lambda s: 10 * np.log10(np.abs(s) ** 2 + 1e-10)}[kind]
    return map_signal(df, column, lambda x: made(np.fft.rfft(x, axis=1, norm=norm)))


def stft_array(x: np.ndarray, size: int, hop: int, centred: bool = True) -> np.ndarray:
    """Magnitudes (frames x bins, end to end) of each channel with a periodic Hann window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    if centred:
        x = np.pad(x, ((0, 0), (size // 2, size // 2)), mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
    return np.abs(np.fft.rfft(frames * window, axis=2)).reshape(len(x), -1)


def stft(df: DataFrame, column: str, size: int = 64, hop: int = 16, centred: bool = True) -> DataFrame:
    return map_signal(df, column, lambda x: stft_array(x, size, hop, centred))


def extrapolate_array(x: np.ndarray, k: int, ahead: int, skip: int = 1) -> np.ndarray:
    """Each channel continued by ahead samples as the sum of its k strongest cosines, without its first skip bins and,
    for an even length, the Nyquist bin."""
    n = x.shape[1]
    s = np.fft.rfft(x, axis=1)
    last = s.shape[1] - (1 if n % 2 == 0 else 0)
    amp = np.abs(s[:, skip:last])
    best = np.argsort(-amp, axis=1, kind="stable")[:, :k] + skip
    t = np.arange(n + ahead)
    out = np.zeros((len(x), n + ahead))
    for c in range(len(x)):
        for b in best[c]:
            out[c] += 2 * np.abs(s[c, b]) / n * np.cos(2 * np.pi * b * t / n + np.angle(s[c, b]))
    return out


def extrapolate(df: DataFrame, column: str, k: int, ahead: int) -> DataFrame:
    return map_signal(df, column, lambda x: extrapolate_array(x, k, ahead))


def correlation_lags(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k lags of the largest circular autocorrelation of each channel, averaged over channels, in column lags."""

    def lags(x: np.ndarray) -> np.ndarray:
        s = np.fft.rfft(x, axis=1)
        r = np.fft.irfft(s * np.conj(s), x.shape[1], axis=1).mean(0)
        best = np.argsort(-r, kind="stable")[:k]
        return np.stack([best, r[best]])

    return map_signal(df.withColumn("lags", F.col(column)), "lags", lags)


def cast_half(df: DataFrame, column: str) -> DataFrame:
    """Values rounded to half precision, kept as doubles."""
    return map_signal(df, column, lambda x: x.astype(np.float16).astype(np.float64))
