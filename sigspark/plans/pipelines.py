"""Whole jobs over recordings: harmonised samples, quality rows, splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import clean, dsp, longsignal, metrics, sampling, windows
from ..operators.ordered import small
from ..operators.sampling import split_random
from ..sources.shared import saved


@dataclass
class Harmonise:
    """How recordings become samples: expected rate, filter edges, channels to drop, target channels, length of a sample. Hooks:
    rename makes a new name of each channel name before anything else; filter takes the place of the band filter and notches;
    steps run after the channels are picked."""

    fs: float
    low: float | None = 0.5
    high: float | None = 100.0
    notch: bool = True
    drop: tuple[str, ...] = ()
    target: tuple[str, ...] = ()
    resample: int | None = None
    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    rename: Callable[[Column], Column] | None = None
    filter: Callable[[DataFrame], DataFrame] | None = None


def filter_pipeline(df: DataFrame, how: Harmonise) -> DataFrame:
    """df(ch_names, signal): length check, dropped channels, filters, target channels, own steps, resampling. A length that
    isn't a multiple of the rate is an error."""
    n = F.size(F.get("signal", 0))
    checked = F.when(n % F.lit(int(how.fs)) == 0, F.col("signal")).otherwise(F.raise_error(F.lit("length doesn't fit the sampling rate")))
    out = df.withColumn("signal", checked.cast(dsp.SIGNAL))
    if how.rename:
        out = out.withColumn("ch_names", F.transform("ch_names", how.rename))
    if how.drop:
        kept = F.filter("ch_names", lambda c: ~c.isin(list(how.drop)))
        out = out.withColumn("signal", clean.drop_channels("signal", "ch_names", list(how.drop))).withColumn("ch_names", kept)
    if how.filter:
        out = how.filter(out)
    elif how.low is not None or how.high is not None:
        out = dsp.bandpass(out, "signal", how.fs, how.low, how.high)
    if how.notch and not how.filter:
        out = dsp.notch(out, "signal", how.fs)
    if how.target:
        out = out.withColumn("signal", clean.select_channels("signal", "ch_names", list(how.target))).withColumn("ch_names", F.array(*(F.lit(t) for t in how.target)))
    for step in how.steps:
        out = step(out)
    return dsp.fft_resample(out, "signal", how.resample) if how.resample else out


def recording_pipeline(df: DataFrame, how: Harmonise, epoch_s: float = 1.0, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, log) of df(rec_id, ch_names, signal): filtered, cut to epochs, flat and (from 20 epochs on) too large ones
    dropped, channels z-scored. log has a row for each recording; at most one epoch left rejects it."""
    ready = filter_pipeline(df, how)
    size = int(epoch_s * how.fs)
    n = F.size(F.get("signal", 0))
    starts = F.sequence(F.lit(0), F.floor(n / size).cast("int") - 1)
    cut = F.when(n >= size, F.transform(starts, lambda i: F.transform("signal", lambda ch: F.slice(ch, i * size + 1, F.lit(size)))))
    # Both results read the epochs, and one joins them with the other: they are filtered and cut once and written.
    epochs = saved(ready.select("rec_id", F.posexplode(cut).alias("epoch", "eeg")), "epochs")
    return judged_epochs(epochs, threshold)


def judged_epochs(epochs: DataFrame, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, log) of written epochs(rec_id, epoch, eeg): see recording_pipeline. Counts a recording are joined to its epochs, which
    stay where they are, however many there are."""
    flat = F.exists("eeg", lambda ch: vec.std(ch) < 1e-8)
    ptp = F.array_max(F.transform("eeg", lambda ch: F.array_max(ch) - F.array_min(ch)))
    fits = F.lit(True) if threshold is None else ptp <= threshold
    told = epochs.groupBy("rec_id").agg(F.count("*").alias("_n"), F.count_if(~flat).alias("_all"), F.count_if(~flat & fits).alias("_fit"))
    many = F.col("_n") >= 20
    told = saved(told.select("rec_id", "_n", F.when(many, F.col("_fit")).otherwise(F.col("_all")).alias("_k")), "log")
    bad = F.col("_k") <= 1
    log = told.select("rec_id", F.when(bad, 0).otherwise(F.col("_k")).alias("remain"), F.when(bad, 0).otherwise(F.col("_n")).alias("total"), F.when(bad, 0).otherwise(F.col("_n") - F.col("_k")).alias("drop"), F.when(bad, 100.0).otherwise((F.col("_n") - F.col("_k")) * 100.0 / F.col("_n")).alias("drop_rate"))
    kept = ~flat & (~many | fits)
    samples = epochs.join(small(told.where(~bad).select("rec_id", "_n")), "rec_id").where(kept)
    return samples.select("rec_id", "epoch", F.transform("eeg", lambda ch: vec.zscore_pop(ch)).alias("eeg")), log


def long_recording_pipeline(chunks: DataFrame, size: int, how: Harmonise, epoch_s: float = 1.0, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """recording_pipeline for chunk rows (rec_id, chunk, n, ch_names, signal) of recordings of any length (see longsignal): size samples a
    chunk, a whole number of epochs before and after resampling. Filters are finite, Hamming-windowed ones; how.filter and how.steps get and
    give chunk rows."""
    fs, out = how.fs, chunks
    if how.rename:
        out = out.withColumn("ch_names", F.transform("ch_names", how.rename))
    if how.drop:
        kept = F.filter("ch_names", lambda c: ~c.isin(list(how.drop)))
        out = out.withColumn("signal", clean.drop_channels("signal", "ch_names", list(how.drop))).withColumn("ch_names", kept)
    if how.target:  # before the filters, which take channels one by one: the rest need not travel
        out = out.withColumn("signal", clean.select_channels("signal", "ch_names", list(how.target))).withColumn("ch_names", F.array(*(F.lit(t) for t in how.target)))
    if how.filter:
        out = how.filter(out)
    else:
        taps = longsignal.band_taps(fs, how.low, how.high) if how.low is not None or how.high is not None else np.ones(1)
        taps = np.convolve(taps, longsignal.notch_taps(fs)) if how.notch else taps
        out = longsignal.fir_filter(out, size, taps) if len(taps) > 1 else out
    for step in how.steps:
        out = step(out)
    if how.resample and how.resample != fs:
        ratio = Fraction(how.resample).limit_denominator(1 << 20) / Fraction(fs).limit_denominator(1 << 20)
        out = longsignal.resample(out, size, ratio.numerator, ratio.denominator)
        size, fs = size * ratio.numerator // ratio.denominator, how.resample
    return judged_epochs(saved(longsignal.epochs(out, size, round(epoch_s * fs)), "epochs"), threshold)


def event_pipeline(recordings: DataFrame, events: DataFrame, how: Harmonise, seed: int, pad_s: float = 2.0, pieces: int = 5, train: float = 0.9, label: Callable[[Column], Column] = lambda code: code - 1) -> DataFrame:
    """Labelled samples around one-second events: padded window, resampled, cut to pieces, harmonised, split. Events of
    another length than one second are left out (see rejected_events). label makes labels of the events' codes."""
    good = events.where(F.abs(F.col("end_s") - F.col("start_s") - 1.0) < 1e-6)
    around = windows.event_windows(recordings, good, how.fs, pad_s)
    size = how.resample or int(how.fs)
    whole = dsp.fft_resample(around.select("rec_id", "event_id", "ch_names", "code", F.col("window").alias("signal")), "signal", size * pieces)
    part = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.transform("signal", lambda ch: F.slice(ch, i * size + 1, F.lit(size))))
    cut = whole.select("rec_id", "event_id", "ch_names", label(F.col("code")).alias("label"), F.posexplode(part).alias("piece", "signal"))
    steps = Harmonise(fs=float(size), low=how.low, high=how.high, notch=how.notch, drop=how.drop, target=how.target)
    out = filter_pipeline(cut, steps)
    key = F.concat_ws(":", "rec_id", F.col("event_id").cast("string"), F.col("piece").cast("string"))
    return out.withColumn("sample_key", key).withColumn("split", split_random("sample_key", seed, train))


def rejected_events(events: DataFrame) -> DataFrame:
    """Events that event_pipeline leaves out."""
    return events.where(F.abs(F.col("end_s") - F.col("start_s") - 1.0) >= 1e-6)


def inference_samples(df: DataFrame, how: Harmonise, size: int) -> DataFrame:
    """filter_pipeline, then each channel's z-score, then its first size values."""
    out = filter_pipeline(df, how)
    return out.withColumn("signal", F.transform("signal", lambda ch: windows.cut_choice(vec.zscore_pop(ch), size)))


def build_store(parts: dict[str, Callable[[], DataFrame]], write: Callable[[str, DataFrame], None]) -> dict[str, str]:
    """Runs each dataset's job; a failing one is reported and the others go on. Returns ok or the error by name."""
    out = {}
    for name, make in parts.items():
        try:
            write(name, make())
            out[name] = "ok"
        except Exception as e:  # reported under its name, and the next dataset's job goes on
            out[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return out


@dataclass
class View:
    """A balanced view of stored samples for training: partitions, seeded limit a dataset, required columns, re-balancing by
    label (under, over or none), and normalisation by split."""

    mode: str = "train"
    datasets: list[str] | str = "all"
    exclude: tuple[str, ...] = ()
    limit: int | None = None
    required: tuple[str, ...] = ()
    strategy: str | None = None
    methods: dict[str, str] = field(default_factory=dict)
    seed: int = 42


def training_view(store: DataFrame, key: str, how: View, vector: str = "feature", label: str = "label") -> DataFrame:
    """store(dataset, split, key, label, vector, ...) as how says: rows of the split and datasets with all required columns, at
    most limit seeded rows a dataset, re-balanced by label, each with class_weight (total / (classes * class rows) before
    re-balancing) and its vector normalised by the method of its split (none where there is none)."""
    df = store.where(F.col("split") == how.mode)
    if how.datasets != "all":
        df = df.where(F.col("dataset").isin([how.datasets] if isinstance(how.datasets, str) else list(how.datasets)))
    if how.exclude:
        df = df.where(~F.col("dataset").isin(list(how.exclude)))
    for c in how.required:
        df = df.where(F.col(c).isNotNull())
    slim = df.select(key, "dataset", label)
    if how.limit is not None:
        slim = sampling.limit_per_group(slim, ["dataset"], how.limit, key, how.seed)
    slim = saved(slim.join(small(metrics.group_weights(slim, label).select(label, F.col("weight").alias("class_weight"))), label), "view")
    if how.strategy:
        slim = sampling.resample_groups(slim, label, key, how.strategy, how.seed)
    extra = [c for c in slim.columns if c not in (key, "dataset", label)]
    out = df.join(slim.select(key, *extra).hint("merge"), key)
    method = F.lit("none")
    for split, name in how.methods.items():
        method = F.when(F.col("split") == split, name).otherwise(method)
    return out.withColumn(vector, vec.normalize_named(vector, method)) if how.methods else out


def load_recordings(files: DataFrame, load: Callable[[str, bytes], Iterator[tuple[str, list[str], float, np.ndarray]]], most_bytes: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """(recordings, bad) of files(path, length, content), as the binaryFile source gives them: load makes (rec_id, ch_names,
    fs, channels x time) rows of a file, one file at a time in a task. A file that fails, or is longer than most_bytes, is a row
    (path, error) of bad. The loaded rows are written once, so no file is read again for the second result."""
    schema = pa.schema([("rec_id", pa.string()), ("ch_names", pa.list_(pa.string())), ("fs", pa.float64()), ("signal", pa.list_(pa.list_(pa.float64()))), ("path", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, length in zip(*batch.columns):
                rows = []
                try:
                    if content.as_py() is None:
                        raise ValueError(f"longer than {most_bytes} bytes: {length.as_py()}")
                    rows = [(i, list(names), float(fs), np.asarray(x, np.float64).tolist(), path.as_py(), None) for i, names, fs, x in load(path.as_py(), content.as_py())]
                except Exception as e:  # a bad file is a row of bad, not the end of the job
                    rows = [(None, None, None, None, path.as_py(), f"{type(e).__name__}: {e}")]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    content = F.when(F.col("length") <= most_bytes, F.col("content"))
    kinds = "rec_id string, ch_names array<string>, fs double, signal array<array<double>>, path string, error string"
    read = saved(files.select("path", content.alias("content"), "length").mapInArrow(run, kinds), "recordings")
    return read.where("error is null").drop("error", "path"), read.where("error is not null").select("path", "error")


def encode(df: DataFrame, key: str, column: str, make: Callable[[], Callable[[list], np.ndarray]], out: str = "feature", batch: int = 256) -> DataFrame:
    """df with out, the encoder's vector of column; null stays null. make() loads the encoder and is called once in a task, not
    once a row; each distinct key is encoded once (its first value by order) in batches, and its vector joined back."""
    once = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("_x"))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                model = model or make()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.asarray(model(part.column(1).to_pylist()), np.float64).tolist(), pa.list_(pa.float64()))], [key, out])

    made = once.select(key, "_x").mapInArrow(run, f"`{key}` {kind}, `{out}` array<double>")
    return df.join(made.hint("merge"), key, "left")


#: Metric families by name; each is a function of a table with label, predicted and, where needed, score.
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "accuracy": lambda df: metrics.accuracy(df, F.col("label") == F.col("predicted")).select("accuracy"),
    "balanced_accuracy": lambda df: metrics.macro_accuracy(df, "label", F.col("label") == F.col("predicted")).select(F.col("macro_accuracy").alias("balanced_accuracy")),
    "f1_weighted": lambda df: metrics.class_report(df, "label", "predicted").select("f1_weighted"),
    "cohen_kappa": lambda df: metrics.class_report(df, "label", "predicted").select(F.col("kappa").alias("cohen_kappa")),
    "roc_auc": lambda df: metrics.auroc(df, F.col("label"), F.col("score")).select(F.col("auroc").alias("roc_auc")),
    "pr_auc": lambda df: metrics.average_precision(df, F.col("label"), F.col("score")).select("pr_auc"),
}


def metric_report(df: DataFrame, wanted: dict[str, list[str]], dataset: str = "dataset") -> DataFrame:
    """(dataset, metric, value): the metrics that wanted lists for each dataset, by name; an unknown name is an error."""
    unknown = {m for names in wanted.values() for m in names} - METRICS.keys()
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    out = None
    for name, names in wanted.items():
        part = df.where(F.col(dataset) == name)
        for m in names:
            row = METRICS[m](part).select(F.lit(name).alias(dataset), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            out = row if out is None else out.unionByName(row)
    return out
