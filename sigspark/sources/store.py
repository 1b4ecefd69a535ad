"""The sample store and other tables on disk: append, read, drop, list, and side caches."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import after_underscore, stem
from ..operators import dsp
from ..operators.ordered import small
from ..schema import ANNOTATIONS, CONVERSATIONS, MCQ


def checked_samples(df: DataFrame, channels: int, length: int, spare: int = 1) -> DataFrame:
    """Samples of the right shape: wrong channel counts or lengths are errors, up to spare values more are cut off, and the
    caption is cut to 192 characters."""
    ok = (F.size("eeg") == channels) & F.forall("eeg", lambda c: (F.size(c) >= length) & (F.size(c) <= length + spare))
    eeg = F.when(ok, F.transform("eeg", lambda c: F.slice(c, 1, length))).otherwise(F.raise_error(F.lit("sample of a wrong shape")))
    return df.withColumn("eeg", eeg).withColumn("caption", F.left(F.coalesce("caption", F.lit("")), F.lit(192)))


def _holds(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder with anything but hidden files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(at) and any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(at))


def _totals(spark: SparkSession, path: str) -> int | None:
    at = f"{path}/_totals"
    return spark.read.schema("rows long, what string").json(at).agg(F.sum("rows")).first()[0] if _holds(spark, at) else None


def _note(spark: SparkSession, path: str, rows: int, what: str) -> None:
    spark.createDataFrame([(rows, what)], "rows long, what string").coalesce(1).write.mode("append").json(f"{path}/_totals")


def _counted(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count() if _holds(spark, path) else 0


def stored_rows(spark: SparkSession, path: str, recount: bool = False) -> int:
    """Rows of a store by its log of totals, which every append and drop writes a line to; the data are not read. A store without a log,
    or recount, is counted once and noted: so after a driver was lost between an append and its line."""
    known = _totals(spark, path)
    if known is None or recount:
        found = _counted(spark, path)
        if found != (known or 0):
            _note(spark, path, found - (known or 0), "counted")
        return found
    return known


def _append(df: DataFrame, path: str, by: list[str]) -> int:
    """Rows are counted in the tasks that write them."""
    before = stored_rows(df.sparkSession, path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*by).parquet(path)
    _note(df.sparkSession, path, seen.get["n"], "appended")
    return before + seen.get["n"]


def append_samples(df: DataFrame, path: str, channels: int, length: int) -> int:
    """Appends to the store, partitioned by dataset and split; Spark's committer makes each append whole or absent. Returns the rows
    that it then holds."""
    return _append(checked_samples(df, channels, length), path, ["dataset", "split"])


def append_epochs(df: DataFrame, path: str, channels: int = 32, length: int = 513) -> int:
    """Appends epochs of exactly channels x length to the older store, partitioned by dataset, in half precision. Returns the
    rows that it then holds."""
    half = dsp.cast_half(checked_samples(df.withColumn("caption", F.lit("")), channels, length, 0).drop("caption"), "eeg")
    return _append(half, path, ["dataset"])


def read_samples(spark: SparkSession, path: str, mode: str, datasets: list[str] | str = "all", exclude: list[str] = (), limit: int | None = None) -> DataFrame:
    """Partitions of a split, pruned at the scan. limit: the first rows of train, seeded rows of other splits."""
    df = spark.read.parquet(path).where(F.col("split") == mode)
    if datasets != "all":
        df = df.where(F.col("dataset").isin([datasets] if isinstance(datasets, str) else list(datasets)))
    if exclude:
        df = df.where(~F.col("dataset").isin(list(exclude)))
    if limit is None:
        return df
    from ..operators.sampling import limit_per_group

    return limit_per_group(df, ["dataset"], limit, "row_idx", None if mode == "train" else 42)


def drop_partition(spark: SparkSession, path: str, dataset: str, split: str | None = None) -> None:
    """Deletes a dataset (or one split of it) from the store; an error if it isn't there."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/dataset={dataset}" + (f"/split={split}" if split else ""))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise ValueError(f"no such partition: {target}")
    if _totals(spark, path) is not None:  # counted from the footers of the partition alone
        _note(spark, path, -_counted(spark, target.toString()), "dropped")
    fs.delete(target, True)


def get_row(df: DataFrame, dataset: str, row_idx: int) -> DataFrame:
    """One row of the store; reading it is an error if it isn't there."""
    hit = df.where((F.col("dataset") == dataset) & (F.col("row_idx") == row_idx))
    counted = hit.agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    return counted.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.concat(F.lit("rows found: "), F.col("n").cast("string")))).alias("row")).select("row.*")


def append_log(df: DataFrame, log: DataFrame | None, order: str, ties: list[str] = ()) -> DataFrame:
    """df with idx going on from the log's last one by order (a number or time), ready to be appended; no task sees all rows."""
    from ..operators.sampling import numbered

    last = log.agg(F.max("idx")).first()[0] if log is not None else None
    return numbered(df, F.col(order), "idx", ties).withColumn("idx", F.col("idx") + F.lit(0 if last is None else last + 1))


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, stem, length) of files below root whose name fits the pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", stem("path").alias("stem"), "length")


def read_npz(spark: SparkSession, root: str, signal: str = "signal", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(samples, bad) of all .npz files: path, signal and label; path and error of files that can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(root).select("path", "content")
    schema = pa.schema([("path", pa.string()), ("signal", pa.list_(pa.list_(pa.float64()))), ("label", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = [path, None, None, None]
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        row[1], row[2] = np.asarray(z[signal], np.float64).tolist(), int(np.asarray(z[label]).reshape(-1)[0])
                except Exception as e:  # a bad file is a row of bad, not the end of the job
                    row[3] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    read = files.mapInArrow(run, "path string, signal array<array<double>>, label int, error string")
    return read.where("error is null").drop("error"), read.where("error is not null").select("path", "error")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all annotation files with rec_id, the file's stem."""
    return spark.read.schema(ANNOTATIONS).csv(path).withColumn("rec_id", stem(F.input_file_name()))


def join_annotations(recordings: DataFrame, annotations: DataFrame) -> DataFrame:
    return recordings.join(annotations.hint("merge"), "rec_id")


def image_catalogue(files: DataFrame, classes: list[int] | None = None, pictures: list[int] | None = None) -> DataFrame:
    """(class_idx, class_name, description, img_idx, path) of files(path) in folders by class, both sorted by name."""
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("class_name"))
    order = named.select("class_name").distinct().withColumn("class_idx", F.row_number().over(Window.orderBy("class_name")) - 1)
    out = named.join(small(order), "class_name").withColumn("img_idx", F.row_number().over(Window.partitionBy("class_name").orderBy("path")) - 1)
    if classes is not None:
        out = out.where(F.col("class_idx").isin(classes))
    if pictures is not None:
        out = out.where(F.col("img_idx").isin(pictures))
    return out.select("class_idx", "class_name", after_underscore("class_name").alias("description"), "img_idx", "path")


def class_mapping(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, name) of "key v1, v2, ..." lines: the variant of the fewest words, the first on ties, lower-cased."""
    line = F.trim(F.col(column))
    variants = F.transform(F.split(F.substr(line, F.instr(line, " ") + 1), ","), lambda v, i: F.struct(F.size(F.filter(F.split(F.trim(v), r"\s+"), lambda w: w != "")).alias("n"), i.alias("i"), F.trim(v).alias("v")))
    return lines.where(F.instr(line, " ") > 0).select(F.substring_index(line, " ", 1).alias("key"), F.lower(F.array_min(variants)["v"]).alias("name"))


def templates(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.trim(column).alias("template")).where("template <> ''")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONVERSATIONS).option("multiLine", True).json(path)


def explode_conversations(df: DataFrame) -> DataFrame:
    return df.select("id", "image", "eeg", F.posexplode("conversations").alias("turn", "c")).select("id", "image", "eeg", "turn", F.col("c.from").alias("role"), F.col("c.value").alias("text"))


def write_mcq(df: DataFrame, path: str) -> None:
    """Questions as CSV; spaces at the ends of values stay, an empty value is read back as null."""
    df.select(*(F.col(n).cast(kind) for n, kind in (c.split(" ") for c in MCQ.split(", ")))).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_mcq(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MCQ).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def check_prototypes(df: DataFrame, width: int, total: int | None = None) -> DataFrame:
    """One row of checks of prototypes(type, dataset, label, proto_idx, feature)."""
    n = F.count("*")
    return df.agg(n.alias("n"), (n > 0).alias("not_empty"), F.bool_and(F.col("type").isNotNull() & F.col("label").isNotNull()).alias("named"), F.bool_and(F.size("feature") == width).alias("width_ok"), (F.lit(True) if total is None else n == total).alias("total_ok"))


def write_prototypes(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("type").parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; made and written if it is absent, or force. Any other trouble in reading it is an error."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def missing_keys(df: DataFrame, key: str, cache: DataFrame) -> DataFrame:
    """Distinct keys of df that the cache lacks."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def embed_with_cache(df: DataFrame, key: str, cache: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """df with feature: from cache(key, feature), or by embed on each distinct missing key once."""
    fresh = missing_keys(df, key, cache).withColumn("feature", embed(F.col(key)))
    return df.join(cache.select(key, "feature").unionByName(fresh).hint("merge"), key, "left")


