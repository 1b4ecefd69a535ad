"""Files of any size read by many tasks: a file's own directory says which ranges it has, and every range is read by itself.

Spark lists the files (batch or stream), without their contents. plan(file) runs in the tasks, looks at a file's header or directory only and
gives its parts; the parts are spread over tasks, and read(file, part) seeks and gives its rows in groups of bounded size. Neither
the driver nor a task ever holds a file. A file or part that fails is a row with error set and nulls elsewhere, not the end of the job.
"""

from __future__ import annotations

import io
import json
import math
import struct
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes a part is meant for, values of a row's piece and of a group of rows, and most tasks that parts are spread over.
PART_BYTES, PIECE, GROUP, TASKS = 64 << 20, 65_536, 1 << 20, 100_000
FILES = "path string, modificationTime timestamp, length long, content binary"
Plan = Callable[[pa.NativeFile, str, int], Iterator[dict]]
Read = Callable[[pa.NativeFile, str, dict], Iterator[list[tuple]]]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    system, root = fs.FileSystem.from_uri(f"{at.scheme}://{at.netloc}/")
    return system, root.rstrip("/") + path.split(at.netloc, 1)[1] if at.netloc else at.path


def open_file(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    system, at = located(path)
    return system.open_input_file(at)


def files(spark: SparkSession, root: str, pattern: str, streaming: bool = False, per_batch: int = 1000) -> DataFrame:
    """(path, length) of the files below root whose names fit the pattern; a stream gives each file once, as it arrives.
    Files without any bytes are not listed."""
    reader = spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_batch) if streaming else spark.read
    return reader.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")


def by_ranges(files: DataFrame, plan: Plan, read: Read, kinds: str, tasks: int | None = None) -> DataFrame:
    """The rows of kinds that read gives of each part of each of files(path, length), with path and error. tasks: how many the parts are
    spread over; by default one for each PART_BYTES of the files, of a stream four for each core."""
    spark = files.sparkSession
    if tasks is None:
        told = 0 if files.isStreaming else (files.agg(F.sum("length")).first()[0] or 0)
        tasks = 4 * spark.sparkContext.defaultParallelism if files.isStreaming else min(TASKS, max(1, math.ceil(told / PART_BYTES)))
    schema = StructType(_parse_datatype_string(f"path string, {kinds}, error string").fields)
    arrow, parts_schema = to_arrow_schema(schema), pa.schema([("path", pa.string()), ("part", pa.string()), ("error", pa.string())])

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    with open_file(path) as f:
                        rows = [(path, json.dumps(part), None) for part in plan(f, path, length)]
                except Exception as e:  # a bad file is a row, not the end of the job
                    rows = [(path, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), parts_schema)], schema=parts_schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [None] * (len(arrow) - 2)
        for batch in batches:
            for path, part, error in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if error is None:
                        with open_file(path) as f:
                            for group in read(f, path, json.loads(part)):
                                columns = [[path] * len(group), *zip(*group), [None] * len(group)]
                                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, arrow)], schema=arrow)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                if error is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip([path, *empty, error], arrow)], schema=arrow)

    parts = files.select("path", "length").mapInArrow(planned, "path string, part string, error string")
    return parts.repartition(tasks).mapInArrow(rows_of, schema)  # a number given is kept: parts are tiny rows of much work


class _Layout:
    """How an array lies in its file: rows of the last dimension, in order (or, in column order, all rows of a column at a time), cut to
    units that are read one after the other."""

    def __init__(self, shape: list[int], columns_first: bool, piece: int):
        self.shape, self.piece = shape, piece
        self.width = shape[-1] if shape else 1
        self.rows = math.prod(shape[:-1])
        self.turned = columns_first and len(shape) > 1
        self.per_row = math.ceil(self.width / piece)
        self.cuts = min(piece, math.ceil(piece * self.rows / GROUP)) if self.turned else 1
        self.units = (self.per_row * self.cuts if self.turned else self.rows * self.per_row) if self.rows * self.width else 0

    def span(self, unit: int) -> tuple[int, int, int]:
        """(row, start, stop) of a unit; row is 0 where units hold all rows."""
        if not self.turned:
            row, k = divmod(unit, self.per_row)
            return row, k * self.piece, min((k + 1) * self.piece, self.width)
        k, j = divmod(unit, self.cuts)
        step = math.ceil(self.piece / self.cuts)
        start = k * self.piece + min(j * step, self.piece)
        return 0, min(start, self.width), min(k * self.piece + min((j + 1) * step, self.piece), self.width)

    def first(self, unit: int) -> int:
        """How many values lie before a unit."""
        row, start, _ = self.span(unit)
        return start * self.rows if self.turned else row * self.width + start

    def rows_of(self, unit: int, take: Callable[[int], np.ndarray]) -> list[tuple]:
        row, start, stop = self.span(unit)
        if not self.turned:
            return [(row, start, take(stop - start))]
        if stop == start:
            return []
        block = take((stop - start) * self.rows).reshape([stop - start, *reversed(self.shape[:-1])])
        block = block.transpose(range(block.ndim - 1, -1, -1)).reshape(self.rows, stop - start)
        return [(r, start, v) for r, v in enumerate(block)]


def _header(f) -> tuple[np.dtype, list[int], bool]:
    version = np.lib.format.read_magic(f)
    shape, columns_first, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.kind not in "biuf":
        raise ValueError(f"values are no numbers: {kind}")
    return kind, list(shape), columns_first


def plan_arrays(piece: int = PIECE, part_bytes: int = PART_BYTES) -> Plan:
    """Parts of the arrays of .npz and .npy files. Members that are stored as they are become ranges of about part_bytes; a compressed
    one can only be read from its start, and is one part."""

    def parts(name: str, kind: np.dtype, shape: list[int], turned: bool, at: int | None, length: int) -> Iterator[dict]:
        lay = _Layout(shape, turned, piece)
        told = {"member": name, "dtype": kind.str, "shape": shape, "turned": turned}
        if at is None:
            yield {**told, "at": None, "units": [0, lay.units]}
            return
        if at + math.prod(shape) * kind.itemsize > length:
            raise ValueError(f"{name}: ends before its last value")
        each = max(1, round(part_bytes / max(1, math.prod(shape) * kind.itemsize / max(1, lay.units))))
        for u in range(0, lay.units, each):
            yield {**told, "at": at, "units": [u, min(u + each, lay.units)]}

    def plan(f: pa.NativeFile, path: str, length: int) -> Iterator[dict]:
        if path.endswith(".npy"):
            kind, shape, turned = _header(f)
            yield from parts("", kind, shape, turned, f.tell(), length)
            return
        with zipfile.ZipFile(f) as z:
            for m in z.infolist():
                if not m.filename.endswith(".npy"):
                    continue
                name, at = m.filename.removesuffix(".npy"), None
                if m.compress_type == zipfile.ZIP_STORED:
                    f.seek(m.header_offset)
                    name_length, more = struct.unpack("<26xHH", f.read(30))
                    f.seek(m.header_offset + 30 + name_length + more)
                    kind, shape, turned = _header(f)
                    at = f.tell()
                else:
                    with z.open(m) as inner:
                        kind, shape, turned = _header(inner)
                yield from parts(name, kind, shape, turned, at, length)

    return plan


def read_arrays(piece: int = PIECE) -> Read:
    """Rows (member, shape, row, start, values) of a part of plan_arrays."""

    def read(f: pa.NativeFile, path: str, part: dict) -> Iterator[list[tuple]]:
        lay, kind = _Layout(part["shape"], part["turned"], piece), np.dtype(part["dtype"])
        first, last = part["units"]
        if part["at"] is None:
            source = zipfile.ZipFile(f).open(part["member"] + ".npy")
            _header(source)
        else:
            source = f
            f.seek(part["at"] + (lay.first(first) * kind.itemsize if first < last else 0))

        def take(n: int) -> np.ndarray:
            got = source.read(n * kind.itemsize)
            if len(got) < n * kind.itemsize:
                raise ValueError(f"{part['member']}: ends before its last value")
            return np.frombuffer(got, kind).astype(np.float64)

        group, held = [], 0
        for u in range(first, last):
            for row, start, values in lay.rows_of(u, take):
                group.append((part["member"], part["shape"], row, start, values))
                held += len(values)
            if held >= GROUP or len(group) >= 10_000:
                yield group
                group, held = [], 0
        if group:
            yield group
        if part["at"] is None and source.read(1):  # its end is where the checksum is compared
            raise ValueError(f"{part['member']}: goes on after its last value")

    return read


def arrays(found: DataFrame, piece: int = PIECE, part_bytes: int = PART_BYTES, tasks: int | None = None) -> DataFrame:
    """(path, member, shape, row, start, values, error) of the numeric arrays in files(path, length) of .npz and .npy form.

    An array is seen as rows of its last dimension, numbered in C order whatever the order in the file (a single number: one row of one
    value); values are those of a row from start on, at most piece of them and never beyond a multiple of piece. Empty
    arrays have no rows. A file with a member of other than numbers, a bad directory or too few bytes is one row with error; a compressed
    member that breaks off half-way leaves the rows before the break and one with error. Stored members are read by range, so their
    checksums are not compared."""
    return by_ranges(found, plan_arrays(piece, part_bytes), read_arrays(piece), "member string, shape array<long>, row long, start long, values array<double>", tasks)


def write_npz(df: DataFrame, folder: str, columns: list[str], rows_per_file: int = 10_000) -> int:
    """Writes number and array columns of df as .npz files of at most rows_per_file rows, one member a column, and returns the rows
    written. A file is named by its task and place and appears whole, so a task that runs again writes its files again. Nulls and arrays of
    unlike lengths in a file are errors; an empty table has no files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = located(folder)
        task, place, held = TaskContext.get().partitionId(), 0, []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            nonlocal place
            members = {}
            for name in columns:
                c = rows[name].combine_chunks()
                if c.null_count:
                    raise ValueError(f"{name}: null in a column for numbers")
                members[name] = np.array(c.to_pylist())
                if members[name].dtype.kind not in "biuf":
                    raise ValueError(f"{name}: arrays of unlike lengths, or no numbers")
            name = f"{at.rstrip('/')}/part-{task:06d}-{place:06d}.npz"
            with system.open_output_stream(name + ".partial") as out:
                whole = io.BytesIO()
                np.savez(whole, **members)
                out.write(whole.getbuffer())
            system.move(name + ".partial", name)
            place += 1
            return pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64())], ["n"])

        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held)
            while whole.num_rows >= rows_per_file:
                yield flush(whole.slice(0, rows_per_file))
                whole = whole.slice(rows_per_file)
            held = whole.to_batches()
        if sum(b.num_rows for b in held):
            yield flush(pa.Table.from_batches(held))

    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return df.select(*columns).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def array_chunks(read: DataFrame, size: int, member: str = "signal") -> DataFrame:
    """Chunk rows (rec_id, chunk, n, signal) for operators.longsignal of the channels x time arrays of that name: rec_id is the
    path. Pieces that reach over a chunk's end are cut there, so size is free. A group is a chunk; rows with error are left out."""
    own = read.where(F.col("error").isNull() & (F.col("member") == member))
    last = F.col("start") + F.size("values") - 1
    cut = own.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))))
    begin = F.greatest(F.col("start"), F.col("chunk") * size)
    stop = F.least(last, (F.col("chunk") + 1) * size - 1)
    piece = F.struct("row", begin.alias("start"), F.slice("values", (begin - F.col("start") + 1).cast("int"), (stop - begin + 1).cast("int")).alias("values"))
    told = cut.groupBy(F.col("path").alias("rec_id"), "chunk").agg(F.max(F.element_at("shape", -1)).alias("n"), F.array_sort(F.collect_list(piece)).alias("p"))
    channels = F.array_distinct(F.transform("p", lambda p: p["row"]))
    signal = F.transform(channels, lambda c: F.flatten(F.transform(F.filter("p", lambda p: p["row"] == c), lambda p: p["values"])))
    return told.select("rec_id", "chunk", "n", signal.alias("signal"))


def recordings(found: DataFrame, describe: Callable[[pa.NativeFile, str], Iterator[dict]], read: Callable[[pa.NativeFile, dict, int, int], np.ndarray], size: int, chunks_per_part: int = 16, tasks: int | None = None) -> DataFrame:
    """Chunk rows (path, rec_id, ch_names, fs, n, chunk, signal, error) for operators.longsignal of files(path, length) of any format and
    size. describe(file, path) gives a dict with rec_id, ch_names, fs and n (samples) and whatever else read needs (as JSON), for each recording;
    read(file, described, start, stop) gives its samples from start up to stop, channels x time."""

    def plan(f: pa.NativeFile, path: str, length: int) -> Iterator[dict]:
        for d in describe(f, path):
            for k in range(0, math.ceil(d["n"] / size), chunks_per_part):
                yield {"d": d, "chunks": [k, min(k + chunks_per_part, math.ceil(d["n"] / size))]}

    def rows(f: pa.NativeFile, path: str, part: dict) -> Iterator[list[tuple]]:
        d = part["d"]
        for k in range(*part["chunks"]):
            stop = min((k + 1) * size, d["n"])
            x = np.asarray(read(f, d, k * size, stop), np.float64)
            if x.shape != (len(d["ch_names"]), stop - k * size):
                raise ValueError(f"{d['rec_id']}: samples {k * size} to {stop} have shape {x.shape}")
            yield [(d["rec_id"], d["ch_names"], float(d["fs"]), d["n"], k, x.tolist())]

    return by_ranges(found, plan, rows, "rec_id string, ch_names array<string>, fs double, n long, chunk long, signal array<array<double>>", tasks)
