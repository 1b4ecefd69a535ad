"""Streams: micro-batch ingest, sliding and tumbling segments, interaction counts, liveness and running totals.

Each job has a batch twin among the operators and gives its rows under an availableNow trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.sampling import split_random
from ..schema import INTERACTIONS

TOTALS = "number long, rows long, bad_rows long"


def read_files(spark: SparkSession, folder: str, schema: StructType, form: str = "parquet", per_batch: int = 10, event_time: str | None = None) -> DataFrame:
    """A stream of a folder's files. event_time: a column without time zone is cast, since watermarks need one."""
    df = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else df


def read_interactions(spark: SparkSession, folder: str, streaming: bool = False, per_batch: int = 10) -> DataFrame:
    """Rows of the interaction log's JSON-lines files (schema.INTERACTIONS), with time, the moment of tstamp. Lines that aren't
    JSON give rows of nulls, and those are left out."""
    if streaming:
        raw = spark.readStream.schema(INTERACTIONS).option("maxFilesPerTrigger", per_batch).json(folder)
    else:
        raw = spark.read.schema(INTERACTIONS).json(folder)
    return raw.where("tstamp is not null").withColumn("time", F.timestamp_seconds("tstamp"))


def ingest(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]], bad_path: str | None = None, rows_per_file: int = 10_000) -> StreamingQuery:
    """Appends each micro-batch's good rows to the store and its bad ones to bad_path. A batch that runs again writes
    its own folder again, so rows are neither lost nor doubled. The rows written are counted as they are written: see ingested()."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = prepare(batch)
        kept, left = Observation(), Observation()
        good.observe(kept, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/batch={number}")
        if bad is not None and bad_path:
            bad.observe(left, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        totals = [(number, kept.get["n"], left.get["n"] if bad is not None and bad_path else None)]
        batch.sparkSession.createDataFrame(totals, TOTALS).coalesce(1).write.mode("overwrite").json(f"{path}/_totals/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """(number, rows, bad_rows) of each micro-batch that ingest() wrote to path; no data is read."""
    return spark.read.schema(TOTALS).json(f"{path}/_totals/*")


def sliding_epochs(stream: DataFrame, time: str, keys: list[str], value: str, length: str = "2 seconds", hop: str | None = "1 second", late: str = "10 seconds") -> DataFrame:
    """Count and sum of value in windows of length every hop (tumbling for hop None), closed once the watermark passes."""
    w = F.window(time, length, hop) if hop else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("v")).select(*keys, F.col("w.start").alias("start"), "n", "v")


def interaction_counts(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows by keys and day, each (time, keys) once within the watermark."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([time, *keys])
    return once.groupBy(*keys, F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("day"), "n")


def spells(stream: DataFrame, key: str, time: str, gap_s: int, late: str = "10 seconds") -> DataFrame:
    """(key, first_seen, last_seen, n): stretches of a key without a pause of over gap_s, each once the watermark has passed its last time
    by gap_s. A key that is seen again has a stretch more."""
    w = F.session_window(time, f"{gap_s} seconds")
    told = stream.select(key, time).withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return told.select(key, F.col("w.start").alias("first_seen"), (F.col("w.end") - F.make_dt_interval(secs=F.lit(gap_s))).alias("last_seen"), "n")


def liveness(stream: DataFrame, key: str, time: str, expiry_s: int = 30, late: str = "10 seconds") -> DataFrame:
    """(key, last_seen, alive), in append mode: a row of alive true for every sighting, and one of alive false when the watermark has passed a
    key's last time by expiry_s. Sightings hold no state, spells are session windows; latest() gives each key's standing."""
    seen = stream.select(key, F.col(time).alias("last_seen"), F.lit(True).alias("alive"))
    return seen.unionByName(spells(stream, key, time, expiry_s, late).select(key, "last_seen", F.lit(False).alias("alive")))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """(key, last_seen, alive): each key's newest row of liveness(), which of one moment is the one of its end."""
    newest = F.max(F.struct("last_seen", (~F.col("alive")).alias("gone")))
    return rows.groupBy(key).agg(newest.alias("_s")).select(key, F.col("_s.last_seen").alias("last_seen"), (~F.col("_s.gone")).alias("alive"))


def split_totals(stream: DataFrame, key: str, seed: int) -> DataFrame:
    """Running counts by seeded split (output mode update or complete)."""
    return stream.groupBy(split_random(key, seed).alias("split")).agg(F.count("*").alias("n"))
