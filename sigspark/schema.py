"""Schemas of the library's tables and its registry of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# DDL of the tables.
SAMPLES = "dataset string, split string, row_idx long, eeg array<array<float>>, feature array<float>, caption string, label int, image_path string"
RECORDINGS = "rec_id string, ch_names array<string>, fs double, signal array<array<float>>"
ANNOTATIONS = "channel int, start_s double, end_s double, code int"
MCQ = "id string, eegpath string, question string, correct_answer string, option_number int"
CONVERSATIONS = "id string, image string, eeg string, conversations array<struct<from:string,value:string>>"
INGEST_LOG = "time timestamp, remain long, total long, drop long, drop_rate double, file string, raw_duration double, samples_number long"
INTERACTIONS = "tstamp double, type string, model string, state string, ip string, start double, finish double, images array<string>"

# Sampling rates and labels of the registered datasets (captions of labels are made by functions.text).
SAMPLING_RATES = {
    "BCICIV2a": 1750, "HMC": 256, "FACE": 250, "ImageNetEEG": 1000, "P2018": 100, "SleepEDFx": 100, "SEED-IV": 200, "TUAB": 512, "TUEV": 512, "SEED": 200, "Siena": 512, "CHB-MIT": 512,
}
LABELS = {
    "BCICIV2a": {0: "left_hand", 1: "right_hand", 2: "feet", 3: "tongue"},
    "SEED": {0: "negative", 1: "neutral", 2: "positive"},
    "TUAB": {0: "abnormal", 1: "normal"},
    "TUEV": {
        0: "spike and sharp wave (SPSW)", 1: "generalized periodic epileptiform discharges (GPED)", 2: "periodic lateralized epileptiform discharges (PLED)",
        3: "eye movement (EYEM)", 4: "artifact (ARTF)", 5: "background (BCKG)",
    },
}


def dim_dataset(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.create_map(*(F.lit(x) for kv in sorted(SAMPLING_RATES.items()) for x in kv)))
    return spark.range(1).select(rows.alias("dataset", "fs"))


def dim_label(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(d).alias("dataset"), F.lit(i).alias("label_id"), F.lit(n).alias("label_name")) for d, m in sorted(LABELS.items()) for i, n in m.items()))
    return spark.range(1).select(F.inline(rows))
