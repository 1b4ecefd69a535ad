"""Validation, quarantine, channel names and channel selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.text import capitalise
from . import within
from .ordered import bucketed, small

# The channels of the clinical montage, old names to new ones, and names that are no channels.
RENAMED = {"FP1": "Fp1", "FP2": "Fp2", "T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8", "FZ": "Fz", "CZ": "Cz", "PZ": "Pz"}
KEPT = ["F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "F7", "F8"]
BLOCKED = ["ROC", "LOC", "EMG", "IBI", "PG1", "PG2", "T1", "T2", "SP1", "SP2", "RLC", "LUC", "X1", "C3P", "C4P"]


def validate_samples(df: DataFrame, vector: str, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows: bad ones hold a null, NaN or infinite value, or aren't of the width."""
    ok = F.coalesce(vec.is_finite(vector), F.lit(False))
    if width is not None:
        ok = ok & (F.size(vector) == width)
    return df.where(ok), df.where(~ok)


def vector_issues(df: DataFrame, vector: str, key: str, threshold: float = 1e-8) -> DataFrame:
    """One row an issue that occurs: its name, the number of rows and the smallest row key."""
    flags = {"zero": vec.norm(vector) < threshold, "nan": F.exists(F.col(vector), lambda v: F.isnan(v)), "inf": F.exists(F.col(vector), lambda v: F.abs(v) == float("inf"))}
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))
    return df.select(key, F.explode(named).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def next_valid(df: DataFrame, order: str, valid: Column) -> DataFrame:
    """source: each row's own order value (a number) if valid, else the next valid one's, else (past the end) the first one's,
    in one order of all rows, bucket by bucket."""
    told = bucketed(df.withColumn("_own", F.when(valid, F.col(order))), order)
    firsts = {r["_b"]: r["v"] for r in told.groupBy("_b").agg(F.min("_own").alias("v")).collect()}  # as many rows as buckets
    later, at = [], min((v for v in firsts.values() if v is not None), default=None)
    for b in range(max(firsts, default=0), -1, -1):
        later.append(at)
        at = firsts.get(b) if firsts.get(b) is not None else at
    after = F.get(F.array(*(F.lit(v) for v in reversed(later))), F.col("_b"))
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return told.withColumn("source", F.coalesce(F.first("_own", ignorenulls=True).over(w), after)).drop("_own", "_b")


def next_valid_by(df: DataFrame, group: str, order: str, valid: Column) -> DataFrame:
    """next_valid within each group, of any size."""
    return within.carry_back(df, [group], order, F.when(valid, F.col(order)), "source", wrap=True)


def drop_keyword(df: DataFrame, column: str, word: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).contains(word), F.lit(False)))


def filter_report(df: DataFrame, kept: Column) -> DataFrame:
    """removed, total and kept_percent (null for no rows)."""
    n = F.count_if(kept)
    return df.agg((F.count("*") - n).alias("removed"), F.count("*").alias("total"), (n * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("kept_percent"))


def auto_scale(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values in one unit by their group's spread: population std below 0.008 counts as volts (x 1e6), below 1 as
    millivolts (x 1000), below 1000 as they are; larger ones are flagged."""
    s = F.stddev_pop(value)
    factor = F.when(s < 8e-3, 1e6).when(s < 1, 1000.0).otherwise(1.0)
    sizes = df.groupBy(group).agg(factor.alias("factor"), (s >= 1000).alias("out_of_range"))
    return df.join(sizes, group).withColumn("scaled", F.col(value) * F.col("factor"))


def reject_flat(df: DataFrame, signal: str, channel: int = 5, other: int = 0, floor: float = 1e-8) -> Column:
    """True for an epoch whose channel is flat in its first 15 samples, or other in samples -15 to -5 from its end."""
    a, b = F.get(F.col(signal), channel), F.get(F.col(signal), other)
    return (vec.std(F.slice(a, 1, 15)) < floor) | (vec.std(F.slice(b, F.size(b) - 14, F.lit(10))) < floor)


def reject_by_amplitude(df: DataFrame, group: str, ptp: str, threshold: float, least: int = 20) -> DataFrame:
    """kept: true in groups of fewer than least epochs, else where the peak-to-peak value is within the threshold."""
    n = F.count("*").over(Window.partitionBy(group))
    return df.withColumn("kept", (n < least) | (F.col(ptp) <= threshold))


def standard_channel(name: Column | str) -> Column:
    """New name of "EEG X-REF" channels of the montage; null for any other."""
    c = F.col(name) if isinstance(name, str) else name
    code = F.upper(F.regexp_extract(c, r"(?i)^EEG ([A-Z0-9]+)-REF$", 1))
    renamed = F.create_map(*(F.lit(x) for kv in RENAMED.items() for x in kv))
    return F.when(code.isin(KEPT), code).otherwise(F.try_element_at(renamed, code))


def clinical_names(df: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Rows whose channel stays, with new_name: without "EEG " and what follows a hyphen, at most three characters, no
    number, DC, EKG or blocked name; the first of equal new names stays. few: fewer than 15 are left."""
    short = F.trim(F.substring_index(F.replace(F.col(name), F.lit("EEG "), F.lit("")), "-", 1))
    bad = short.rlike("^[0-9]+$") | short.startswith("DC") | (F.length(short) > 3) | F.upper(short).contains("EKG") | F.upper(short).isin(BLOCKED) | (short == "")
    kept = df.where(~bad).withColumn("new_name", F.when(F.length(short) == 1, F.upper(short)).otherwise(capitalise(short)))
    first = kept.withColumn("_r", F.row_number().over(Window.partitionBy(group, "new_name").orderBy(order))).where("_r = 1").drop("_r")
    return first.withColumn("few", F.count("*").over(Window.partitionBy(group)) < 15)


def select_channels(signal: Column | str, names: Column | str, target: list[str], strict: bool = True) -> Column:
    """The signal's channels in target order. strict: an error for a missing one, else null."""
    s, n = (F.col(x) if isinstance(x, str) else x for x in (signal, names))
    at = lambda t: F.array_position(n, t)
    pick = F.transform(F.array(*(F.lit(t) for t in target)), lambda t: F.when(at(t) > 0, F.get(s, (at(t) - 1).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("missing channel: "), t)) if strict else None))
    return pick


def drop_channels(signal: Column | str, names: Column | str, gone: list[str]) -> Column:
    s, n = (F.col(x) if isinstance(x, str) else x for x in (signal, names))
    return F.filter(s, lambda x, i: ~F.get(n, i).isin(gone))


def nearest_channel(targets: DataFrame, present: DataFrame, positions: DataFrame, other: str = "Fpz") -> DataFrame:
    """(rec_id, target, channel, exact): each target's own channel (case aside) where the recording has it, else the one of
    the recording's channels among the targets that is nearest to it. A target without a position stands where other does; a
    channel without one is farther than all others. targets(target), present(rec_id, channel), positions(name, x, y, z)."""
    at = positions.select(F.lower("name").alias("k"), "x", "y", "z").dropDuplicates(["k"])
    spare = at.where(F.col("k") == other.lower()).select(*(F.col(c).alias(f"o{c}") for c in "xyz"))
    t = targets.join(small(at), F.lower("target") == F.col("k"), "left").join(F.broadcast(spare.limit(1)), how="left")
    t = t.select("target", *(F.coalesce(c, f"o{c}").alias(f"t{c}") for c in "xyz"))
    wanted = targets.select(F.lower("target").alias("w")).distinct()
    p = present.join(small(at), F.lower("channel") == F.col("k"), "left").join(small(wanted), F.lower("channel") == F.col("w"), "left_semi")
    pairs = p.select("rec_id", "channel", "x", "y", "z").crossJoin(small(t))
    exact = F.lower("channel") == F.lower("target")
    d = sum((F.pow(F.col(c) - F.col(f"t{c}"), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    best = F.struct((~exact).alias("o"), F.coalesce(d, F.lit(1e300)).alias("d"), F.col("channel"))
    return pairs.groupBy("rec_id", "target").agg(F.min(best).alias("b")).select("rec_id", "target", F.col("b.channel").alias("channel"), (~F.col("b.o")).alias("exact"))


def interpolate_channels(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(rec_id, t, target, value): the weighted sum of source channels. samples(rec_id, t, channel, value); weights(target,
    channel, w), a small dimension."""
    return samples.join(small(weights), "channel").groupBy("rec_id", "t", "target").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def inverse_distance_weights(targets: DataFrame, sources: DataFrame, power: float = 2.0) -> DataFrame:
    """Weight table for interpolate_channels from positions (target or channel, x, y, z): 1 / distance^power, adding up to 1;
    a source at the target's place has all the weight."""
    s = sources.select("channel", *(F.col(c).alias(f"s{c}") for c in "xyz"))
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"s{c}"), F.lit(2.0)) for c in "xyz"), F.lit(0.0)))
    raw = targets.crossJoin(small(s)).withColumn("d", d).withColumn("near", F.min("d").over(Window.partitionBy("target")))
    w = F.when(F.col("near") < 1e-9, (F.col("d") < 1e-9).cast("double")).otherwise(F.pow("d", F.lit(-power)))
    return raw.withColumn("w", w).select("target", "channel", (F.col("w") / F.sum("w").over(Window.partitionBy("target"))).alias("w")).where("w > 0")


# The region each name part stands for.
REGIONS = {"F": "frontal", "C": "central", "P": "parietal", "O": "occipital", "T": "temporal", "FP": "frontal_polar", "FC": "fronto_central", "CP": "centro_parietal", "PO": "parieto_occipital"}


def brain_region(name: Column | str) -> Column:
    """Region of a channel name: what its letters before the number (or the z of the midline) stand for, the longest part
    first, whatever their case; other for names of no region."""
    letters = F.upper(F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"^([A-Za-z]*?)(?:[zZ]|[hH]?[0-9]*)$", 1))
    regions = F.create_map(*(F.lit(x) for pair in REGIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(regions, F.substring(letters, 1, 2)), F.try_element_at(regions, F.substring(letters, 1, 1)), F.lit("other"))
