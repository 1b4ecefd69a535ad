"""Seeded sampling, splitting, re-balancing and numbering. Every random choice is a hash of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rnd import md5_key, uniform
from . import within
from .metrics import group_weights
from .ordered import bucketed, constants, small


def numbered(df: DataFrame, key: Column, name: str, ties: list[str | Column] = ()) -> DataFrame:
    """df with name: each row's number from 0 in the order of key (a number, a time, or the hex text of md5_key), then ties.

    No single task orders all rows: they are cut to buckets in order (at approximate quantiles, or by the first hex digits),
    the buckets' counts give where each one starts, and rows are numbered within buckets.
    """
    told = df.withColumn("_k", key)
    if dict(told.dtypes)["_k"] == "string":
        told = told.withColumn("_b", F.conv(F.substring("_k", 1, 3), 16, 10).cast("int"))
    else:
        told = bucketed(told, "_k")
    counts = {r["_b"] or 0: r["n"] for r in told.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # as many rows as buckets
    start, at = [], 0
    for b in range(max(counts, default=0) + 1):
        start.append(at)
        at += counts.get(b, 0)
    number = F.row_number().over(Window.partitionBy("_b").orderBy("_k", *ties)) - 1
    return told.withColumn(name, (number + F.get(constants(start, "long"), F.coalesce("_b", F.lit(0)))).cast("long")).drop("_k", "_b")


def seeded_rank(df: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """df with _r, each row's rank from 1 in its group by md5_key, and _n, the group's rows. A group of any size is ranked in
    pieces: hashes are cut by their first digits, and the pieces' counts tell where each one starts."""
    told = df.withColumn("_k", md5_key(seed, key)).withColumn("_b", F.substring("_k", 1, 3))
    piece = told.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = piece.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_b").alias("_p"), before.alias("_s"), F.sum("_c").over(w).alias("_n"))
    on = F.col("_b") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    ranked = told.join(starts.hint("merge"), on).withColumn("_r", F.col("_s") + F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_k", key)))
    return ranked.drop("_k", "_b", "_p", "_s", *(f"_g{i}" for i in range(len(group))))


def limit_per_group(df: DataFrame, group: list[str], n: int, key: str, seed: int | None = None) -> DataFrame:
    """The first n rows of each group by key, or n seeded ones."""
    if seed is not None:
        return seeded_rank(df, group, key, seed).where(F.col("_r") <= n).drop("_r", "_n")
    w = Window.partitionBy(*group).orderBy(key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def resample_groups(df: DataFrame, group: str, key: str, strategy: str, seed: int) -> DataFrame:
    """under: every group cut to the smallest one's size. over: whole copies of every group, then a seeded rest, up to the
    largest one's size; column copy counts from 0."""
    ends = df.groupBy(group).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))  # one row
    ranked = seeded_rank(df, [group], key, seed).crossJoin(F.broadcast(ends))
    if strategy == "under":
        return ranked.where(F.col("_r") <= F.col("_lo")).drop("_n", "_lo", "_hi", "_r")
    whole = F.floor(F.col("_hi") / F.col("_n"))
    last = F.when(F.col("_r") <= F.col("_hi") - F.col("_n") * whole, whole).otherwise(whole - 1)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_n", "_lo", "_hi", "_r")


def split_random(key: str, seed: int, train: float = 0.9) -> Column:
    return F.when(uniform(seed, key) < train, "train").otherwise("test")


def split_by_subject(subject: str, key: str, held: list, seed: int, train: float = 0.9) -> Column:
    """cross for held-out subjects; train or val at random for the others."""
    return F.when(F.col(subject).isin(held), "cross").when(uniform(seed, key) < train, "train").otherwise("val")


def split_modulo(index: str, every: int = 10) -> Column:
    return F.when(F.pmod(F.col(index), F.lit(every)) < every - 1, "train").otherwise("val")


def split_tail(df: DataFrame, key: str, share: float) -> DataFrame:
    """train for the first floor(share * n) rows by key."""
    n = df.count()
    return numbered(df, F.col(key), "_i").withColumn("split", F.when(F.col("_i") < int(n * share), "train").otherwise("test")).drop("_i")


def sample_fraction(df: DataFrame, group: list[str], key: str, share: float, seed: int) -> DataFrame:
    """Exactly floor(share * n) rows of each group."""
    return seeded_rank(df, group, key, seed).where(F.col("_r") <= F.floor(F.col("_n") * share)).drop("_r", "_n")


def draw_with_replacement(df: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """draws rows, each any row of df with equal chance: draw i takes the row whose number by key is hash(i) mod n."""
    rows = numbered(df, F.col(key), "_i")
    n = df.count()
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(uniform(seed, "id") * n).cast("long").alias("_i"))
    return picks.join(rows.hint("merge"), "_i").drop("_i")


def first_per(df: DataFrame, name: str, order: str) -> DataFrame:
    w = Window.partitionBy(name).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sequential_id(df: DataFrame, group: str, order: str, prefix: str) -> DataFrame:
    """Dense ids from 1 within each group: prefix, group and number."""
    eid = F.format_string(prefix + "_%s_%06d", F.col(group).cast("string"), F.col("_number") + 1)
    return within.number(df, [group], order, "_number").withColumn("eid", eid).drop("_number")


def expand_repeats(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def dense_relabel(df: DataFrame, label: str, order: str) -> DataFrame:
    """Labels numbered from 0 by their first row in order. Numbers are given over distinct labels, not over rows."""
    firsts = df.groupBy(label).agg(F.min(order).alias("_f"))
    return df.join(small(numbered(firsts, F.col("_f"), "new_label", [label]).withColumn("new_label", F.col("new_label").cast("int")).drop("_f")), label)


def sample_weights(df: DataFrame, group: str, key: str) -> DataFrame:
    """Each row's inverse-frequency weight over the sum of all rows' weights."""
    w = group_weights(df, group)
    total = w.agg(F.sum(F.col("weight") * F.col("n")).alias("_t"))
    return df.join(small(w.crossJoin(F.broadcast(total))), group).select(key, group, (F.col("weight") / F.col("_t")).alias("sample_weight"))
