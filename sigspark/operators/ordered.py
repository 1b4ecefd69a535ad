"""Order over whole tables without one task that sees all rows: rows are cut to ordered buckets, the buckets' totals come to
the driver (at most BUCKETS rows), and what is left is a window within each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most buckets of a table, rows a bucket is meant for, and cuts that a row is held against at each of two levels.
BUCKETS, ROWS, FAN = 1024, 1_000_000, 32
#: Sizes up to which a table counts as small enough to broadcast.
SMALL_ROWS = 20_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df for the side of a join: broadcast if it has no more than that many rows, else sorted and merged."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def constants(values: list, kind: str) -> Column:
    """An array of numbers as one constant of the optimised plan, however many there are."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def as_number(df: DataFrame, key: str) -> Column:
    """A number in the order of a numeric, date or time column."""
    kind = df.select(key).dtypes[0][1]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(key).cast("timestamp")).cast("double")
    if kind == "string":
        raise ValueError(f"{key}: no order of strings here; give a number, date or time")
    return F.col(key).cast("double")


def bucketed(df: DataFrame, key: str, least: int = 64) -> DataFrame:
    """df with _b: buckets in the order of the column key (nulls first), cut at approximate quantiles; from least buckets on
    their number follows the rows."""
    number = as_number(df, key)
    told = df.agg(F.percentile_approx(number, [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("c"), F.count("*").alias("n")).first()
    every = max(1, BUCKETS // max(least, min(BUCKETS, told["n"] // ROWS)))
    cuts = sorted(set(map(float, (told["c"] or [])[every - 1 :: every])))
    if not cuts:
        return df.withColumn("_b", F.lit(0))
    coarse, fine = constants(cuts[FAN - 1 :: FAN] or [float("inf")], "double"), constants(cuts, "double")
    first = F.size(F.filter(coarse, lambda c: c <= number)) if len(cuts) >= FAN else F.lit(0)
    place = df.withColumn("_b0", F.when(number.isNotNull(), first * FAN).otherwise(0))
    return place.withColumn("_b", F.col("_b0") + F.when(number.isNotNull(), F.size(F.filter(F.slice(fine, F.col("_b0") + 1, F.lit(FAN)), lambda c: c <= number))).otherwise(0)).drop("_b0")


def running(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df, distinct by key, with before_<c> for each of columns: its sum over all rows of smaller keys."""
    told = bucketed(df, key)
    totals = {r["_b"]: r for r in told.groupBy("_b").agg(*(F.sum(c).alias(c) for c in columns)).collect()}
    w = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(told.dtypes)
    for c in columns:
        before, at = [], 0
        for b in range(max(totals, default=0) + 1):
            before.append(at)
            at += (totals[b][c] or 0) if b in totals else 0
        told = told.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(w), F.lit(0)) + F.get(constants(before, "double" if kinds[c] in ("double", "float") else "long"), F.col("_b")))
    return told.drop("_b")
