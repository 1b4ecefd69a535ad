"""Order inside groups of any size. A hot group, one with over PIECE_ROWS rows or over a SHARE-th of all, is cut to pieces at quantiles of its
order; each piece is a window of its own, and what pieces hand on (counts, sums, the next value) comes from a table with a row a piece.
Cold groups are one piece. Columns that slide over neighbours read blocks of row numbers, with copies of the rows beyond their edges."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .ordered import bucketed, small

PIECE_ROWS, SHARE = 1_000_000, 32


@dataclass
class Pieces:
    """rows with _hot and _p, the piece's number in its group; hot: whether any group was cut; limit: most rows of a cold group."""

    rows: DataFrame
    group: list[str]
    hot: bool
    limit: int

    def window(self, *order: str | Column):
        return Window.partitionBy(*self.group, "_p").orderBy(*order)

    def summary(self, *columns: Column) -> DataFrame:
        """A row for each piece of hot groups."""
        return self.rows.where("_hot").groupBy(*self.group, "_p").agg(*columns)

    def attach(self, table: DataFrame) -> DataFrame:
        """rows with the columns of a table by group and _p, null in cold groups. The table is written, so that its size is known."""
        names = {g: f"_g{i}" for i, g in enumerate(self.group)} | {"_p": "_q"}
        on = F.col("_p") == F.col("_q")
        for g in self.group:
            on = on & F.col(g).eqNullSafe(F.col(names[g]))
        return self.rows.join(saved(table, "pieces").withColumnsRenamed(names), on, "left").drop(*names.values())


def over(group: list[str], *order: str):
    return Window.partitionBy(*group).orderBy(*order)


def cut(df: DataFrame, group: list[str], order: str) -> Pieces:
    """df, which is read four times at most, cut to pieces; where there are hot groups they are written once. Rows of one piece come before those of the next by order; rows of equal order are
    one piece. order of hot groups must be a number, date or time."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_c"))
    told = sizes.agg(F.sum("_c").alias("n"), F.max("_c").alias("most")).first()
    limit = min(PIECE_ROWS, max(1, (told["n"] or 0) // SHARE))
    if (told["most"] or 0) <= limit:
        return Pieces(df.withColumns({"_p": F.lit(0), "_hot": F.lit(False)}), group, False, limit)
    names = [f"_g{i}" for i in range(len(group))]
    hot = sizes.where(F.col("_c") > limit).select(*(F.col(g).alias(n) for g, n in zip(group, names)), F.lit(True).alias("_hot"))
    on = F.lit(True)
    for g, n in zip(group, names):
        on = on & F.col(g).eqNullSafe(F.col(n))
    rows = df.join(small(hot), on, "left").drop(*names).withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    rows = bucketed(rows.withColumn("_o", F.when(F.col("_hot"), F.col(order))), "_o").drop("_o")
    rows = rows.withColumn("_p", F.when(F.col("_hot"), F.col("_b")).otherwise(0)).drop("_b")
    return Pieces(saved(rows, "pieces"), group, True, limit)


def number(df: DataFrame, group: list[str], order: str, name: str, ties: list[str] | None = None, pieces: Pieces | None = None) -> DataFrame:
    """df with name: each row's number from 0 in its group by order, then ties."""
    p = pieces or cut(df, group, order)
    local = F.row_number().over(p.window(order, *(ties or []))).cast("long") - 1
    if p.hot:
        counts = p.summary(F.count("*").alias("_c"))
        before = F.sum("_c").over(over(group, "_p").rowsBetween(Window.unboundedPreceding, -1))
        p = Pieces(p.attach(counts.select(*group, "_p", before.alias("_before"))), group, True, p.limit)
        local = local + F.coalesce("_before", F.lit(0))
    out = p.rows.withColumn(name, local)
    return (out if pieces else out.drop("_p", "_hot")).drop("_before")


def running_before(df: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """df, distinct by group and order, with before_<c> for each of columns: its sum over the group's rows of smaller order."""
    p = cut(df, group, order)
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"before_{c}": F.coalesce(F.sum(c).over(past(p.window(order))), F.lit(0)) for c in columns}
    if p.hot:
        sums = p.summary(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)))
        sums = sums.select(*group, "_p", *(F.sum(f"_s{i}").over(past(over(group, "_p"))).alias(f"_s{i}") for i in range(len(columns))))
        p = Pieces(p.attach(sums), group, True, p.limit)
        local = {k: v + F.coalesce(f"_s{i}", F.lit(0)) for i, (k, v) in enumerate(local.items())}
    return p.rows.withColumns(local).drop("_p", "_hot", *(f"_s{i}" for i in range(len(columns))))


def carry_back(df: DataFrame, group: list[str], order: str, value: Column, name: str, ties: list[str] | None = None, wrap: bool = False) -> DataFrame:
    """df with name: the first value that isn't null at or after each row of its group, by order and ties; wrap: past the end, the
    group's first one."""
    p = cut(df.withColumn("_v", value), group, order)
    by = [order, *(ties or [])]
    after = lambda c, w, a: F.first(c, ignorenulls=True).over(w.rowsBetween(a, Window.unboundedFollowing))
    found = [after("_v", p.window(*by), 0)]
    whole = after("_v", p.window(*by), Window.unboundedPreceding)
    if p.hot:
        first = F.min(F.when(F.col("_v").isNotNull(), F.struct(*by, "_v")))["_v"]
        firsts = p.summary(first.alias("_f"))
        later = firsts.select(*group, "_p", after("_f", over(group, "_p"), 1).alias("_later"), after("_f", over(group, "_p"), Window.unboundedPreceding).alias("_first"))
        p = Pieces(p.attach(later), group, True, p.limit)
        found.append(F.col("_later"))
        whole = F.when(F.col("_hot"), F.col("_first")).otherwise(whole)
    return p.rows.withColumn(name, F.coalesce(*found, *([whole] if wrap else []))).drop("_p", "_hot", "_v", "_later", "_first")


def blocks(df: DataFrame, group: list[str], order: str, before: int, after: int, value: str) -> DataFrame:
    """df with _i (number in the group), _n, _head and _tail (rows of the group, and its first and last value), _block and _own: each row in its
    block, and copies of it (_own false) in those that read it as one of up to before rows ahead of theirs or after rows behind. A cold
    group is one block."""
    p = cut(df, group, order)
    whole = p.window(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"_n": F.count("*").over(whole), "_head": F.first(value).over(whole), "_tail": F.last(value).over(whole)}
    rows = number(df, group, order, "_i", pieces=p)
    size = max(8 * (before + after), p.limit // 4, 1)
    if p.hot:
        told = p.summary(F.count("*").alias("_c"), F.min_by(value, order).alias("_a"), F.max_by(value, order).alias("_z"))
        full = over(group, "_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        told = told.select(*group, "_p", F.sum("_c").over(full).alias("_hn"), F.first("_a").over(full).alias("_ha"), F.last("_z").over(full).alias("_hz"))
        rows = Pieces(rows, group, True, p.limit).attach(told)
        ends = {k: F.when(F.col("_hot"), F.col(h)).otherwise(c) for (k, c), h in zip(ends.items(), ("_hn", "_ha", "_hz"))}
    rows = rows.withColumns(ends)
    first, last = F.floor(F.greatest(F.col("_i") - after, F.lit(0)) / size), F.floor(F.least(F.col("_i") + before, F.col("_n") - 1) / size)
    if p.hot:
        rows = rows.withColumn("_block", F.explode(F.when(F.col("_hot"), F.sequence(first, last)).otherwise(F.array(F.lit(0).cast("long")))))
        rows = rows.withColumn("_own", ~F.col("_hot") | (F.floor(F.col("_i") / size) == F.col("_block")))
    else:
        rows = rows.withColumns({"_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    return rows.drop("_p", "_hot", "_hn", "_ha", "_hz")


def decompose(df: DataFrame, group: str | list[str], order: str, value: str, ks: list[int]) -> DataFrame:
    """trend: the mean over ks of the mean of k values around each of its group, the first and last value repeated beyond the ends; rest:
    value less trend."""
    by = [group] if isinstance(group, str) else list(group)
    trend = F.lit(0.0)
    for k in ks:
        front, back = (k - 1) // 2, k - 1 - (k - 1) // 2
        near = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(-front, back)
        head = F.greatest(F.lit(front) - F.col("_i"), F.lit(0)) * F.col("_head")
        tail = F.greatest(F.col("_i") + back + 1 - F.col("_n"), F.lit(0)) * F.col("_tail")
        trend = trend + (F.sum(value).over(near) + head + tail) / k
    front, back = max((k - 1) // 2 for k in ks), max(k - 1 - (k - 1) // 2 for k in ks)
    out = blocks(df, by, order, front, back, value).withColumn("trend", trend / len(ks)).where("_own")
    return out.withColumn("rest", F.col(value) - F.col("trend")).select(*df.columns, "trend", "rest")


def moving_average(df: DataFrame, group: str | list[str], order: str, value: str, k: int) -> DataFrame:
    """decompose() with one kernel."""
    return decompose(df, group, order, value, [k])


def exp_smooth(df: DataFrame, group: str | list[str], order: str, value: str, alpha: float, first: float = 0.0) -> DataFrame:
    """df with smooth: s = alpha * s + (1 - alpha) * value along each group, from s = first. A null value has no smooth and leaves s as it is. A block
    beyond a group's first starts so many rows early that what came before weighs less than 1e-18."""
    if not 0 <= alpha < 1:
        raise ValueError("alpha must be in [0, 1)")
    by = [group] if isinstance(group, str) else list(group)
    before = ceil(log(1e-18) / log(alpha)) if alpha else 1
    known = F.col(value).isNotNull()
    rows = blocks(df.where(known).withColumn("_x", F.col(value).cast("double")), by, order, before, 0, "_x").drop("_n", "_head", "_tail")
    slim = rows.select(*by, "_block", "_i", "_own", "_x", F.struct(*df.columns).alias("_row"))
    schema = slim.select("_row").withColumn("smooth", F.lit(None).cast("double")).schema

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        s = np.array(list(accumulate(t.column("_x").to_pylist(), lambda s, x: alpha * s + (1 - alpha) * x, initial=first if t.column("_i")[0].as_py() == 0 else 0.0))[1:])
        return pa.table({"_row": t.column("_row"), "smooth": pa.array(s, pa.float64())}).filter(t.column("_own"))

    out = slim.groupBy(*by, "_block").applyInArrow(run, schema).select("_row.*", "smooth")
    return out.unionByName(df.where(~known).withColumn("smooth", F.lit(None).cast("double")))
