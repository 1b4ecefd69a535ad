"""Preparation of conversations for training: filters, lengths, batches, masks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rnd import md5_key, uniform
from ..functions.text import word_count
from ..sources.shared import saved
from .ordered import small
from .sampling import numbered

IGNORE = -100


def drop_leading(df: DataFrame, conv: str, turn: str, role: str, human: str) -> DataFrame:
    """Without a conversation's first turn where that isn't the human's."""
    first = F.row_number().over(Window.partitionBy(conv).orderBy(turn)) == 1
    return df.withColumn("_f", first).where(~(F.col("_f") & (F.col(role) != human))).drop("_f")


def alternation_violations(df: DataFrame, conv: str, turn: str, role: str, roles: tuple[str, str]) -> DataFrame:
    """Turns whose role isn't the one that their place asks for, first human, then in turn."""
    i = F.row_number().over(Window.partitionBy(conv).orderBy(turn)) - 1
    told = df.withColumn("expected", F.when(i % 2 == 0, roles[0]).otherwise(roles[1]))
    return told.where(F.col(role) != F.col("expected"))


def token_lengths(df: DataFrame, conv: str, text: str, image: Column, image_tokens: int = 128) -> DataFrame:
    """length: words of a conversation and image_tokens if it has an image; signed: negative without one."""
    out = df.groupBy(conv).agg(F.sum(word_count(text)).cast("long").alias("words"), F.bool_or(image).alias("image"))
    length = F.col("words") + F.when(F.col("image"), image_tokens).otherwise(0)
    return out.select(conv, length.cast("long").alias("length"), F.when(F.col("image"), length).otherwise(-length).cast("long").alias("signed"))


def length_totals(lengths: DataFrame) -> DataFrame:
    """(rows_with_image, rows_without, total_with_image, total_without) of token_lengths(), by the sign."""
    pos = F.col("signed") > 0
    neg = F.col("signed") < 0
    return lengths.agg(F.count_if(pos).alias("rows_with_image"), F.count_if(neg).alias("rows_without"), F.coalesce(F.sum(F.when(pos, F.col("signed"))), F.lit(0)).alias("total_with_image"), F.coalesce(F.sum(F.when(neg, -F.col("signed"))), F.lit(0)).alias("total_without"))


def collect_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv and turns: array of struct(role, text) in order."""
    packed = df.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("a"))
    return packed.select(conv, F.transform("a", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).alias("turns"))


def append_context(df: DataFrame, conv: str, turn: str, role: str, text: str, human: str, context: Column) -> DataFrame:
    """The first human turn of each conversation with context after it on a new line (null context: unchanged)."""
    n = F.sum((F.col(role) == human).cast("int")).over(Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0))
    first = (F.col(role) == human) & (n == 1)
    return df.withColumn("_first", first).withColumn(text, F.when(F.col("_first") & context.isNotNull(), F.concat(F.col(text), F.lit("\n"), context)).otherwise(F.col(text))).drop("_first")


def sampled(rate: float, seed: int, key: str) -> Column:
    return uniform(seed, key) < rate


def loss_mask(turns: Column | str, ids: Column | str, answer: str) -> Column:
    """Labels over all turns' token ids (array of arrays in turn order): ids of answer turns, IGNORE for the others."""
    t, i = (F.col(x) if isinstance(x, str) else x for x in (turns, ids))
    return F.flatten(F.zip_with(t, i, lambda turn, x: F.when(turn["role"] == answer, x).otherwise(F.transform(x, lambda _: F.lit(IGNORE)))))


def splice_placeholder(chunks: Column | str, mark: int, start: int | None = None) -> Column:
    """Token ids of chunks (array of arrays) joined by mark; with start, the chunks open with it and only the first keeps it."""
    c = F.col(chunks) if isinstance(chunks, str) else chunks
    own = (lambda x, i: F.when((i > 0) & (F.try_element_at(x, F.lit(1)) == start), F.slice(x, F.lit(2), F.size(x))).otherwise(x)) if start is not None else (lambda x, i: x)
    parts = F.transform(c, lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(mark)), own(x, i))).otherwise(x))
    return F.flatten(parts)


def pad_batch(df: DataFrame, batch: str, key: str, ids: str, labels: str, pad_id: int, longest: int, mark: int | None = None, mark_at: int = 10, pad_ends: bool = False) -> DataFrame:
    """Rows of a batch padded to its longest one: ids with pad_id, labels with IGNORE; in a batch with a row over longest, rows are cut to longest - 1.
    A mark that a row loses by that takes the place mark_at (from 0). mask: true on what isn't padding; pad_ends (the padding id also ends
    texts): true on ids that aren't pad_id, and on the first one after the last of those."""
    width = F.max(F.size(ids)).over(Window.partitionBy(batch))
    told = df.withColumn("_w", width).withColumn("_over", F.col("_w") > longest)
    cut = lambda c: F.when(F.col("_over"), F.slice(c, 1, longest - 1)).otherwise(F.col(c))
    short = cut(ids)
    if mark is not None:
        lost = F.array_contains(ids, mark) & ~F.array_contains(short, mark)
        short = F.when(lost, F.transform(short, lambda x, i: F.when(i == mark_at, mark).otherwise(x))).otherwise(short)
    told = told.withColumn("_ids", short).withColumn(labels, cut(labels)).withColumn("_w", F.when(F.col("_over"), longest - 1).otherwise(F.col("_w")))
    told = told.drop(ids).withColumnRenamed("_ids", ids).withColumn("_n", F.size(ids))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("_w") - F.col("_n")))
    told = told.withColumn("_full", fill(ids, pad_id))
    real = F.transform("_full", lambda x, i: i < F.col("_n"))
    if pad_ends:
        last = F.size("_full") - F.coalesce(F.array_position(F.transform(F.reverse("_full"), lambda x: x != pad_id), True), F.size("_full") + 1).cast("int")
        real = F.transform("_full", lambda x, i: (x != pad_id) | (i == last + 1))
    return told.select(batch, key, F.col("_full").alias(ids), fill(labels, IGNORE).alias(labels), real.alias("mask"))


def length_order(df: DataFrame, key: str, length: str, megabatch: int, seed: int) -> DataFrame:
    """megabatch and place: rows in seeded order, cut into megabatches, each sorted by length from long to short."""
    told = numbered(df, md5_key(seed, key), "_r", [key])
    told = told.withColumn("megabatch", F.floor(F.col("_r") / megabatch))
    return told.withColumn("place", F.row_number().over(Window.partitionBy("megabatch").orderBy(F.col(length).desc(), key)) - 1).drop("_r")


def modality_order(df: DataFrame, key: str, length: str, image: Column, megabatch: int, seed: int) -> DataFrame:
    """megabatch and place with rows that have an image apart from those that don't: each kind is ordered by length_order, all its megabatches but
    the last are dealt in seeded order, and both last ones together are the last of all, by key. Rows of one kind alone are in
    length_order. A null image counts as none."""
    told = df.withColumn("_m", F.coalesce(image, F.lit(False)))
    n = {r["_m"]: r["n"] for r in told.groupBy("_m").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return length_order(df, key, length, megabatch, seed)
    parts = [length_order(told.where(F.col("_m") == m), key, length, megabatch, seed).withColumn("_last", F.col("megabatch") == -(-n[m] // megabatch) - 1) for m in (True, False)]
    both = saved(parts[0].unionByName(parts[1]), "order")
    whole = both.where("not _last")
    dealt = numbered(whole.select("_m", "megabatch").distinct(), md5_key(seed, "_m", "megabatch"), "_to", ["_m", "megabatch"])
    first = whole.join(small(dealt), ["_m", "megabatch"]).withColumn("megabatch", F.col("_to")).select(*df.columns, "megabatch", "place")
    total = sum(-(-c // megabatch) - 1 for c in n.values())
    tail = both.where("_last").withColumns({"megabatch": F.lit(total).cast("long"), "place": F.row_number().over(Window.partitionBy("_last").orderBy(key)) - 1})  # at most two megabatches
    return first.unionByName(tail.select(*df.columns, "megabatch", "place"))


def even_chunks(df: DataFrame, key: str, length: str, world: int) -> DataFrame:
    """chunk of each row of a megabatch of length_order: longest first, each to the chunk of the least total length that still has room, so that
    world chunks are of equal size and near-equal length. A megabatch that world does not divide is dealt in turn."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        room = len(rows) // world
        if len(rows) % world:
            return pd.DataFrame({key: rows[key], "megabatch": rows["megabatch"], "chunk": [i % world for i in range(len(rows))]})
        totals, counts, out = [0] * world, [0] * world, []
        for n in rows[length]:
            k = min((t, i) for i, t in enumerate(totals) if counts[i] < room)[1]
            totals[k] += int(n)
            counts[k] += 1
            out.append(k)
        return pd.DataFrame({key: rows[key], "megabatch": rows["megabatch"], "chunk": out})

    kind = dict(df.dtypes)[key]
    return df.select(key, length, "megabatch", "place").groupBy("megabatch").applyInPandas(fill, f"`{key}` {kind}, megabatch long, chunk int")
