"""Choices of k of n classes for each row, without meeting the other n - k: draws of class numbers in the row, and a join on the number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vec
from ..functions.rnd import md5_key, uniform
from ..sources.shared import saved
from .ordered import small
from .sampling import numbered


def drawn(n: Column, k: Column | int, seed: int, *keys: Column | str) -> Column:
    """min(k, n) distinct numbers below n, each set of them as likely as any other (Floyd's draws: as many steps as numbers drawn, whatever n
    is). The array's order is no random one."""
    k = F.lit(k) if isinstance(k, int) else k
    first = (n - F.least(k.cast("long"), n)).cast("long")

    def step(have: Column, j: Column) -> Column:
        at = F.floor(uniform(seed, *keys, j) * (j + 1)).cast("long")
        return F.concat(have, F.array(F.when(F.array_contains(have, at), j).otherwise(at)))

    none = F.array().cast("array<long>")
    return F.when((n > 0) & (k > 0), F.aggregate(F.sequence(first, n.cast("long") - 1), none, step)).otherwise(none)


def class_numbers(classes: DataFrame, name: str = "class") -> DataFrame:
    """(name, _c): distinct classes, nulls left out, numbered from 0 in seeded order; written once."""
    return saved(numbered(classes.select(name).where(F.col(name).isNotNull()).distinct(), md5_key(0, name), "_c", [name]), "classes")


def negatives(queries: DataFrame, classes: DataFrame, query: str | list[str], label: str, k: int | Column, seed: int) -> DataFrame:
    """(query, label, class): k - 1 distinct classes (all, if there are fewer) other than the query's own, for every row of queries. classes: one
    column class, of any number of rows. Rows without a label have none; a label that is no class excludes nothing."""
    keys = [query] if isinstance(query, str) else list(query)
    numbers = class_numbers(classes)
    n = numbers.count()
    own = numbers.select(F.col("class").alias("_own_class"), F.col("_c").alias("_own"))
    picks = (F.lit(k) if isinstance(k, int) else k) - 1
    told = queries.where(F.col(label).isNotNull()).select(*keys, label, picks.alias("_k"))
    told = told.join(small(own), F.col(label) == F.col("_own_class"), "left")
    size = F.lit(n).cast("long") - F.when(F.col("_own").isNull(), 0).otherwise(1)
    drawn_ = drawn(size, F.col("_k"), seed, *keys)
    rows = told.select(*keys, label, F.explode(F.transform(drawn_, lambda v: F.when(v >= F.col("_own"), v + 1).otherwise(v))).alias("_c"))
    return rows.join(small(numbers), "_c").select(*keys, label, "class")


def questions(items: DataFrame, key: str | list[str], label: str, options: int | Column, seed: int, templates: list[str]) -> DataFrame:
    """(key, label, question, correct, option_number) of each labelled item: its label among seeded other labels of items, up to options in
    all, in seeded order behind a seeded template."""
    keys = [key] if isinstance(key, str) else list(key)
    others = negatives(items, items.select(F.col(label).alias("class")), keys, label, options, seed)
    labelled = items.where(F.col(label).isNotNull())
    shown = others.unionByName(labelled.select(*keys, label, F.col(label).alias("class")))
    order = F.struct(md5_key(seed + 1, *keys, "class").alias("o"), F.col("class").cast("string").alias("class"))
    packed = shown.groupBy(*keys, label).agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["class"]).alias("_options"))
    which = F.floor(uniform(seed + 2, *keys) * len(templates)).cast("int")
    asked = F.get(F.array(*(F.lit(t) for t in templates)), which)
    correct = X.option_letter(F.array_position("_options", F.col(label).cast("string")).cast("int") - 1)
    return packed.select(*keys, label, X.render_question(asked, "_options").alias("question"), correct.alias("correct"), F.size("_options").alias("option_number"))


def kway_hits(queries: DataFrame, prototypes: DataFrame, ks: list[int], query: str, label: str, qvec: str, seed: int) -> DataFrame:
    """(k, query, label, rank): place of the true class among itself and k - 1 seeded negatives, for each of ks. prototypes: class, vec. Rows
    whose label is no prototype have no place. The vectors stay with their rows: what is ranked is a number a candidate."""
    numbers = class_numbers(prototypes)
    n = numbers.count()
    gallery = saved(prototypes.select("class", "vec").join(small(numbers), "class"), "gallery")
    own = gallery.select(F.col("class").alias("_own_class"), F.col("_c").alias("_own"))
    told = queries.select(query, label, qvec).join(small(own), F.col(label) == F.col("_own_class"))
    one = lambda k: F.concat(F.array("_own"), F.transform(drawn(F.lit(n - 1).cast("long"), k - 1, seed, query, F.lit(k)), lambda v: F.when(v >= F.col("_own"), v + 1).otherwise(v)))
    rows = told.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), one(k).alias("c")) for k in ks))))
    rows = rows.select(query, label, qvec, F.col("_s.k").alias("k"), F.explode("_s.c").alias("_c"))
    scored = rows.join(small(gallery), "_c").select("k", query, label, "class", vec.cosine(qvec, "vec").alias("sim"))
    w = Window.partitionBy("k", query).orderBy(F.col("sim").desc(), "class")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("class") == F.col(label)).select("k", query, label, "rank")
