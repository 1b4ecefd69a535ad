"""Seeded augmentation of vectors and signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.rnd import gaussian, md5_key


def jitter(x: str, sigma: float, seed: int, key: str) -> Column:
    """x plus a normal number of deviation sigma for each value."""
    return F.transform(F.col(x).cast("array<double>"), lambda v, i: v + sigma * gaussian(seed, F.col(key), i))


def scale(x: str, sigma: float, seed: int, key: str) -> Column:
    """x times a normal number around 1, one a row."""
    return vec.bound({"x": F.col(x).cast("array<double>"), "g": gaussian(seed, F.col(key))}, lambda b: F.transform(b["x"], lambda v: v * (1 + sigma * b["g"])))


def shift(x: str, sigma: float, seed: int, key: str) -> Column:
    """x plus a normal number, one a row."""
    return vec.bound({"x": F.col(x).cast("array<double>"), "g": gaussian(seed, F.col(key))}, lambda b: F.transform(b["x"], lambda v: v + sigma * b["g"]))


def masked(n: int, share: float, seed: int, key: str) -> Column:
    """n booleans of which floor(share * n) seeded ones are true."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(md5_key(seed, F.col(key), i).alias("o"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, int(share * n)), lambda s: s["i"])
    return vec.bound({"c": chosen}, lambda b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(b["c"], i)))


def mask_channels(signal: str, n: int, share: float, seed: int, key: str) -> Column:
    """signal (n channels) with seeded channels replaced by normal noise of the channel's own norm."""

    def noise(ch: Column, c: Column) -> Column:
        raw = F.transform(ch, lambda _, i: gaussian(seed, F.col(key), c, i))
        scaled = lambda r: vec.bound({"r": r, "f": vec.norm(ch) / F.greatest(vec.norm(r), F.lit(1e-12))}, lambda b: F.transform(b["r"], lambda v: v * b["f"]))
        return vec.bound({"r": raw}, lambda o: scaled(o["r"]))

    values = {"s": F.col(signal).cast("array<array<double>>"), "m": masked(n, share, seed, key)}
    return vec.bound(values, lambda b: F.transform(b["s"], lambda ch, c: F.when(F.get(b["m"], c), noise(ch, c)).otherwise(ch)))
