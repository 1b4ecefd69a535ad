"""Seeded choices by key hash: the same for any partitioning, and the same text in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(seed: int | str, *keys: Column | str) -> Column:
    """Hex string whose order is a random permutation of the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first eight hex digits of md5_key."""
    return F.conv(F.substring(md5_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gaussian(seed: int | str, *keys: Column | str) -> Column:
    """A standard normal number of the keys, from two uniform ones."""
    u, v = uniform(f"{seed}a", *keys), uniform(f"{seed}b", *keys)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(2 * 3.141592653589793) * v)
