"""Vector algebra, normalisation and resampling of array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rnd import uniform


def _c(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def bound(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """f of a struct of values that are evaluated once for a row, however often f's lambdas look at them."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), f), F.lit(0))


def total(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def norm(x: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v * v))


def l2_normalize(x: Column | str, eps: float = 1e-12) -> Column:
    """x / max(|x|, eps)."""
    return bound({"x": _c(x), "n": F.greatest(norm(x), F.lit(eps))}, lambda b: F.transform(b["x"], lambda v: v / b["n"]))


def cosine(x: Column | str, y: Column | str, eps: float = 1e-12) -> Column:
    return dot(x, y) / (F.greatest(norm(x), F.lit(eps)) * F.greatest(norm(y), F.lit(eps)))


def mean(x: Column | str) -> Column:
    return total(x) / F.size(_c(x))


def std(x: Column | str, sample: bool = False) -> Column:
    """Population standard deviation, or the sample's (n - 1)."""
    squares = bound({"x": _c(x), "m": mean(x)}, lambda b: F.aggregate(b["x"], F.lit(0.0), lambda a, v: a + (v - b["m"]) * (v - b["m"])))
    n = F.size(_c(x)) - (1 if sample else 0)
    return F.sqrt(squares / F.greatest(n, F.lit(1)))


def _scaled(x: Column | str, centre: Column, spread: Column) -> Column:
    return bound({"x": _c(x), "m": centre, "s": spread}, lambda b: F.transform(b["x"], lambda v: (v - b["m"]) / b["s"]))


def zscore_pop(x: Column | str) -> Column:
    """(x - mean) / population std; a std of 0 counts as 1."""
    return _scaled(x, mean(x), F.coalesce(F.nullif(std(x), F.lit(0.0)), F.lit(1.0)))


def zscore_sample(x: Column | str, floor: float = 1e-8) -> Column:
    """(x - mean) / max(sample std, floor)."""
    return _scaled(x, mean(x), F.greatest(std(x, True), F.lit(floor)))


def scale_std(x: Column | str, floor: float = 1e-8) -> Column:
    """x / max(sample std, floor), not centred."""
    return _scaled(x, F.lit(0.0), F.greatest(std(x, True), F.lit(floor)))


def instance_norm(x: Column | str, eps: float = 1e-5, last: bool = False) -> Column:
    """Struct of the normalised series and what undoes it: its mean (or last value) and sqrt(population variance + eps)."""
    centre = F.element_at(_c(x), -1) if last else mean(x)
    spread = F.sqrt(F.pow(std(x), F.lit(2.0)) + eps)
    return F.struct(_scaled(x, centre, spread).alias("values"), centre.alias("centre"), spread.alias("spread"))


def instance_denorm(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return bound({"c": c}, lambda b: F.transform(b["c"]["values"], lambda v: v * b["c"]["spread"] + b["c"]["centre"]))


def normalize_named(x: Column | str, method: Column) -> Column:
    """One of zscore_global, scale_std, zscore_pop, instance, none by the name in method."""
    return (
        F.when(method == "zscore_global", zscore_sample(x))
        .when(method == "scale_std", scale_std(x))
        .when(method == "zscore_pop", zscore_pop(x))
        .when(method == "instance", instance_norm(x)["values"])
        .otherwise(_c(x))
    )


def normalize_signal(x: Column | str, method: str, seed: int = 0, *key: str) -> Column:
    """A signal (channels) by one of identity, zscore_global, std_global (statistics over all channels), zscore_channel, std_channel (a channel's own), or
    random: one of those five by a hash of the row's key. Deviations are the sample's, and 1e-8 at least."""
    c = (F.col(x) if isinstance(x, str) else x).cast("array<array<double>>")
    floor = lambda v: F.greatest(std(v, True), F.lit(1e-8))
    scaled = lambda s, f: F.transform(s, lambda ch: F.transform(ch, f))
    whole = bound({"s": c, "m": mean(F.flatten(c)), "d": floor(F.flatten(c))}, lambda b: scaled(b["s"], lambda v: (v - b["m"]) / b["d"]))
    over = bound({"s": c, "d": floor(F.flatten(c))}, lambda b: scaled(b["s"], lambda v: v / b["d"]))
    made = {"identity": c, "zscore_global": whole, "std_global": over, "zscore_channel": F.transform(c, lambda ch: zscore_sample(ch)), "std_channel": F.transform(c, lambda ch: scale_std(ch))}
    if method == "random":
        out, pick = c, F.floor(uniform(seed, *key) * len(made))
        for i, m in enumerate(made.values()):
            out = F.when(pick == i, m).otherwise(out)
        return out
    if method not in made:
        raise ValueError(f"unknown normalisation: {method}")
    return made[method]


def linear_resample(x: Column | str, m: int) -> Column:
    """n to m samples by linear interpolation at (i + 0.5) * n / m - 0.5, held at the ends."""

    def at(i: Column, c: Column) -> Column:
        n = F.size(c)
        src = F.greatest((i + 0.5) * n / m - 0.5, F.lit(0.0))
        lo = F.least(F.floor(src).cast("int"), n - 1)
        hi = F.least(lo + 1, n - 1)
        return F.get(c, lo) + (F.get(c, hi) - F.get(c, lo)) * (src - lo)

    return bound({"x": _c(x)}, lambda b: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: at(i, b["x"])))


def softmax(x: Column | str) -> Column:
    powers = bound({"x": _c(x), "top": F.array_max(_c(x))}, lambda b: F.transform(b["x"], lambda v: F.exp(v - b["top"])))
    return bound({"e": powers}, lambda o: bound({"e": o["e"], "z": F.aggregate(o["e"], F.lit(0.0), lambda a, v: a + v)}, lambda b: F.transform(b["e"], lambda v: v / b["z"])))


def argmax(x: Column | str) -> Column:
    """Index from 0 of the first largest value."""
    c = _c(x)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def one_hot(label: Column | str, n: int) -> Column:
    k = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == k).cast("int"))


def amplitude_jitter(x: Column | str, u: Column, low: float = 0.9, high: float = 1.1) -> Column:
    """x times a factor in [low, high) picked by u in [0, 1)."""
    return bound({"x": _c(x), "f": low + (high - low) * u}, lambda b: F.transform(b["x"], lambda v: v * b["f"]))


def is_finite(x: Column | str) -> Column:
    """True where no component is null, NaN or infinite."""
    return F.forall(_c(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def dft_amplitude(x: Column | str) -> Column:
    """|rfft(x)| by the definition, for short series."""

    def bin_(k: Column, c: Column) -> Column:
        turn = lambda i: i * k * (2 * 3.141592653589793) / F.size(c)
        start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        add = lambda a, v: F.struct((a["i"] + 1).alias("i"), (a["re"] + v * F.cos(turn(a["i"]))).alias("re"), (a["im"] - v * F.sin(turn(a["i"]))).alias("im"))
        return F.aggregate(c, start, add, lambda a: F.sqrt(a["re"] * a["re"] + a["im"] * a["im"]))

    return bound({"x": _c(x)}, lambda b: F.transform(F.sequence(F.lit(0), F.floor(F.size(b["x"]) / 2).cast("int")), lambda k: bin_(k, b["x"])))


def circular_autocorrelation(x: Column | str, y: Column | str | None = None) -> Column:
    """For each lag k: sum over i of x[(i + k) mod n] * y[i] (y is x by default): the inverse transform of
    rfft(x) * conj(rfft(y))."""

    def lag(k: Column, a: Column, b: Column) -> Column:
        turned = F.concat(F.slice(a, k + 1, F.size(a)), F.slice(a, F.lit(1), k))
        return F.aggregate(F.zip_with(turned, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    return bound({"x": _c(x), "y": _c(x if y is None else y)}, lambda b: F.transform(F.sequence(F.lit(0), F.size(b["x"]) - 1), lambda k: lag(k, b["x"], b["y"])))
