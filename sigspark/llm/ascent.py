"""The least value of a smooth convex function of many numbers, for the small fits done in one task."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np


def least(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, bound: float, curvature: np.ndarray | float = 1.0, rounds: int = 2000, memory: int = 20) -> np.ndarray:
    """Where f, which returns its value and gradient, has no slope above bound: L-BFGS steps with a line search that meets both
    Wolfe conditions. curvature: a guess of the second derivatives. Raises RuntimeError if rounds steps do not settle."""
    x, held = start.astype(float), deque(maxlen=memory)
    value, g = f(x)
    for _ in range(rounds):
        if np.abs(g).max(initial=0) <= bound:
            return x
        step, used = -g, []
        for s, y, r in reversed(held):
            used.append(a := r * (s @ step))
            step = step - a * y
        step = step / curvature
        if held:
            s, y, _ = held[-1]
            step *= (s @ y) / (y @ (y / curvature))
        for (s, y, r), a in zip(held, reversed(used)):
            step = step + s * (a - r * (y @ step))
        slope = g @ step
        if slope >= 0:  # rounding: start again from the gradient
            held.clear()
            step = -g / curvature
            slope = g @ step
        low, high, t = 0.0, np.inf, 1.0
        for _ in range(60):
            new, h = f(x + t * step)
            if not new <= value + 1e-4 * t * slope + 1e-13 * abs(value):
                high = t
            elif h @ step < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if np.isfinite(high) else 2 * low
        s, y = t * step, h - g
        x, value, g = x + s, new, h
        if s @ y > 0:
            held.append((s, y, 1 / (s @ y)))
    if np.abs(g).max(initial=0) <= bound:
        return x
    raise RuntimeError(f"no optimum in {rounds} steps: a slope of {np.abs(g).max():.3g} is left, over {bound:.3g}")
