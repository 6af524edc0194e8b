"""Bounded minimisation of a few parameters with a gradient."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, lower: np.ndarray | None = None, upper: np.ndarray | None = None, turns: int = 300, close: float = 1e-10) -> np.ndarray:
    """A projected quasi-Newton descent: BFGS on the free parameters, backtracking along the projected path.

    Parameters are scaled by their start, so densities of very different size converge alike.
    """
    scale = np.maximum(np.abs(start), 1.0)
    lo = np.full(len(start), -np.inf) if lower is None else np.asarray(lower) / scale
    hi = np.full(len(start), np.inf) if upper is None else np.asarray(upper) / scale

    def at(y: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = loss(y * scale)
        return value, np.asarray(slope) * scale

    x = np.clip(start / scale, lo, hi)
    value, slope = at(x)
    inverse = np.eye(len(x))
    for _ in range(turns):
        held = ((x <= lo) & (slope > 0)) | ((x >= hi) & (slope < 0))
        free = ~held
        if not free.any() or np.abs(slope[free]).max() < close * max(1.0, abs(value)):
            break
        step = np.zeros_like(x)
        step[free] = -inverse[np.ix_(free, free)] @ slope[free]
        if step @ slope >= 0:
            inverse = np.eye(len(x))
            step = np.where(free, -slope, 0)
        size = 1.0 if np.abs(inverse - np.eye(len(x))).max() > 0 else min(1.0, 1 / max(1e-300, np.abs(step).max()))
        while size > 1e-18:
            new = np.clip(x + size * step, lo, hi)
            new_value, new_slope = at(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * (slope @ (new - x)):
                break
            size /= 2
        else:
            break
        moved, turned = new - x, new_slope - slope
        done = value - new_value <= 1e-15 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if (bend := moved @ turned) > 1e-300:
            r = np.eye(len(x)) - np.outer(moved, turned) / bend
            inverse = r @ inverse @ r.T + np.outer(moved, moved) / bend
        if done:
            break
    return x * scale
