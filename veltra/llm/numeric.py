"""Limited-memory BFGS for smooth convex losses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = 100, tolerance: float = 1e-3) -> np.ndarray:
    """loss gives a value and its gradient; stops where the largest part of the gradient is under tolerance."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0.0) < tolerance:
            break
        q, kept = grad.copy(), []
        for s, d, rho in reversed(past):
            a = rho * (s @ q)
            kept.append(a)
            q -= a * d
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, np.abs(grad).sum())
        for (s, d, rho), a in zip(past, reversed(kept), strict=True):
            q += (a - rho * (d @ q)) * s
        slope, step = grad @ q, 1.0
        while step > 1e-8:
            new_value, new_grad = loss(w - step * q)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = -step * q, new_grad - grad
        if s @ d > 1e-10:
            past = [*past[-9:], (s, d, 1.0 / (s @ d))]
        w, value, grad = w + s, new_value, new_grad
    return w
