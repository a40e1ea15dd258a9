"""Steps of convex fits on the driver, over a bounded number of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def conjugate(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, scale: np.ndarray, near: float, rounds: int = 100) -> np.ndarray:
    """The solution of ``times``(x) = b, preconditioned by the diagonal ``scale``."""
    x, r = np.zeros_like(b), b.copy()
    z = r / scale
    p, rz = z.copy(), r @ z
    first = np.sqrt(b @ b)
    for _ in range(rounds):
        if np.sqrt(r @ r) <= near * first or rz == 0:
            break
        q = times(p)
        a = rz / (p @ q)
        x += a * p
        r -= a * q
        z = r / scale
        rz, before = r @ z, rz
        p = z + rz / before * p
    return x
