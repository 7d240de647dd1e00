"""Least squares from sums of products, for the small matrices that reach a task."""

from __future__ import annotations

import numpy as np


def matrix(m, k: int) -> np.ndarray:
    """The symmetric k x k matrix of an upper triangle, row by row."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = m
    return out + np.triu(out, 1).T


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Least squares from moments; None if the regressors are not independent."""
    scale = np.sqrt(np.diag(a))
    if not (scale > 0).all():
        return None
    scaled = a / np.outer(scale, scale)
    return np.linalg.solve(scaled, b / scale) / scale if np.linalg.cond(scaled) < 1e12 else None
