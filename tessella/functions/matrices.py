"""The distances of ``functions.distance`` between two small sets of cases, as numpy matrices, for the block and group
kernels. A block has a bounded number of cases, chosen by the caller."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Weights = list[float] | None


#: Dimensions from which squared distances are by one matrix product.
PRODUCT_DIMENSIONS = 16


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By differences, or in many dimensions by |a|^2 + |b|^2 - 2ab, and by differences where that is small beside its parts."""
    if a.shape[1] < PRODUCT_DIMENSIONS:
        return sum(((a[:, j, None] - b[None, :, j]) ** 2 for j in range(a.shape[1])), np.zeros((len(a), len(b))))
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    out = a @ b.T
    out *= -2
    out += size
    size *= 1e-6
    i, j = np.nonzero(~(out > size))
    for at in range(0, len(i), 10_000):
        p, q = i[at : at + 10_000], j[at : at + 10_000]
        out[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return out


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((np.abs(a[:, j, None] - b[None, :, j]) for j in range(a.shape[1])), np.zeros((len(a), len(b))))


def _maximum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        np.maximum(out, np.abs(a[:, j, None] - b[None, :, j]), out=out)
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    return np.where(size > 0, np.clip(1 - a @ b.T / np.where(size > 0, size, 1.0), 0.0, 2.0), 2.0)


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _cosine(a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True))


def _ranks(a: np.ndarray) -> np.ndarray:
    """Average ranks within each row."""
    less = (a[:, None, :] < a[:, :, None]).sum(2)
    return less + ((a[:, None, :] == a[:, :, None]).sum(2) + 1) / 2.0


def _spearman(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _correlation(_ranks(a), _ranks(b))


def _chi_square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ta, tb = a.sum(1)[:, None], b.sum(1)[None]
    parts = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        p, q = a[:, j, None], b[None, :, j]
        both = np.where(p + q > 0, p + q, 1.0)
        parts += p * p / (both * ta) + q * q / (both * tb)
    return np.sqrt(np.maximum(0.0, (ta + tb) * (parts - 1)))


def _phi_square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _chi_square(a, b) / np.sqrt(a.sum(1)[:, None] + b.sum(1)[None])


def _gower(a: np.ndarray, b: np.ndarray, weights: Weights, ranges: list[float]) -> np.ndarray:
    far, mass = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        w = 1.0 if weights is None else float(weights[j])
        d = np.abs(a[:, j, None] - b[None, :, j]) / float(ranges[j])
        known = ~np.isnan(d)
        far += np.where(known, w * d, 0.0)
        mass += w * known
    return np.where(mass > 0, far / np.where(mass > 0, mass, 1.0), np.nan)


def _jaccard(a: np.ndarray, b: np.ndarray, weights: Weights) -> np.ndarray:
    w = np.ones(a.shape[1]) if weights is None else np.asarray(weights, float)
    both = (a * w) @ b.T
    union = sum((w[j] * np.maximum(a[:, j, None], b[None, :, j]) for j in range(a.shape[1])), np.zeros((len(a), len(b))))
    return np.where(union > 0, 1 - both / np.where(union > 0, union, 1.0), 0.0)


def _simple_matching(a: np.ndarray, b: np.ndarray, weights: Weights) -> np.ndarray:
    w = np.ones(a.shape[1]) if weights is None else np.asarray(weights, float)
    return _manhattan(a * w, b * w) / w.sum()


def _russell_rao(a: np.ndarray, b: np.ndarray, weights: Weights) -> np.ndarray:
    w = np.ones(a.shape[1]) if weights is None else np.asarray(weights, float)
    return 1 - (a * w) @ b.T / w.sum()


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(a, b))


PLAIN: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": _euclidean, "minkowski": _euclidean, "mahalanobis": _euclidean, "sqeuclidean": _squares, "manhattan": _manhattan, "maximum": _maximum,
    "cosine": _cosine, "correlation": _correlation, "spearman": _spearman, "chi_square": _chi_square, "phi_square": _phi_square,
}
WEIGHTED = {"jaccard": _jaccard, "simple_matching": _simple_matching, "russell_rao": _russell_rao}


def matrix(name: str, a: np.ndarray, b: np.ndarray, weights: Weights = None, ranges: list[float] | None = None) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b``; NaN marks a missing component, and under Gower distance a pair
    without a common one. Mahalanobis distance takes whitened cases."""
    if name in PLAIN:
        return PLAIN[name](a, b)
    if name in WEIGHTED:
        return WEIGHTED[name](a, b, weights)
    if name == "gower" and ranges is not None:
        return _gower(a, b, weights, ranges)
    raise ValueError(f"no matrix of {name!r} distance")


def points(column) -> np.ndarray:
    """Arrays of a pandas column as rows of a matrix, null as NaN."""
    return np.array([[np.nan if v is None else v for v in row] for row in column], float).reshape(len(column), -1)


def square(name: str, x: np.ndarray, weights: Weights = None, ranges: list[float] | None = None) -> np.ndarray:
    """Distances within one set, zero to itself; pairs without a common variable have the largest, 1 at least."""
    d = matrix(name, x, x, weights, ranges)
    np.fill_diagonal(d, 0.0)
    if np.isnan(d).any():
        d = np.where(np.isnan(d), max(1.0, float(np.nanmax(d, initial=1.0))), d)
    return (d + d.T) / 2
