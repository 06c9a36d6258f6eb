"""Matrix algebra: small matrices as NumPy arrays, tall ones as tables whose columns are the matrix's.

What is small has the size of the columns; what has the size of the rows stays in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from larkspur.functions.ml import moments

# Small matrices


def reduced_echelon(a: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    a, row = np.array(a, float), 0
    for column in range(a.shape[1]):
        if row == a.shape[0]:
            break
        best = row + int(np.abs(a[row:, column]).argmax())
        if abs(a[best, column]) <= tolerance:
            a[row:, column] = 0
            continue
        a[[row, best]] = a[[best, row]]
        a[row] /= a[row, column]
        others = np.arange(len(a)) != row
        a[others] -= np.outer(a[others, column], a[row])
        row += 1
    return a


def norm(a: np.ndarray, kind: str = "frobenius") -> float:
    return float(np.linalg.norm(a, {"frobenius": "fro", "one": 1, "infinity": np.inf, "spectral": 2}[kind]))


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L and U with P @ a = L @ U, by partial pivoting."""
    u = np.array(a, float)
    n = len(u)
    p, low = np.eye(n), np.zeros((n, n))
    for k in range(n):
        best = k + int(np.abs(u[k:, k]).argmax())
        for m in (u, p, low):
            m[[k, best]] = m[[best, k]]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return p, low + np.eye(n), np.triu(u)


def ldl(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and the diagonal of D with a = L @ D @ L.T, for a symmetric matrix that needs no pivots."""
    a = np.array(a, float)
    n = len(a)
    low, d = np.eye(n), np.zeros(n)
    for j in range(n):
        d[j] = a[j, j] - (low[j, :j] ** 2) @ d[:j]
        low[j + 1 :, j] = (a[j + 1 :, j] - (low[j + 1 :, :j] * low[j, :j]) @ d[:j]) / d[j]
    return low, d


def minor(a: np.ndarray, row: int, column: int) -> np.ndarray:
    return np.delete(np.delete(np.asarray(a, float), row, 0), column, 1)


def cofactors(a: np.ndarray) -> np.ndarray:
    n = len(a)
    return np.array([[(-1) ** (i + j) * np.linalg.det(minor(a, i, j)) if n > 1 else 1.0 for j in range(n)] for i in range(n)])


def adjoint(a: np.ndarray) -> np.ndarray:
    return cofactors(a).T


def degree_matrix(adjacency: np.ndarray) -> np.ndarray:
    return np.diag(np.asarray(adjacency, float).sum(1))


def graph_laplacian(adjacency: np.ndarray) -> np.ndarray:
    return degree_matrix(adjacency) - adjacency


def square_root(a: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix without negative eigenvalues."""
    values, v = np.linalg.eigh(a)
    return v * np.sqrt(np.maximum(values, 0)) @ v.T


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in ascending order and their vectors as columns."""
    a = np.asarray(a, float)
    if np.allclose(a, a.T):
        return np.linalg.eigh(a)
    values, v = np.linalg.eig(a)
    order = np.argsort(values)
    return values[order], v[:, order]


# Tables as tall matrices


def gram(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """A.T @ A, in one aggregate."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = df.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = one[f"g{i}_{j}"]
    return out


def covariance(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    return moments(df, names)[2]


def times(df: DataFrame, names: Sequence[str], matrix: np.ndarray, prefix: str = "y") -> DataFrame:
    """Adds the columns of A @ matrix, as plain expressions."""
    return df.select("*", *[sum((F.col(c) * float(w) for c, w in zip(names, column)), F.lit(0.0)).alias(f"{prefix}{i}") for i, column in enumerate(np.asarray(matrix, float).T)])


def centered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    _, means, _ = moments(df, names)
    return df.withColumns({c: F.col(c) - float(m) for c, m in zip(names, means)})


def whitened(df: DataFrame, names: Sequence[str], prefix: str = "w") -> DataFrame:
    """Adds columns whose covariance is the unit matrix."""
    _, means, cov = moments(df, names)
    values, v = np.linalg.eigh(cov)
    turn = v / np.sqrt(np.maximum(values, 1e-300)) @ v.T
    return times(centered(df, names), names, turn, prefix).select(*df.columns, *[F.col(f"{prefix}{i}") for i in range(len(names))])


def least_squares(df: DataFrame, names: Sequence[str], target: str) -> np.ndarray:
    """x with the least ||A @ x - target||, by the normal equations of one aggregate."""
    g = gram(df, [*names, target])
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
