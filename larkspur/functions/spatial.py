"""Nearest rows of a table to query points: a k-d tree on each part of the table, and the best of all parts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

#: Query points at most: they travel with the plan. More are asked in several calls.
MOST_QUERIES = 100_000
LEAF = 32


class KDTree:
    """Points split at the median of their widest side; leaves are compared by force."""

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, float)
        self.root = self._split(np.arange(len(self.points))) if len(self.points) else None

    def _split(self, own: np.ndarray):
        part = self.points[own]
        side = int(np.ptp(part, 0).argmax())
        if len(own) <= LEAF or np.ptp(part[:, side]) == 0:
            return own
        order = np.argsort(part[:, side], kind="stable")
        middle = len(own) // 2
        return side, part[order[middle], side], self._split(own[order[:middle]]), self._split(own[order[middle:]])

    def nearest(self, point: Sequence[float], k: int = 1) -> list[tuple[float, int]]:
        """Distances and numbers of the k nearest points, nearest first; of equal ones the lower number."""
        point, found = np.asarray(point, float), []
        self._visit(self.root, point, k, found)
        return sorted((-d, -i) for d, i in found)

    def _visit(self, node, point, k, found):
        if node is None:
            return
        if isinstance(node, tuple):
            side, value, low, high = node
            first, second = (low, high) if point[side] < value else (high, low)
            self._visit(first, point, k, found)
            if len(found) < k or abs(point[side] - value) <= -found[0][0]:
                self._visit(second, point, k, found)
            return
        for d, i in zip(np.sqrt(((self.points[node] - point) ** 2).sum(1)).tolist(), node.tolist()):
            if len(found) < k:
                heapq.heappush(found, (-d, -i))
            elif (-d, -i) > found[0]:
                heapq.heapreplace(found, (-d, -i))

    def within(self, point: Sequence[float], reach: float) -> list[int]:
        """Numbers of the points at most ``reach`` away, ascending."""
        point, out, todo = np.asarray(point, float), [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                side, value, low, high = node
                todo += [low] * (point[side] - reach <= value) + [high] * (point[side] + reach >= value)
            elif node is not None:
                out += node[np.sqrt(((self.points[node] - point) ** 2).sum(1)) <= reach].tolist()
        return sorted(out)


def nearest_rows(df: DataFrame, id_column: str, names: Sequence[str], queries: Sequence[Sequence[float]], k: int, batch: int = 100_000) -> DataFrame:
    """query (its number), the id and distance of each one's k nearest rows; ties go to the least id.

    Each task indexes ``batch`` rows at a time and keeps k for each query; the best of all
    tasks are taken by query. Rows with a missing coordinate are left out.
    """
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at once")
    points = np.asarray(queries, float).reshape(len(queries), len(names))
    rows = df.select(id_column, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    schema = T.StructType([T.StructField("query", T.IntegerType()), rows.schema[id_column], T.StructField("distance", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                own = part.iloc[at : at + batch].sort_values(id_column)
                tree, ids = KDTree(own.iloc[:, 1:].to_numpy()), own[id_column].to_numpy()
                found = [(q, ids[i], d) for q, p in enumerate(points) for d, i in tree.nearest(p, k)]
                yield pd.DataFrame(found, columns=schema.names)

    best = Window.partitionBy("query").orderBy("distance", id_column)
    return rows.mapInPandas(run, schema).withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= k).drop("__rank")
