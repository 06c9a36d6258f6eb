"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated on labelled rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.llm import _kernels as k
from larkspur.llm._shared import Scratch, written
from larkspur.llm.rule_stats import BASE, FEATURES, rule_stats

#: Bits of a number that one pass of ``quantiles`` tells apart.
DIGIT = 13
#: Rows, least and greatest values of the nodes of one level, by tree and node.
Bounds = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class IsolationForest:
    """Trees as arrays: a node splits ``feature`` at ``value``; leaves have feature -1 and the path length."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    normal: float
    threshold: float = 1.0
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None

    @staticmethod
    def _expected(n: np.ndarray | float, most: int) -> np.ndarray:
        """Mean path length of a search that fails among n rows, at most ``most``; between whole numbers on a line."""
        whole = np.arange(2, most + 1)
        return np.interp(n, np.arange(most + 1), np.concatenate([[0.0, 0.0], 2 * np.cumsum(1 / (whole - 1)) - 2 * (whole - 1) / whole]))

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int = 100, unit: int = 256, seed: int = 7) -> IsolationForest:
        """The forest of rows that are here."""
        return cls.grown(lambda forest, level: forest.bounds([rows], level, rows.shape[1]), len(rows), trees, unit, seed)

    @classmethod
    def grown(cls, bounds: Callable[[IsolationForest, int], Bounds], total: int, trees: int, unit: int, seed: int = 7) -> IsolationForest:
        """Grows all trees a level at a time on all ``total`` rows, wherever these are.

        ``bounds`` gives what ``IsolationForest.bounds`` does, over all rows. A node is cut in
        a random feature at a random place between the least and the greatest value of all its
        rows, while it holds two rows in ``unit`` and is less than log2(``unit``) deep. Path
        lengths are those of ``unit`` rows dealt out as all rows are.
        """
        rng = np.random.default_rng(seed)
        unit = max(2, min(unit, total))
        depth = int(np.ceil(np.log2(unit)))
        size = 2 ** (depth + 1) - 1
        level_of = np.floor(np.log2(np.arange(size) + 1))
        forest = cls(np.full((trees, size), -1), np.zeros((trees, size)), np.tile(level_of, (trees, 1)), float(cls._expected(unit, unit)))
        for level in range(depth + 1):
            first, (n, low, high) = 2**level - 1, bounds(forest, level)
            shares = n * (unit / total)
            forest.length[:, first : 2 * first + 1] += cls._expected(shares, unit)
            if level == depth:
                break
            for t, at in np.argwhere(shares >= 2):
                wide = np.flatnonzero(high[t, at] > low[t, at])
                if len(wide):
                    f = int(rng.choice(wide))
                    forest.feature[t, first + at], forest.value[t, first + at] = f, rng.uniform(low[t, at, f], high[t, at, f])
        return forest

    def reached(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the node at which the path of each row ends."""
        index = np.arange(len(rows))
        for feature, value in zip(self.feature, self.value):
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                x = rows[index, np.maximum(f, 0)]
                node = np.where(inner, 2 * node + 1 + (x >= value[node]), node)
            yield node

    def bounds(self, batches: Iterable[np.ndarray], level: int, width: int = len(FEATURES)) -> Bounds:
        """Rows, least and greatest values of each node of the level that grows, over ``batches`` of rows."""
        n = np.zeros((len(self.feature), 2**level), np.int64)
        low = np.full((*n.shape, width), np.inf)
        high = -low
        for rows in batches:
            for t, node in enumerate(self.reached(rows)):
                at = (node - (2**level - 1)).astype(np.min_scalar_type(-(2**level)))
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]  # the others have ended above
                at = at[order]
                starts = np.flatnonzero(np.diff(at, prepend=at.dtype.type(-1)))
                if len(starts):
                    nodes, own = at[starts], rows[order]
                    n[t, nodes] += np.diff(starts, append=len(at))
                    low[t, nodes] = np.minimum(low[t, nodes], np.minimum.reduceat(own, starts))
                    high[t, nodes] = np.maximum(high[t, nodes], np.maximum.reduceat(own, starts))
        return n, low, high

    def judged(self, rows: np.ndarray) -> np.ndarray:
        """Scores of raw statistics, through their deviations."""
        return self.scores(_deviations(rows, self.centre, self.scale))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Near 1: isolated by few splits. About 0.5 and below: as deep as most rows."""
        total = np.zeros(len(rows))
        for length, node in zip(self.length, self.reached(rows)):
            total += length[node]
        return np.exp2(-total / len(self.feature) / self.normal)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def _deviations(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """How far each statistic is from that of good rows, in units that hold 99 % of these, on a log scale."""
    return np.log1p(np.abs(rows - centre) / scale)


def _best_cut(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, above: tuple[int, int], totals: tuple[int, int], after: float, cost: float) -> tuple[float, float, float]:
    """The largest gain, the score down to which rows are rejected for it, and the next lower score.

    ``scores`` are distinct and fall, with their numbers of good and bad rows; ``above`` them
    are so many good and bad rows, and ``after`` them comes that score.
    """
    lost, caught = (above[0] + np.cumsum(good)) / max(1, totals[0]), (above[1] + np.cumsum(bad)) / max(1, totals[1])
    gain = caught - cost * lost
    at = int(gain.argmax())
    return float(gain[at]), float(scores[at]), float(scores[at + 1]) if at + 1 < len(scores) else after


def best_threshold(scored: DataFrame, cost: float) -> float:
    """The score above which rows are rejected: the share of bad rows caught less ``cost`` times that of good rows lost is largest.

    ``scored`` has score and good of all rows. Equal scores share their fate. The scores are
    cut into ranges; of each range its totals and its best place come to the driver.
    """
    scratch = Scratch(scored.sparkSession, "rules")
    counted = scratch.write(scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "scores")
    ranges = scratch.write(counted.repartitionByRange("score").withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("most")).toPandas().sort_values("most", ascending=False)
    sums = int(totals["good"].sum()), int(totals["bad"].sum())
    above = totals[["good", "bad"]].cumsum() - totals[["good", "bad"]]
    after = [*totals["most"].tolist()[1:], 0.0]
    at = {r: (int(g), int(b), n) for r, g, b, n in zip(totals["range"], above["good"], above["bad"], after)}

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending")])
        scores, good, bad, own = (table[x].to_numpy() for x in ("score", "good", "bad", "range"))
        g, b, n = at[int(own[0])]
        return pa.table(dict(zip(("gain", "score", "next"), ([x] for x in _best_cut(scores, good, bad, (g, b), sums, n, cost)))))

    found = ranges.groupBy("range").applyInArrow(best, "gain double, score double, next double").toPandas().sort_values(["gain", "score"], ascending=False)
    scratch.drop(counted, ranges)
    gain, score, following = found.iloc[0]
    return float((score + following) / 2) if gain > 0 else float(totals["most"].iloc[0])


def _features(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(FEATURES))


def quantiles(rows: DataFrame, total: int, share: float, centre: np.ndarray | None = None) -> np.ndarray:
    """``numpy.quantile`` of each statistic, or of its distance from ``centre``, over all ``total`` rows, exactly.

    Numbers from 0 up are ordered like their bits, so each pass counts the next bits, where
    the rows are, of the numbers that begin like the one sought; only counts leave the tasks.
    """
    place = share * (total - 1)
    rank = np.array([[int(place), min(int(place) + 1, total - 1)]] * len(FEATURES))
    prefix = np.zeros(rank.shape, np.uint64)

    def count(shift: int, bits: int, prefix: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((*prefix.shape, 1 << bits), np.int64)
        for batch in batches:
            x = _features(batch.column(0))
            keys = np.abs(x if centre is None else x - centre).view(np.uint64) >> np.uint64(shift)
            for f, i in np.ndindex(prefix.shape):
                own = keys[:, f]
                own = own[own >> np.uint64(bits) == prefix[f, i]]
                n[f, i] += np.bincount((own & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["at", "n"])

    left = 64
    while left:
        bits = min(DIGIT, left)
        left -= bits
        counted = rows.select("features").mapInArrow(k.tidy(functools.partial(count, left, bits, prefix)), "at long, n long")
        counted = counted.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros((*prefix.shape, 1 << bits), np.int64)
        n.reshape(-1)[counted["at"].to_numpy()] = counted["n"].to_numpy()
        prefix = prefix.copy()
        for at in np.ndindex(prefix.shape):
            up_to = np.cumsum(n[at])
            digit = int(np.searchsorted(up_to, rank[at], "right"))
            rank[at] -= up_to[digit] - n[at][digit]
            prefix[at] = (int(prefix[at]) << bits) | digit
    low, high = prefix.view(np.float64).T
    return low + (high - low) * (place - int(place))


def labelled_rows(docs: DataFrame, labels: DataFrame, fit_rows: int, *names: str) -> DataFrame:
    """text and the label columns ``names`` of a bounded sample of documents, the same in every run.

    Labels with a null are left out; of several labels or texts of one id the least counts.
    """
    sample = labels.select("doc_id", *names).dropna().groupBy("doc_id").agg(F.min(F.struct(*names)).alias("__label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__label").alias("__label"))
    return found.select("text", *[F.col(f"__label.{n}").cast("int").alias(n) for n in names])


def rule_rows(docs: DataFrame) -> DataFrame:
    """doc_id, BASE counts, base_failed and ``features`` for each row of ``docs``. One pass, no shuffle."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(x, T.LongType()) for x in BASE]
    schema = T.StructType(fields + [T.StructField("base_failed", T.BooleanType()), T.StructField("features", T.ArrayType(T.FloatType()))])

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = rule_stats(k.texts_of(batch.column(1)))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            features = pa.ListArray.from_arrays(ends, pa.array(s["features"].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(s[x], pa.int64()) for x in BASE] + [pa.array(base_failed(s)), features], schema.names)

    return docs.select("doc_id", "text").mapInArrow(k.tidy(stats), schema)


def _grown(rows: DataFrame, total: int, centre: np.ndarray, scale: np.ndarray, trees: int, unit: int) -> IsolationForest:
    """The forest of all ``rows``: each task finds the bounds of its own, and what reaches the driver is a row a node."""
    names = [f"{x}{f}" for x in ("low", "high") for f in range(len(FEATURES))]

    def bounds(forest: IsolationForest, level: int) -> Bounds:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, low, high = forest.bounds((_deviations(_features(b.column(0)), centre, scale) for b in batches), level)
            at = np.flatnonzero(n)
            values = np.concatenate([low, high], 2).reshape(n.size, -1)[at]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at]), *map(pa.array, np.ascontiguousarray(values.T))], ["at", "n", *names])

        found = rows.select("features").mapInArrow(k.tidy(own), "at long, n long, " + ", ".join(f"{x} double" for x in names))
        merged = [F.sum("n").alias("n")] + [(F.min if x.startswith("low") else F.max)(x).alias(x) for x in names]
        found = found.groupBy("at").agg(*merged).toPandas()
        n, values = np.zeros((trees, 2**level), np.int64), np.zeros((trees, 2**level, len(names)))
        n.reshape(-1)[found["at"].to_numpy()] = found["n"].to_numpy()
        values.reshape(n.size, -1)[found["at"].to_numpy()] = found[names].to_numpy()
        return n, values[..., : len(FEATURES)], values[..., len(FEATURES) :]

    return IsolationForest.grown(bounds, total, trees, unit)


def fit_on_rows(rules: DataFrame, labels: DataFrame, cost: float = 10.0, trees: int = 200, unit: int = 24) -> IsolationForest | None:
    """Grows the forest on one half of all labelled rows and sets its threshold on the other; ``rules`` come from ``rule_rows``.

    Labels with a null are left out; of several labels of one id, and of the statistics of
    several texts, the least counts. Rows that fail the base rules take no part. The trees see
    good and bad rows alike; the threshold weighs a good row lost ``cost`` times a bad one
    caught. The halves go by a bit of the id's hash, that of 32 which divides both
    qualities most evenly. None if a quality is too rare: then only the base rules decide.
    """
    scratch = Scratch(rules.sparkSession, "rules")
    marks = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg((F.min("quality").cast("int") == 1).alias("good"))
    stats = rules.where("NOT base_failed").groupBy("doc_id").agg(F.min("features").alias("features"))
    fit = scratch.write(stats.join(marks, "doc_id").select("good", "features", F.xxhash64("doc_id").alias("hash")), "labelled")
    bit = [F.shiftright("hash", i).bitwiseAND(F.lit(1)) for i in range(32)]
    counted = fit.groupBy("good").agg(F.count("*").alias("n"), *[F.sum(b).alias(f"n{i}") for i, b in enumerate(bit)]).collect()
    n = {r["good"]: (r["n"], np.array([r[f"n{i}"] for i in range(32)])) for r in counted}
    forest = None
    if n.get(True, (0,))[0] >= 4 and n.get(False, (0,))[0] >= 2:
        split = int(np.argmin(np.max([np.abs(2 * own / every - 1) for every, own in n.values()], 0)))
        total = sum(own[split] for _, own in n.values())
        grow, judge = fit.where(bit[split] == 1), fit.where(bit[split] == 0)
        n_good = int(n[True][1][split])
        if 0 < n_good < n[True][0] and n[False][1][split] < n[False][0]:
            centre = quantiles(grow.where("good"), n_good, 0.5)
            scale = quantiles(grow.where("good"), n_good, 0.99, centre) + 1e-3
            forest = _grown(grow, int(total), centre, scale, trees, unit)
            forest.centre, forest.scale = centre, scale

            def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(forest.judged(_features(batch.column(0)))), batch.column(1)], ["score", "good"])

            forest.threshold = best_threshold(judge.select("features", "good").mapInArrow(k.tidy(score), "score double, good boolean"), cost)
    scratch.drop(fit)
    return forest


def fit_forest(docs: DataFrame, labels: DataFrame, cost: float = 10.0, trees: int = 200, unit: int = 24) -> IsolationForest | None:
    """``fit_on_rows`` of ``docs``."""
    scratch = Scratch(docs.sparkSession, "rules")
    rules = scratch.write(rule_rows(docs), "rows")
    forest = fit_on_rows(rules, labels, cost, trees, unit)
    scratch.drop(rules)
    return forest


def judged(rules: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """The columns of ``rule_rows`` but the features, anomaly score and ``kept``."""
    schema = T.StructType([f for f in rules.schema.fields if f.name != "features"] + [T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    names = schema.names[:-2]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = np.asarray(batch.column(len(names) - 1)).astype(bool)
            scores = np.zeros(len(failed))
            if forest is not None and (~failed).any():
                scores[~failed] = forest.judged(_features(batch.column(len(names)))[~failed])
            kept = ~failed & (scores <= (forest.threshold if forest is not None else 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores), pa.array(kept)], schema.names)

    return rules.select(*names, "features").mapInArrow(k.tidy(judge), schema)


def quality_rules(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """doc_id, BASE counts, base_failed, anomaly score and ``kept`` for each row of ``docs``.

    Null and empty texts have no words and fail the base rules. Repeated rows give repeated
    results; ids may be null; other columns are not read. One pass, no shuffle.
    """
    return judged(rule_rows(docs), forest)


def fitted_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``quality_rules`` by the forest of ``docs`` and ``labels``. Texts are read once: their statistics are written, and fit and verdicts read these."""
    rules = written(rule_rows(docs), "rules")
    return judged(rules, fit_on_rows(rules, labels))
