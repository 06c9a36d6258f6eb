"""Quality classifier: a document's evidence and the posteriors of its host and path, combined by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from larkspur.llm import _kernels as k
from larkspur.llm._shared import unused, written
from larkspur.llm.quality_rules import labelled_rows
from larkspur.llm.rule_stats import rule_stats

#: At most so many labelled rows are fitted on; what is learned from them is bounded by their texts.
FIT_ROWS = 4000
#: A word is evidence of toxic text if so many toxic rows hold it, at such log odds against the others.
TOXIC_ROWS, TOXIC_ODDS = 3, 2.5
#: Rows that a worker scores and hands on at once.
ROWS_AT_ONCE = 2000


@dataclass
class Evidence:
    """A logistic model of rule statistics for quality, and weights of words for toxicity."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    toxic_words: np.ndarray
    toxic_weights: np.ndarray
    toxic_bias: float

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, x * x, np.minimum(np.abs(x), 1)], 1)

    def quality(self, x: np.ndarray) -> np.ndarray:
        """Log odds that a text is good."""
        return np.clip(self._wide((x - self.centre) / self.scale), -8, 8) @ self.weights + self.bias

    def toxic(self, texts: pa.StringArray) -> np.ndarray:
        """Log odds that a text is toxic, from the words that it holds."""
        out = np.full(len(texts), self.toxic_bias)
        for a, b in k.pieces(texts):
            hashes, rows = word_hashes(texts.slice(a, b - a))
            if not len(self.toxic_words):
                continue
            at = np.minimum(np.searchsorted(self.toxic_words, hashes), len(self.toxic_words) - 1)
            hit = np.flatnonzero(self.toxic_words[at] == hashes)
            pairs = np.unique(np.stack([rows[hit], at[hit]], 1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
            out[a:b] += np.bincount(pairs[:, 0], self.toxic_weights[pairs[:, 1]], b - a)
        return out


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters in each text, in lower case for ASCII, and their rows."""
    raw, offsets = k.buffers(texts)
    folded = raw.copy()
    folded[(raw >= 65) & (raw <= 90)] += 32
    starts, ends, counts = k.runs(((folded >= 97) & (folded <= 122)) | (folded >= 128), offsets)
    return k.Hasher(folded)(starts, ends), k.owners(counts)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge; both classes weigh alike."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * p * (1 - p)
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_evidence(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Evidence | None:
    """Fits both models on a bounded sample of ``labels`` (doc_id, quality, toxic).

    Labels with a null are not used, and of several labels or texts of one id the least
    counts. None if the sample doesn't hold both qualities.
    """

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = k.texts_of(batch.column(0))
            x = rule_stats(texts)["features"].astype(np.float64)
            hashes, rows = word_hashes(texts)
            own = np.split(hashes, np.searchsorted(rows, np.arange(1, len(texts))))
            words = [np.unique(h).view(np.int64) for h in own]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int64()))], ["quality", "toxic", "features", "words"])

    texts = labelled_rows(docs, labels, fit_rows, "quality", "toxic").where(F.col("text").isNotNull())
    seen = written(texts.mapInArrow(k.tidy(stats), "quality int, toxic int, features array<double>, words array<bigint>"), "labelled")
    rows = seen.select("quality", "toxic", "features").toPandas()
    if rows["quality"].nunique() < 2:
        return None
    # Words are counted where they are; those that speak for toxic text come back.
    n_bad, n_other = max(1, int((rows["toxic"] == 1).sum())), max(1, int((rows["toxic"] == 0).sum()))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    counted = seen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("other"))
    top = counted.where(F.col("bad") >= TOXIC_ROWS).withColumn("odds", odds).where(F.col("odds") > TOXIC_ODDS).select("word", "odds").toPandas()
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    x = np.array(rows["features"].tolist())
    own_order = np.lexsort(x.T)
    x, y = x[own_order], rows["quality"].to_numpy()[own_order] == 1
    centre, scale = np.median(x, 0), x.std(0) + 1e-6
    evidence = Evidence(centre, scale, np.zeros(3 * x.shape[1]), 0.0, hashes[order], top["odds"].to_numpy(float)[order], -3.0)
    evidence.weights, evidence.bias = _logistic(np.clip(evidence._wide((x - centre) / scale), -8, 8), y.astype(float))
    return evidence


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sites(scored: DataFrame, host: str, path: str, evidence: str) -> DataFrame:
    """For each host and path: soft counts of both, the global share and the strengths of the two priors.

    Soft counts of all documents are summed by path, once; hosts and the whole are sums of
    these. How strongly a level is shrunk comes from the spread of its shares beyond what
    their counts explain (method of moments). Aggregation is partial before each shuffle, and
    what is broadcast is one row.
    """
    p = 1 / (1 + F.exp(-F.col(evidence)))
    paths = written(scored.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(F.count("*").alias("__n"), F.sum(p).alias("__good")), "sites")
    hosts = paths.groupBy("__host").agg(F.sum("__n").alias("__host_n"), F.sum("__good").alias("__host_good"))
    mean = F.greatest(F.least(F.sum("__host_good") / F.sum("__host_n"), F.lit(1 - 1e-4)), F.lit(1e-4))

    def strength(spread: Column, noise: Column, at: Column) -> Column:
        """Of the Beta prior whose variance is the spread that is left."""
        return F.greatest(at * (1 - at) / F.greatest(spread - at * (1 - at) * noise, at * (1 - at) / 500) - 1, F.lit(2.0))

    world = hosts.agg(mean.alias("__world_p"), F.var_pop(F.col("__host_good") / F.col("__host_n")).alias("spread"), F.avg(1 / F.col("__host_n")).alias("noise"))
    world = world.select("__world_p", strength(F.col("spread"), F.col("noise"), F.col("__world_p")).alias("__host_prior"))
    hosts = hosts.crossJoin(F.broadcast(world)).withColumnRenamed("__host", "__host2")
    placed = paths.join(hosts, F.col("__host").eqNullSafe(F.col("__host2"))).drop("__host2")
    away = F.col("__good") / F.col("__n") - _shrunk("__host_good", "__host_n", "__host_prior", F.col("__world_p"))
    within = placed.agg(F.avg(away * away).alias("spread"), F.avg(1 / F.col("__n")).alias("noise"), F.first("__world_p").alias("w"))
    within = within.select(strength(F.col("spread"), F.col("noise"), F.col("w")).alias("__path_prior"))
    return placed.crossJoin(F.broadcast(within))


def _shrunk(good: str, n: str, prior: str, towards: Column, own: Column | None = None) -> Column:
    """Posterior share of a site, without the document whose own soft count is given."""
    less = (own, 1) if own is not None else (F.lit(0.0), 0)
    return (F.col(good) - less[0] + F.col(prior) * towards) / (F.col(n) - less[1] + F.col(prior))


def site_posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """__host, __path and the posterior share of good documents of each, host_p and path_p, and of all, world_p.

    A host is shrunk to the global share and a path to its host's, so that sites with few
    documents stay near their prior. ``scored`` has the evidence, log odds, of every document.
    """
    host_p = _shrunk("__host_good", "__host_n", "__host_prior", F.col("__world_p"))
    return _sites(scored, host, path, "evidence").select("__host", "__path", host_p.alias("host_p"), _shrunk("__good", "__n", "__path_prior", host_p).alias("path_p"), F.col("__world_p").alias("world_p"))


def classify(docs: DataFrame, evidence: Evidence | None, host: str = "source", path: str = "lang", site_weight: float = 0.5, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``columns`` of ``docs`` (its doc_id by default) with six results, and the names that these have.

    Log odds of the posterior: the document's evidence plus ``site_weight`` times how far its
    path's log odds are from the global ones. The shares of a document's host and path leave
    out the document itself, so that its evidence counts once. It is kept if it is more
    likely good than not and not likely toxic. Null and empty texts are rejected; rows whose
    host or path is null form sites of their own; repeated rows give repeated results; columns
    of any name are carried along. Texts go to Python once: their scores are written with
    ``columns``, and both the sites and the verdicts read these. The site table is joined by
    hash and broadcast by Spark only if it is below the session's limit.
    """
    columns = columns or ["doc_id"]
    found = dict(zip(("evidence", "toxic_odds", "blank", "host", "path", "host_p", "path_p", "p", "toxic", "kept"), unused(docs, *[f"__{n}" for n in ("evidence", "toxic_odds", "blank", "h", "l", "host_p", "path_p", "p", "toxic", "kept")])))
    names = [*columns, found["host"], found["path"]]
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(host).alias(found["host"]), F.col(path).alias(found["path"]), *([] if "text" in columns else [F.col("text").alias(unused(docs, "__text")[0])]))
    at = columns.index("text") if "text" in columns else len(names)  # a text that is kept goes to Python once
    fields = source.schema.fields[: len(names)] + [T.StructField(found["evidence"], T.DoubleType()), T.StructField(found["toxic_odds"], T.DoubleType()), T.StructField(found["blank"], T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                texts = k.texts_of(batch.column(at))
                s = rule_stats(texts)
                odds = evidence.quality(s["features"].astype(np.float64)) if evidence is not None else np.zeros(len(texts))
                bad = evidence.toxic(texts) if evidence is not None else np.full(len(texts), -3.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(odds, pa.float64()), pa.array(bad, pa.float64()), pa.array(s["n_words"] == 0)], [f.name for f in fields])

    scored = written(source.mapInArrow(k.tidy(run), T.StructType(fields)), "evidence")
    sites = _sites(scored, found["host"], found["path"], found["evidence"])
    joined = scored.join(sites, F.col(found["host"]).eqNullSafe(F.col("__host")) & F.col(found["path"]).eqNullSafe(F.col("__path")), "left")
    own = 1 / (1 + F.exp(-F.col(found["evidence"])))
    host_p = _shrunk("__host_good", "__host_n", "__host_prior", F.col("__world_p"), own)
    path_p = _shrunk("__good", "__n", "__path_prior", host_p, own)
    odds = F.col(found["evidence"]) + site_weight * (_logit(path_p) - _logit(F.col("__world_p")))
    toxic = F.col(found["toxic_odds"]) > 0
    out = joined.select(
        *[F.col(f"`{c}`") for c in columns], found["evidence"], host_p.alias(found["host_p"]), path_p.alias(found["path_p"]), (1 / (1 + F.exp(-odds))).alias(found["p"]),
        toxic.alias(found["toxic"]), (~F.col(found["blank"]) & (odds >= 0) & ~toxic).alias(found["kept"]),
    )
    return out, found


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, evidence, host_p, path_p, p_good, toxic and kept for every row of ``docs``."""
    out, found = classify(docs, fit_evidence(docs, labels, fit_rows))
    return out.select("doc_id", *[F.col(found[c]).alias("p_good" if c == "p" else c) for c in ("evidence", "host_p", "path_p", "p", "toxic", "kept")])


def kept(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    out, found = classify(docs, fit_evidence(docs, labels, fit_rows), columns=docs.columns)
    return out.where(F.col(found["kept"])).select(*[F.col(f"`{c}`") for c in docs.columns])
