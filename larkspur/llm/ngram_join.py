"""Jaccard self-join of word shingles by chosen paths.

Every set is embedded as its minimum hashes. In each of several runs, all sets begin in one
bucket; a bucket samples a coordinate or two, and a set goes on to the bucket of its token
there, so that similar sets stay together. Small buckets are compared by force: first
sketches, then the whole sets. Runs are repeated until the expected recall is reached.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from larkspur.llm import _kernels as k
from larkspur.llm._shared import Scratch, unused
from larkspur.llm.components import components

WIDTH = 128
#: Levels of splitting after which buckets above LIMIT are counted again; after the last, they are compared in blocks.
DEPTHS = (2, 4, 6)
LIMIT, BLOCK = 512, 256
_rng = np.random.default_rng(20240229)
_FACTOR = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def _spread(threshold: float) -> list[float]:
    """How likely a pair at the threshold has 0, 1, ... WIDTH minima in common."""
    return [math.comb(WIDTH, c) * threshold**c * (1 - threshold) ** (WIDTH - c) for c in range(WIDTH + 1)]


def least_common(threshold: float, recall: float) -> int:
    """Common minima below which a pair is not compared: four deviations, or more where a tenth of the allowed loss needs it."""
    least = math.ceil((threshold - 4 * math.sqrt(threshold * (1 - threshold) / WIDTH)) * WIDTH)
    while least > 0 and sum(_spread(threshold)[:least]) > (1 - recall) / 10:
        least -= 1
    return max(0, least)


def _lost(common: int, threshold: float, depth: int) -> float:
    """How likely a pair with so many common minima shares no bucket ``depth`` levels down in one run."""
    two = min(1.0, 1 / threshold - 1)  # the share of buckets that sample two coordinates: 1 / threshold on average
    one = common / WIDTH
    both = one * (common - 1) / (WIDTH - 1)
    lost = 0.0
    for _ in range(depth):
        lost = (1 - two) * (1 - one + one * lost) + two * (1 - 2 * one + both + 2 * (one - both) * lost + both * lost**2)
    return lost


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a leaf with probability ``recall``, over the spread of its common minima."""
    least = least_common(threshold, recall)
    spread = _spread(threshold)
    lost = [_lost(c, threshold, depth) for c in range(least, WIDTH + 1)]
    missed, runs = sum(spread[:least]), 1
    while missed + sum(p * x**runs for p, x in zip(spread[least:], lost)) > 1 - recall:
        runs += 1
    return runs


def shingle_sets(texts: pa.StringArray, n: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text; words are runs without white space in lower case."""
    lowered = pa.array([x.lower() for x in texts.to_pylist()], pa.string())
    for a, b in k.pieces(lowered):
        raw, offsets = k.buffers(lowered.slice(a, b - a))
        starts, ends, counts = k.words(raw, offsets)
        hashes, rows = k.shingles(k.Hasher(raw)(starts, ends), counts, n)
        at = np.searchsorted(rows, np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(hashes[at[i] : at[i + 1]])


def _embedded(tokens: np.ndarray) -> np.ndarray:
    low = np.full(WIDTH, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(tokens), 2048):
            low = np.minimum(low, ((tokens[at : at + 2048, None] * _FACTOR + _SHIFT) >> np.uint64(32)).min(0))
    return low.astype("<u4")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, signature (of the whole set), size and minima of every row; a text without words has size 0."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = k.texts_of(batch.column(1))
            for at in range(0, len(texts), 2000):
                own = list(shingle_sets(texts.slice(at, 2000), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 2000).cast(pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own], pa.binary()), pa.array(map(len, own), pa.int32()), pa.array([_embedded(x).tobytes() for x in own], pa.binary())],
                    ["doc_id", "signature", "size", "minima"],
                )

    return docs.select("doc_id", "text").mapInArrow(k.tidy(run), "doc_id bigint, signature binary, size int, minima binary")


def _split(path: np.ndarray, row: np.ndarray, minima: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One level down: the coordinates depend on the bucket only, the child bucket on the set's tokens there."""
    with np.errstate(over="ignore"):
        draw = k.mix(path ^ k.U64(0xA5A5A5A5A5A5A5A5))
        first = (k.mix(draw + k.U64(1)) % k.U64(WIDTH)).astype(np.int64)
        second = (first + 1 + (k.mix(draw + k.U64(2)) % k.U64(WIDTH - 1)).astype(np.int64)) % WIDTH
        two = (draw >> k.U64(11)).astype(np.float64) / 2.0**53 < 1 / threshold - 1
        out_path, out_row = [], []
        for coordinate, some in ((first, np.ones(len(path), bool)), (second, two)):
            token = minima[row[some], coordinate[some]].astype(np.uint64)
            out_path.append(k.mix(path[some] * k.U64(0x9E3779B97F4A7C15) + (token << k.U64(8)) + coordinate[some].astype(np.uint64)))
            out_row.append(row[some])
    return np.concatenate(out_path), np.concatenate(out_row)


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _descend(rows: DataFrame, levels: int, threshold: float, runs: int = 0) -> DataFrame:
    """rep and path, ``levels`` further down. With ``runs``, rows are rep and minima at the roots; else rep, minima and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            minima = _matrix(batch.column(1), "<u4", WIDTH)
            row = np.arange(batch.num_rows)
            if runs:
                path, row = np.repeat(k.mix(np.arange(1, runs + 1, dtype=np.uint64)), len(row)), np.tile(row, runs)
            else:
                path = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for _ in range(levels):
                path, row = _split(path, row, minima, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy(zero_copy_only=False)[row]), pa.array(path.view(np.int64))], ["rep", "path"])

    return rows.mapInArrow(k.tidy(run), "rep bigint, path bigint")


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """Columns of each run of rows that are equal in the first ``keys`` columns; rows come sorted by these."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cuts = _cuts(table, keys)
        yield from _parts(table, cuts[:-1])
        rest = table.slice(cuts[-2]) if len(cuts) > 1 else table
    if rest is not None and rest.num_rows:
        yield from _parts(rest, _cuts(rest, keys))


def _cuts(table: pa.Table, keys: int) -> list[int]:
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for c in range(keys):
        x = table.column(c).to_numpy()
        change |= x[1:] != x[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows] if table.num_rows else [0]


def _parts(table: pa.Table, cuts: list[int]) -> Iterator[list[pa.Array]]:
    columns = [c.combine_chunks() for c in table.columns]
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 1:
            yield [c.slice(a, b - a) for c in columns]


def _block(rep: np.ndarray, blocks: int) -> np.ndarray:
    return (k.mix(rep.view(np.uint64)) % k.U64(blocks)).astype(np.int64)


def _first_common(path: int, leaves: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share no leaf below ``path``: each pair counts only in the least leaf that holds both."""
    width = max(map(len, leaves))
    left, right = np.full((len(leaves), width), np.iinfo(np.int64).min), np.full((len(leaves), width), np.iinfo(np.int64).max)
    for i, own in enumerate(leaves):
        lower = own[own < path]
        left[i, : len(lower)] = right[i, : len(lower)] = lower
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 20000):
        s = slice(at, at + 20000)
        out[s] = ~(left[a[s]][:, :, None] == right[b[s]][:, None, :]).any((1, 2))
    return out


def _pairs(rep: np.ndarray, blocks: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that block pair (i, j) of a bucket compares."""
    if blocks == 1 or i == j:
        return np.triu_indices(len(rep), 1)
    own = _block(rep, blocks)
    a, b = np.meshgrid(np.flatnonzero(own == i), np.flatnonzero(own == j), indexing="ij")
    return a.ravel(), b.ravel()


def _distinct(columns: list[pa.Array], at: int) -> list[pa.Array]:
    rep = columns[at].to_numpy(zero_copy_only=False)
    _, first = np.unique(rep, return_index=True)
    return [c.take(pa.array(first)) for c in columns] if len(first) < len(rep) else columns


def _likely(rows: DataFrame, least: int) -> DataFrame:
    """path, i, j, blocks, rep, copies and leaves of the members that have a partner with ``least`` equal values in the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_group(batches, 3):
            group = _distinct(group, 4)
            rep = group[4].to_numpy(zero_copy_only=False)
            path, i, j, blocks = (group[c][0].as_py() for c in range(4))
            sketch = _matrix(group[7], "u1", WIDTH)
            a, b = _pairs(rep, blocks, i, j)
            near = np.concatenate([(sketch[a[x : x + 50000]] == sketch[b[x : x + 50000]]).sum(1) for x in range(0, len(a), 50000)]) >= least if len(a) else np.zeros(0, bool)
            a, b = a[near], b[near]
            if len(a):
                own = _first_common(path, [np.array(x.as_py()) for x in group[6]], a, b)
                some = pa.array(np.unique(np.concatenate([a[own], b[own]])))
                if len(some):
                    yield pa.RecordBatch.from_arrays([c.take(some) for c in group[:7]], names)

    names = ["path", "i", "j", "blocks", "rep", "copies", "leaves"]
    return rows.select(*names, "sketch").mapInArrow(k.tidy(run), T.StructType([rows.schema[n] for n in names]))


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """rep, links (rows of partners) and root (the least rep that it is linked with in this bucket, over others too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_group(batches, 3):
            group = _distinct(group, 4)
            rep, copies = group[4].to_numpy(zero_copy_only=False), group[5].to_numpy(zero_copy_only=False)
            path, i, j, blocks = (group[c][0].as_py() for c in range(4))
            sets = [np.frombuffer(x.as_py(), "<u8") for x in group[7]]
            a, b = _pairs(rep, blocks, i, j)
            if not len(a):
                continue
            sizes = np.array([len(x) for x in sets])
            shared = _shared_counts(sets)[a, b]
            near = np.flatnonzero(shared >= threshold * (sizes[a] + sizes[b] - shared) - 1e-9)
            a, b = a[near], b[near]
            if not len(a):
                continue
            own = _first_common(path, [np.array(x.as_py()) for x in group[6]], a, b)
            a, b = a[own], b[own]
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
            root = rep.copy()
            while True:  # least label over the pairs of one block pair
                before = root.copy()
                np.minimum.at(root, a, before[b])
                np.minimum.at(root, b, before[a])
                if (root == before).all():
                    break
            some = np.unique(np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["rep", "links", "root"])

    return rows.mapInArrow(k.tidy(run), "rep bigint, links bigint, root bigint")


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share; tokens of one set only are left out before the product."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every)
    every, row = every[order], row[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    token = np.cumsum(new) - 1
    often = np.bincount(token)
    common = often[token] > 1
    index = np.cumsum(often > 1) - 1
    row, token = row[common], index[token[common]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    step = max(256, (1 << 22) // max(1, len(sets)))
    n = int(token[-1]) + 1 if len(token) else 0
    for at in range(0, n, step):
        lo, hi = np.searchsorted(token, [at, at + step])
        dense = np.zeros((len(sets), step), np.float32)
        dense[row[lo:hi], token[lo:hi] - at] = 1
        out += dense @ dense.T
    return out


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_links for every row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of ``n``-word shingles is at
    least ``threshold``; classes are the connected components. A text of fewer words is one
    shingle of all; texts without words, and null texts, have no links. Equal sets are one
    member that counts for its copies. A pair that is linked is found with probability
    ``recall`` or more. A row whose id is null has no class and no links; rows that share an
    id are one document, whose class they share. Ids are whole numbers of at most 64 bits;
    those of other types that aren't are an error. Other columns are not read. Every link of a
    class is counted, so work within a class of n different texts grows with n squared.

    Only buckets of at most 2 * BLOCK members are compared in one task: larger ones are cut
    into blocks, and each pair of blocks is a task of its own. Pairs are never emitted, only
    counts and one edge per member.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    sets = scratch.write(_sets(docs, n), "sets")
    real = sets.where("doc_id IS NOT NULL AND size > 0")
    groups = scratch.write(real.groupBy("signature").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "groups")
    # By id alone, so that the rows of an id are together already when one of them is taken.
    own = sets.select("doc_id", F.col("signature").alias("of"), "minima")
    members = groups.select(F.col("rep").alias("doc_id"), "signature", "copies").join(own.hint("merge"), "doc_id").where("signature = of").dropDuplicates(["doc_id"])
    members = scratch.write(members.select(F.col("doc_id").alias("rep"), "copies", "minima"), "members")

    # For the deepest leaves: members of large buckets go on with the same runs.
    runs = runs_needed(threshold, recall, DEPTHS[-1])
    found = _descend(members.select("rep", "minima"), DEPTHS[0], threshold, runs)
    leaves: DataFrame | None = None
    tables = [members]
    for depth, following in zip(DEPTHS, (*DEPTHS[1:], None)):
        found = scratch.write(found.distinct(), "paths")
        count = found.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        sized = scratch.write(found.join(count, "path"), "sized")
        tables.append(sized)
        scratch.drop(found)
        done = sized if following is None else sized.where(F.col("n") <= LIMIT)
        leaves = done if leaves is None else leaves.union(done)
        large = None if following is None else sized.where(F.col("n") > LIMIT)
        if large is None or large.isEmpty():
            break
        found = _descend(large.join(members, "rep").select("rep", "minima", "path"), following - depth, threshold)

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    per_rep = leaves.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("path", blocks.alias("blocks")))).alias("own"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = (_matrix(batch.column(2), "<u4", WIDTH) & 0xFF).astype("u1") if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in small], pa.binary()), batch.column(3)], ["rep", "copies", "sketch", "own"])

    joined = members.join(per_rep, "rep").select("rep", "copies", "minima", "own")
    joined = joined.mapInArrow(k.tidy(sketches), T.StructType([joined.schema["rep"], joined.schema["copies"], T.StructField("sketch", T.BinaryType()), joined.schema["own"]]))
    placed = joined.select("rep", "copies", "sketch", F.col("own.path").alias("leaves"), F.explode("own").alias("leaf")).select("rep", "copies", "sketch", "leaves", F.col("leaf.path").alias("path"), F.col("leaf.blocks").alias("blocks"))
    placed = _dealt(placed)
    likely = scratch.write(_likely(placed.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j"), least_common(threshold, recall)), "likely")

    wanted = likely.groupBy("rep").agg(F.first("copies").alias("copies"), F.first("leaves").alias("leaves"), F.collect_list(F.struct("path", "i", "j", "blocks")).alias("at"))
    # Always by sorting: the plan is the same at every size.
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id") == F.col("rep")).select("rep", "text", "copies", "leaves", "at")

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = k.texts_of(batch.column(1))
            for a, b in k.pieces(texts):
                own = [x.tobytes() for x in shingle_sets(texts.slice(a, b - a), n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 2, 3, 4)), pa.array(own, pa.binary())], ["rep", "copies", "leaves", "at", "tokens"])

    whole = texts.mapInArrow(k.tidy(shipped), T.StructType([texts.schema[c] for c in ("rep", "copies", "leaves", "at")] + [T.StructField("tokens", T.BinaryType())]))
    whole = whole.select("rep", "copies", "leaves", "tokens", F.explode("at").alias("at")).select("at.path", "at.i", "at.j", "at.blocks", "rep", "copies", "leaves", "tokens")
    checked = scratch.write(_verified(whole.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j"), threshold), "checked")

    scratch.drop(*tables, likely)
    roots = components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = groups.join(roots, F.col("rep") == F.col("node"), "left").join(links, "rep", "left").select("signature", "copies", F.coalesce("root", "rep").alias("class_id"), "links")
    out = sets.select("doc_id", "size", "signature").join(classes, "signature", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    return out.select(
        "doc_id", F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def _dealt(placed: DataFrame) -> DataFrame:
    """Each member of a bucket of several blocks once for every block pair that its block is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, blocks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(rep), 1000):
                s = slice(at, at + 1000)
                own = (k.mix(rep[s].view(np.uint64)) % blocks[s].astype(np.uint64)).astype(np.int64)
                row = np.repeat(np.arange(len(own)), blocks[s])
                other = np.arange(len(row)) - np.repeat(np.cumsum(blocks[s]) - blocks[s], blocks[s])
                i, j = np.minimum(own[row], other), np.maximum(own[row], other)
                take = pa.array(row)
                part = batch.slice(at, 1000)
                columns = [part.column(c).take(take) for c in range(6)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names)

    names = ["rep", "copies", "sketch", "leaves", "path", "blocks", "i", "j"]
    rows = placed.select(*names[:6])
    return rows.mapInArrow(k.tidy(run), T.StructType([*rows.schema.fields, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """The rows of ``docs`` that stand for their class: those with its least doc_id, each once.

    Rows without an id stay, and so do null and empty texts, which are classes of their own.
    Of several rows of one id the first by the hash of the text stays. Columns of any name are
    carried along.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    kept, row = unused(docs, "__kept", "__row")
    leaders = scratch.write(near_duplicates(docs, n, threshold, recall).where("doc_id = class_id").select(F.col("doc_id").alias(kept)).distinct(), "kept")
    found = docs.join(leaders.hint("merge"), F.col("doc_id") == F.col(kept))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return found.withColumn(row, first).where(F.col(row) == 1).select(*columns).unionByName(docs.where("doc_id IS NULL"))
