"""Passages that occur in several documents, by a sparse suffix array.

Only suffixes at minimiser positions are retained: the least of every WINDOW neighbouring
GRAM-word hashes, so that any SHORTEST words that two documents share hold a position that
both retain. Retained suffixes are sorted, neighbours are compared for their common
prefixes, and the matches are extended to the left and right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.llm import _kernels as k
from larkspur.llm._shared import Scratch, join_shared

#: Words that a passage has at least, words of a suffix's bucket, and hashes among which the least is retained.
SHORTEST, GRAM = 50, 8
WINDOW = SHORTEST - GRAM + 1
#: Suffixes of a bucket from which it is dealt out by 25 words to the right and by 25 to the left,
#: and from which its windows of SHORTEST words are counted by their hashes instead.
HOT, HOTTEST = 2000, 20_000
HALF = SHORTEST // 2
#: Suffixes compared at once.
AT_ONCE = 30_000


def _word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = k.buffers(texts)
    starts, ends, counts = k.words(raw, offsets)
    return k.Hasher(raw)(starts, ends), counts


def _minima(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of SHORTEST words within a text, the place retained for each, and the hashes of all GRAM words."""
    n = len(hashes) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(GRAM):
            grams = grams * k.U64(0xD6E8FEB86659FD93) + hashes[step : step + n]
    grams = k.mix(grams)
    rows = k.owners(counts)
    whole = np.flatnonzero(rows[: len(hashes) - SHORTEST + 1] == rows[SHORTEST - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    chosen = [own + least[own].argmin(1) for own in np.split(whole, range(1 << 16, len(whole), 1 << 16))]
    return whole, np.concatenate(chosen), grams


def _positions(docs: DataFrame) -> DataFrame:
    """gram, doc_id and pos (in words) of every retained suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False), k.texts_of(batch.column(1))
            for a, b in k.pieces(texts):
                hashes, counts = _word_hashes(texts.slice(a, b - a))
                _, chosen, grams = _minima(hashes, counts)
                places = np.unique(chosen)
                row = np.searchsorted(counts, places, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[places].view(np.int64)), pa.array(ids[a:b][row]), pa.array((places - counts[row]).astype(np.int32))], ["gram", "doc_id", "pos"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(k.tidy(run), "gram bigint, doc_id bigint, pos int")


def _wanted(places: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and bucket's size of each wanted place; rows that share an id share places, which a shorter text may lack."""
    row, flat = np.repeat(np.arange(len(places)), [len(x) for x in places]), places.flatten()
    pos, many = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False)
    held = pos < counts[row + 1] - counts[row]
    return row[held], pos[held], many[held]


def _suffixes(rows: DataFrame) -> DataFrame:
    """bucket, doc_id, pos and the words to the left (nearest first) and right, as 32-bit hashes, of the wanted suffixes.

    Of suffixes in buckets above HOTTEST, the windows of SHORTEST words that retain them come
    instead: the hash of their words as bucket, doc_id and where they start; left and right are null.
    """
    names = ["bucket", "doc_id", "pos", "left", "right"]

    def windows(ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, chosen, _ = _minima(hashes, counts)
        hottest = np.zeros(len(hashes), bool)
        hottest[places] = True
        starts = starts[hottest[chosen]]
        for at in range(0, len(starts), 20_000):
            own = starts[at : at + 20_000]
            key = _prefix_hash(hashes[own[:, None] + np.arange(SHORTEST)])
            row = np.searchsorted(counts, own, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array((own - counts[row]).astype(np.int32)), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), k.texts_of(batch.column(1))
            for a, b in k.pieces(texts, 1 << 20):
                hashes, counts = _word_hashes(texts.slice(a, b - a))
                small = np.concatenate([np.zeros(SHORTEST, np.uint32), (hashes >> k.U64(32)).astype("<u4"), np.zeros(SHORTEST, np.uint32)])
                row, pos, many = _wanted(batch.column(2).slice(a, b - a), counts)
                if len(over := np.flatnonzero(many > HOTTEST)):
                    yield from windows(ids[a:b], hashes, counts, counts[row[over]] + pos[over])
                    row, pos, many = np.delete(row, over), np.delete(pos, over), np.delete(many, over)
                for at in range(0, len(pos), 4000):
                    p, r = pos[at : at + 4000], row[at : at + 4000]
                    place = counts[r] + p + SHORTEST
                    right = small[place[:, None] + np.arange(SHORTEST)]
                    left = small[place[:, None] - 1 - np.arange(WINDOW - 1)]
                    r_size, l_size = np.minimum(SHORTEST, counts[r + 1] - counts[r] - p), np.minimum(WINDOW - 1, p)
                    gram = k.mix(_prefix_hash(right[:, :GRAM]))
                    hot = many[at : at + 4000] > HOT
                    by_right, by_left = k.mix(_prefix_hash(right[:, :HALF]) + k.U64(1)), k.mix(_prefix_hash(left[:, :HALF]) ^ gram + k.U64(2))
                    lefts = [x[:n].tobytes() for x, n in zip(left, l_size)]
                    rights = [x[:n].tobytes() for x, n in zip(right, r_size)]
                    for key, some in ((gram, ~hot), (by_right, hot & (r_size >= HALF)), (by_left, hot & (l_size >= HALF))):
                        at_some = np.flatnonzero(some)
                        if len(at_some):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(key[at_some].view(np.int64)), pa.array(ids[a:b][r[at_some]]), pa.array(p[at_some].astype(np.int32)), pa.array([lefts[i] for i in at_some], pa.binary()), pa.array([rights[i] for i in at_some], pa.binary())],
                                names,
                            )

    return rows.mapInArrow(k.tidy(run), "bucket bigint, doc_id bigint, pos int, left binary, right binary")


def _prefix_hash(words: np.ndarray) -> np.ndarray:
    out = np.full(len(words), 0x51ED270B, np.uint64)
    with np.errstate(over="ignore"):
        for column in words.T:
            out = k.mix(out * k.U64(0x9E3779B97F4A7C15) + column)
    return out


def _padded(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 32-bit hashes, filled up with 0, and how many each has; straight from the column's buffers."""
    out, sizes, at = np.zeros((len(column), width), np.uint32), np.zeros(len(column), np.int64), 0
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        own = sizes[at : at + len(chunk)] = np.diff(offsets) // 4
        if offsets[-1] > offsets[0]:
            out[at : at + len(chunk)][np.arange(width) < own[:, None]] = np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4")
        at += len(chunk)
    return out, sizes


def _compared(table: pa.Table, within: bool = False) -> pa.RecordBatch | None:
    """Sorted suffixes of whole buckets: doc_id, start and end of the words around each that another document has too, or with ``within`` another place."""
    bucket, doc, pos = (table.column(c).to_numpy() for c in range(3))
    left, l_size = _padded(table.column(3), WINDOW - 1)
    right, r_size = _padded(table.column(4), SHORTEST)
    # What neighbours in sorted order have in common; none across buckets.
    same = right[1:] == right[:-1]
    common = np.where(same.all(1), SHORTEST, same.argmin(1))
    common = np.minimum(common, np.minimum(r_size[1:], r_size[:-1]))
    common[bucket[1:] != bucket[:-1]] = -1
    low, high = np.full(len(doc), SHORTEST), np.full(len(doc), -1)
    before = np.full(len(doc), 0x51ED270B, np.uint64)
    for words in range(WINDOW):
        # Suffixes with as many words to the left, and in one run of neighbours that share the rest to the right.
        run = np.concatenate([[0], np.cumsum(common < SHORTEST - words)]).astype(np.uint64)
        some = np.flatnonzero((l_size >= words) & (r_size >= SHORTEST - words))
        if len(some):
            with np.errstate(over="ignore"):
                key = k.mix(run[some] * k.U64(0x9E3779B97F4A7C15) + before[some])
            order = np.argsort(key)
            key, own = key[order], some[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(doc[own], first) < np.maximum.reduceat(doc[own], first)
            if within:
                several |= np.minimum.reduceat(pos[own], first) < np.maximum.reduceat(pos[own], first)
            hit = own[np.repeat(several, np.diff(np.append(first, len(own))))]
            low[hit] = np.minimum(low[hit], words)
            high[hit] = np.maximum(high[hit], words)
        if words < WINDOW - 1:
            with np.errstate(over="ignore"):
                before = k.mix(before * k.U64(0x9E3779B97F4A7C15) + left[:, words])
    found = np.flatnonzero(high >= 0)
    if not len(found):
        return None
    return pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array((pos[found] - high[found]).astype(np.int64)), pa.array((pos[found] + SHORTEST - low[found]).astype(np.int64))], ["doc_id", "start", "end"])


def _matches(suffixes: DataFrame, within: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rest.append(batch.slice(at, AT_ONCE))
                size += rest[-1].num_rows
                if size >= AT_ONCE:
                    table = pa.Table.from_batches(rest)
                    bucket = table.column(0).to_numpy()
                    cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                    if cut:
                        out = _compared(table.slice(0, cut), within)
                        if out is not None:
                            yield out
                        rest = table.slice(cut).combine_chunks().to_batches()
                        size = table.num_rows - cut
        if size:
            out = _compared(pa.Table.from_batches(rest), within)
            if out is not None:
                yield out

    return suffixes.mapInArrow(k.tidy(run), "doc_id bigint, start bigint, end bigint")


def repeated_passages(docs: DataFrame, within: bool = False) -> DataFrame:
    """doc_id, n_words_repeated and spans for every row of ``docs`` that has an id.

    Spans are maximal runs of words, as ascending [start, end) in words of the whole text,
    each the union of passages of SHORTEST or more words that another document has as well,
    word for word; with ``within``, or the same document at another place. Words are runs
    without ASCII white space. Texts that are null or have
    fewer words have no spans; rows without an id take no part and are not returned; rows
    that share an id are one document, returned once for each row. Other columns are not read.

    Only hashes that two documents share go on; texts are shuffled once by id, and each
    suffix carries SHORTEST words to the right and WINDOW - 1 to the left, which is enough to
    decide about every passage of SHORTEST words that holds it. Buckets above HOT are dealt
    out by the next words on either side; a match has at least HALF words on one of them.
    Buckets above HOTTEST, whose neighbours may be equal for good, are never gathered: every
    window of SHORTEST words whose retained suffix is in one of them is counted by its hash, in
    partial aggregates. What a window retains depends on its words alone, so equal windows take
    the same way.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    thin = scratch.write(_positions(docs), "positions")
    several = "a < b OR n > 1" if within else "a < b"
    counts = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    total = lambda rows: rows.agg(F.count("*").alias("total"))
    shared = scratch.write(counts(thin, "gram").where(several).select("gram", "n"), "shared")
    wanted = scratch.write(join_shared(thin, shared, "gram", total(thin)).select("doc_id", "pos", "n"), "wanted")
    scratch.drop(thin, shared)

    own = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "n")).alias("wanted"))
    rows = scratch.write(_suffixes(docs.select("doc_id", "text").join(own, "doc_id").select("doc_id", "text", "wanted")), "rows")
    scratch.drop(wanted)
    suffixes = rows.where("right IS NOT NULL").repartition("bucket").sortWithinPartitions("bucket", "right")
    spans = scratch.write(_matches(suffixes, within), "spans")
    windows = rows.where("right IS NULL").select(F.col("bucket").alias("key"), "doc_id", F.col("pos").alias("start"))
    if not windows.isEmpty():
        places = scratch.write(counts(windows.distinct() if within else windows, "key").where(several).select("key", "n"), "places")
        repeated = join_shared(windows, places, "key", total(windows))
        # Windows that start within SHORTEST words overlap, so that the first and last of them span all.
        block = F.floor(F.col("start") / SHORTEST).alias("block")
        span = repeated.groupBy("doc_id", block).agg(F.min("start").cast("long").alias("start"), (F.max("start") + SHORTEST).cast("long").alias("end"))
        more = scratch.write(span.drop("block"), "spans")
        scratch.drop(places)
        spans = spans.unionByName(more)
    scratch.drop(rows)
    ordered = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("all"))
    merged = F.aggregate(
        "all", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    found = ordered.select("doc_id", merged.alias("spans"))
    nothing = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    out = docs.select("doc_id").where("doc_id IS NOT NULL").join(found, "doc_id", "left").select("doc_id", F.coalesce("spans", nothing).alias("spans"))
    return out.select("doc_id", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_words_repeated"), "spans")
