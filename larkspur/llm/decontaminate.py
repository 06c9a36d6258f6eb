"""Benchmark decontamination by the q-gram lemma.

An item of m bytes that occurs in a text with at most e edits shares at least
m + 1 - q * (e + 1) of its q-grams with it, all within e diagonals of each other. Shared
q-grams are counted in overlapping bands of diagonals; bands that reach the bound are
verified by banded alignment. Text and items are compared in lower case, with every run
of ASCII characters other than letters and digits as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.llm import _kernels as k
from larkspur.llm._shared import unused

Q = 8
EDIT_RATE = 0.05
#: Edits at most in an item of any length.
MOST_EDITS = 512
#: Items with fewer bytes than this when normalised are looked for without edits, as whole words.
LEAST_BYTES = 24
#: Items go to the executors in blocks of at most so many bytes; each block is one pass over the documents.
BLOCK_BYTES = 8 << 20
#: Bytes of all items together at most: they travel through the driver. More are asked for in several calls.
MOST_BYTES = 256 << 20
#: Matches of probe q-grams with items that are looked at together.
AT_ONCE = 1 << 21
_TABLE_BITS = 22
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def _lower(text: str) -> bytes:
    return text.lower().encode()


def _folded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folds bytes and drops spaces that follow a space; returns the bytes and the texts' new offsets."""
    folded = _FOLD[raw]
    kept = np.ones(len(folded), bool)
    space = folded == 32
    kept[1:] = ~(space[1:] & space[:-1])
    kept[offsets[:-1][offsets[:-1] < len(kept)]] = True
    before = np.zeros(len(kept) + 1, np.int32)
    np.cumsum(kept, out=before[1:])
    return folded[kept], before[offsets].astype(np.int64)


def normalised(text: str | None) -> bytes:
    raw = np.frombuffer(_lower(text or ""), np.uint8)
    return _folded(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")


def _grams(raw: np.ndarray) -> np.ndarray:
    """The q-gram at each position as a 64-bit number."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, Q)).view("<u8").ravel()


def within(item: bytes, region: bytes, shift: int, reach: int, edits: int) -> bool:
    """Whether ``item`` aligns to a part of ``region`` with at most ``edits`` edits, inside the diagonals shift - reach to shift + reach."""
    if item in region:
        return True
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    width = 2 * reach + 1
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    column = shift - reach + steps
    row[(column < 0) | (column > len(b))] = 1 << 20
    for i, c in enumerate(a):
        column = i + 1 + shift - reach + steps
        valid = (column >= 0) & (column <= len(b))
        at = np.clip(column - 1, 0, max(0, len(b) - 1))
        same = (b[at] != c) if len(b) else np.ones(width, bool)
        new = row + np.where((column >= 1) & valid, same, 1 << 20)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where(valid, new, 1 << 20)
        row = np.minimum.accumulate(new - steps) + steps
        row = np.where(valid, row, 1 << 20)
        if row.min() > edits:
            return False
    return bool(row.min() <= edits)


#: Items of more bytes are aligned by the furthest points that each number of edits reaches.
LONG = 4096


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes at the front of both are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, min(4 * step, 1 << 16)
    return n


def within_far(item: bytes, region: bytes, shift: int, reach: int, edits: int) -> bool:
    """What ``within`` says, in work that grows with edits times diagonals instead of with the item's length times diagonals."""
    if item in region:
        return True
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    m, n, least = len(a), len(b), shift - reach
    none = -2
    far = [none] * (2 * reach + 3)  # one diagonal more on either side is never reached
    for e in range(edits + 1):
        new = list(far)
        for at in range(1, len(far) - 1):
            d = least + at - 1
            i = max(far[at] + 1 if far[at] >= 0 else none, far[at - 1], far[at + 1] + 1 if far[at + 1] >= 0 else none) if e else none
            if 0 <= d <= n:
                i = max(i, 0)
            i = min(i, m, n - d)
            if i < 0 or i + d < 0:
                continue
            i += _equal_run(a[i:], b[i + d :])
            if i >= m:
                return True
            new[at] = max(i, far[at])
        far = new
    return False


class ItemIndex:
    """The items of a block: q-grams of the longer ones, and an automaton of the short ones.

    An item that shares ``least`` of its q-grams with a text shares one of any len - least + 1
    of them; the rarest of these among the items are its probes. Only probes lead to items.
    """

    def __init__(self, items: list[tuple[int, bytes]], edit_rate: float = EDIT_RATE):
        self.items = [x for x in items if len(x[1]) >= LEAST_BYTES]
        self.short = _automaton([x for x in items if 0 < len(x[1]) < LEAST_BYTES])
        self.edits = np.array([min(int(edit_rate * len(t)), (len(t) + 1) // Q - 2, MOST_EDITS) for _, t in self.items], np.int64)
        self.least = np.array([len(t) + 1 - Q * (e + 1) for (_, t), e in zip(self.items, self.edits)], np.int64)
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.grams = [_grams(np.frombuffer(t, np.uint8)) for _, t in self.items]
        every = np.concatenate(self.grams) if self.grams else np.zeros(0, np.uint64)
        self.values, counts = np.unique(every, return_counts=True)
        item, offset, place = [], [], []
        for i, own in enumerate(self.grams):
            at = np.searchsorted(self.values, own)
            rare = np.argsort(counts[at], kind="stable")[: len(own) - self.least[i] + 1]
            item.append(np.full(len(rare), i))
            offset.append(rare)
            place.append(at[rare])
        place = np.concatenate(place) if place else np.zeros(0, np.int64)
        order = np.argsort(place, kind="stable")
        self.item, self.offset = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (item, offset))
        self.first = np.searchsorted(place[order], np.arange(len(self.values) + 1))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.values)] = True
        self.order = [np.argsort(g, kind="stable") for g in self.grams]

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def find(self, texts: pa.StringArray) -> list[list[int]]:
        """The ids of the items that each text holds, ascending."""
        found: list[list[int]] = []
        for a, b in k.pieces(texts):
            found += self._find(texts.slice(a, b - a))
        return found

    def _find(self, texts: pa.StringArray) -> list[list[int]]:
        out: list[set] = [set() for _ in range(len(texts))]
        lowered = [_lower(x) for x in texts.to_pylist()]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw, offsets = _folded(np.frombuffer(b"".join(lowered), np.uint8), offsets)
        if self.short is not None:
            for p in range(len(out)):
                out[p] |= _short_items(self.short, raw[offsets[p] : offsets[p + 1]].tobytes().decode())
        grams = _grams(raw)
        if not len(grams) or not len(self.values):
            return [sorted(x) for x in out]
        at = np.flatnonzero(self.table[self._slot(grams)])
        place = np.minimum(np.searchsorted(self.values, grams[at]), len(self.values) - 1)
        real = self.values[place] == grams[at]
        at, place = at[real], place[real]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, place, row = at[inside], place[inside], row[inside]
        hits = np.zeros(len(raw) + 1, np.int64)
        hits[at + 1] = 1
        np.cumsum(hits, out=hits)
        bounds = np.searchsorted(row, np.arange(len(out) + 1))
        for p, i in self._candidates(at, place, row, hits, len(raw)):
            if self.items[i][0] not in out[p]:
                own = slice(bounds[p], bounds[p + 1])
                if self._holds(i, raw[offsets[p] : offsets[p + 1]], at[own] - offsets[p], grams[at[own]]):
                    out[p].add(self.items[i][0])
        return [sorted(x) for x in out]

    def _candidates(self, at: np.ndarray, place: np.ndarray, row: np.ndarray, hits: np.ndarray, end: int) -> list[tuple[int, int]]:
        """Texts and items where a probe lies among enough shared q-grams of any kind, on the bytes that an occurrence there can take."""
        many = self.first[place + 1] - self.first[place]
        upto = np.cumsum(many)
        pairs: set[int] = set()
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + AT_ONCE, "right")))
            own = many[start:stop]
            which = np.repeat(np.arange(start, stop), own)
            posting = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.first[place[start:stop]], own)
            item = self.item[posting]
            begin = at[which] - self.offset[posting]
            low = np.maximum(begin - self.edits[item], 0)
            high = np.clip(begin + self.size[item] + self.edits[item] + 1, 0, end)
            dense = hits[high] - hits[low] >= self.least[item]
            pairs.update(np.unique(row[which[dense]] * len(self.items) + item[dense]).tolist())
            start = stop
        return [divmod(x, len(self.items)) for x in sorted(pairs)]

    def _holds(self, i: int, text: np.ndarray, pos: np.ndarray, grams: np.ndarray) -> bool:
        """Counts the q-grams that text and item share in overlapping bands of diagonals and aligns where they suffice."""
        order, edits, item = self.order[i], int(self.edits[i]), self.items[i][1]
        own = self.grams[i][order]
        first, last = np.searchsorted(own, grams, "left"), np.searchsorted(own, grams, "right")
        many = last - first
        which = np.repeat(np.arange(len(pos)), many)
        offset = order[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        # A band spans 2 * (edits + 1) diagonals and begins every edits + 1: any edits + 1 neighbours lie within one.
        diagonal = pos[which] - offset
        half = (diagonal + len(item)) // (edits + 1)
        bands, counts = np.unique(np.concatenate([half, half - 1]), return_counts=True)
        ordered, failed = np.sort(diagonal), set()
        for h in bands[counts >= self.least[i]].tolist():
            first, last = np.searchsorted(ordered, [h * (edits + 1) - len(item), (h + 2) * (edits + 1) - len(item)])
            low, high, allowed = int(ordered[first]), int(ordered[last - 1]), min(8, edits)
            while True:  # few edits are tried first, on as few diagonals
                start, end = max(0, low - allowed), min(len(text), high + len(item) + allowed)
                middle = (low + high) // 2
                task = text[start : max(start, end)].tobytes(), middle - start, high - middle + 1 + allowed, allowed
                if task not in failed:  # a text that repeats itself asks the same again
                    if (within_far if len(item) > LONG else within)(item, *task):
                        return True
                    failed.add(task)
                if allowed == edits:
                    break
                allowed = min(4 * allowed, edits)
        return False


def _automaton(items: list[tuple[int, bytes]]):
    """Finds all short items in one walk over a text; None without any."""
    import ahocorasick

    ids: dict[str, list[int]] = {}
    for i, item in items:
        ids.setdefault(item.decode(), []).append(i)
    if not ids:
        return None
    out = ahocorasick.Automaton()
    for text, own in ids.items():
        out.add_word(text, (len(text), own))
    out.make_automaton()
    return out


def _short_items(automaton, text: str) -> set[int]:
    """Ids of the short items that stand in a text as whole words; beside a letter beyond ASCII any place will do."""
    found: set[int] = set()
    for end, (size, ids) in automaton.iter(text):
        start = end + 1 - size
        left = start == 0 or not (text[start].isascii() and text[start - 1].isascii()) or text[start - 1] == " "
        right = end + 1 == len(text) or not (text[end].isascii() and text[end + 1].isascii()) or text[end + 1] == " "
        if left and right:
            found.update(ids)
    return found


def _blocks(benchmark: DataFrame, id_column: str) -> Iterator[list[tuple[int, bytes]]]:
    items = benchmark.select(id_column, "text").where(F.col("text").isNotNull() & F.col(id_column).isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MOST_BYTES:
        raise ValueError(f"the items have {total} bytes; at most {MOST_BYTES} are looked for in one call")
    block, size = [], 0
    for row in items.orderBy(id_column, "text").toLocalIterator():
        item = normalised(row[1])
        if block and size + len(item) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], item))
        size += len(item)
    yield block


def find_items(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """``columns`` of ``docs`` (its doc_id by default) with the ids of the benchmark items that each row's whole text holds, and that column's name.

    Benchmark items are the query set, of at most MOST_BYTES: they go to the executors in
    blocks of bounded size, and each block is one pass over ``docs`` without a shuffle. Rows
    with null or empty text hold none; null items, empty ones and repeated ones add nothing.
    Items of less than LEAST_BYTES are found without edits, where they stand as whole words.
    Repeated rows give repeated results; columns of any name are carried along.
    """
    columns = columns or ["doc_id"]
    kept = [*columns, *([] if "text" in columns else ["text"])]
    result, name = docs.select(*[F.col(f"`{c}`") for c in kept]), unused(docs, "__item_ids")[0]
    for n, block in enumerate(_blocks(benchmark, "item_id")):
        result = _pass(result, kept.index("text"), block, edit_rate, name, n > 0)
    return result.select(*[F.col(f"`{c}`") for c in columns], name), name


def _pass(df: DataFrame, at: int, block: list[tuple[int, bytes]], edit_rate: float, name: str, earlier: bool) -> DataFrame:
    schema = df.schema if earlier else T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])
    n = len(schema) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(block, edit_rate)
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                found = index.find(k.texts_of(batch.column(at)))
                if earlier:
                    found = [sorted({*x, *y}) for x, y in zip(found, batch.column(n).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, pa.list_(pa.int64()))], schema.names)

    return df.mapInArrow(k.tidy(run), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, contaminated and item_ids for every row of ``docs``."""
    found, name = find_items(docs, benchmark, edit_rate)
    return found.select("doc_id", (F.size(name) > 0).alias("contaminated"), F.col(name).alias("item_ids"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text holds no benchmark item."""
    found, name = find_items(docs, benchmark, edit_rate, docs.columns)
    return found.where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
