"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

The tree's leaves are the byte positions of a piece of text; each holds the rank of the
pair that begins there, and each inner node the leftmost minimum below it. A merge reads
the root, joins two live neighbours and updates three leaves up to the root.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from larkspur.llm import _kernels as k

NONE = 1 << 30
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Pieces up to so many bytes are merged side by side; longer ones one by one.
SIDE_BY_SIDE = 64


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = {i: t for t, i in ranks.items()}
        parts, merged = [], []
        # Two tokens merge where the bytes of both are a token; every split of a token is such a pair.
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    parts.append((a << 20) | b)
                    merged.append(rank)
        order = np.argsort(parts)
        self.pairs, self.merged = np.array(parts, np.int64)[order], np.array(merged, np.int64)[order]
        self.by_pair = dict(zip(self.pairs.tolist(), self.merged.tolist()))
        #: Ids of pieces that were met before, as little-endian unsigned 32-bit integers.
        self.pieces: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def encode_long(self, piece: bytes) -> bytes:
        """One piece: a scalar segment tree, n merges of log n steps each."""
        n = len(piece)
        size = 1 << max(0, n - 1).bit_length()
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = self.by_pair.get((ids[i] << 20) | ids[i + 1], NONE)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, rank: int) -> None:
            node = size + i
            tree[node] = rank
            node >>= 1
            while node:
                low = tree[2 * node] if tree[2 * node] <= tree[2 * node + 1] else tree[2 * node + 1]
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while size > 1 and tree[1] < NONE:
            low, node = tree[1], 1
            while node < size:
                node *= 2
                if tree[node] != low:
                    node += 1
            i = node - size
            j = after[i]
            ids[i], ids[j] = low, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, NONE)
            put(i, self.by_pair.get((ids[i] << 20) | ids[after[i]], NONE) if after[i] < n else NONE)
            if before[i] >= 0:
                put(before[i], self.by_pair.get((ids[before[i]] << 20) | ids[i], NONE))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_side_by_side(self, found: list[bytes]) -> list[bytes]:
        """Many pieces: the same tree for each, and one merge in every live piece at a time."""
        m = len(found)
        lengths = np.fromiter(map(len, found), np.int64, m)
        size = 1 << max(1, int(lengths.max() - 1)).bit_length() if lengths.max() > 1 else 2
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in found), np.uint8).reshape(m, size)
        ids = np.where(np.arange(size) < lengths[:, None], self.single[raw], -1)
        after = np.tile(np.arange(1, size + 1), (m, 1))
        before = np.tile(np.arange(-1, size - 1), (m, 1))
        tree = np.full((m, 2 * size), NONE, np.int64)
        has = np.arange(size - 1) < lengths[:, None] - 1
        tree[:, size : 2 * size - 1] = np.where(has, self.pair_ranks(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), NONE)
        level = size >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1

        def put(row: np.ndarray, i: np.ndarray, rank: np.ndarray) -> None:
            node = size + i
            tree[row, node] = rank
            node = node >> 1
            while node[0]:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node = node >> 1

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            low, node = tree[live, 1], np.ones(len(live), np.int64)
            while node[0] < size:
                node = 2 * node
                node += tree[live, node] != low
            i = node - size
            j = after[live, i]
            ids[live, i], ids[live, j] = low, -1
            nxt = after[live, j]
            after[live, i] = nxt
            ends = nxt >= lengths[live]
            inside = np.minimum(nxt, size - 1)
            before[live[~ends], nxt[~ends]] = i[~ends]
            put(live, j, NONE)
            put(live, i, np.where(ends, NONE, self.pair_ranks(low, np.maximum(ids[live, inside], 0))))
            prior = before[live, i]
            has_prior = np.flatnonzero(prior >= 0)
            if len(has_prior):
                row, p = live[has_prior], prior[has_prior]
                put(row, p, self.pair_ranks(ids[row, p], low[has_prior]))
            live = live[tree[live, 1] < NONE]
        return [row[row >= 0].astype("<u4").tobytes() for row in ids]

    def learn(self, wanted: set[str]) -> None:
        """Encodes the pieces that are not remembered yet; all of ``wanted`` are known afterwards."""
        new = [x for x in wanted if x not in self.pieces]
        if len(self.pieces) + len(new) > REMEMBERED:
            self.pieces.clear()
            new = list(wanted)
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
            elif len(data) > SIDE_BY_SIDE:
                self.pieces[piece] = self.encode_long(data)
            else:
                groups.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
        for group in groups.values():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                for (piece, _), ids in zip(part, self.encode_side_by_side([x for _, x in part])):
                    self.pieces[piece] = ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.find = vocabulary(path), regex.compile(pattern).findall

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text as unsigned 32-bit integers. Text outside every match of the pattern gives no token."""
        found = [self.find(text) for text in texts]
        self.vocabulary.learn(set().union(*found))
        known = self.vocabulary.pieces
        return [np.frombuffer(b"".join([known[x] for x in pieces]), "<u4") for pieces in found]

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids, counts and digests of each row's whole text, and the digest of what the ids decode to.

    ``path`` names the rank file, which has to be on every executor. A null text is empty: no
    tokens. Ids may repeat or be null; other columns are not read. One pass, no shuffle;
    ``with_ids`` adds the ids as an array of longs.
    """
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + [T.StructField("token_ids", T.ArrayType(T.LongType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        try:
            for batch in batches:
                texts = k.texts_of(batch.column(1))
                for at, end in k.pieces(texts, 1 << 22):
                    ids = encoder.encode_all(texts.slice(at, end - at).to_pylist())
                    digests = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
                    decoded = [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]
                    columns = [batch.column(0).slice(at, end - at), pa.array(map(len, ids), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] * with_ids, schema.names)
        finally:
            encoder.vocabulary.pieces.clear()  # a worker lives on for other tasks

    return docs.select(id_column, text_column).mapInArrow(k.tidy(run), schema)
