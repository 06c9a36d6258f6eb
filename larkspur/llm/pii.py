"""Personal data: fixed formats, and further spans that boosted trees choose among candidates.

Generators with high recall propose spans, which may overlap. Gradient boosted trees judge
each by its format and context; a threshold calibrated on held-out examples selects. The
examples are made by a seeded generator, so the model is the same everywhere.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from larkspur.llm import _kernels as k

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "account", "contact")
KINDS = BASE_KINDS + ADDED_KINDS
EXAMPLES = 6000
#: Rows whose candidates are scored together.
ROWS_AT_ONCE = 500

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @, the local part to its left that no earlier match holds: linear in long words."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed formats, by kind, in code points with exclusive ends."""
    out = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) < 60 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


#: Each generator's kind and pattern; all need a digit, an @ or a word for it, which _MAYBE finds.
GENERATORS = (
    ("secret", re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|auth)[\x20]?[=:][\x20]?[\"']?[^\s\"']{6,}+")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("account", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){7,18}(?![0-9A-Za-z])")),
    ("contact", re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    ("contact", re.compile(r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]{2,}+)+")),
    ("contact", re.compile(r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){4,7}[0-9a-f]{1,4}(?![0-9a-f:])")),
)
#: The generator of unbroken runs, which must hold a digit somewhere.
_RUNS = 1
_DIGIT = re.compile("[0-9]")
_MAYBE = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key|auth)[\x20]?[=:]|(?i:[\[(]\x20?at\x20?[\])])")
_WORDS = ("password", "token", "secret", "key", "ssn", "account", "iban", "phone", "call", "contact", "mail", "order", "invoice", "version", "build", "page", "isbn", "commit", "date", "id", "sha", "md5", "hash", "digest", "http", "file", "of")


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start, end and generator of every proposal; they may overlap."""
    return [(kind, *m.span(), g) for g, (kind, pattern) in enumerate(GENERATORS) for m in pattern.finditer(text) if g != _RUNS or _DIGIT.search(text, *m.span())]


def features(text: str, start: int, end: int, generator: int) -> list[float]:
    """Format of the span and what stands around it."""
    span, left, right = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 4]
    n = len(span)
    counts = Counter(span)
    digits = sum(c.isdigit() for c in span)
    only = "".join(c for c in span if c.isdigit())
    upper, lower = sum(c.isupper() for c in span), sum(c.islower() for c in span)
    switches = sum((a.isdigit() != b.isdigit()) for a, b in zip(span, span[1:]))
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    head = span.lower()
    return [
        n, digits / n, upper / n, lower / n, sum(c in "0123456789abcdef" for c in span) / n, entropy, switches / n,
        sum(c in " -" for c in span) / n, sum(c in "=:" for c in span), sum(c in "/_" for c in span) / n, len(only), float(13 <= len(only) <= 19 and _luhn(only)), float(only[:2] in ("19", "20")),
        float(left.endswith(("=", ": ", ":", '"', "'", "= "))), float(right[:1] in ('"', "'", ".", ",", "", " ", "\n")), float(span[:1] == "0"),
        *[float(generator == g) for g in range(len(GENERATORS))], *[float(w in left or head.startswith(w)) for w in _WORDS],
    ]


def _examples(seed: int, n: int) -> Iterator[tuple[str, bool]]:
    """A text around each span marked by \\x02 and \\x03, and whether the span is personal."""
    r = random.Random(seed)
    some = lambda chars, a, b=0: "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: some(low, 2, 9)
    personal = (
        lambda: ("", f"password={some(hexa, 8, 24)}"),
        lambda: ("", f"{r.choice(('pwd', 'Password', 'secret', 'passwd'))}{r.choice(('=', ': ', ' = '))}{some(low + up + dig + '!#$', 8, 20)}"),
        lambda: (r.choice(("", "api_key = \"", "key: ", word() + " ")), some(low + up + dig, 24, 48)),
        lambda: ("", f"token{r.choice((' = ', '=', ': '))}\"{some(hexa, 32, 40)}"),
        lambda: (word() + " ", r.choice(("AKIA", "ASIA", "SK", "AIza", "ghp_")) + some(up + dig, 16, 30)),
        lambda: (r.choice(("ssn ", "SSN: ", word() + " ")), f"{some('12345678', 3)}-{some(dig, 2)}-{some(dig, 4)}"),
        lambda: (r.choice(("iban ", "IBAN: ", word() + " ")), some(up, 2) + some(dig, 2) + some(dig, 12, 18)),
        lambda: (r.choice(("account ", "account no: ")), some(dig, 8, 12)),
        lambda: (r.choice(("call ", "phone: ", "tel ", word() + " ")), f"({some('23456789', 3)}) {some(dig, 3)}-{some(dig, 4)}"),
        lambda: (r.choice(("mail ", "contact ", "")), f"{word()}.{word()} [at] {word()} [dot] com"),
        lambda: (word() + " ", ":".join(some(hexa, 4) for _ in range(8))),
    )
    harmless = (
        lambda: (r.choice(("order ", "invoice ", "page ", "build ", "id ", word() + " ")), some(dig, 8, 12)),
        lambda: (r.choice(("version ", "date ", word() + " ")), f"{r.choice(('19', '20'))}{some(dig, 2)}-{some('01', 1)}{some('12', 1)}-{some('012', 1)}{some('1234', 1)}"),
        lambda: (r.choice(("isbn ", "ISBN: ")), f"978-{some(dig, 1)}-{some(dig, 4)}-{some(dig, 4)}-{some(dig, 1)}"),
        lambda: (r.choice(("commit ", "build ", "sha1 ", "sha256 ", "md5 ", "hash ", "digest ", "hash: ", "sha1: ")), some(hexa, r.choice((32, 40, 64)))),
        lambda: (r.choice(("https://", "http://", "see https://www.")), "/".join((word(), *(f"{word()}{r.choice(('-', '_', ''))}{some(dig, 1, 4)}" if r.random() < 0.5 else word() for _ in range(r.randint(2, 5)))))),
        lambda: (word() + " ", "-".join(word() for _ in range(4)) + "-" + some(dig, 1, 2)),
        lambda: (word() + " ", "_".join(word() for _ in range(3)) + some(dig, 1, 3)),
        lambda: (word() + " ", "=" * r.randint(10, 30) + some(dig, 1) + "=" * r.randint(5, 20)),
        lambda: (word() + " ", " ".join(some(dig, 1, 2) for _ in range(r.randint(8, 14)))),
        lambda: ("", f"{r.choice(('token', 'secret', 'password'))}: {word()}ing"),
        lambda: (r.choice(("file ", "page ", "")), f"/{word()}/{word()}-{some(dig, 1, 4)}/{word()}_{some(dig, 1, 3)}.{r.choice(('html', 'png', 'txt'))}"),
        lambda: (r.choice(("see ", "")), f"http://{word()}.example/{word()}/{word()}/{some(dig, 3, 8)}"),
        lambda: (r.choice(("section ", "chapter ", "sec ")), f"{some('123456789', 3)}-{some(dig, 2)}-{some('123456789', 1, 3)}"),
        lambda: (word() + " ", f"{some(dig, 3)} {some(dig, 3)} {some(dig, 3)} {some(dig, 3)}"),
        lambda: (r.choice(("version ", "release ")), f"{some(dig, 1, 2)}.{some(dig, 3)}.{some(dig, 4)}"),
        lambda: (r.choice(("total ", "sum ", "number ")), some(dig, 13, 19)),
        lambda: (r.choice(("from ", "between ")), f"{r.choice(('18', '19', '20'))}{some(dig, 2)} {r.choice(('18', '19', '20'))}{some(dig, 2)} {r.choice(('18', '19', '20'))}{some(dig, 2)}"),
        lambda: (r.choice(("at ", "time ")), ":".join(some("012345", 2) for _ in range(r.randint(5, 6)))),
    )
    for i in range(n):
        yes = i % 2 == 0
        before, span = r.choice(personal if yes else harmless)()
        yield f"{word()} {word()} {before}\x02{span}\x03{r.choice((' ', '. ', ', ', '', chr(34)))}{' ' if r.random() < 0.5 else ''}{word()} {word()}", yes


class BoostedTrees:
    """Logistic gradient boosting of shallow trees over quantile cuts."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 12):
        self.rounds, self.depth, self.rate, self.cuts, self.threshold = rounds, depth, rate, cuts, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        values = [np.unique(np.quantile(c, np.linspace(0, 1, self.cuts + 2)[1:-1])) for c in x.T]
        tests = [(f, v) for f, vs in enumerate(values) for v in vs]
        above = np.stack([x[:, f] > v for f, v in tests], 1).astype(np.float64)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p) + 1e-6
            node, tree = np.zeros(len(y), np.int64), {}
            for at in range(2**self.depth - 1):
                own = node == at
                if own.sum() < 8:
                    tree[at] = None
                    continue
                g, h = gradient[own], weight[own]
                ga, ha = above[own].T @ g, above[own].T @ h
                gain = ga**2 / (ha + 1) + (g.sum() - ga) ** 2 / (h.sum() - ha + 1)
                best = int(np.argmax(gain))
                tree[at] = tests[best]
                node[own] = 2 * at + 1 + above[own, best].astype(np.int64)
            leaves = {int(n): float(self.rate * gradient[node == n].sum() / (weight[node == n].sum() + 1)) for n in np.unique(node)}
            margin += np.array([leaves[int(n)] for n in node])
            self.trees.append((tree, leaves))
        return self

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of many rows at once: all trees as arrays of tests, walked level by level."""
        if not hasattr(self, "_arrays"):
            size = 2**self.depth - 1
            feature, value, leaf = np.full((len(self.trees), size), -1), np.zeros((len(self.trees), size)), np.zeros((len(self.trees), 2 * size + 1))
            for t, (tree, leaves) in enumerate(self.trees):
                for at, test in tree.items():
                    if test:
                        feature[t, at], value[t, at] = test
                for at, v in leaves.items():
                    leaf[t, at] = v
            self._arrays = feature, value, leaf
        margin, index = np.full(len(rows), self.start), np.arange(len(rows))
        for feature, value, leaf in zip(*self._arrays):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                inner = node < len(feature)
                f = np.where(inner, feature[np.minimum(node, len(feature) - 1)], -1)
                go = f >= 0
                node = np.where(go, 2 * node + 1 + (rows[index, np.maximum(f, 0)] > value[np.minimum(node, len(feature) - 1)]), node)
            margin += leaf[node]
        return 1 / (1 + np.exp(-margin))


@lru_cache(maxsize=4)
def trained(seed: int = 11, examples: int = EXAMPLES, precision: float = 0.99) -> BoostedTrees:
    """Trees fitted on two thirds of the examples; the threshold is the least with ``precision`` on the rest."""
    rows, truth = [], []
    for text, yes in _examples(seed, examples):
        start, end = text.index("\x02"), text.index("\x03") - 1
        plain = text.replace("\x02", "").replace("\x03", "")
        for kind, a, b, g in candidates(plain):
            inside = a >= start - 1 and b <= end + 1
            if inside and b - a >= 0.6 * (end - start):
                rows.append(features(plain, a, b, g))
                truth.append(yes)
    x, y = np.array(rows), np.array(truth, float)
    cut = 2 * len(y) // 3
    model = BoostedTrees().fit(x[:cut], y[:cut])
    scores = model.scores(x[cut:])
    order = np.argsort(-scores)
    good = np.cumsum(y[cut:][order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(good >= precision)
    model.threshold = float(scores[order][enough[-1]]) if len(enough) else 1.1
    return model


Found = tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]


def find_spans(text: str, model: BoostedTrees) -> Found:
    """The base spans by kind, and all spans, of one text."""
    return find_all([text], model)[0]


def find_all(texts: list[str], model: BoostedTrees) -> list[Found]:
    """``find_spans`` of many texts, whose candidates are scored together.

    An added span overlaps no base span and no added span of a higher score; of equal scores
    the longer one goes first, then the one further left.
    """
    base = [base_spans(x) if _MAYBE.search(x) else None for x in texts]
    proposed = [(i, kind, a, b, g) for i, x in enumerate(texts) if base[i] is not None for kind, a, b, g in candidates(x)]
    rows = np.array([features(texts[i], a, b, g) for i, _, a, b, g in proposed], float)
    scores = model.scores(rows) if len(rows) else np.zeros(0)
    added: dict[int, list[tuple]] = {}
    for (i, kind, a, b, _), score in zip(proposed, scores.tolist()):
        if score >= model.threshold:
            added.setdefault(i, []).append((-score, a - b, a, b, kind))
    out: list[Found] = []
    for i, own in enumerate(base):
        if own is None:
            out.append(({x: [] for x in BASE_KINDS}, []))
            continue
        every = [(kind, a, b) for kind in BASE_KINDS for a, b in own[kind]]
        starts, ends = _merged(sorted((a, b) for _, a, b in every))
        for _, _, a, b, kind in sorted(added.get(i, ())):
            # Covered stretches are apart from each other, so the last one that begins before the end decides.
            at = bisect.bisect_left(starts, b)
            if not at or ends[at - 1] <= a:
                starts.insert(at, a)
                ends.insert(at, b)
                every.append((kind, a, b))
        out.append((own, sorted(every, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what sorted spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in spans:
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for kind, a, b in spans])


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and digest of base spans, and all spans as text.

    A null text is empty and has no spans. Ids may be null or repeat; other columns are not
    read. One pass, no shuffle; candidates and spans of a text are never capped.
    """
    names = ["n_email", "n_ip", "n_card", "n_phone"]
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in names] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                rows = []
                for base, every in find_all(k.texts_of(batch.column(1)).to_pylist(), model):
                    own = [(kind, a, b) for kind in BASE_KINDS for a, b in base[kind]]
                    rows.append((*(len(base[x]) for x in BASE_KINDS), hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(every)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]], schema.names)

    return docs.select("doc_id", "text").mapInArrow(k.tidy(run), schema)


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every span in the text column redacted; its other columns, of any name, and null texts stay as they are.

    Empty and very long texts, repeated rows and empty tables give as many rows as they have.
    One pass, no shuffle.
    """
    schema, at, model = docs.schema, docs.columns.index(text_column), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                given = batch.column(at).to_pylist()
                found = find_all([x or "" for x in given], model)
                texts = [None if x is None else redact(x, every) for x, (_, every) in zip(given, found)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], schema.names)

    return docs.mapInArrow(k.tidy(run), schema)
