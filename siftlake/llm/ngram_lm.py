"""Interpolated modified Kneser-Ney language model over hashed n-grams.

Counting runs in Spark, words first: every distinct word gets a number, the
frequent ones small numbers, kept with its count in sorted arrays of word
hashes. Then n-grams of word numbers are counted from the highest order
down. Map tasks reduce their texts to sorted distinct n-grams with counts,
cut into compressed blobs by partition; one reduce group a partition merges
them and writes a sorted hash array with its counts to the shared folder,
the statistics of its contexts and, as the next order's n-grams, its
suffixes with their numbers of distinct left extensions.

N-grams go by the words that all their contexts and suffixes share, so that
both are summed in one place. Words of more than a quarter of a partition
are hot: n-grams that share only hot words go by their context, and where
that is hot as well by the whole n-gram, whose contexts are summed in a
small shuffle. So no frequent word or context makes a large group.

An array's key is the first bits of a 64-bit hash, as the place of a bucket
of about eight keys, and the next 32: one look-up in 5 * 10^8 finds the
count of another n-gram. Scoring maps the arrays into memory.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import tokens
from siftlake.llm.common import forget, mounted, release, residue, shared_path, written

_END = np.uint64(2)
#: Number of the begin token, which is hot; of words that training doesn't have.
_BEGIN, _NONE = np.uint64(1), np.uint64((1 << 40) - 2)
#: Tokens that a task holds before it counts them, and that make a partition.
_FLUSH = 2_500_000
#: Words that get small numbers.
_TOP = 1 << 16


def _fold(columns: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """A 64-bit hash of rows given by columns."""
    key = np.full(len(columns[0]) if columns else 1, 0x9E3779B97F4A7C15 * (2 * salt + 1) & (2**64 - 1), np.uint64)
    for w in columns:
        z = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        key = z ^ (z >> np.uint64(30))
    z = key * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def _range(key: np.ndarray, parts: int) -> np.ndarray:
    """The hash range that a key is in, non-decreasing in the key."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _firsts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, some place of each, and which of them each key is."""
    order = np.argsort(key)
    ordered = key[order]
    first = _firsts([ordered])
    which = np.empty(len(key), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return ordered[first], order[first], which


def _grouped(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by partition, each partition's in order, and where the next one begins."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    return order, np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))


def _sums(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted hashes of the distinct rows of ``columns``, these rows, and the sums of ``values`` over each, in 64 bits."""
    key = _fold(columns)
    order = np.argsort(key)
    key = key[order]
    first = _firsts([key])
    sums = [np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values]
    return key[first], [c[order[first]] for c in columns], sums


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows and how often each occurs."""
    if len(columns) == 1:
        key, often = np.unique(columns[0], return_counts=True)
        return [key], often
    distinct = np.unique(np.concatenate([np.unique(c) for c in columns]))
    n = len(distinct)
    if n ** len(columns) < 1 << 63:
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            key = key * n + np.searchsorted(distinct, c)
        return _unpacked(key, distinct, len(columns))
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = _firsts(columns)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _unpacked(key: np.ndarray, words: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows and their counts, of rows that are one number each, in the order of rows."""
    key.sort()
    first = _firsts([key])
    often = np.diff(np.append(first, len(key)))
    key, rows = key[first], []
    for _ in range(order):
        rows.append(words[key % max(1, len(words))])
        key //= max(1, len(words))
    return rows[::-1], often


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of nonnegative integers as compressed planes of bytes, the first one by its differences: small where it is sorted."""
    n = len(columns[0])
    kept, planes = [], []
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(c, "<u8")
        if i == 0 and n:
            c = np.diff(c, prepend=np.zeros(1, np.uint64))
        most = int(c.max()) if n else 0
        kept.append(max(1, (most.bit_length() + 7) // 8))
        planes.append(c.view(np.uint8).reshape(n, 8).T[: kept[-1]].tobytes())
    return np.array([n, *kept], "<u4").tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unsqueeze(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in range(columns)]
    for b in blobs:
        n, *kept = np.frombuffer(b, "<u4", columns + 1).tolist()
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4 * columns + 4 :], max_output_size=max(1, n * sum(kept))), np.uint8)
        at = 0
        for i, k in enumerate(kept):
            c = np.zeros((n, 8), np.uint8)
            c[:, :k] = raw[at : at + n * k].reshape(k, n).T
            at += n * k
            c = c.view("<u8").ravel()
            out[i].append(np.cumsum(c, dtype=np.uint64) if i == 0 else c)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def _coded(values: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of counts as one byte each: the most frequent rows by number, 255 for others, which are listed by place."""
    n = len(values[0])
    if not n:
        return {"code": np.zeros(0, np.uint8), "rows": np.zeros((0, len(values)), "<u8"), "place": np.zeros(0, "<u8"), "other": np.zeros((0, len(values)), "<u8")}
    # Rows of numbers under 32 are told apart by one number; few others are left to be sorted.
    small = np.all([v < 32 for v in values], axis=0)
    key = np.zeros(n, np.int64)
    for v in values:
        key = key << 5 | v
    often = np.bincount(key[small], minlength=1)
    found = np.flatnonzero(often)
    shifts = np.arange(len(values) - 1, -1, -1) * 5
    rest = np.flatnonzero(~small)
    others, back, times = np.unique(np.stack([v[rest] for v in values], axis=1), axis=0, return_inverse=True, return_counts=True)
    table = np.concatenate([found[:, None] >> shifts & 31, others])
    rank = np.argsort(-np.concatenate([often[found], times]), kind="stable")
    code_of = np.full(len(table), 255, np.uint8)
    code_of[rank[:255]] = np.arange(min(255, len(rank)))
    of_key = np.full(len(often), 255, np.uint8)
    of_key[found] = code_of[: len(found)]
    code = np.empty(n, np.uint8)
    code[small] = of_key[key[small]]
    code[rest] = code_of[len(found) + back.ravel()]
    place = np.flatnonzero(code == 255)
    return {"code": code, "rows": table[rank[:255]].astype("<u8"), "place": place.astype("<u8"), "other": np.stack([v[place] for v in values], axis=1).astype("<u8")}


def _decoded(t: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The rows of counts at some places."""
    code = t["code"][at]
    out = np.zeros((len(at), t["rows"].shape[1]), np.int64)
    known = code < 255
    out[known] = t["rows"][code[known]]
    rest = np.flatnonzero(~known)
    if len(rest):
        out[rest] = t["other"][np.searchsorted(t["place"], at[rest].astype(np.uint64))]
    return out


def _bits(n: int) -> int:
    return max(1, min(30, math.ceil(math.log2(max(2, n / 8)))))


def _save(path: str, **arrays: np.ndarray) -> None:
    """Arrays in one file, under its final name when whole: a task that runs again writes the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, a.shape, at)
        at += (a.nbytes + 7) // 8 * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    temporary = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(temporary, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(temporary, path)


@lru_cache(maxsize=100_000)
def _mapped(path: str) -> dict[str, np.ndarray] | None:
    if not os.path.exists(path):
        return None
    raw = np.asarray(np.memmap(path, np.uint8, "r"))  # without the class, whose slices take long
    size = int(raw[:8].view("<u8")[0])
    out = {}
    for name, (kind, shape, at) in json.loads(raw[8 : 8 + size].tobytes()).items():
        begin = 8 + size + at
        out[name] = raw[begin : begin + math.prod(shape) * np.dtype(kind).itemsize].view(kind).reshape(shape)
    return out


def _save_table(path: str, key: np.ndarray, values: list[np.ndarray]) -> None:
    """A sorted hash array, from sorted keys: buckets by the first bits of the key, then 32 bits of each key, and coded values."""
    bits = _bits(len(key))
    start = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4")
    _save(path, start=start, key=(key >> np.uint64(32 - bits)).astype("<u4"), **_coded(values))


def _find(path: str, key: np.ndarray, width: int) -> np.ndarray:
    """Values of keys in a saved table, zeros where a key is absent."""
    t = _mapped(path)
    if t is None or not len(t["key"]):
        return np.zeros((len(key), width), np.int64)
    bits = (len(t["start"]) - 1).bit_length() - 1
    bucket = key >> np.uint64(64 - bits)
    lo, end = t["start"][bucket].astype(np.int64), t["start"][bucket + np.uint64(1)].astype(np.int64)
    want, keys = (key >> np.uint64(32 - bits)).astype("<u4"), t["key"]
    size = end - lo
    # Halve all buckets alike, as far as the largest asks for; an empty half stays where it is.
    for _ in range(int(size.max()).bit_length()):
        half = (size + 1) >> 1
        below = (size > 0) & (keys[np.minimum(lo + half - 1, len(keys) - 1)] < want)
        lo = np.where(below, lo + half, lo)
        size = np.where(below, size - half, half - 1)
    hit = np.flatnonzero(lo < end)
    hit = hit[keys[lo[hit]] == want[hit]]
    out = np.zeros((len(key), width), np.int64)
    out[hit] = _decoded(t, lo[hit])
    return out


def _hot(number: np.ndarray) -> np.ndarray:
    return (number & np.uint64(1)).astype(bool)


def _places(columns: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram's partition, and whether it goes by all its words, apart from others of its context."""
    n = len(columns[0])
    key = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    if len(columns) >= 3:
        by_shared = ~np.all([_hot(c) for c in columns[1:-1]], axis=0)
        key[by_shared] = _fold([c[by_shared] for c in columns[1:-1]], 1)
        whole &= ~by_shared
    if len(columns) >= 2:
        by_context = whole & ~_hot(columns[0])
        key[by_context] = _fold([c[by_context] for c in columns[:-1]], 2)
        whole &= ~by_context
    key[whole] = _fold([c[whole] for c in columns], 3)
    return _range(key, parts), whole


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, an end token closing each, and each text's token count."""
    w = tokens.words(raw, offsets)
    h = tokens.word_hashes(w)
    count = w.count + 1
    ends = np.cumsum(count) - 1
    out = np.full(int(count.sum()), _END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = np.where(h <= _END, h + np.uint64(3), h)
    return out, count


def _windows(number: np.ndarray, count: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """Columns of the n-grams that end at each token, begin tokens before a text."""
    ends = np.cumsum(count)
    since = np.arange(len(number)) - np.repeat(ends - count, count)
    out = []
    for k in range(order - 1, -1, -1):
        column = np.full(len(number), begin, number.dtype)
        column[k:] = number[: len(number) - k]
        column[since < k] = begin
        out.append(column)
    return out


@dataclass
class Model:
    """Folder, order and partitions of the arrays; first numbers of the words of each range; discounts and totals."""

    path: str
    order: int
    ranges: int
    parts: int = 1
    bases: list[int] = field(default_factory=list)
    tokens: int = 0
    types: int = 0
    discounts: list[list[float]] = field(default_factory=list)
    unigrams: list[int] = field(default_factory=list)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of sorted distinct word hashes."""
        number, count = np.full(len(hashes), _NONE, np.uint64), np.zeros(len(hashes), np.int64)
        bounds = np.searchsorted(_range(hashes, self.ranges), np.arange(self.ranges + 1))
        for p in np.flatnonzero(bounds[1:] > bounds[:-1]):
            t = _mapped(f"{self.path}/words/{p}")
            if t is None or not len(t["key"]):
                continue
            own = hashes[bounds[p] : bounds[p + 1]]
            at = np.minimum(np.searchsorted(t["key"], own), len(t["key"]) - 1)
            hit = np.flatnonzero(t["key"][at] == own)
            count[bounds[p] + hit] = _decoded(t, at[hit])[:, 0]
            number[bounds[p] + hit] = np.uint64(2 + _TOP + self.bases[p]) + at[hit].astype(np.uint64)
        top = _mapped(f"{self.path}/top")
        if top is not None and len(top["key"]):
            at = np.minimum(np.searchsorted(top["key"], hashes), len(top["key"]) - 1)
            hit = top["key"][at] == hashes
            number[hit] = 1 + top["rank"][at[hit]]
        known = count > 0
        hot = count * 4 * self.parts > self.tokens
        number[known] = number[known] << np.uint64(1) | hot[known].astype(np.uint64)
        return number, count

    def look_up(self, kind: str, part: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
        """Rows of counts of keys, each in the table of its partition."""
        out = np.zeros((len(key), width), np.int64)
        order, bounds = _grouped(part)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            own = order[lo:hi]
            out[own] = _find(f"{self.path}/{kind}/{part[own[0]]}", key[own], width)
        return out

    def _discount(self, count: np.ndarray, level: int) -> np.ndarray:
        return np.array([0.0, *self.discounts[level - 1]])[np.minimum(count, 3)]

    def probabilities(self, words: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of each token after the tokens before it in its text.

        ``words`` are numbers of different words, ``which`` says for each
        token which of them it is, ``count`` how many tokens a text has.
        Each different n-gram of every order is looked up once.
        """
        before = self.order - 1
        begin = np.cumsum(count + before) - count - before
        real = np.arange(len(which)) + np.repeat(begin + before - (np.cumsum(count) - count), count)
        words = np.append(words, _BEGIN)
        sequence = np.full(len(which) + before * len(count), len(words) - 1)
        sequence[real] = which
        total, n1, n2, n3 = self.unigrams or [0, 0, 0, 0]
        d = self.discounts[0]
        columns, index = [words], sequence
        seen = self._counts(columns)
        if total:
            p = np.maximum(seen - self._discount(seen, 1), 0) / total + (d[0] * n1 + d[1] * n2 + d[2] * n3) / total / (self.types + 1)
        else:
            p = np.full(len(words), 1 / (self.types + 1))
        for level in range(2, self.order + 1):
            # The n-gram that ends at a place: the shorter one that ends before it, and its word. Across texts they mean nothing.
            grams, example, after = _distinct(index[:-1] * len(words) + sequence[1:])
            context, shorter = grams // len(words), index[1:][example]
            total, n1, n2, n3 = self._contexts(columns, seen > 0)[:, context]
            columns = [*[c[context] for c in columns], words[grams % len(words)]]
            seen = self._counts(columns)
            d, some = self.discounts[level - 1], total > 0
            total = np.where(some, total, 1)
            p = np.where(some, np.maximum(seen - self._discount(seen, level), 0) / total + (d[0] * n1 + d[1] * n2 + d[2] * n3) / total * p[shorter], p[shorter])
            index = np.append(0, after)
        return p[index[real]]

    def _counts(self, columns: list[np.ndarray]) -> np.ndarray:
        return self.look_up(f"grams-{len(columns)}", _places(columns, self.parts)[0], _fold(columns), 1)[:, 0]

    def _contexts(self, context: list[np.ndarray], known: np.ndarray) -> np.ndarray:
        """Total, n1, n2, n3 of contexts. Only those that aren't followed by a single n-gram seen once are stored."""
        part, whole = _places([*context, context[0]], self.parts)
        # By all words: the context's own place.
        part = np.where(whole, _range(_fold(context, 4), self.parts), part)
        level, key = len(context) + 1, _fold(context)
        out = np.zeros((len(key), 4), np.int64)
        for kind, which in (("contexts", ~whole), ("hot-contexts", whole)):
            at = np.flatnonzero(which)
            out[at] = self.look_up(f"{kind}-{level}", part[at], key[at], 4)
        out[known & (out[:, 0] == 0)] = (1, 1, 0, 0)
        return out.T


def _discounts(n: np.ndarray) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; 0.5, 1, 1.5 where too few tell."""
    if (n[:4] <= 0).any():
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k)) for k in (1, 2, 3)]


_SHAPE = "kind string, part int, blob binary"


def _rows(kind: str, part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A blob for each partition, in which the sorted rows of ``columns`` stay in order."""
    order, bounds = _grouped(part)
    part, columns = part[order], [c[order] for c in columns]
    blobs = [_squeeze([c[a:b] for c in columns]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(blobs), pa.string()), pa.array(part[bounds[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["kind", "part", "blob"])


def _said(part: int, **what: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(["stats"]), pa.array([part], pa.int32()), pa.array([json.dumps(what).encode()], pa.binary())], ["kind", "part", "blob"])


def _heard(rows: DataFrame) -> list[dict]:
    """What the groups of words said: some numbers from each range."""
    return [{"part": r[0], **json.loads(bytes(r[1]))} for r in rows.where("kind = 'stats'").select("part", "blob").collect()]


def _counting(of: Callable[[np.ndarray, np.ndarray], tuple], counted: Callable[[list[tuple]], tuple[list[np.ndarray], np.ndarray]], place: Callable[[list[np.ndarray]], np.ndarray]) -> Callable:
    """Map side of a count: ``of`` makes something of each piece of text, ``counted`` distinct rows and their counts of many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns, n = counted(held)
            held.clear()
            return _rows("gram", place(columns), [*columns, n])

        size = 0
        for b in batches:
            for _, _, raw, offsets in tokens.chunks(b.column(0)):
                h, n = _words(raw, offsets)
                held.append(of(h, n))
                size += len(h)
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return count


def _word_counts(held: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    key, n = np.unique(np.concatenate([h for h, _ in held]), return_counts=True)
    return [key], n


def _gram_counts(order: int) -> Callable[[list[tuple]], tuple[list[np.ndarray], np.ndarray]]:
    """N-grams of pieces given by the numbers of their different words, which of them each token is, and the texts' token counts."""

    def counted(held: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
        words = np.unique(np.concatenate([*[w for w, _, _ in held], np.array([_BEGIN])]))
        begin, n = int(np.searchsorted(words, _BEGIN)), len(words)
        pieces = [_windows(np.searchsorted(words, w)[which], count, order, begin) for w, which, count in held]
        if n**order >= 1 << 63:
            return _counted([words[np.concatenate(c)] for c in zip(*pieces, strict=True)])
        keys = []
        for columns in pieces:
            keys.append(columns[0])
            for c in columns[1:]:
                keys[-1] = keys[-1] * n + c
        return _unpacked(np.concatenate(keys), words, order)

    return counted


def _merge_words(path: str, ranges: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        key, n = _unsqueeze(table.column("blob").to_pylist(), 2)
        order = np.argsort(key)
        first = _firsts([key[order]])
        key, count = key[order[first]], np.add.reduceat(n[order].astype(np.int64), first)
        _save(f"{path}/words/{part}", key=key, **_coded([count]))
        most = np.argsort(-count, kind="stable")[: max(1, _TOP // ranges)]
        top = {"hash": [int(k) for k in key[most]], "count": [int(c) for c in count[most]]}
        return pa.Table.from_batches([_said(part, tokens=int(count.sum()), types=len(key), top=top)])

    return run


def _merge_grams(path: str, level: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        *columns, n = _unsqueeze(table.column("blob").to_pylist(), level + 1)
        key, columns, (count,) = _sums(columns, [n])
        _save_table(f"{path}/grams-{level}/{part}", key, [count])
        small = np.minimum(count, 5)
        out = [_said(part, n=np.bincount(small, minlength=6)[1:5].tolist(), n3=int((count >= 3).sum()), total=int(count.sum()))]
        if level > 1:
            _, context, stats = _sums(columns[:-1], [count, count == 1, count == 2, count >= 3])
            whole = _places([*context, context[0]], parts)[1]
            _save_contexts(f"{path}/contexts-{level}/{part}", [c[~whole] for c in context], [x[~whole] for x in stats])
            if whole.any():
                context = [c[whole] for c in context]
                order = np.lexsort(context[::-1])
                out.append(_rows("context", _range(_fold(context, 4), parts)[order], [*[c[order] for c in context], *[x[whole][order] for x in stats]]))
            rest, n = _counted(columns[1:])
            out.append(_rows("gram", _places(rest, parts)[0], [*rest, n]))
        return pa.Table.from_batches(out)

    return run


def _save_contexts(path: str, context: list[np.ndarray], stats: list[np.ndarray]) -> None:
    """Without contexts of one n-gram seen once, which show by being n-grams of the order below; begin tokens never do."""
    keep = (stats[0] != 1) | (context[-1] == _BEGIN)
    key = _fold([c[keep] for c in context])
    order = np.argsort(key)
    _save_table(path, key[order], [x[keep][order] for x in stats])


def _merge_contexts(path: str, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        columns = _unsqueeze(table.column("blob").to_pylist(), level + 3)
        _, context, stats = _sums(columns[: level - 1], columns[level - 1 :])
        _save_contexts(f"{path}/hot-contexts-{level}/{part}", context, stats)
        return pa.table({"part": pa.array([part], pa.int32())})

    return run


def train(texts: DataFrame, order: int = 3, text: str = "text", parts: int | None = None, flush: int = _FLUSH) -> Model:
    """Count ``texts`` and write the model to the shared folder, which must be mounted on every machine.

    ``parts`` partitions (by default the session's shuffle partitions, more
    where ``flush`` tokens a partition ask for it) bound what one task
    holds. Counts have 64 bits. Null and blank texts count one end token
    each; repeated rows count as often. An empty table gives the uniform
    model.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = texts.sparkSession
    ranges = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = mounted(shared_path(spark, "lm"))
    model = Model(path, order, ranges, discounts=[[0.5, 1.0, 1.5]] * order)
    given = texts.select(F.col(text).alias("text"))
    words = given.mapInArrow(_counting(lambda h, n: (h, n), _word_counts, lambda c: _range(c[0], ranges)), _SHAPE).groupBy("part").applyInArrow(_merge_words(path, ranges), _SHAPE)
    stats = sorted(_heard(words), key=lambda s: s["part"])
    model.tokens, model.types = sum(s["tokens"] for s in stats), sum(s["types"] for s in stats)
    types = {s["part"]: s["types"] for s in stats}
    model.bases = [sum(types.get(q, 0) for q in range(p)) for p in range(ranges)]
    model.parts = parts or max(ranges, math.ceil(model.tokens / flush))
    top = sorted((-c, h) for s in stats for c, h in zip(s["top"]["count"], s["top"]["hash"], strict=True))[:_TOP]
    by_hash = sorted((h, rank) for rank, (_, h) in enumerate(top))
    _save(f"{path}/top", key=np.array([h for h, _ in by_hash], "<u8"), rank=np.array([r for _, r in by_hash], "<u8"))
    del words
    release(spark)

    def pieces(h: np.ndarray, count: np.ndarray) -> tuple:
        distinct, _, which = _distinct(h)
        return model.words(distinct)[0], which, count

    rows: DataFrame = given.mapInArrow(_counting(pieces, _gram_counts(order), lambda c: _places(c, model.parts)[0]), _SHAPE)
    before = None
    for level in range(order, 0, -1):
        after = written(rows.where("kind = 'gram'").groupBy("part").applyInArrow(_merge_grams(path, level, model.parts), _SHAPE), f"lm-{level}")
        del rows
        forget(before)
        release(spark)
        # Summed by Spark: there is a row for every partition, and partitions grow with the input.
        said = F.from_json(F.col("blob").cast("string"), "n array<long>, n3 long, total long")
        of = after.where("kind = 'stats'").select(said.alias("s"))
        *n, n3, total = [x or 0 for x in of.agg(*[F.sum(F.get("s.n", i)) for i in range(4)], F.sum("s.n3"), F.sum("s.total")).first()]
        model.discounts[level - 1] = _discounts(np.asarray(n))
        if level > 1:
            after.where("kind = 'context'").groupBy("part").applyInArrow(_merge_contexts(path, level), "part int").count()
        elif total:
            model.unigrams = [total, n[0], n[1], n3]
        rows = before = after
    forget(before)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every document; log10 probabilities of the whole text.

    Null texts are empty: one end token. ``base_score`` is the add-0.1
    unigram score over the same training tokens. Rows are scored each by
    itself: repeated ones stay, null ids are kept, an empty table gives an
    empty one; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_tokens = np.zeros(b.num_rows, np.int64)
            n_known, base, full = n_tokens.copy(), np.zeros(b.num_rows), np.zeros(b.num_rows)
            for lo, hi, raw, offsets in tokens.chunks(b.column(1)):
                h, count = _words(raw, offsets)
                distinct, _, which = _distinct(h)
                words, known = model.words(distinct)
                p, seen = model.probabilities(words, which, count), known[which]
                first = np.cumsum(count) - count
                n_tokens[lo:hi] = count
                n_known[lo:hi] = np.add.reduceat((seen > 0).astype(np.int64), first)
                base[lo:hi] = np.add.reduceat(np.log10((seen + 0.1) / (model.tokens + 0.1 * (model.types + 1))), first)
                full[lo:hi] = np.add.reduceat(np.log10(p), first)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(full)], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    )


def perplexity(score: str = "score", n_tokens: str = "n_tokens"):
    """Perplexity of a scored row."""
    return F.pow(F.lit(10.0), -F.col(score) / F.col(n_tokens))


def held_out_scores(docs: DataFrame, order: int = 3, folds: int = 10) -> DataFrame:
    """Train on the documents of all folds but 0 and score every document."""
    rest = residue(F.col("doc_id"), folds)
    model = train(docs.where(rest != 0), order)
    scored = score(docs, model)
    return scored.select(
        "doc_id", (residue(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
