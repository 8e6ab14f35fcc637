"""Whole Arrow batches of texts as arrays: words, their hashes, XXH64 of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PAD = 8


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data`` (lower-cased A-Z) and each text's first word and count."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.first)


def chunks(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, offsets)`` for runs of texts of about ``most`` bytes; a longer text comes alone. Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Split at white space (0x20, 0x09-0x0D), lower-case A-Z, put one space between words of a text."""
    space = _SPACE[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets] = True
    before = np.ones(len(raw), bool)
    before[1:] = space[:-1]
    before |= begins[:-1]
    head = ~space & before
    keep = ~space | ~before  # the first blank after a word stays
    low = _LOWER[raw]
    low[space] = 0x20
    place = np.cumsum(keep) - keep
    data = np.concatenate([low[keep], np.zeros(_PAD, np.uint8)])
    at = np.flatnonzero(head)
    start = place[at]
    tail = np.ones(len(raw), bool)
    if len(raw):
        tail[:-1] = space[1:] | begins[1:-1]
    end = place[np.flatnonzero(~space & tail)] + 1
    first = np.searchsorted(at, offsets[:-1])
    count = np.searchsorted(at, offsets[1:]) - first
    return Words(data, start, end - start, first, count)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int, step: int = 1 << 15) -> np.ndarray:
    """XXH64 of each range of ``data``, which ends in eight spare bytes."""
    out = np.empty(len(start), np.uint64)
    u8 = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    u4 = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    zero, s = np.zeros(1, np.uint64), np.array([seed], np.uint64)
    for lo in range(0, len(start), step):
        at, left = start[lo : lo + step].copy(), size[lo : lo + step].copy()
        h = np.repeat(s + _P5, len(at))
        big = np.flatnonzero(left >= 32)
        if len(big):
            v = [np.repeat(x, len(big)) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            stripes, act, k = left[big] // 32, np.arange(len(big)), 0
            while len(act):
                p = at[big[act]] + 32 * k
                for i in range(4):
                    v[i][act] = _round(v[i][act], u8[p + 8 * i])
                k += 1
                act = act[stripes[act] > k]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for i in range(4):
                x = (x ^ _round(zero, v[i])) * _P1 + _P4
            h[big] = x
            at[big] += 32 * stripes
            left[big] -= 32 * stripes
        h += size[lo : lo + step].astype(np.uint64)
        while len(a := np.flatnonzero(left >= 8)):
            h[a] = _rotl(h[a] ^ _round(zero, u8[at[a]]), 27) * _P1 + _P4
            at[a] += 8
            left[a] -= 8
        a = np.flatnonzero(left >= 4)
        h[a] = _rotl(h[a] ^ (u4[at[a]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[a] += 4
        left[a] -= 4
        while len(a := np.flatnonzero(left > 0)):
            h[a] = _rotl(h[a] ^ (data[at[a]].astype(np.uint64) * _P5), 11) * _P1
            at[a] += 1
            left[a] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[lo : lo + step] = h ^ (h >> np.uint64(32))
    return out


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """XXH64 of every word."""
    return xxh64(w.data, w.start, w.size, seed)


def shingle_hashes(w: Words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of ``k`` words and each text's bounds among them; fewer words give one run, none give none."""
    runs = np.where(w.count == 0, 0, np.maximum(w.count - k + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(w)), runs)
    head = w.first[text] + np.arange(bounds[-1]) - bounds[text]
    last = head + np.minimum(w.count[text], k) - 1
    start = w.start[head]
    return xxh64(w.data, start, w.start[last] + w.size[last] - start, seed), bounds
