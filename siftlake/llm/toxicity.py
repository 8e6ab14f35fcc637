"""Toxicity by a gapped-subsequence kernel SVM with Nyström landmarks.

The unit is a word, stripped to its letters: digits that stand for letters
are read as such, punctuation inside is dropped and runs of single letters
are joined. Two units are compared by the subsequences of four symbols they
share, word ends included, where up to two other symbols may stand in
between at a price: inserted and spaced characters lower the similarity but
don't hide a word. The normalised kernel is cubed, so that only units alike
as a whole count. A support vector machine over the kernel's Nyström map
scores units: their kernel with some hundred landmark units, looked up by
shared subsequences, times one weight a landmark. A document's score is a
calibrated function of its highest unit scores.

Labels are of documents; the machine is trained as multiple-instance: units
that only toxic documents hold start as positive, then each toxic
document's highest units and each clean document's highest ones retrain it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm import tokens
from siftlake.llm.common import forget, residue, written

#: Distances between the four symbols of a subsequence, at most two symbols skipped; each costs a factor.
_SHAPES = tuple((a, b, c, a + b + c - 3) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3) if a + b + c <= 5)
_SKIP = 0.5
_HEAD, _TAIL = 62, 63
#: Subsequences are hashed to so many features.
_DIMS = 1 << 20
#: Symbol of each byte: letters 1-26, bytes of other letters 27-61, 0 for what is dropped.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
for _c, _letter in zip(b"013457", b"oieast", strict=True):
    _SYMBOL[_c] = _letter - 96
_SYMBOL[128:] = 27 + (np.arange(128, 256) % 35)
_SYMBOL[0x80:0x9F] = _SYMBOL[0xA0:0xBF]  # small and capital Latin letters after 0xC3


@dataclass(frozen=True)
class Options:
    """Bounds of the fit, which one task runs, and its constants.

    At most ``per_class`` labelled documents of either class are fitted on,
    those whose ids hash lowest, and of these, in that order, only as many
    as have ``train_bytes`` of whole text together. The machine starts from
    at most ``positives`` units of toxic documents, those with the most
    evidence, and ``negatives`` of clean ones.
    """

    per_class: int = 1500
    train_bytes: int = 64 << 20
    positives: int = 4000
    landmarks: int = 800
    negatives: int = 10_000
    rounds: int = 4
    ridge: float = 1e-4
    threshold: float = 0.3


@dataclass
class Units:
    """Symbols of the units of some texts, each between a head and a tail mark."""

    symbols: np.ndarray
    unit: np.ndarray
    first: np.ndarray
    text: np.ndarray
    texts: int


def units(raw: np.ndarray, offsets: np.ndarray) -> Units:
    """Units of the texts; words without letters have none."""
    w = tokens.words(raw, offsets)
    sym = _SYMBOL[w.data[: len(w.data) - 8]]
    word = np.repeat(np.arange(len(w.start)), w.size)
    place = np.repeat(w.start - (np.cumsum(w.size) - w.size), w.size) + np.arange(len(word))
    letters = sym[place]
    word, letters = word[letters > 0], letters[letters > 0]
    size = np.bincount(word, minlength=len(w.start))
    text = np.repeat(np.arange(len(w)), w.count)
    some = np.flatnonzero(size > 0)
    joined = np.zeros(len(some), bool)  # a single letter after a single letter continues its unit
    if len(some):
        joined[1:] = (size[some[1:]] == 1) & (size[some[:-1]] == 1) & (text[some[1:]] == text[some[:-1]]) & (some[1:] - some[:-1] == 1)
    unit_of_word = np.zeros(len(w.start), np.int64)
    unit_of_word[some] = np.cumsum(~joined) - 1
    n = int((~joined).sum())
    owner = unit_of_word[word]
    length = np.bincount(owner, minlength=n) + 2
    first = np.cumsum(length) - length
    symbols = np.empty(int(length.sum()), np.int32)
    symbols[first] = _HEAD
    symbols[first + length - 1] = _TAIL
    symbols[np.arange(len(letters)) + 2 * owner + 1] = letters
    return Units(symbols, np.repeat(np.arange(n), length), first, text[some[~joined]], len(w))


def _features(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(unit, feature, weight) of each shape's subsequences."""
    s, n = u.symbols, len(u.symbols)
    for d1, d2, d3, skipped in _SHAPES:
        m = n - d1 - d2 - d3
        if m <= 0:
            continue
        code = (s[:m] << 18) | (s[d1 : d1 + m] << 12) | (s[d1 + d2 : d1 + d2 + m] << 6) | s[d1 + d2 + d3 :]
        code = (code.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(12)
        inside = u.unit[:m] == u.unit[d1 + d2 + d3 :]
        yield u.unit[:m][inside], code[inside].astype(np.int32), _SKIP**skipped


def distinct(u: Units) -> tuple[Units, np.ndarray, np.ndarray]:
    """The different units, which of them each unit is, and their hashes."""
    table = np.random.default_rng(99).integers(1, 2**63, (64, 1024), dtype=np.uint64)
    place = np.arange(len(u.symbols)) - u.first[u.unit]
    mixed = table[u.symbols, place & 1023] * (2 * (place >> 10) + 1).astype(np.uint64)
    key = np.add.reduceat(mixed, u.first) if len(u.first) else np.zeros(0, np.uint64)
    keys, example, kind = np.unique(key, return_index=True, return_inverse=True)
    return _subset(u, example), kind, keys


def _subset(u: Units, which: np.ndarray) -> Units:
    """Some units, each as a text of its own."""
    ends = np.append(u.first[1:], len(u.symbols))
    size = (ends - u.first)[which]
    first = np.cumsum(size) - size
    unit = np.repeat(np.arange(len(which)), size)
    return Units(u.symbols[u.first[which][unit] + np.arange(len(unit)) - first[unit]], unit, first, np.arange(len(which)), len(which))


def _entries(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, feature, normalised weight) of all subsequences."""
    parts = [(unit, feature, np.full(len(unit), weight, np.float32)) for unit, feature, weight in _features(u)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    unit, feature, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    norm = np.sqrt(np.maximum(np.bincount(unit, weight**2, len(u.first)), 1e-9))
    return unit, feature, weight / norm[unit]


@dataclass
class Landmarks:
    """Landmark units as an inverted list: the landmarks of each feature with their weights."""

    begin: np.ndarray
    mark: np.ndarray
    weight: np.ndarray
    n: int

    @staticmethod
    def of(u: Units) -> Landmarks:
        unit, feature, weight = _entries(u)
        order = np.argsort(feature, kind="stable")
        begin = np.searchsorted(feature[order], np.arange(_DIMS + 1)).astype(np.int32)
        return Landmarks(begin, unit[order].astype(np.int32), weight[order], len(u.first))

    def kernel(self, u: Units, which: np.ndarray) -> np.ndarray:
        """Cubed kernel of some units with the landmarks."""
        unit, feature, weight = _entries(_subset(u, which))
        lists = self.begin[feature + 1] - self.begin[feature]
        some = lists > 0
        unit, feature, weight, lists = unit[some], feature[some], weight[some], lists[some]
        at = np.repeat(self.begin[feature] - (np.cumsum(lists) - lists), lists) + np.arange(lists.sum())
        cell = np.repeat(unit, lists) * self.n + self.mark[at]
        k = np.bincount(cell, np.repeat(weight, lists) * self.weight[at], len(which) * self.n)
        k = k.reshape(len(which), self.n)
        return k * k * k


class Known:
    """Values of units that a task has worked out, by hash; when more than ``most`` are held it starts anew."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.keys, self.values = most, np.zeros(0, np.uint64), np.zeros(0)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of sorted keys, and which are known."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.most:
            self.keys, self.values = keys, values
            return
        keys, values = np.concatenate([self.keys, keys]), np.concatenate([self.values, values])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]


@dataclass
class Machine:
    """Landmarks, one weight for each, and the bias."""

    landmarks: Landmarks
    beta: np.ndarray
    bias: float

    def values(self, u: Units, known: Known | None = None, step: int = 4000) -> np.ndarray:
        """The machine's value of every unit; each different unit is worked out once, and not if it is ``known``."""
        different, kind, keys = distinct(u)
        out, have = (known or Known()).find(keys)
        new = np.flatnonzero(~have)
        for at in range(0, len(new), step):
            which = new[at : at + step]
            out[which] = self.landmarks.kernel(different, which) @ self.beta + self.bias
        if known is not None and len(new):
            known.add(keys[new], out[new])
        return out[kind]


def pooled(u: Units, values: np.ndarray) -> np.ndarray:
    """Per text: how far the highest value passes -0.25, and the log of how many pass 0.25; zeros where none does."""
    out = np.zeros((u.texts, 2))
    np.maximum.at(out[:, 0], u.text, np.minimum(values + 0.25, 1.5))
    out[:, 1] = np.log1p(np.bincount(u.text[values > 0.25], minlength=u.texts))
    return out


@dataclass
class Model:
    """The machine (none: nothing was learnt), and the calibration of the pooled values."""

    machine: Machine | None
    calibration: np.ndarray

    def scores(self, texts: pa.Array, known: Known | None = None) -> np.ndarray:
        x = _pooled_texts(self.machine, texts, known)
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration[:-1] + self.calibration[-1], -30, 30)))


def _pooled_texts(machine: Machine | None, texts: pa.Array, known: Known | None = None) -> np.ndarray:
    out = np.zeros((len(texts), 2))
    for lo, hi, raw, offsets in tokens.chunks(texts, 1 << 20):
        u = units(raw, offsets)
        if machine and len(u.first):
            out[lo:hi] = pooled(u, machine.values(u, known))
    return out


def _vocabulary(texts: pa.Array) -> tuple[Units, np.ndarray, np.ndarray]:
    """The different units of some texts, and (text, unit) of each text's different units, by text; worked out in pieces."""
    text_of, key_of, keys, symbols, sizes = [], [], [], [], []
    for lo, _, raw, offsets in tokens.chunks(texts, 1 << 20):
        u = units(raw, offsets)
        d, kind, key = distinct(u)
        pair = np.unique(u.text * max(1, len(key)) + kind)
        text_of.append((lo + pair // max(1, len(key))).astype(np.int32))
        key_of.append(key[pair % max(1, len(key))])
        keys.append(key)
        symbols.append(d.symbols.astype(np.uint8))
        sizes.append(np.diff(np.append(d.first, len(d.symbols))))
    joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    size = joined(sizes, np.int64)
    first = np.cumsum(size) - size
    every, example = np.unique(joined(keys, np.uint64), return_index=True)
    # Cut the units out of the pieces without a table of all their symbols' owners.
    size, first = size[example], first[example]
    start = np.cumsum(size) - size
    unit = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(unit)) - start[unit] + first[unit]
    d = Units(joined(symbols, np.uint8)[at].astype(np.int32), unit, start, np.arange(len(size)), len(size))
    return d, joined(text_of, np.int32).astype(np.int64), np.searchsorted(every, joined(key_of, np.uint64))


def _grams(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """(unit, run of five symbols), by unit; shorter units give themselves."""
    s, n = u.symbols.astype(np.int64), len(u.symbols)
    run = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    last = np.append(u.first[1:], n)[u.unit]
    for k in range(5):
        here = np.minimum(np.arange(n) + k, n - 1)
        run = run << 6 | np.where(np.arange(n) + k < last, s[here], 0)
        inside &= (np.arange(n) + k < last) | (np.arange(n) == u.first[u.unit])
    return u.unit[inside], run[inside]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge linear machine with a free bias as last column, by Newton steps that are halved while they don't help."""
    b = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = ridge * 1e-3
    loss = lambda v: float((weight * np.maximum(1 - y * (z @ v), 0) ** 2).sum() + (penalty * v * v).sum())
    now = loss(b)
    for _ in range(60):
        gap = 1 - y * (z @ b)
        on = gap > 0
        zw = z[on] * weight[on, None]
        step = np.linalg.solve((zw.T @ z[on]).astype(float) + np.diag(penalty), zw.T @ (y[on] * gap[on]) - penalty * b)
        scale, after = 1.0, loss(b + step)
        while after > now and scale > 1e-4:
            scale /= 2
            after = loss(b + scale * step)
        if after > now:
            break
        b, done, now = b + scale * step, now - after < 1e-9 * max(now, 1e-12), after
        if done:
            break
    return b


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _standing_out(t: np.ndarray, c: np.ndarray, nt: int, nc: int) -> np.ndarray:
    """Log-likelihood ratio against chance of being in t of nt toxic and c of nc clean texts; 0 where not clearly more toxic."""
    share = nt / (nt + nc)
    part = lambda x, e: x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9))
    ratio = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
    return np.where(ratio > 1.5, part(t, (t + c) * share) + part(c, (t + c) * (1 - share)), 0.0)


def fit(texts: list[str], toxic: np.ndarray, prior: float, options: Options = Options()) -> Model:
    """Fit on labelled texts in memory; ``prior`` is the share of toxic ones among all labelled.

    Without both classes the score is the prior everywhere.
    """
    logit = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    every = pa.array(texts, pa.large_string())
    d, text_of, kind_of = _vocabulary(every)
    n = len(d.first)
    if toxic.all() or not toxic.any() or not n:
        return Model(None, np.array([0.0, 0.0, logit]))
    rng = np.random.default_rng(0)
    calibrating = rng.random(len(texts)) < 0.25  # fitted apart from the machine
    use = ~calibrating[text_of]
    t = np.bincount(kind_of[use & toxic[text_of]], minlength=n)
    c = np.bincount(kind_of[use & ~toxic[text_of]], minlength=n)
    nt, nc = max(1, int((toxic & ~calibrating).sum())), max(1, int((~toxic & ~calibrating).sum()))
    # Units, and runs of five symbols in them, that stand out in toxic documents: a stem with many endings is found
    # though each of its forms is rare.
    unit, gram = _grams(d)
    grams, gram = np.unique(gram, return_inverse=True)
    of_kind = np.searchsorted(unit, np.arange(n + 1))
    gt, gc = np.zeros(len(grams)), np.zeros(len(grams))
    for lo in range(0, len(texts), 200):
        own = np.flatnonzero(use & (text_of >= lo) & (text_of < lo + 200))
        size = of_kind[kind_of[own] + 1] - of_kind[kind_of[own]]
        at = np.repeat(of_kind[kind_of[own]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        seen = np.unique(np.repeat(text_of[own], size) * len(grams) + gram[at])
        by_toxic = toxic[seen // len(grams)]
        gt += np.bincount(seen[by_toxic] % len(grams), minlength=len(grams))
        gc += np.bincount(seen[~by_toxic] % len(grams), minlength=len(grams))
    evidence = _standing_out(t, c, nt, nc)
    np.maximum.at(evidence, unit, _standing_out(gt, gc, nt, nc)[gram])
    evidence[(t == 0) | (c * nt > t * nc / 4)] = 0
    positive = np.flatnonzero(evidence > np.log(len(grams)) + 2)
    positive = positive[np.argsort(-evidence[positive] - t[positive] / (1 + t.max()), kind="stable")][: options.positives]
    if not len(positive):
        positive = np.argsort(-_standing_out(t, c, nt, nc), kind="stable")[:10]
    clean = np.flatnonzero(c > 0)
    weight = np.sqrt(c[clean])
    negative = rng.choice(clean, min(len(clean), options.negatives), replace=False, p=weight / weight.sum()) if len(clean) else clean
    negative = np.setdiff1d(negative, positive)
    machine, best = None, None
    for _ in range(options.rounds):
        # Evident units first, then a spread of the others; of the clean ones those that score highest, then a spread.
        foot = negative[np.argsort(-best[negative], kind="stable")] if best is not None else rng.permutation(negative)
        spread = lambda x, k: np.concatenate([x[: k // 2], rng.permutation(x[k // 2 :])[: k - k // 2]])
        chosen = np.concatenate([spread(positive, 3 * options.landmarks // 5), spread(foot, 2 * options.landmarks // 5)])
        marks = Landmarks.of(_subset(d, chosen))
        values, vectors = np.linalg.eigh(marks.kernel(d, chosen))
        keep = values > 1e-4 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        rows = np.concatenate([positive, negative])
        z = np.ones((len(rows), root.shape[1] + 1), np.float32)
        for i in range(0, len(rows), 2000):
            z[i : i + 2000, :-1] = marks.kernel(d, rows[i : i + 2000]) @ root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        trust = np.sqrt(np.concatenate([t[positive], c[negative]]) + 1.0)
        trust = trust * np.where(y > 0, 0.3 / trust[y > 0].sum(), 0.7 / max(1e-9, trust[y < 0].sum()))
        b = _svm(z, y.astype(np.float32), trust.astype(np.float32), options.ridge)
        machine = Machine(marks, root @ b[:-1], float(b[-1]))
        best = machine.values(d)
        order = np.lexsort((-best[kind_of], text_of))
        rank = np.arange(len(order)) - np.searchsorted(text_of[order], text_of[order])
        hard = order[(rank < 3) & use[order] & ~toxic[text_of[order]]]
        negative = np.setdiff1d(np.concatenate([negative, kind_of[hard]]), positive)
    x, y = _pooled_texts(machine, every.take(pa.array(np.flatnonzero(calibrating)))), toxic[calibrating].astype(float)
    share = y.mean() if len(y) else 0.5
    fitted = _logistic(x, y) if 0 < share < 1 else np.array([3.0, 1.0, -2.0])
    fitted[-1] += logit - float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    return Model(machine, fitted)


def train(docs: DataFrame, labels: DataFrame, options: Options = Options(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled documents: of either class those whose ids hash lowest.

    Rows without an id or label are left out; of repeated labels of an id
    the highest counts, of repeated rows of an id the smallest text (null
    texts are empty). Without labels, or labels of one class only, the score
    is the same everywhere. The sample goes to one task, not to the driver,
    which receives the model (some MB).
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(label) > 0).alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if share is None:
        return fit([""], np.array([False]), 0.5, options)
    low = lambda flag: known.where(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.per_class)
    picked = F.broadcast(low(True).unionByName(low(False)))
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).join(picked, "doc_id")
    sample = written(given.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "sample")
    # Rows of the sample's ids and sizes, at most 2 * per_class, in one order.
    sizes = sample.select("doc_id", F.octet_length("text").alias("size")).withColumn("rank", F.xxhash64("doc_id"))
    upto = F.sum("size").over(Window.orderBy("rank", "doc_id"))
    few = F.broadcast(sizes.select("doc_id", upto.alias("upto")).where(F.col("upto") <= options.train_bytes).select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            table = pa.Table.from_batches(got).sort_by("doc_id")
            model = fit(table.column("text").to_pylist(), np.asarray(table.column("toxic").to_pylist(), bool), float(share), options)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = sample.join(few, "doc_id").select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "model binary").collect()
    forget(sample)
    return pickle.loads(fitted[0][0]) if fitted else fit([""], np.array([False]), float(share), options)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text; null texts are empty, repeated rows and null ids stay, an empty table gives an empty one."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some MB: the landmarks' features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(b.column(1), known))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            yield b.filter(pa.array(sent.value.scores(b.column(at), known) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out_scores(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """Fit on the labels whose residue modulo 4 isn't 2 and score every document."""
    model = train(docs, labels.where(residue(F.col("doc_id"), 4) != 2), options)
    return score(docs, model).select(
        "doc_id",
        (residue(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= options.threshold).cast("int").alias("predicted"),
    )
