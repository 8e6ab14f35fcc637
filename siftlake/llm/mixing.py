"""Mixing documents to target weights of domains, in built-in SQL functions only.

A labelled table trains a naive Bayes classifier (normal densities of a few
measures of the text, frequencies of categories) whose posteriors are soft
memberships in domains. Nonnegative rates of the documents are then fitted
by projected-gradient least squares so that the expected token totals of
the domains match the targets. A step only needs totals and a matrix of
the size of the domains, summed by Spark; the rate of a document is a function of its posteriors, so
nothing per document reaches the driver.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import forget, written

MEASURES = ("log_words", "word_chars", "other_bytes", "symbols", "capitals", "distinct_words")


def measures(text: Column) -> Column:
    """``struct<n_tokens, log_words, word_chars, ...>`` of a text; null is empty. Tokens are words at white space."""
    t = F.coalesce(text, F.lit(""))

    def of(s: Column) -> Column:
        words, n, chars = s["words"], F.size(s["words"]), F.greatest(F.length(s["t"]), F.lit(1)).cast("double")
        share = lambda letters: (F.length(s["t"]) - F.length(F.translate(s["t"], letters, ""))) / chars
        return F.struct(
            n.cast("long").alias("n_tokens"),
            F.log1p(n.cast("double")).alias("log_words"),
            (chars / F.greatest(n, F.lit(1))).alias("word_chars"),
            ((F.octet_length(s["t"]) - F.length(s["t"])) / chars).alias("other_bytes"),
            share("#$%&*!|@=").alias("symbols"),
            share("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals"),
            (F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1))).alias("distinct_words"),
        )

    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(F.struct(t.alias("t"), words.alias("words"))), of)[0]


@dataclass(frozen=True)
class Classifier:
    """Domains, their priors, and the normal density and category frequencies of each."""

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    normals: tuple[tuple[tuple[float, float], ...], ...]
    categories: tuple[str, ...]
    frequencies: tuple[tuple[dict, ...], ...]

    def renamed(self, categories: tuple[str, ...]) -> Classifier:
        return replace(self, categories=tuple(categories))

    def posteriors(self, measured: Column, category: dict[str, Column]) -> list[Column]:
        """One column a domain; they add up to 1. A domain with prior 0 has posterior 0."""
        logs = []
        seen = [k for k, p in enumerate(self.priors) if p > 0]
        for k in seen:
            s = F.lit(math.log(self.priors[k]))
            for name, (mean, sd) in zip(MEASURES, self.normals[k], strict=True):
                z = F.least(F.abs(measured[name] - mean) / sd, F.lit(6.0))  # an outlier alone doesn't decide
                s = s - z * z / 2 - math.log(sd)
            for c, freq in zip(self.categories, self.frequencies[k], strict=True):
                e = F.lit(math.log(freq[None]))
                for value, p in freq.items():
                    if value is not None:
                        e = F.when(category[c] == value, math.log(p)).otherwise(e)
                s = s + e
            logs.append(s)
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        parts = [F.exp(s - top) for s in logs]
        shares = {k: p / sum(parts[1:], parts[0]) for k, p in zip(seen, parts, strict=True)}
        return [shares.get(k, F.lit(0.0)) for k in range(len(self.domains))]


def classifier(rows: DataFrame, domain: str, categories: tuple[str, ...] = (), domains: tuple[str, ...] | None = None, most: int = 100) -> Classifier:
    """Fit on ``rows`` with the measures, ``domain`` and categories; rows without a domain are left out.

    ``domains`` fixes the domains and their order; those without rows get
    prior 0, with a warning, and no rows at all give equal priors. Only sums
    by domain (at most ``most``) and by category value (the ``most`` most
    frequent of each) reach the driver; other values share one frequency.
    """
    rows = rows.where(F.col(domain).isNotNull())
    stats = rows.groupBy(F.col(domain).cast("string").alias("d")).agg(
        F.count("*").alias("n"), *[f(m).alias(f"{a}_{m}") for m in MEASURES for a, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    )
    got = {r["d"]: r for r in stats.orderBy("d").limit(most + 1).collect()}
    if len(got) > most or len(domains or ()) > most:
        raise ValueError(f"more than {most} domains")
    names = tuple(domains or got)
    if not names:
        raise ValueError("no domains")
    if missing := [d for d in names if d not in got]:
        warnings.warn(f"no labelled documents of {', '.join(missing)}", stacklevel=2)
    if not got:
        flat = tuple((0.0, 1.0) for _ in MEASURES)
        return Classifier(names, (1 / len(names),) * len(names), (flat,) * len(names), tuple(categories), (tuple({None: 1.0} for _ in categories),) * len(names))
    total = sum(got[d]["n"] for d in names if d in got)
    frequencies: dict[str, list[dict]] = {d: [] for d in names}
    for c in categories:
        values = [r[0] for r in rows.groupBy(F.col(c).cast("string").alias("c")).count().where("c IS NOT NULL").orderBy(F.desc("count"), "c").limit(most).collect()]
        counts = {(r[0], r[1]): r[2] for r in rows.where(F.col(c).cast("string").isin(values)).groupBy(F.col(domain).cast("string"), F.col(c).cast("string")).count().collect()}
        for d in names:
            n = got[d]["n"] if d in got else 0
            out = {v: (counts.get((d, v), 0) + 1) / (n + len(values) + 1) for v in values}
            frequencies[d].append(out | {None: 1 / (n + len(values) + 1)})
    normal = lambda r, m: (r[f"mean_{m}"], max(r[f"sd_{m}"], 0.02 * abs(r[f"mean_{m}"]), 1e-3))
    return Classifier(
        names,
        tuple(got[d]["n"] / total if d in got else 0.0 for d in names),
        tuple(tuple(normal(got[d], m) if d in got else (0.0, 1.0) for m in MEASURES) for d in names),
        tuple(categories),
        tuple(tuple(frequencies[d]) for d in names),
    )


@dataclass(frozen=True)
class Rates:
    """The gradient steps that lead to the rates; :meth:`rate` is a function of the posteriors.

    ``gap`` bounds how far half the squared residual is from the least
    possible; ``converged`` tells whether that is within the tolerance.
    """

    steps: tuple[tuple[float, ...], ...]
    start: float
    totals: tuple[float, ...]
    targets: tuple[float, ...]
    gap: float = 0.0
    converged: bool = True

    def rate(self, posteriors: list[Column], zero: Column | None = None) -> Column:
        r = F.lit(self.start)
        for step in self.steps:
            r = _stepped(r, posteriors, _numbers(step, zero))
        return r


def _numbers(values: Sequence[float], zero: Column | None) -> list[Column]:
    """Numbers as literals; with a column of zeros as items of an array, which generated code takes from outside: other numbers then need no other code."""
    if zero is None:
        return [F.lit(float(x)) for x in values]
    held = F.array(*[F.lit(float(x)) for x in values])
    return [F.get(held, zero + i) for i in range(len(values))]


def _along(posteriors: list[Column], step: list[Column]) -> Column:
    return sum((p * s for p, s in zip(posteriors[1:], step[1:], strict=True)), posteriors[0] * step[0])


def _stepped(r: Column, posteriors: list[Column], step: list[Column]) -> Column:
    return F.greatest(r - _along(posteriors, step), F.lit(0.0))


def fit_rates(rows: DataFrame, n: str, posteriors: list[str], weights: list[float], factor: float = 1.0, passes: int = 80, tolerance: float = 1e-6) -> Rates:
    """Rates of ``rows`` whose expected token totals by domain match ``weights`` of ``factor`` times all tokens.

    Projected gradient from equal rates, by implicit steps. The gradient of
    a document's rate, in units of its tokens, is its posteriors times the
    residual; a step moves all rates against it, cuts them off at zero, and
    takes the residual that it leads to, not the one it starts from: an
    explicit step must be short where domains nearly coincide and needs
    thousands of passes. That residual has as many numbers as there are
    domains; a damped Newton search finds it, a pass over the rows for each
    trial. Steps get a hundred times longer each.

    Targets out of reach get the least-squares fit. The fit ends when the
    residual is under ``tolerance`` of the target, when the duality gap
    proves half its square within a hundredth of ``tolerance`` of the least
    in units of half the squared target, or after ``passes``; ``converged``
    and ``gap`` say which. Null tokens count 0, null posteriors 0; no tokens
    give equal rates.
    """
    k = len(posteriors)
    names = [f"__p{i}" for i in range(k)]
    cols = [F.col(p) for p in names]
    given = rows.select(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("__n"), *[F.coalesce(F.col(f"`{p}`"), F.lit(0.0)).alias(q) for p, q in zip(posteriors, names, strict=True)])
    given = given.where("__n > 0").withColumn("__zero", F.when(F.col("__n") > 0, 0).otherwise(1))
    zero = F.col("__zero")
    tokens, whole = float(given.agg(F.sum("__n")).first()[0] or 0), sum(weights)
    goal = np.array([w / whole * tokens * factor if whole > 0 else 0.0 for w in weights])
    if tokens <= 0:
        return Rates((), float(factor), (0.0,) * k, tuple(goal.tolist()))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    left = passes

    def moved(taken: list[np.ndarray], step: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """After a step: totals, the Gram matrix of documents still used, their squared rates by tokens; the least gradient of any document."""
        nonlocal left
        left -= 1
        before = Rates(tuple(tuple(s.tolist()) for s in taken), float(factor), (), ()).rate(cols, zero)
        at = given.select("*", before.alias("__r")).select("*", _stepped(F.col("__r"), cols, _numbers(step.tolist(), zero)).alias("__s"))
        on = F.when(F.col("__s") > 0, F.col("__n")).otherwise(0.0)
        got = at.agg(
            *[F.sum(F.col("__s") * F.col("__n") * p) for p in cols], *[F.sum(on * cols[i] * cols[j]) for i, j in pairs],
            F.sum(F.col("__n") * F.col("__s") * F.col("__s")), F.min(_along(cols, _numbers(residual.tolist(), zero))),
        ).first()
        gram = np.zeros((k, k))
        for (i, j), g in zip(pairs, got[k : k + len(pairs)], strict=True):
            gram[i, j] = gram[j, i] = g
        return np.array(got[:k]), gram, got[-2], got[-1]

    taken: list[np.ndarray] = []
    totals, gram, squares, _ = moved(taken, np.zeros(k), np.zeros(k))
    weight = 1e-3 * np.trace(gram) / k  # one over the length of a step
    least, size = 1e-15 * np.trace(gram), float(np.linalg.norm(goal)) or 1.0
    gap, lost = math.inf, float(np.linalg.norm(totals - goal))
    while lost > tolerance * size and left > 1 and weight > least:
        u, value = np.zeros(k), squares / 2
        while left > 1:
            slope = weight * u + goal - totals
            if np.linalg.norm(slope) <= 1e-3 * tolerance * size:
                break
            way, scale = -np.linalg.solve(gram + weight * np.eye(k), slope), 1.0
            while True:
                to = u + scale * way
                tried = moved(taken, to, to)
                after = weight / 2 * to @ to + to @ goal + tried[2] / 2
                if after <= value + 1e-4 * scale * (slope @ way) or scale < 1e-6 or left < 1:
                    break
                scale /= 2
            done = value - after <= 1e-14 * abs(value)
            u, value, (totals, gram, squares, _) = to, after, tried
            if done:
                break
        taken.append(u)
        residual = totals - goal
        # Posteriors add up to 1, so raising the residual by its worst slope makes it feasible for the dual problem.
        low = moved(taken, np.zeros(k), residual)[3]
        dual = residual + max(0.0, -low)
        gap = float(residual @ residual / 2 + dual @ dual / 2 + dual @ goal)
        lost = float(np.linalg.norm(residual))
        if gap <= tolerance / 100 * size * size / 2:
            break
        weight /= 100
    gap = min(gap, lost * lost / 2)
    met = lost <= tolerance * size or gap <= tolerance / 100 * size * size / 2
    return Rates(tuple(tuple(s.tolist()) for s in taken), float(factor), tuple(totals.tolist()), tuple(goal.tolist()), gap, met)


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], domain: str = "domain", categories: tuple[str, ...] = ("lang",),
    factor: float = 1.0, doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, Classifier, Rates]:
    """``(doc_id, n_tokens, p_<domain>..., rate)`` of every document, the classifier and the rates.

    ``labelled`` has ids and domains; of several domains of an id the
    smallest counts, null ids and domains are left out, and ``weights`` names
    the domains used. A domain of ``weights`` without labelled documents has
    posterior 0 everywhere, with a warning: its target can't be met, and the
    others are fitted as they are. Where nothing is labelled (an empty table
    of either kind) all domains are equally likely. Null texts are empty;
    repeated rows get equal rates; an empty table gives an empty one. Other
    columns, whatever their names, are ignored. Texts are measured once, in
    a narrow table in the shared folder.
    """
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be nonnegative, and one positive")
    inner = [f"__c{i}" for i in range(len(categories))]
    given = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).cast("string").alias(i) for c, i in zip(categories, inner, strict=True)], measures(F.col(text)).alias("m"))
    kept = written(given.select("doc_id", *inner, "m.*"), "measures")
    known = labelled.where(F.col(doc_id).isNotNull() & F.col(domain).isin(*weights)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(domain).alias("__domain"))
    model = classifier(kept.join(known, "doc_id"), "__domain", tuple(inner), tuple(weights)).renamed(categories)
    names = [f"p_{d}" for d in model.domains]
    soft = model.posteriors({m: F.col(m) for m in MEASURES}, {c: F.col(i) for c, i in zip(categories, inner, strict=True)})
    rows = written(kept.select("doc_id", "n_tokens", *[p.alias(n) for p, n in zip(soft, names, strict=True)]), "posteriors")
    forget(kept)
    rates = fit_rates(rows, "n_tokens", names, [weights[d] for d in model.domains], factor)
    return rows.withColumn("rate", rates.rate([F.col(f"`{n}`") for n in names])), model, rates


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated, and written in plans, once."""
    return F.transform(F.array(value), then)[0]


def with_rates(docs: DataFrame, model: Classifier, rates: Rates, text: str = "text") -> DataFrame:
    """``docs`` with ``rate`` (which replaces a column of that name), without a join: the rate is a function of the row."""
    soft = model.posteriors(F.col("__m"), {c: F.col(c) for c in model.categories})
    out = docs.withColumn("__m", measures(F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns if c != "rate"], F.array(*soft).alias("__p"))
    rate = _once(F.col("__p"), lambda p: rates.rate([p[i] for i in range(len(soft))]))
    return out.withColumn("rate", rate).drop("__p")


def with_copies(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text", zero: bool = True) -> DataFrame:
    """``docs`` with ``copies``: the rate rounded up or down by a hash of the row, so that its expectation is the rate.

    Without ``zero`` rows of no copies are left out, by a generator and not
    by a condition, which the optimizer would work out a second time below.
    A column called copies is replaced.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    copies = lambda r: (F.floor(r) + (u < r - F.floor(r)).cast("int")).cast("int")
    if zero:
        return docs.withColumn("copies", _once(F.col("rate"), copies))
    both = _once(F.col("rate"), lambda r: F.struct(r.alias("rate"), copies(r).alias("copies")))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("rate", "copies")]
    return docs.select(*rest, F.inline(F.filter(F.array(both), lambda x: x["copies"] > 0)))
