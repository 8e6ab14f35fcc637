"""Analysed tokens, exact and fuzzy token match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = r"[^\p{L}\p{Nd}]+"


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits; null or blank text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda t: t != "")


def analyse(text: str | None) -> list[str]:
    """:func:`tokens` of a Python string."""
    out, run = [], []
    for c in (text or "") + " ":
        if c.isalpha() or c.isdecimal():
            run.append(c.lower())
        elif run:
            out.append("".join(run))
            run = []
    return out


def single_term(text: str) -> str:
    """The one token of ``text``; raises if it has none or several."""
    found = analyse(text)
    if len(found) != 1:
        raise ValueError(f"a search term must analyse to exactly one token: {text!r} gives {len(found)}")
    return found[0]


def check_fuzzy(max_edits: int, prefix_length: int) -> None:
    """Raise unless 0 <= max_edits <= 2 and prefix_length >= 0."""
    if not 0 <= max_edits <= 2:
        raise ValueError("max_edits must be 0, 1 or 2")
    if prefix_length < 0:
        raise ValueError("prefix_length must not be negative")


def _one_swap(token: Column, term: str) -> Column:
    """Whether swapping two neighbouring characters of ``token`` gives ``term``."""
    if len(term) < 2:
        return F.lit(False)
    swapped = [term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)]
    return token.isin(*dict.fromkeys(swapped))


def osa_distance(token: Column, term: str) -> Column:
    """Optimal string alignment distance to a literal, by dynamic programming over the token's characters."""
    n = len(term)
    start = F.struct(
        F.array(*[F.lit(j) for j in range(n + 1)]).alias("row"), F.array(*[F.lit(0)] * (n + 1)).alias("before"), F.lit("").alias("last"), F.lit(0).alias("i")
    )

    def cell(s: Column, c: Column, j: int):
        """Appends the row's cell of the term's character j."""

        def append(prev: Column) -> Column:
            best = F.least(s["row"][j] + 1, prev[j - 1] + 1, s["row"][j - 1] + F.when(c == term[j - 1], 0).otherwise(1))
            if j > 1:
                swap = (s["i"] >= 1) & (c == term[j - 2]) & (s["last"] == term[j - 1])
                best = F.when(swap, F.least(best, s["before"][j - 2] + 1)).otherwise(best)
            return F.array_append(prev, best)

        return append

    def step(s: Column, c: Column) -> Column:
        cells = F.array(s["i"] + 1)
        for j in range(1, n + 1):
            cells = F.transform(F.array(cells), cell(s, c, j))[0]
        return F.struct(cells.alias("row"), s["row"].alias("before"), c.alias("last"), (s["i"] + 1).alias("i"))

    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda s: s["row"][n])


def within_edits(token: Column, term: str, max_edits: int = 1, prefix_length: int = 0, transpositions: bool = True) -> Column:
    """Whether ``token`` is within ``max_edits`` of ``term`` after an equal prefix.

    The prefix covers at most the whole term; a token must then start with
    it, and the rest is compared. A plain edit distance of twice the edits
    is necessary for a transposing one, which spares most tokens the longer
    calculation.
    """
    check_fuzzy(max_edits, prefix_length)
    head = term[:prefix_length]
    tail = term[len(head) :]
    rest = F.substring(token, len(head) + 1, 2**31 - 1)
    starts = token.startswith(head) if head else F.lit(True)
    if max_edits == 0:
        return token == term
    near = (F.abs(F.length(rest) - len(tail)) <= max_edits) & (F.levenshtein(rest, F.lit(tail), max_edits) >= 0)
    if transpositions:
        if max_edits == 1:
            near = near | ((F.length(rest) == len(tail)) & _one_swap(rest, tail))
        else:
            near = near | ((F.levenshtein(rest, F.lit(tail), 2 * max_edits) >= 0) & (osa_distance(rest, tail) <= max_edits))
    return starts & near


def _pieces(text: Column) -> Column:
    """:func:`tokens`, and empty strings perhaps."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS)


def _may_hold(text: Column, term: str, max_edits: int, prefix_length: int, transpositions: bool) -> Column:
    """A cheap necessary condition on a whole text: it holds the prefix, and some piece of the rest unchanged.

    An edit damages one of the rest's pieces, a transposition two at most,
    so with one piece more than can be damaged one stands in the token.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    head = term[:prefix_length]
    tail = term[len(head) :]
    n = max_edits * (2 if transpositions else 1) + 1
    out = F.contains(low, F.lit(head)) if head else F.lit(True)
    if len(tail) >= n:
        cuts = [len(tail) * i // n for i in range(n + 1)]
        some = [F.contains(low, F.lit(tail[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        any_of = some[0]
        for s in some[1:]:
            any_of = any_of | s
        out = out & any_of
    return out


def token_match(text: Column, term: str) -> Column:
    """Whether a token equals the term; only texts that hold it anywhere are taken apart."""
    if not term:
        return F.lit(False)
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(term)) & F.array_contains(_pieces(text), term)


def fuzzy_match(text: Column, term: str, max_edits: int = 1, prefix_length: int = 0, transpositions: bool = True) -> Column:
    near = lambda t: (t != "") & within_edits(t, term, max_edits, prefix_length, transpositions)
    # The length rules most tokens out before anything is compared.
    sized = lambda t: (F.length(t) >= len(term) - max_edits) & (F.length(t) <= len(term) + max_edits) & near(t)
    return _may_hold(text, term, max_edits, prefix_length, transpositions) & F.exists(_pieces(text), sized)


def edit_distance(a: str, b: str, transpositions: bool = True) -> int:
    """Distance of two Python strings, for term lookups on the driver."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if transpositions and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]
