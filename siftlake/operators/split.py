"""Split row conditions into what planning can use and what only rows can decide."""

from __future__ import annotations

from dataclasses import dataclass

from siftlake.operators import predicates as P


@dataclass(frozen=True)
class Diagnostic:
    expression: str
    reason: str

    def __str__(self) -> str:
        return f"{self.expression} => {self.reason}"


@dataclass(frozen=True)
class Split:
    pushed: tuple[P.Predicate, ...]
    residual: tuple[P.Predicate, ...]
    diagnostics: tuple[Diagnostic, ...]


def reason(p: P.Predicate) -> str:
    """Why a predicate can't be pushed down."""
    if isinstance(p, P.Or):
        return "alternatives can't be split; only conditions joined by AND are pushed down"
    if isinstance(p, P.Not):
        return "a negated condition isn't pushed down; use != or the opposite comparison"
    if isinstance(p, P.CaseFoldedPrefix):
        return "only a case-sensitive prefix test has an order that statistics follow"
    if isinstance(p, P.TextTest):
        return f"{p.kind} says nothing about a column's minimum and maximum"
    if isinstance(p, P.FieldCompare):
        return "both sides are columns; one side must be a constant"
    if isinstance(p, P.Constant):
        return "a constant condition names no column"
    if isinstance(p, P.Opaque) and len(p.reads) == 1 and p.text == p.reads[0]:
        return "a bare Boolean column isn't a comparison; compare it with true"
    if isinstance(p, P.Opaque):
        return "a computed expression can only be evaluated on rows"
    return "this kind of condition can only be evaluated on rows"


def split(condition: P.Predicate) -> Split:
    """Pushed conjuncts and the rest. The whole condition is still evaluated on rows."""
    pushed, residual, said = [], [], []
    for p in P.conjuncts(condition):
        if p.pushable:
            pushed.append(p)
        else:
            residual.append(p)
            said.append(Diagnostic(p.describe(), reason(p)))
    return Split(tuple(pushed), tuple(residual), tuple(said))
