"""What bounds say about predicates: files by partition value, row groups, pages."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from siftlake.operators.predicates import Compare, Op, Predicate, StartsWith
from siftlake.plans.footer import Chunk, Page


@dataclass(frozen=True)
class Decision:
    """Whether rows of a file, row group or page range may match, and who says so."""

    predicate: str
    may_match: bool
    source: str
    reason: str

    def __str__(self) -> str:
        return f"{self.predicate}: {'may match' if self.may_match else 'no match'} [{self.source}] {self.reason}"


def upper_bound(prefix: str) -> str | None:
    """The least text above all texts with the prefix; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i])
        if c < 0x10FFFF:
            c = 0xE000 if c == 0xD7FF else c + 1
            return prefix[:i] + chr(c)
    return None


def comparable(value: Any, bound: Any) -> Any:
    """The literal in the bound's type; raises if they don't compare."""
    if isinstance(bound, bool) or isinstance(value, bool):
        if type(bound) is type(value):
            return value
        raise TypeError("a Boolean compares with a Boolean only")
    if isinstance(bound, dt.datetime) and isinstance(value, dt.datetime):
        return value.replace(tzinfo=bound.tzinfo) if (value.tzinfo is None) != (bound.tzinfo is None) else value
    if isinstance(bound, dt.datetime) and isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day, tzinfo=bound.tzinfo)
    if isinstance(bound, decimal.Decimal) and isinstance(value, (int, float, str)):
        return decimal.Decimal(str(value))
    _ = bound < value
    return value


def _order(v: Any) -> Any:
    """Texts compare by their UTF-8 bytes, as the statistics do."""
    return v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v


def outside(p: Predicate, low: Any, high: Any, nulls: int | None, rows: int) -> str | None:
    """Why no row between the bounds can match; None if one may. Bounds of None are unknown."""
    if isinstance(p, Compare) and p.value is None:
        if p.op is Op.EQ:
            return "no nulls" if nulls == 0 else None
        if p.op is Op.NE:
            return "only nulls" if nulls is not None and nulls == rows else None
        return "nothing orders against null"
    if nulls is not None and nulls == rows and rows and not (isinstance(p, Compare) and p.op is Op.NE):
        return "only nulls"
    if low is None or high is None:
        return None
    if isinstance(p, StartsWith):
        if not isinstance(low, str) or not isinstance(high, str):
            return None
        end = upper_bound(p.prefix)
        if _order(high) < _order(p.prefix) or (end is not None and _order(low) >= _order(end)):
            return f"prefix range is outside [{low!r}, {high!r}]"
        return None
    if not isinstance(p, Compare):
        return None
    try:
        v = _order(comparable(p.value, low))
    except TypeError:
        return None
    if v != v:
        return None
    a, b = _order(low), _order(high)
    out = {
        Op.EQ: v < a or v > b,
        Op.NE: a == b == v and nulls == 0,
        Op.LT: a >= v,
        Op.LE: a > v,
        Op.GT: b <= v,
        Op.GE: b < v,
    }[p.op]
    return f"value is outside what [{low!r}, {high!r}] allows" if out else None


def by_statistics(p: Predicate, chunk: Chunk, rows: int) -> Decision:
    why = outside(p, chunk.minimum, chunk.maximum, chunk.nulls, rows)
    if why:
        return Decision(p.describe(), False, "statistics", why)
    if chunk.minimum is None and chunk.nulls is None:
        return Decision(p.describe(), True, "statistics", "no usable statistics")
    return Decision(p.describe(), True, "statistics", "bounds allow a match")


def by_partition(p: Predicate, values: dict[str, str]) -> Decision | None:
    """A file's verdict from the ``k=v`` directories of its path; None if the column isn't among them."""
    paths = p.columns()
    if len(paths) != 1 or not isinstance(p, (Compare, StartsWith)):
        return None
    key = paths[0].replace(".", "/").rsplit("/", 1)[-1].lower()
    if key not in values:
        return None
    text = values[key]
    if text == "__HIVE_DEFAULT_PARTITION__":
        got, nulls = None, 1
    else:
        nulls, want = 0, p.value if isinstance(p, Compare) else ""
        try:
            got = parse(text, type(want)) if want is not None else text
        except ValueError:
            return Decision(p.describe(), True, "partition", f"{text!r} could not be interpreted")
    why = outside(p, got, got, nulls, 1)
    return Decision(p.describe(), why is None, "partition", f"{key}={text}")


def parse(text: str, kind: type) -> Any:
    """A text as a value of a Python type."""
    if kind is bool:
        if text.lower() not in ("true", "false"):
            raise ValueError(text)
        return text.lower() == "true"
    if kind is dt.datetime:
        return dt.datetime.fromisoformat(text)
    if kind is dt.date:
        return dt.date.fromisoformat(text)
    if kind is decimal.Decimal:
        try:
            return decimal.Decimal(text)
        except decimal.InvalidOperation as e:
            raise ValueError(text) from e
    return kind(text)


Interval = tuple[int, int]


def merged(intervals: Iterable[Interval]) -> list[Interval]:
    """Sorted, disjoint, with touching ones joined; empty ones dropped."""
    out: list[Interval] = []
    for a, b in sorted(i for i in intervals if i[0] < i[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def intersect(x: Sequence[Interval], y: Sequence[Interval]) -> list[Interval]:
    return merged((max(a, c), min(b, d)) for a, b in x for c, d in y)


def page_intervals(p: Predicate, pages: list[Page]) -> list[Interval]:
    """Rows of the pages that may match."""
    return merged((g.first_row, g.first_row + g.rows) for g in pages if outside(p, g.minimum, g.maximum, g.rows if g.all_null else g.nulls, g.rows) is None)


def touched(pages: list[Page], intervals: Sequence[Interval]) -> list[int]:
    """Ordinals of the pages that intersect some rows."""
    return [i for i, g in enumerate(pages) if any(a < g.first_row + g.rows and g.first_row < b for a, b in intervals)]
