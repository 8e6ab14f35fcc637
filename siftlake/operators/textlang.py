"""A line language for predicates: one call a line, all joined by AND.

    Eq(l_returnflag, "R")        // comments run to the end of the line
    Between("Net Weight", 1, 20)
    TokenFuzzy(text, 'berlin', maxEdits=1, prefixLength=2)

Names of functions and columns are case-insensitive; columns may be quoted.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from siftlake.operators.dynamic import DynamicPredicate

#: function: (operator, least and most arguments after the column, for texts only)
FUNCTIONS = {
    "eq": ("Eq", "==", 1, 1, False), "noteq": ("NotEq", "!=", 1, 1, False), "lt": ("Lt", "<", 1, 1, False), "le": ("Le", "<=", 1, 1, False),
    "gt": ("Gt", ">", 1, 1, False), "ge": ("Ge", ">=", 1, 1, False), "between": ("Between", "between", 2, 2, False),
    "startswith": ("StartsWith", "startswith", 1, 1, True), "contains": ("Contains", "contains", 1, 1, True),
    "tokenmatch": ("TokenMatch", "tokenmatch", 1, 1, True), "tokenfuzzy": ("TokenFuzzy", "tokenfuzzy", 1, 4, True),
    "lucenematch": ("TokenMatch", "tokenmatch", 1, 1, True), "lucenefuzzy": ("TokenFuzzy", "tokenfuzzy", 1, 4, True),
}
OPTIONS = ("maxEdits", "prefixLength", "transpositions")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}


@dataclass(frozen=True)
class LineError:
    line: int
    message: str


@dataclass(frozen=True)
class Parsed:
    predicates: tuple[DynamicPredicate, ...]
    errors: tuple[LineError, ...]


class _Bad(ValueError):
    pass


def _scan(line: str) -> list[tuple[str, str]]:
    """Tokens: name, text, or one of ( ) , =."""
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if c.isspace():
            i += 1
        elif line.startswith("//", i):
            break
        elif c in "(),=":
            out.append((c, c))
            i += 1
        elif c in "\"'":
            text, j = [], i + 1
            while j < len(line) and line[j] != c:
                if line[j] == "\\":
                    j += 1
                    if j == len(line):
                        break
                    text.append(_ESCAPES.get(line[j], line[j]))
                else:
                    text.append(line[j])
                j += 1
            if j >= len(line):
                raise _Bad("a quoted text isn't closed")
            out.append(("text", "".join(text)))
            i = j + 1
        else:
            j = i
            while j < len(line) and line[j] not in "(),=\"'" and not line[j].isspace() and not line.startswith("//", j):
                j += 1
            out.append(("name", line[i:j]))
            i = j
    return out


def _line(line: str, columns: dict[str, tuple[str, bool]] | None) -> DynamicPredicate | None:
    found = _scan(line)
    if not found:
        return None
    if found[0][0] != "name" or len(found) < 3 or found[1][0] != "(" or found[-1][0] != ")":
        raise _Bad("expected Function(column, ...)")
    spec = FUNCTIONS.get(found[0][1].lower())
    if spec is None:
        raise _Bad(f"unknown function {found[0][1]}")
    name, operator, least, most, texts = spec
    arguments: list[list[tuple[str, str]]] = [[]]
    for token in found[2:-1]:
        if token[0] in "()":
            raise _Bad("calls can't be nested")
        if token[0] == ",":
            arguments.append([])
        else:
            arguments[-1].append(token)
    if any(not a for a in arguments):
        raise _Bad("an argument is empty")
    plain: list[tuple[str, str]] = []
    options: dict[str, str] = {}
    for a in arguments:
        if len(a) == 3 and a[1][0] == "=":
            options[a[0][1].lower()] = a[2][1]
        elif len(a) == 1:
            if options:
                raise _Bad("named options come last")
            plain.append(a[0])
        else:
            raise _Bad("expected a comma")
    fuzzy = operator == "tokenfuzzy"
    for key in options:
        if not fuzzy or key not in [o.lower() for o in OPTIONS]:
            raise _Bad(f"unknown option {key}")
    if not least <= len(plain) - 1 <= most:
        raise _Bad(f"{name} takes {least}{f' to {most}' if most != least else ''} arguments after the column, not {len(plain) - 1}")
    column = plain[0][1]
    if columns is not None:
        if column.lower() not in columns:
            raise _Bad(f"unknown column {column}")
        column, is_text = columns[column.lower()]
        if texts and not is_text:
            raise _Bad(f"{name} needs a text column")
    values: list[Any] = [None if kind == "name" and text.lower() == "null" else text for kind, text in plain[1:]]
    if not fuzzy:
        return DynamicPredicate(column, operator, *values)
    for key, (_, text) in zip(OPTIONS, plain[2:], strict=False):
        if key.lower() in options:
            raise _Bad(f"{key} is given twice")
        options[key.lower()] = text
    try:
        edits, prefix = int(options.get("maxedits", 1)), int(options.get("prefixlength", 0))
    except ValueError:
        raise _Bad("maxEdits and prefixLength are whole numbers") from None
    if not 0 <= edits <= 2 or prefix < 0:
        raise _Bad("maxEdits is 0 to 2, prefixLength 0 or more")
    swap = options.get("transpositions", "true").lower()
    if swap not in ("true", "false"):
        raise _Bad("transpositions is true or false")
    return DynamicPredicate(column, operator, values[0], None, edits, prefix, swap == "true")


def parse(text: str, columns: dict[str, bool] | None = None) -> Parsed:
    """Predicates of all good lines and the errors of the others.

    ``columns`` maps names to whether they are texts; without it any name is taken.
    """
    known = None if columns is None else {k.lower(): (k, v) for k, v in columns.items()}
    out, errors = [], []
    for n, line in enumerate(text.splitlines(), 1):
        try:
            p = _line(line, known)
        except _Bad as e:
            errors.append(LineError(n, str(e)))
        else:
            if p is not None:
                out.append(p)
    return Parsed(tuple(out), tuple(errors))


def complete(prefix: str, columns: list[str] = ()) -> list[str]:
    """Functions before the first parenthesis; then columns, then fuzzy options."""
    head, paren, rest = prefix.rpartition("\n")[2].partition("(")
    if not paren:
        names = dict.fromkeys(spec[0] for spec in FUNCTIONS.values())
        return [f"{n}(" for n in names if n.lower().startswith(head.strip().lower())]
    last = rest.rsplit(",", 1)[-1].strip().lower()
    if "," not in rest:
        return [c for c in columns if c.lower().startswith(last)]
    return [f"{o}=" for o in OPTIONS if head.strip().lower().endswith("fuzzy") and rest.count(",") >= 2 and o.lower().startswith(last)]


def to_python(predicates: list[DynamicPredicate], path: str = "data.parquet") -> str:
    """Python that asks the same by the fluent query."""
    fluent = {"==": "==", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
    out = [f"query = Query.from_file(spark, {path!r})"]
    for p in predicates:
        c, op = f"col({p.column!r})", p.operator
        if op in fluent:
            out.append(f"query = query.where({c} {op} {p.value!r})")
        elif op == "between":
            out.append(f"query = query.where({c}.between({p.value!r}, {p.value2!r}))")
        elif op in ("startswith", "endswith"):
            out.append(f"query = query.where({c}.{op.replace('with', '_with')}({p.value!r}))")
        elif op == "contains":
            out.append(f"query = query.where({c}.contains({p.value!r}))")
        elif op in ("isnull", "isnotnull"):
            out.append(f"query = query.where({c}.{'is_null' if op == 'isnull' else 'is_not_null'}())")
        elif op == "tokenmatch":
            out.append(f"query = query.token_match({p.column!r}, {p.value!r})")
        else:
            out.append(f"query = query.token_fuzzy({p.column!r}, {p.value!r}, {p.max_edits}, {p.prefix_length}, {p.transpositions})")
    return "\n".join(out)
