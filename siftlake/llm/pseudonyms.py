"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses.

Built-in SQL functions only. Each kind of value is a domain that a keyed
Feistel network permutes: a state (a, b) in Z_p x Z_q, a and b in turn
shifted by a keyed hash of the other. As that is a bijection of the valid
values, equal values stay equal across documents, different ones stay
different, and the results pass the same validation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm import spans

_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: kind, regular expression; tried in this order at each place.
PATTERNS = (
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"),
    ("iban", rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}{_END}"),
    ("date", rf"(?<![0-9A-Za-z.-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}})(?![0-9A-Za-z-])"),
    ("ssn", rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{1,4}(?:(?:[ .-]?[0-9]{2}){4,5}|(?:[ .-]?[0-9]{2,4}){1,3})(?![0-9A-Za-z])"),
    ("ipv4", r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"),
    ("card", rf"{_EDGE}[0-9](?:[ -]?[0-9]){{12,63}}{_END}"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: How a card is grouped that stands in a longer row of digits.
_CARD_SHAPE = "^[ -]?(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,4}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
ROUNDS = 10
#: Days of 1900-2099: 73,049 = 17 * 4,297.
_DAYS = (17, 4297)
_CLASSES = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), then)[0]


def _keyed(key: str, tweak: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *parts).cast("binary"), 256)


def _number(hexed: Column) -> Column:
    """The first 60 bits of a hexadecimal hash."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, p: Column, q: Column, key: str, tweak: str) -> Column:
    """``struct<a, b>``: the keyed permutation of Z_p x Z_q; p and q below 2^59."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        f = _number(_keyed(key, tweak, i.cast("string"), p.cast("string"), q.cast("string"), F.when(even, s["b"]).otherwise(s["a"]).cast("string")))
        return F.struct(
            F.when(even, (s["a"] + f % p) % p).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + f % q) % q).alias("b"),
        )

    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step)


def digits(value: Column, key: str, tweak: str) -> Column:
    """Permute strings of 2 to 34 digits of one length."""

    def go(v: Column) -> Column:
        n = F.length(v)
        left = F.floor(n / 2).cast("int")
        p, q = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), n - left).cast("long")
        done = feistel(F.substring(v, F.lit(1), left).cast("long"), F.substring(v, left + 1, n - left).cast("long"), p, q, key, tweak)
        return _once(done, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, F.lit("0")), F.lpad(s["b"].cast("string"), n - left, F.lit("0"))))

    return _once(value, go)


def characters(value: Column, key: str, tweak: str) -> Column:
    """Permute a text of any length; each character stays in its class (digit, small or capital letter, accented)."""

    def shift(s: Column, by: Column) -> Column:
        def one(c: Column, f: Column) -> Column:
            out = c
            for members in _CLASSES:
                at = F.instr(F.lit(members), c)
                out = F.when(at > 0, F.substring(F.lit(members), (at - 1 + f) % len(members) + 1, F.lit(1))).otherwise(out)
            return out

        # One hash serves sixteen characters.
        hashes = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 16).cast("int")), lambda b: _keyed(key, tweak, by, b.cast("string")))
        number = lambda h, j: F.conv(F.substring(F.get(h, F.floor(j / 16).cast("int")), (j % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.when(s == "", s).otherwise(_once(hashes, lambda h: F.array_join(F.transform(F.split(s, ""), lambda c, j: one(c, number(h, j))), "")))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, shift(s["a"], F.concat_ws("|", i.cast("string"), s["b"]))).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(shift(s["b"], F.concat_ws("|", i.cast("string"), s["a"]))).alias("b"),
        )

    def go(v: Column) -> Column:
        left = F.floor(F.length(v) / 2).cast("int")
        state = F.struct(F.substring(v, F.lit(1), left).alias("a"), F.substring(v, left + 1, F.length(v)).alias("b"))
        return _once(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step), lambda s: F.concat(s["a"], s["b"]))

    return _once(value, go)


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(shape: Column, new: Column) -> Column:
    """Put the digits of ``new`` in the places of the digits of ``shape``."""
    return F.array_join(F.zip_with(F.split(shape, "[0-9]", -1), F.split(new, ""), lambda s, d: F.concat(s, F.coalesce(d, F.lit("")))), "")


def _luhn(v: Column) -> Column:
    """Luhn sum of a digit string, its last digit undoubled."""
    each = F.transform(
        F.reverse(F.split(v, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))
    )
    return F.aggregate(each, F.lit(0), lambda t, x: t + x)


def _mod97(v: Column) -> Column:
    """An IBAN's number, letters as 10-35, modulo 97; its first four characters count last."""
    moved = F.split(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4)), "")

    def step(t: Column, c: Column) -> Column:
        value = F.instr(F.lit("0123456789" + _CLASSES[2]), c) - 1
        return (t * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(moved, F.lit(0), step)


def _date(m: Column, key: str) -> Column:
    part = lambda at, n: F.substring(m, at, n)
    iso = m.rlike("^[0-9]{4}-")
    year, month, day = F.when(iso, part(1, 4)).otherwise(part(7, 4)), part(6, 2), F.when(iso, part(9, 2)).otherwise(part(1, 2))
    month = F.when(iso, month).otherwise(part(4, 2))
    date = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")

    def go(d: Column) -> Column:
        n = F.datediff(d, F.lit("1900-01-01").cast("date"))
        p, q = _DAYS
        done = feistel(F.floor(n / q), n % q, F.lit(p).cast("long"), F.lit(q).cast("long"), key, "date")
        new = _once(done, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * q + s["b"]).cast("int")))
        shown = lambda n: F.when(iso, F.date_format(n, "yyyy-MM-dd")).when(F.contains(m, F.lit("/")), F.date_format(n, "dd/MM/yyyy")).otherwise(F.date_format(n, "dd.MM.yyyy"))
        return F.when((n >= 0) & (n < p * q), _once(new, shown)).otherwise(m)

    return _once(date, go)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    done = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")

    def shown(s: Column) -> Column:
        i = F.floor(s["a"] / 99)
        new = i + 1 + F.when(i >= 665, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(new, 3), pad(s["a"] % 99 + 1, 2), pad(s["b"] + 1, 4))

    return F.when(valid, _once(done, shown)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:\+1(?=[^0-9])|\+[0-9]{1,3}(?=[^0-9])|\+[0-9]{2}|\+)", 0)
    rest = F.substring(m, F.length(head) + 1, F.lit(40))
    n = F.length(_only_digits(rest))
    return F.when((n >= 6) & (n <= 13), F.concat(head, _refill(rest, digits(_only_digits(rest), key, "phone")))).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    half = lambda i: o[i] * 256 + o[i + 1]
    done = feistel(half(0), half(2), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ipv4")
    shown = lambda s: F.concat_ws(".", *[x.cast("int").cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), s[h] % 256)])
    return F.when(F.forall(o, lambda x: x < 256), _once(done, shown)).otherwise(m)


def _card(m: Column, key: str) -> Column:
    """The match as one card, or else the longest runs of its groups that are cards in their usual groups, from the left."""

    def card(shape: Column, d: Column) -> Column:
        head = F.substring(d, F.lit(1), F.length(d) - 1)
        new = digits(head, key, "card")
        return _refill(shape, _once(new, lambda h: F.concat(h, ((10 - _luhn(F.concat(h, F.lit("0"))) % 10) % 10).cast("string"))))

    valid = lambda d: (F.length(d) >= 13) & (F.length(d) <= 19) & (_luhn(d) % 10 == 0)

    def runs(groups: Column) -> Column:
        run = lambda i, n: F.array_join(F.slice(groups, i + 1, n), "")

        def step(s: Column, i: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i))
            found = F.array_max(F.filter(lengths, lambda n: _once(run(i, n), lambda v: v.rlike(_CARD_SHAPE) & _once(_only_digits(v), valid))))
            taken = lambda n: F.when(n.isNull(), F.struct((i + 1).alias("at"), F.concat(s["out"], F.get(groups, i)).alias("out"))).otherwise(
                F.struct((i + n).alias("at"), F.concat(s["out"], card(run(i, n), _only_digits(run(i, n)))).alias("out"))
            )
            return F.when(i < s["at"], s).otherwise(_once(found, taken))

        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

    groups = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))
    return _once(_only_digits(m), lambda d: F.when(valid(d), card(m, d)).when(F.length(d) == F.length(m), m).otherwise(_once(groups, runs)))


def _iban(m: Column, key: str) -> Column:
    body = F.substring(m, 5, 40)
    fresh = _once(characters(body, key, "iban"), lambda b: F.concat(F.substring(m, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(m, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), b))
    return F.when(_mod97(m) == 1, fresh).otherwise(m)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(characters(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


_KINDS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "card": _card}


@dataclass(frozen=True)
class Pseudonyms:
    """The secret key, and which kinds are replaced."""

    key: str
    kinds: tuple[str, ...] = tuple(k for k, _ in PATTERNS)

    def pattern(self) -> str:
        return "|".join(f"(?:{p})" for k, p in PATTERNS if k in self.kinds)

    def replaced(self, match: Column) -> Column:
        """The pseudonym of one match of the pattern, or itself where it fails its kind's validation."""
        out = match
        for kind, p in reversed(PATTERNS):
            if kind in self.kinds:
                out = F.when(match.rlike(f"^(?:{p})$"), _KINDS[kind](match, self.key)).otherwise(out)
        return out


def pseudonymised(docs: DataFrame, how: Pseudonyms, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten; all columns stay, in order; null texts stay null.

    Numbers that fail their check (Luhn, mod 97, octets, calendar, area
    numbers) aren't personal data and stay; of a row of groups of digits, up
    to 64 of them at a time, those that are cards are replaced. The result's
    row count and every character outside a replaced value are unchanged.
    Repeated rows stay, an empty table gives an empty one, other columns are
    carried, whatever their names.
    """
    return docs.select(*[_rewritten(F.col(text), how)[0].alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, how: Pseudonyms, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n_replaced`` for every document; null texts are empty."""
    new = _rewritten(F.coalesce(F.col(text), F.lit("")), how)
    out = docs.select(F.col(doc_id).alias("doc_id"), F.struct(new[0].alias("text"), new[1].alias("n_replaced")).alias("new"))
    return out.select("doc_id", "new.text", "new.n_replaced")


def _rewritten(text: Column, how: Pseudonyms) -> tuple[Column, Column]:
    """The new text and how many values changed."""
    pattern = how.pattern()
    parts = spans.pieces(text, pattern)
    found = spans.matches(text, pattern, parts)
    pairs = F.transform(found, lambda m: F.struct(m.alias("old"), how.replaced(m).alias("new")))
    joined = F.array_join(F.zip_with(parts, pairs, lambda p, m: F.concat(p, F.coalesce(m["new"], F.lit("")))), "")
    changed = F.size(F.filter(pairs, lambda m: m["old"] != m["new"])).cast("long")
    return F.when(text.isNull(), text).otherwise(joined), changed
