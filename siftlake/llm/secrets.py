"""Secret scans: patterns, and a randomness battery with false-discovery control.

Built-in SQL functions only. Three patterns give the base spans. Besides,
every long token is tested for randomness over the alphabet of its inferred
encoding:

- chi-squared uniformity of its symbols, a runs test about the middle of
  the alphabet and the lag-1 serial correlation, each against "random";
- the same chi-squared value against "structured", text whose symbols
  collide at a known rate. Its expectation grows with the length, so short
  tokens can't look random by luck.

A token is a discovery if no test against "random" rejects and its p-value
against "structured" passes the Benjamini-Hochberg bound of its stratum
(encoding and length band) over the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlake.llm import spans
from siftlake.llm.common import written

_ANY = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
#: kind, regular expression (leftmost non-overlapping), what a match must fulfil besides.
ASSIGN = rf"(?:{'|'.join(map(_ANY, ('password', 'passwd', 'secret', 'token')))}|{_ANY('api')}_?{_ANY('key')})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = rf"^(?:{'|'.join(map(_ANY, ('password', 'passwd', 'secret', 'token')))}|{_ANY('api')}_?{_ANY('key')})[\"']?\x20*[:=]\x20*[\"']?"
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

_L, _U, _D = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name, pattern, alphabet, collision rate of structured text in it; the first that fits is inferred.
ENCODINGS = (
    ("decimal", "[0-9]+", _D, 0.20),
    ("hex", "[0-9a-f]+", _D + "abcdef", 0.15),
    ("HEX", "[0-9A-F]+", _D + "ABCDEF", 0.15),
    ("lower", "[a-z]+", _L, 0.066),
    ("upper", "[A-Z]+", _U, 0.066),
    ("base32", "[A-Z2-7]+", _U + "234567", 0.06),
    ("base36", "[a-z0-9]+", _L + _D, 0.06),
    ("BASE36", "[A-Z0-9]+", _U + _D, 0.06),
    ("base62", "[A-Za-z0-9]+", _U + _L + _D, 0.06),
    ("base64", "[A-Za-z0-9+/]+", _U + _L + _D + "+/", 0.06),
    ("base64url", "[A-Za-z0-9_-]+", _U + _L + _D + "-_", 0.06),
)
BANDS = (24, 32, 48, 64)
#: Bins to a factor of ten in p, and the last bin.
_FINE, _LAST = 50, 2000


@dataclass(frozen=True)
class Battery:
    """Least token length, level of each test against "random", false-discovery rate against "structured"."""

    least: int = 20
    reject: float = 0.001
    fdr: float = 0.01

    @property
    def token(self) -> str:
        return rf"[A-Za-z0-9+/_-]{{{self.least},}}={{0,2}}"


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z; relative error under 1e-3 down to 1e-40."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    dense = F.exp(-a * a / 2) * 0.3989422804014327
    near = dense * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = dense / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 5 / (a + 6 / (a + 0.0 + 7 / (a + 8 / a))))))))
    p = F.when(a < 3, near).otherwise(far)
    return F.when(z >= 0, p).otherwise(1 - p)


def tested(token: Column, battery: Battery = Battery()) -> Column:
    """``struct<stratum, bin, random>`` of a token.

    ``stratum`` numbers its encoding and length band, ``bin`` is the floor
    of 50 times minus log10 of p against "structured" (at most 2000), and
    ``random`` tells that no test against "random" rejects.
    """
    body = F.regexp_replace(token, "=+$", "")
    which = F.coalesce(*[F.when(body.rlike(f"^{p}$"), F.lit(i)) for i, (_, p, _, _) in enumerate(ENCODINGS)], F.lit(len(ENCODINGS)))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), which + 1)
    alphabets = [a for _, _, a, _ in ENCODINGS] + [_U + _L + _D + "+/-_"]
    facts = F.struct(
        which.alias("which"),
        pick([float(len(a)) for a in alphabets]).alias("k"),
        pick([r for *_, r in ENCODINGS] + [0.06]).alias("rate"),
        F.length(body).cast("double").alias("n"),
        F.transform(F.split(body, ""), lambda c: (F.instr(pick(alphabets), c) - 1).cast("double")).alias("x"),
    )

    def sums(s: Column) -> Column:
        x, n, k = s["x"], s["n"], s["k"]
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda t, d: t + F.pow(F.size(F.filter(x, lambda y: y == d)).cast("double"), F.lit(2.0)))
        mean = F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / n
        spread = F.aggregate(x, F.lit(0.0), lambda t, y: t + (y - mean) * (y - mean))
        after = F.slice(x, F.lit(2), F.size(x) - 1)
        before = F.slice(x, F.lit(1), F.size(x) - 1)
        serial = F.aggregate(F.zip_with(before, after, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda t, y: t + y)
        high = F.size(F.filter(x, lambda y: y * 2 >= k)).cast("double")
        turns = F.size(F.filter(F.zip_with(before, after, lambda a, b: (a * 2 >= k) != (b * 2 >= k)), lambda c: c)).cast("double")
        return F.struct(
            s["which"].alias("which"), k.alias("k"), n.alias("n"), s["rate"].alias("rate"),
            (squares * k / n - n).alias("chi"), spread.alias("spread"), serial.alias("serial"), high.alias("high"), (turns + 1).alias("runs"),
        )

    def verdict(s: Column) -> Column:
        n, df = s["n"], s["k"] - 1
        delta = s["k"] * s["rate"] - 1
        z_uniform = (F.pow(F.greatest(s["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        pairs = s["high"] * (n - s["high"])
        expected = 1 + 2 * pairs / n
        variance = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(variance > 0, (s["runs"] - expected) / F.sqrt(F.when(variance > 0, variance).otherwise(1.0))).otherwise(99.0)
        z_serial = F.when(s["spread"] > 0, (s["serial"] / F.when(s["spread"] > 0, s["spread"]).otherwise(1.0)) * F.sqrt(n)).otherwise(99.0)
        fits = (
            (_upper_tail(z_uniform) >= battery.reject)
            & (2 * _upper_tail(F.abs(z_runs)) >= battery.reject)
            & (2 * _upper_tail(F.abs(z_serial)) >= battery.reject)
        )
        z_text = (df + n * delta - s["chi"]) / F.sqrt(2 * (df + 2 * n * delta))
        p = F.greatest(_upper_tail(z_text), F.lit(1e-40))
        band = sum((F.when(n >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
        return F.struct(
            (s["which"] * (len(BANDS) + 1) + band).cast("int").alias("stratum"),
            F.least(F.floor(-F.log10(p) * _FINE), F.lit(_LAST)).cast("int").alias("bin"),
            fits.alias("random"),
        )

    one = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  # evaluates value once
    return one(one(facts, sums), verdict)


def bounds(tokens: DataFrame, battery: Battery = Battery()) -> dict[int, int]:
    """Benjamini-Hochberg: the least bin discovered in each stratum, from ``stratum, bin`` of every token.

    Counted by stratum and bin before ranking, so at most a few thousand
    bins for each of at most 60 strata leave the executors' hash tables. A
    stratum without discoveries is absent.
    """
    counts = tokens.groupBy("stratum", "bin").count()
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = counts.select("stratum", "bin", F.sum("count").over(down).alias("rank"), F.sum("count").over(Window.partitionBy("stratum")).alias("all"))
    good = ranked.where(F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / _FINE) <= battery.fdr * F.col("rank"))
    return {r[0]: r[1] for r in good.groupBy("stratum").agg(F.min("bin")).collect()}


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end>>`` of the three patterns; ``kind`` counts from 0 in the order of ``KINDS``."""

    def kind(k: int, regex: str) -> Column:
        parts = spans.pieces(text, regex)
        return F.transform(
            spans.located(parts, spans.matches(text, regex, parts)),
            lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["text"].alias("text")),
        )

    assign = F.filter(kind(0, ASSIGN), lambda m: F.length(F.regexp_replace(m["text"], ASSIGN_HEAD, "")) >= 6)
    every = F.concat(assign, kind(1, ACCESS), kind(2, HEX))
    return F.array_sort(F.transform(every, lambda m: F.struct(m["start"], m["kind"], m["end"])))


def scan(docs: DataFrame, battery: Battery = Battery(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every document, each ``array<struct<start, kind, end>>`` sorted by start, then kind.

    ``base`` has the pattern spans, ``spans`` those and the random tokens
    that no base span covers. A null text is empty; repeated rows are
    scanned each; extra columns are ignored. Tokens are tested in one pass,
    whose narrow result is kept in the shared folder; only counts by bin
    reach the driver.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    parts = spans.pieces(F.col("text"), battery.token)
    long = spans.located(parts, spans.matches(F.col("text"), battery.token, parts))
    judged = F.transform(
        long, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), tested(m["text"], battery).alias("t"))
    )
    kept = written(given.select("doc_id", base_spans(F.col("text")).alias("base"), judged.alias("tokens")), "tokens")
    least = bounds(kept.select(F.explode("tokens.t").alias("t")).select("t.stratum", "t.bin"), battery)
    bound = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.create_map().cast("map<int,int>")
    found = F.filter(
        "tokens",
        lambda m: m["t"]["random"]
        & F.coalesce(m["t"]["bin"] >= F.try_element_at(bound, m["t"]["stratum"]), F.lit(False))
        & ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])),
    )
    random = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return kept.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def shown(of: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def counted(of: Column, kind: str) -> Column:
    return F.size(F.filter(of, lambda m: m["kind"] == KINDS.index(kind))).cast("long")


