"""Matches of a regular expression with their places, in built-in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(text: Column, regex: str) -> Column:
    """What stands before, between and after the matches: one more than there are matches."""
    return F.split(text, regex, -1)


def matches(text: Column, regex: str, parts: Column) -> Column:
    """The leftmost non-overlapping matches; texts whose ``parts`` show none aren't searched again."""
    return F.when(F.size(parts) > 1, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(F.array().cast("array<string>"))


def located(parts: Column, found: Column) -> Column:
    """``array<struct<start, end, text>>`` in code points, end exclusive.

    A match begins after all pieces and matches before it: the running sums
    are carried as two numbers through blocks of about the square root of
    the matches, so that a text of n matches costs n * sqrt(n) at most.
    """
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    sizes = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("text")))

    def placed(s: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(s).cast("double"))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / width).cast("int")), lambda b: F.slice(s, b * width + 1, width))
        total = lambda x: F.aggregate(x, F.lit(0), lambda t, m: t + m["gap"] + m["size"])
        # Each block with the sum of the blocks before it, then each match with the sum within its block.
        sums = F.transform(blocks, lambda b: F.struct(b.alias("b"), total(b).alias("n")))

        def inside(x: Column, i: Column) -> Column:
            base = F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda t, y: t + y["n"])
            return _once(
                F.struct(base.alias("base"), x["b"].alias("b")),
                lambda c: F.transform(
                    c["b"],
                    lambda m, j: _once(
                        c["base"] + total(F.slice(c["b"], F.lit(1), j)) + m["gap"],
                        lambda at: F.struct(at.alias("start"), (at + m["size"]).alias("end"), m["text"].alias("text")),
                    ),
                ),
            )

        return F.flatten(F.transform(sums, inside))

    return F.when(F.size(found) > 0, _once(sizes, placed)).otherwise(none)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), then)[0]
