"""Text search, string-typed predicates, the line language."""

import itertools
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions import text as X
from siftlake.operators import predicates as P
from siftlake.operators.dynamic import DynamicPredicate, DynamicQuery, parse_literal
from siftlake.operators.predicates import FilterBuilder, col
from siftlake.operators.query import Query, StrictPushdownError
from siftlake.operators.textlang import complete, parse, to_python
from pyspark.sql import types as T
from tests.test_query import save


@pytest.fixture()
def names(spark, tmp_path):
    rows = [(1, "Berlin Travel"), (2, "Hamburg Harbor"), (3, "Tokyo Lights"), (4, "Osaka-Castle 2x"), (5, None), (6, "")]
    return save(spark, rows, "Id int, Name string", tmp_path / "n")


def ids(q):
    return sorted(r[0] for r in q.select("Id").to_list())


def test_tokens(spark):
    got = spark.createDataFrame([("Ab-c1 Éáx",), (None,), ("  ",)], "t string").select(X.tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [["ab", "c1", "éa", "x"], [], []]
    assert X.analyse("Ab-c1 Éáx") == ["ab", "c1", "éa", "x"]


def test_match_and_fuzzy(spark, names):
    q = Query.from_file(spark, names)
    assert ids(q.token_match("Name", "castle")) == [4]
    assert ids(q.token_match("Name", "Castl")) == []
    assert ids(q.token_fuzzy("Name", "berln", 1, 1)) == [1]
    with pytest.raises(ValueError):
        q.token_match("Name", "two words")
    with pytest.raises(ValueError):
        FilterBuilder().token_fuzzy("Name", "--")
    bad = q.pushdown(P.TokenMatch("Name", "x", 3))
    with pytest.raises(ValueError):
        bad.to_list()


def test_transpositions_switch(spark, tmp_path):
    f = save(spark, [(1, "abcd"), (2, "wxyz")], "Id int, Name string", tmp_path / "a")
    q = Query.from_file(spark, f)
    assert ids(q.token_fuzzy("Name", "abdc", 1)) == [1]
    assert ids(q.token_fuzzy("Name", "abdc", 1, transpositions=False)) == []
    assert ids(q.token_fuzzy("Name", "abc", 1, prefix_length=3)) == [1]  # the prefix is the whole term


def test_edits_against_brute_force(spark):
    words = ["".join(w) for n in range(0, 5) for w in itertools.product("abc", repeat=n)]
    random.seed(3)
    words = random.sample(words, 60) + ["ca", "abc", "acb", "bca"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for term, k, prefix, swap in (("abc", 1, 0, True), ("abc", 2, 0, True), ("ca", 2, 0, True), ("abca", 2, 1, True), ("abc", 2, 0, False), ("abc", 1, 2, False), ("abcb", 2, 9, True)):
        got = {r[0] for r in df.where(X.within_edits(F.col("w"), term, k, prefix, swap)).collect()}
        match = P.TokenMatch("w", term, k, prefix, swap)
        assert got == {w for w in words if match.matches_term(w)}, (term, k, prefix, swap)
    assert X.edit_distance("ca", "abc") == 3 and X.edit_distance("ab", "ba") == 1 and X.edit_distance("ab", "ba", False) == 2


def test_matches_of_whole_texts_against_brute_force(spark):
    """The condition on whole texts that comes first loses no match."""
    random.seed(4)
    letters = "abcd"
    texts = [" ".join("".join(random.choice(letters) for _ in range(random.randint(1, 6))) for _ in range(random.randint(0, 4))) for _ in range(150)] + [None, "", "ABCD-abdc", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for term, k, prefix, swap in (("abcd", 0, 0, True), ("abcd", 1, 0, True), ("abcd", 1, 0, False), ("abcdab", 2, 0, True), ("abcdab", 2, 0, False), ("abcda", 2, 2, True), ("ab", 2, 0, True), ("abc", 1, 3, True)):
        match = P.TokenMatch("t", term, k, prefix, swap)
        got = {r.i for r in df.where(match.to_column()).collect()}
        assert got == {i for i, t in enumerate(texts) if any(match.matches_term(x) for x in X.analyse(t))}, (term, k, prefix, swap)


DATA = [(1, "DE", "alpha", 10), (2, "US", "bravo", 20), (3, "DE", "gamma", 15), (4, "US", "delta", 30)]


@pytest.fixture()
def people(spark, tmp_path):
    return DynamicQuery.from_path(spark, save(spark, DATA, "Id int, Country string, Name string, Age int", tmp_path / "p"))


def test_dynamic(people):
    got = people.where(DynamicPredicate("Age", " Between ", "15", "25")).execute()
    assert [r["Name"] for r in got.rows] == ["bravo", "gamma"] and got.total == 2
    page = people.execute(1, 2)
    assert [r["Id"] for r in page.rows] == [2, 3] and page.total == 4 and page.plan.total_groups == 2
    assert people.where() is people
    assert people.where(DynamicPredicate("Nope", "isnull")).count() == 4
    assert people.where(DynamicPredicate("Nope", "isnotnull")).count() == 0
    odd = people.where(DynamicPredicate("Nope", "eq", "1"))
    assert odd.count() == 4 and len(odd.ignored) == 1
    from dataclasses import replace

    with pytest.raises(StrictPushdownError):
        replace(odd, strict=True).count()
    with pytest.raises(ValueError):
        people.where(DynamicPredicate("Age", "like", "1")).count()
    with pytest.raises(ValueError):
        people.where(DynamicPredicate("Age", "eq", "x")).count()
    assert people.where(DynamicPredicate("Name", "tokenfuzzy", "aplha")).count() == 1
    assert people.where(DynamicPredicate("Age", "contains", "1")).count() == 0
    assert sorted(r["Id"] for r in people.to_iterator()) == [1, 2, 3, 4] and people.any()


def test_literals():
    assert parse_literal("true", T.BooleanType()) is True and parse_literal("aGk=", T.BinaryType()) == b"hi"
    assert parse_literal("2024-01-02T03:04:05+01:00", T.TimestampNTZType()).hour == 2
    for text, kind in (("x", T.IntegerType()), ("maybe", T.BooleanType()), ("*", T.BinaryType()), ("2024-13-01", T.DateType())):
        with pytest.raises(ValueError):
            parse_literal(text, kind)


def test_language():
    got = parse('EQ(age, 5) // c\n\nBad(x)\nBetween("q w", 1, 2)\nLuceneFuzzy(name, \'a\\\'b\', maxEdits=2, transpositions=false)\nLt(age)\nContains(age, "1")\nGt(zz, 1)\nEq(age, "x', {"Age": False, "q w": False, "Name": True})
    assert [(p.column, p.operator) for p in got.predicates] == [("Age", "=="), ("q w", "between"), ("Name", "tokenfuzzy")]
    fuzzy = got.predicates[2]
    assert (fuzzy.value, fuzzy.max_edits, fuzzy.prefix_length, fuzzy.transpositions) == ("a'b", 2, 0, False)
    assert [e.line for e in got.errors] == [3, 6, 7, 8, 9]
    assert complete("Be") == ["Between("] and complete("Eq(Na", ["Name", "Age"]) == ["Name"] and "maxEdits=" in complete("TokenFuzzy(a, b, ")
    assert "between" in to_python(list(got.predicates))


_leaf = st.one_of(
    st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(list(P.Op)), st.one_of(st.none(), st.integers(0, 4))),
)


def _tree(x):
    return st.one_of(st.tuples(st.just("and"), x, x), st.tuples(st.just("or"), x, x), st.tuples(st.just("not"), x))


_SQL = {P.Op.EQ: "=", P.Op.NE: "IS DISTINCT FROM", P.Op.LT: "<", P.Op.LE: "<=", P.Op.GT: ">", P.Op.GE: ">="}


def _both(t):
    """The predicate and its SQL under two-valued negation."""
    if t[0] == "and":
        (p, s), (q, u) = _both(t[1]), _both(t[2])
        return p & q, f"({s} AND {u})"
    if t[0] == "or":
        (p, s), (q, u) = _both(t[1]), _both(t[2])
        return p | q, f"({s} OR {u})"
    if t[0] == "not":
        p, s = _both(t[1])
        return ~p, f"(NOT {s})"
    c, op, v = t
    if v is None:
        return P.Compare(c, op, v), {P.Op.EQ: f"({c} IS NULL)", P.Op.NE: f"({c} IS NOT NULL)"}.get(op, "false")
    return P.Compare(c, op, v), f"coalesce({c} {_SQL[op]} {v}, false)"


@given(st.recursive(_leaf, _tree, max_leaves=6))
@settings(max_examples=40, deadline=None)
def test_random_trees_with_nulls_against_duckdb(spark, tree):
    rows = [(a, b) for a in (None, 0, 1, 2, 3) for b in (None, 0, 2, 4)]
    p, sql = _both(tree)
    df = spark.createDataFrame(rows, "a int, b int").where(p.to_column())
    values = ", ".join(f"({'NULL' if a is None else a}, {'NULL' if b is None else b})" for a, b in rows)
    want = duckdb.sql(f"SELECT a, b FROM (VALUES {values}) t(a, b) WHERE {sql}").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)
