"""Scenarios of filters, pruning, projections and terminals on small files of two-row groups."""

import decimal
import os

import pytest
from pyspark.sql import functions as F

from siftlake.operators import predicates as P
from siftlake.operators.predicates import FilterBuilder, col, pushdown
from siftlake.operators.query import Query, StrictPushdownError
from siftlake.operators.split import split
from siftlake.plans.cache import LruPlanCache
from siftlake.plans.prune import Decision

TINY = {"parquet.block.row.count.limit": "2", "parquet.page.row.count.limit": "2", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def save(spark, rows, schema, path, **options):
    spark.createDataFrame(rows, schema).coalesce(1).write.options(**{**TINY, **options}).parquet(str(path))
    return next(os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".parquet"))


def people(spark, path, ages, countries=None, **options):
    rows = [(i + 1, (countries or ["DE"] * len(ages))[i], f"n{i}", a) for i, a in enumerate(ages)]
    return save(spark, rows, "Id int, Country string, Name string, Age int", path, **options)


def swap(new, old):
    """Put a file in another's place, without the checksum that Hadoop keeps beside the old one."""
    os.replace(new, old)
    crc = os.path.join(os.path.dirname(old), f".{os.path.basename(old)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def ids(q):
    return sorted(r["Id"] for r in q.select("Id").to_list())


def test_statistics_skip_a_group(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1, 2, 10, 20])
    q = Query.from_file(spark, f).pushdown(lambda b: b.ge("Age", 10))
    assert ids(q) == [3, 4]
    plan = q.plan()
    assert (plan.total_groups, plan.selected_groups) == (2, 1)
    assert plan.files[0].groups[0].decisions[0].source == "statistics"


@pytest.mark.parametrize(
    "build, expected",
    [
        (lambda b: b.eq("Age", 5), [1, 2]), (lambda b: b.not_eq("Age", 5), [3, 4, 5, 6]), (lambda b: b.lt("Age", 6), [1, 2]), (lambda b: b.le("Age", 6), [1, 2, 3]),
        (lambda b: b.gt("Age", 8), [6]), (lambda b: b.ge("Age", 8), [5, 6]), (lambda b: b.between("Age", 6, 7), [3, 4]), (lambda b: b.starts_with("Name", "n2"), [3]),
        (lambda b: b.eq("Age", None), []), (lambda b: b.lt("Age", None), []), (lambda b: b.not_eq("Age", None), [1, 2, 3, 4, 5, 6]),
    ],
)
def test_comparisons(spark, tmp_path, build, expected):
    f = people(spark, tmp_path / "a", [5, 5, 6, 7, 8, 9])
    q = Query.from_file(spark, f).pushdown(build)
    assert ids(q) == expected
    kept = {i for g in q.plan().files[0].groups if g.selected for i in (2 * g.ordinal + 1, 2 * g.ordinal + 2)}
    assert set(expected) <= kept


def test_not_equal_keeps_nulls_and_null_equality_loses_none(spark, tmp_path):
    f = save(spark, [(1, None), (2, None), (3, 5), (4, 6)], "Id int, Score int", tmp_path / "a")
    assert ids(Query.from_file(spark, f).where(col("Score") != 5)) == [1, 2, 4]
    q = Query.from_file(spark, f).pushdown(lambda b: b.eq("Score", None))
    assert ids(q) == [1, 2]
    assert [g.selected for g in q.plan().files[0].groups] == [True, False]
    assert ids(Query.from_file(spark, f).where(~(col("Score") > 5))) == [1, 2, 3]


def test_pages(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1, 2, 3, 4, 5, 6], **{"parquet.block.row.count.limit": "100"})
    q = Query.from_file(spark, f).where(col("Age") >= 5)
    assert ids(q) == [5, 6]
    g = q.plan().files[0].groups[0]
    assert (g.pages.selected, g.pages.total, g.pages.rows) == (1, 3, 2)


def test_bloom_rules_out(spark, tmp_path):
    options = {"parquet.bloom.filter.enabled#Name": "true", "parquet.enable.dictionary#Name": "false"}
    f = people(spark, tmp_path / "a", [1, 2, 3, 4], **options)
    plan = Query.from_file(spark, f).pushdown(lambda b: b.eq("Name", "n00")).plan()
    assert any(d.source == "bloom" for g in plan.files[0].groups for d in g.decisions)


def test_mixed_case_text_order(spark, tmp_path):
    f = save(spark, [(1, "B"), (2, "a"), (3, "Z"), (4, "é")], "Id int, Name string", tmp_path / "a")
    for v, want in (("a", [2]), ("B", [1]), ("é", [4])):
        q = Query.from_file(spark, f).pushdown(lambda b, v=v: b.eq("Name", v))
        assert ids(q) == want and any(g.selected for g in q.plan().files[0].groups)


def test_partitions_skip_files_and_fill_rows(spark, tmp_path):
    a = people(spark, tmp_path / "Country=DE", [1, 2])
    b = people(spark, tmp_path / "Country=US", [3, 4])
    spark.read.parquet(a).drop("Country").coalesce(1).write.parquet(str(tmp_path / "x" / "Country=DE"))
    spark.read.parquet(b).drop("Country").coalesce(1).write.parquet(str(tmp_path / "x" / "Country=US"))
    q = Query.from_directory(spark, str(tmp_path / "x")).where(col("Country") == "DE")
    assert ids(q) == [1, 2]
    assert [f.selected for f in q.plan().files] == [True, False]
    assert q.plan().lines()[0] == "Files: 1/2 selected"


def test_bad_partition_value_may_match():
    from siftlake.plans.prune import by_partition

    d = by_partition(P.Compare("Age", P.Op.GT, 18), {"age": "oops"})
    assert d.may_match and "could not be interpreted" in d.reason


def test_file_set(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1, 2])
    assert len(Query.from_files(spark, [f, "", f]).to_list()) == 2
    with pytest.raises(ValueError):
        Query.from_files(spark, ["", " "])
    people(spark, tmp_path / "b", [3])
    assert len(Query.from_directory(spark, str(tmp_path)).to_list()) == 3


def test_split_diagnostics_and_strict(spark, tmp_path):
    s = split((col("a") == 1) & ((col("b") == 2) | (col("c") == 3)) & ~(col("d") == 1) & col("e").ends_with("x") & col("f").is_true() & (col("g") == col("h")) & col("i").starts_with("p", ordinal=False))
    assert [p.describe() for p in s.pushed] == ["a == 1"]
    assert len(s.residual) == 6 and len({d.reason for d in s.diagnostics}) == 6
    assert str(s.diagnostics[2]).startswith('e.EndsWith("x") => ')
    f = people(spark, tmp_path / "a", [1])
    q = Query.from_file(spark, f).where(col("Name").ends_with("0")).strict_pushdown()
    for run in (q.plan, q.to_list, q.count):
        with pytest.raises(StrictPushdownError, match="EndsWith"):
            run()
    assert P.constant(5, "<", col("x")).describe() == "x > 5"


def test_nested_projection(spark, tmp_path):
    rows = [(1, "DE", ("Berlin", "1"), (10, 1)), (2, "DE", ("Munich", "2"), (20, 2)), (3, "US", ("Boston", "3"), (30, 3))]
    f = save(spark, rows, "Id int, Country string, Address struct<City:string,PostalCode:string>, Metrics struct<Score:int,Rank:int>", tmp_path / "a")
    q = Query.from_file(spark, f).where((col("Country") == "DE") & (col("Metrics.Score") >= 15)).select("Id", "Address.City", "Metrics.Score")
    assert [tuple(r) for r in q.to_list()] == [(2, "Munich", 20)]
    plan = q.plan()
    assert plan.filter_columns == ("Country", "Metrics/Score") and plan.deferred_columns == ("Address/City", "Id") and plan.late
    assert [tuple(r) for r in q.select(F.lit("k").alias("k"), "Address").to_list()] == [("k", ("Munich", "2"))]
    assert len(q.select("Id").to_list()[0]) == 1


def test_arrays_and_missing_columns(spark, tmp_path):
    f = save(spark, [(1, ["a", "b"]), (2, None)], "Id int, Tags array<string>", tmp_path / "a")
    assert Query.from_file(spark, f).where(col("Id") == 1).select("Tags").to_list()[0][0] == ["a", "b"]
    plan = Query.from_file(spark, f).pushdown(lambda b: b.eq("Missing", 1)).plan()
    assert all(d.source == "schema" and d.may_match for g in plan.files[0].groups for d in g.decisions)


def test_terminals(spark, tmp_path):
    f = people(spark, tmp_path / "a", [10, 20, 30, 40], ["DE", "DE", "DE", "US"])
    q = Query.from_file(spark, f)
    assert q.count() == 4 and q.where((col("Country") == "DE") & (col("Age") >= 20)).long_count() == 2
    assert q.any() and not q.where(col("Age") > 99).any()
    assert q.where(col("Age") > 10).select("Id").first_or_default()[0] == 2
    assert q.where(col("Age") > 99).first_or_default("none") == "none"
    assert sorted(r.Id for r in q.to_iterator()) == [1, 2, 3, 4]


def test_custom_predicate_planner_and_factory(spark, tmp_path):
    a, b = people(spark, tmp_path / "a", [1, 2]), people(spark, tmp_path / "b", [3, 4])

    class Planner:
        def can_plan(self, p):
            return True

        def evaluate(self, path, group, p):
            return Decision(p.describe(), path == a, "mine", "")

    seen = []

    def factory(spark, paths, options):
        seen.append(paths)
        return spark.read.parquet(*paths)

    q = Query.from_files(spark, [a, b]).pushdown(lambda f: f.ge("Age", 0)).with_planner(Planner()).with_reader_factory(factory)
    assert len(q.to_list()) == 2 and seen[-1] == [a]
    assert [f.selected for f in q.plan().files] == [True, False]


def test_shared_filters_and_immutability(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1, 2, 3])
    base = Query.from_file(spark, f)
    shared = pushdown(col("Age") > 1)
    assert base.pushdown(shared).pushdown(FilterBuilder().lt("Age", 3).build()).count() == 1
    assert base.count() == 3 and shared.both(pushdown()).predicates == shared.predicates and pushdown().empty
    changed = base.configure_options(lambda o: o.update(x="1"))
    assert base.options == {} and dict(changed.options) == {"x": "1"}


def test_plan_cache(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1, 2])
    cache = LruPlanCache(2)
    q = Query.from_file(spark, f).where(col("Age") == 1).with_cache(cache)
    assert q.plan() is q.plan() and len(cache) == 1
    people(spark, tmp_path / "c", [7, 8, 9])
    swap(next(str(p) for p in (tmp_path / "c").glob("*.parquet")), f)
    assert q.plan().files[0].rows == 3
    assert q.without_cache().plan() is not q.without_cache().plan()
    with pytest.raises(ValueError):
        LruPlanCache(0)


def test_catalyst_gets_the_filters(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1, 2])
    text = Query.from_file(spark, f).pushdown(lambda b: b.ge("Age", 1).not_eq("Country", "US").starts_with("Name", "n")).select("Id").explain(spark_plan=True)
    assert "GreaterThanOrEqual(Age,1)" in text and "StringStartsWith(Name,n)" in text and "Not(EqualNullSafe(Country,US))" in text.replace(" ", "")


def test_decimal_bounds():
    from siftlake.plans.prune import outside

    assert outside(P.Compare("a", P.Op.GT, 5), decimal.Decimal("1"), decimal.Decimal("4"), 0, 3)
    assert outside(P.Compare("a", P.Op.EQ, "x"), 1, 4, 0, 3) is None
