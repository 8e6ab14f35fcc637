"""Write plans, sidecar indexes and their soundness, pool, keys, inspection, streaming, entry module."""

import dataclasses
import datetime as dt
import decimal
import importlib
import os
import sys
import threading
import warnings
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftlake.operators.predicates import col
from siftlake.operators.query import Query
from siftlake.plans import footer, indexes
from siftlake.sources import encryption, inspect
from siftlake.sources.pool import ReaderPool
from siftlake.sources.write import BitmapIndex, Bloom, Index, IndexKind, SortKey, TermIndex, build_plan, build_schema, column, write, write_options
from tests.test_query import people, swap


@dataclass
class Customer:
    CustomerId: str = column(Index("btree", order=1))


@write_options(compression="zstd", row_group_rows=256)
@dataclass
class Event:
    id: int
    name: str = column(Bloom(), Index("hash", order=2), name="event_name", required=True)
    CreatedAt: dt.datetime = column(SortKey(1, descending=True))
    Amount: decimal.Decimal = column(SortKey(2), precision=(20, 4))
    Buyer: Customer = column(name="Customer")
    Ignored: int = column(ignore=True, default=0)


def test_write_plan():
    plan = build_plan(Event)
    assert plan is build_plan(Event)
    assert [f.name for f in plan.schema] == ["id", "event_name", "CreatedAt", "Amount", "Customer"]
    assert not plan.schema["event_name"].nullable and plan.schema["Amount"].dataType.simpleString() == "decimal(20,4)"
    assert [(d.column, d.name) for d in plan.of_kind(IndexKind.EXTERNAL)] == [("Customer/CustomerId", "btree"), ("event_name", "hash")]
    assert [(d.column, d.order, d.descending) for d in plan.of_kind(IndexKind.SORT_KEY)] == [("CreatedAt", 1, True), ("Amount", 2, False)]
    assert plan.options["compression"] == "zstd" and plan.options["parquet.block.row.count.limit"] == "256" and plan.options["parquet.bloom.filter.enabled#event_name"] == "true"
    assert build_plan(Event, {"compression": "gzip"}).options["compression"] == "gzip" and build_plan(Event).options["compression"] == "zstd"
    with pytest.raises(TypeError):
        build_schema(int)


@write_options(row_group_rows=2)
@dataclass
class Row:
    Id: str
    Group: str = column(BitmapIndex(), SortKey(1))
    Name: str = column(TermIndex())


ROWS = [Row("1", "alpha", "Berlin Travel"), Row("2", "charlie", "Hamburg Harbor"), Row("3", "bravo", "Tokyo Lights"), Row("4", "delta", None)]
STRATEGIES = (indexes.BitmapStrategy(), indexes.TermStrategy(), indexes.SortOrderStrategy())


def test_indexes_prune_and_stay_sound(spark, tmp_path):
    at = str(tmp_path / "d")
    write(spark, ROWS, at, Row, STRATEGIES, files=1)
    q = Query.from_directory(spark, at)
    hit = q.with_indexes().pushdown(lambda b: b.eq("Group", "bravo"))
    assert [r.Id for r in hit.to_list()] == ["3"]
    groups = hit.plan().files[0].groups
    assert [g.selected for g in groups] == [False, True] and groups[0].decisions[0].source == "statistics+bitmap"
    fuzzy = q.token_fuzzy("Name", "berln", 1, 1)
    assert [r.Id for r in fuzzy.to_list()] == ["1"] and [g.selected for g in fuzzy.plan().files[0].groups] == [True, False]
    assert q.with_indexes().pushdown(lambda b: b.eq("Group", "zulu")).to_list() == []
    for value in ("alpha", "bravo", "nope", None):
        on, off = q.with_indexes().pushdown(lambda b, v=value: b.eq("Group", v)), q.pushdown(lambda b, v=value: b.eq("Group", v))
        assert on.count() == off.count()
    assert indexes.sort_order(at) == [{"path": "Group", "order": 1, "direction": "asc"}]
    assert [r.value for r in indexes.entries(spark, at, "bitmap", "Group", contains="AL").collect()] == ["alpha"]
    kinds = {(i.kind, i.column) for i in inspect.index_listing(at)}
    assert {("bitmap", "Group"), ("terms", "Name"), ("sort-order", "Group")} <= kinds
    # Stale: the file changes, the index gives no verdict.
    f = next(os.path.join(at, x) for x in os.listdir(at) if x.endswith(".parquet"))
    os.utime(f, ns=(1, 1))
    assert all(g.selected for g in hit.without_cache().plan().files[0].groups) and len(hit.to_list()) == 1
    # Unreadable: likewise.
    d = indexes.directory(at, "bitmap", "Group")
    for x in os.listdir(d):
        os.remove(os.path.join(d, x))
    assert [r.Id for r in q.with_indexes().pushdown(lambda b: b.eq("Group", "bravo")).to_list()] == ["3"]


def test_index_refusals(spark, tmp_path):
    at = str(tmp_path / "d")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        with pytest.raises(ValueError, match="low-cardinality"):
            write(spark, ROWS, at, Row, (indexes.BitmapStrategy(most=2),), files=1)
    assert said and len(Query.from_directory(spark, at).to_list()) == 4
    numbers = str(tmp_path / "n")
    spark.range(3).write.parquet(numbers)
    with pytest.raises(ValueError, match="only text"):
        indexes.build_terms(spark, numbers, "id")


def test_pool_blocks_and_refreshes(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1, 2])
    pool = ReaderPool(1)
    pool.prewarm(spark, f)
    q = Query.from_file(spark, f).with_reader_pool(pool)
    assert q.where(col("Age") > 1).count() == 1 and pool.opened == 1
    other = people(spark, tmp_path / "b", [7, 8, 9])
    waited = []
    with pool.block(spark, f):
        t = threading.Thread(target=lambda: waited.append(q.where(col("Age") > 0).count()))
        t.start()
        swap(other, f)
        t.join(0.3)
        assert not waited
    t.join(30)
    assert waited == [3]
    with pytest.raises(ValueError):
        ReaderPool(0)


def test_keys(tmp_path):
    assert encryption.normalise_key("0123456789abcdef") == b"0123456789abcdef"
    assert len(encryption.normalise_key("00" * 16)) == 32 and encryption.normalise_key("ab" * 12) == b"ab" * 12
    assert encryption.normalise_key("AAECAwQFBgcICQoLDA0ODxAREhMUFRYXGBkaGxwdHh8=") == bytes(range(32)) and len(encryption.normalise_key("pw")) == 32
    (tmp_path / "x").write_bytes(b"....PARE")
    assert encryption.is_encrypted_footer(str(tmp_path / "x"))


def test_encryption_needs_a_client(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1])
    q = Query.from_file(spark, f).with_footer_key("k").use_plaintext_footer().use_ctr_variant().with_column_key_resolver(lambda c: "c1" if c == "Name" else None)
    options = q.encryption.options(["Name", "Age"])
    assert options["parquet.encryption.column.keys"] == "c1:Name" and options["parquet.encryption.algorithm"] == "AES_GCM_CTR_V1"
    with pytest.raises(RuntimeError, match="key-management"):
        q.to_list()
    assert dataclasses.replace(q.encryption).fingerprint() == q.encryption.fingerprint()
    with pytest.raises(RuntimeError, match="AAD"):
        q.with_aad_prefix("p").to_list()


def test_column_keys_reach_the_reader(spark, tmp_path, monkeypatch):
    f = people(spark, tmp_path / "a", [1])
    seen = []
    monkeypatch.setattr(encryption.Encryption, "require_client", lambda *_: None)
    q = Query.from_file(spark, f).with_column_key_resolver(lambda c: "k1" if c in ("Name", "Age") else None)
    q.with_reader_factory(lambda s, paths, options: seen.append(dict(options)) or s.read.parquet(*paths)).source()
    assert seen[-1]["parquet.encryption.column.keys"] == "k1:Name,Age"


def test_pool_holds_its_lease_while_a_query_runs(spark, tmp_path):
    f = people(spark, tmp_path / "a", [1, 2, 3])
    pool = ReaderPool(1, capacity=1)
    q = Query.from_file(spark, f).with_reader_pool(pool)
    rows = q.to_iterator()
    next(rows)
    blocked = threading.Event()

    def replace_it():
        with pool.block(spark, f):
            blocked.set()

    t = threading.Thread(target=replace_it)
    t.start()
    assert not blocked.wait(0.3)  # the open iterator drains first
    assert len(list(rows)) == 2
    assert blocked.wait(30)
    t.join(30)
    assert not pool._out and not pool._holders
    pool.prewarm(spark, people(spark, tmp_path / "b", [1]), n=1)
    assert len(pool._frames) == 1
    with pytest.raises(ValueError):
        pool.prewarm(spark, f, n=2)


def test_plan_cache_sees_new_indexes_and_other_factories(spark, tmp_path):
    at = str(tmp_path / "d")
    write(spark, ROWS, at, Row, (), files=1)
    q = Query.from_directory(spark, at).with_indexes().pushdown(lambda b: b.eq("Group", "bz"))
    assert [g.selected for g in q.plan().files[0].groups] == [True, True]
    indexes.build_bitmap(spark, at, "Group")
    assert [g.selected for g in q.plan().files[0].groups] == [False, False] and q.to_list() == []
    keys = set()
    for _ in range(50):
        keys.add(q.with_reader_factory(lambda s, p, o: s.read.parquet(*p))._key("plan"))
    assert len(keys) == 50
    assert q.with_reader_pool(pool := ReaderPool())._key("plan") == q.with_reader_pool(pool)._key("plan")


def test_files_by_hadoop_file_system(spark, tmp_path, monkeypatch):
    from siftlake.plans import cache
    from siftlake.sources import scan

    at = str(tmp_path / "d d")
    write(spark, ROWS, at, Row, STRATEGIES, files=1)
    path = next(os.path.join(at, x) for x in os.listdir(at) if x.endswith(".parquet"))
    want = footer.read(path), cache.file_stamp(path)[1], indexes.sort_order(at), scan.names(at)
    monkeypatch.setattr(scan, "is_local", lambda p: False)
    got = footer.read(path), cache.file_stamp(path)[1], indexes.sort_order(at), scan.names(at)
    assert got[:3] == want[:3] and set(got[3]) == {n for n in want[3] if not n.endswith(".crc")}
    assert indexes.set_key_values(at, {"a": "1", "b": "2"}) == {"a": "1", "b": "2"} and indexes.set_key_values(at, {"a": None}) == {"b": "2"}
    assert inspect.key_values(path)["b"] == "2" and not scan.exists(at + "/nope")


def test_pages_of_several_files(spark, tmp_path):
    from siftlake.operators.dynamic import DynamicPredicate, DynamicQuery

    files = [people(spark, tmp_path / x, ages) for x, ages in (("a", [1, 2, 3]), ("b", [4]), ("c", [5, 6, 7, 8]))]
    q = DynamicQuery.from_path(spark, files).where(DynamicPredicate("Age", "ge", "2"))
    for offset in range(8):
        assert [r["Age"] for r in q.page(offset, 3).collect()] == list(range(2, 9))[offset : offset + 3]
    first = Query.from_files(spark, files)
    assert first.where(col("Age") > 3).select("Age").first_or_default()[0] == 4 and first.where(col("Age") > 9).first_or_default() is None
    assert first.count() == 8


def test_inspection(spark, tmp_path):
    f = people(spark, tmp_path / "a", [3, 1, 2])
    assert [r.path for r in inspect.schema_listing(spark, f).collect()] == ["Id", "Country", "Name", "Age"]
    m = {(r.row_group, r.path): r for r in inspect.metadata(spark, f).collect()}
    assert m[(0, "Age")].minimum == "1" and m[(0, "Age")].maximum == "3" and m[(0, "Age")].column_index
    assert [r["Age"] for r in inspect.browse(spark, f, 1, 5)] == [1, 2]
    answer = inspect.ask(spark, f, inspect.parse_for(spark, f, "ge(age, 2)").predicates)
    assert answer.total == 2 and answer.plan[0].startswith("File: ")
    assert footer.decode(b"\1\0\0\0", "INT32", False) == 1 and footer.decode(b"x", "INT96", False) is None


def test_follow(spark, tmp_path):
    from siftlake.streaming.follow import follow

    f = people(spark, tmp_path / "a", [1, 2, 3])
    q = follow(Query.from_file(spark, f).where(col("Age") > 1).select("Id"), str(tmp_path / "a")).writeStream.format("memory").queryName("followed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("followed").collect()) == [2, 3]


def test_entry_without_the_corpus_subpackage(monkeypatch):
    sys.modules.pop("__spark_entry__", None)
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("siftlake.llm", "corpus_pipeline") else real(name, *a))
    entry = importlib.import_module("__spark_entry__")
    assert "pushdown_select" in entry.queries() and not any(k.startswith("op1_") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)


def test_entries_without_limit_give_all_keys(spark, tmp_path):
    at = str(tmp_path / "data")
    path = indexes.directory(at, indexes.BITMAP, "name")
    spark.range(1200).selectExpr("cast(id AS string) AS value", "'f' AS file", "0 AS row_group").write.parquet(path)
    assert indexes.entries(spark, at, indexes.BITMAP, "name", limit=None).count() == 1200
    assert indexes.entries(spark, at, indexes.BITMAP, "name").count() == 100


def uneven(directory, sizes):
    """One file with row groups of the given sizes."""
    schema = pa.schema([("k", pa.string()), ("t", pa.string())])
    directory.mkdir()
    at, keys = 0, []
    with pq.ParquetWriter(str(directory / "a b+c.parquet"), schema) as w:
        for n in sizes:
            keys.append({f"v{i % 7}" for i in range(at, at + n)})
            w.write_table(pa.table({"k": [f"v{i % 7}" for i in range(at, at + n)], "t": [f"T{i % 5} x" for i in range(at, at + n)]}, schema), row_group_size=max(1, n))
            at += n
    return str(directory), keys


def test_rows_meet_few_row_groups(spark, tmp_path):
    """Comparisons of rows with row groups grow with the rows, not with rows times groups."""
    sizes = [900, *[1] * 300, 0, 3, 700, *[2] * 150, 40]
    at, keys = uneven(tmp_path / "data", sizes)
    indexes.build_bitmap(spark, at, "k")
    got = {}
    for r in spark.read.parquet(indexes.directory(at, indexes.BITMAP, "k")).collect():
        got.setdefault(r["row_group"], set()).update({r["value"]} - {None})
    assert [got.get(g, set()) for g in range(len(keys))] == keys
    # Rows of a file and the groups that they are compared with meet by the join's equal keys.
    placed = indexes._placed(spark, at, "k", lambda s: F.col("k"))._jdf.queryExecution().optimizedPlan()
    joins = [x for x in placed.toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 1 and "bin#" in joins[0]
    groups, width = indexes._groups(spark, [f"{at}/a b+c.parquet"])
    pairs = indexes._binned(groups, width).count() * width
    assert pairs <= 2 * (sum(sizes) + len(sizes)) < sum(sizes) * len(sizes) / 50


def test_index_builds_leave_page_indexes_alone(spark, tmp_path):
    """What a build reads doesn't follow the number of row groups."""
    at = str(tmp_path / "data")
    rows = spark.range(30_000).selectExpr("concat('v', id % 7) AS k", "id", "concat('T', id % 5) AS t")
    rows.coalesce(1).write.options(**{"parquet.block.row.count.limit": "10", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}).parquet(at)
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = read()
    indexes.build_bitmap(spark, at, "k")
    size = sum(os.path.getsize(f"{at}/{x}") for x in os.listdir(at) if x.endswith(".parquet"))
    assert read() - before < 10 * size
    assert indexes.entries(spark, at, indexes.BITMAP, "k").count() == 7


def test_files_of_parts_follow_the_rows(spark, tmp_path, monkeypatch):
    """No file, so no task, holds more for a larger table, even if all rows are of one brand."""
    from siftlake import queries

    monkeypatch.setattr(queries, "_FILE_ROWS", 500, raising=False)
    parts = spark.range(4000).selectExpr("id AS p_partkey", "concat('hot bolt ', id % 5) AS p_name", "'Brand#22' AS p_brand", "'SMALL' AS p_type", "cast(id % 50 AS int) AS p_size", "900.0D AS p_retailprice")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    at = queries._clustered(spark, str(tmp_path))
    rows = [r["count"] for r in spark.read.parquet(at).groupBy("_metadata.file_path").count().collect()]
    assert len(rows) == 8 and sum(rows) == 4000 and max(rows) <= 1000
    run = lambda name: [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    assert run("plan_rows") == [(4000,)] and run("plan_without_match") == [(0,)] and run("bitmap_index_entries") == [("Brand#22",)]
    assert len(run("indexed_bitmap_lookup")) == 4000 and len(run("term_index_entries")) == 7
