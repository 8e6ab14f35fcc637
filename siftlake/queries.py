"""Registered queries of the query layer and their SQL."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import text as text_functions
from siftlake.operators import predicates as P
from siftlake.operators.dynamic import DynamicPredicate, DynamicQuery
from siftlake.operators.predicates import col
from siftlake.operators.query import Query
from siftlake.operators.textlang import parse
from siftlake.plans import indexes
from siftlake.plans.cache import file_stamp
from siftlake.sources import inspect as inspection
from siftlake.sources import scan
from siftlake.sources.pool import ReaderPool
from siftlake.sources.write import BitmapIndex, Bloom, SortKey, TermIndex, column, write, write_options
from siftlake.streaming.follow import follow

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_KEYS = ["l_orderkey", "l_linenumber"]
_SQL_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda t: t <> '')"


def _query(spark: SparkSession, sf_dir: str, table: str) -> Query:
    return Query.from_file(spark, f"{sf_dir}/{table}.parquet")


def _dynamic(spark: SparkSession, sf_dir: str, table: str) -> DynamicQuery:
    return DynamicQuery.from_path(spark, f"{sf_dir}/{table}.parquet")


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    _FOUND[name] = (run, sql)


def _filter(name: str, table: str, condition: P.Predicate, keep: list[str], sql: str, pushed: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = _query(spark, sf_dir, table)
        return (q.pushdown(condition) if pushed else q.where(condition)).select(*keep).dataframe()

    _register(name, run, f"SELECT {', '.join(keep)} FROM {table} WHERE {sql}")


# Filters by the builder and by conditions.

_register(
    "pushdown_select",
    lambda s, d: _query(s, d, "lineitem").pushdown(lambda b: b.eq("l_returnflag", "R").ge("l_quantity", 25.0)).select(*_KEYS, "l_quantity").dataframe(),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25",
)
_AT = dt.datetime(1996, 1, 1)
for _name, _table, _p, _keep, _sql in (
    ("eq_string", "lineitem", col("l_returnflag") == "A", [*_KEYS, "l_returnflag"], "l_returnflag = 'A'"),
    ("eq_int", "lineitem", col("l_linenumber") == 3, _KEYS, "l_linenumber = 3"),
    ("ge_timestamp", "orders", col("o_orderdate") >= _AT, ["o_orderkey", "o_orderdate"], "o_orderdate >= TIMESTAMP '1996-01-01'"),
    ("not_eq", "orders", col("o_orderstatus") != "F", ["o_orderkey", "o_orderstatus"], "o_orderstatus IS DISTINCT FROM 'F'"),
    ("lt", "lineitem", col("l_discount") < 0.02, _KEYS, "l_discount < 0.02"),
    ("le", "lineitem", col("l_quantity") <= 5.0, _KEYS, "l_quantity <= 5"),
    ("gt", "orders", col("o_totalprice") > 200000.0, ["o_orderkey", "o_totalprice"], "o_totalprice > 200000"),
    ("ge", "part", col("p_size") >= 40, ["p_partkey", "p_size"], "p_size >= 40"),
    ("between", "part", col("p_size").between(10, 12), ["p_partkey", "p_size"], "p_size BETWEEN 10 AND 12"),
    ("starts_with", "orders", col("o_orderpriority").starts_with("1-"), ["o_orderkey", "o_orderpriority"], "starts_with(o_orderpriority, '1-')"),
    ("eq_null", "customer", col("c_mktsegment") == None, ["c_custkey"], "c_mktsegment IS NULL"),  # noqa: E711
    ("not_eq_null", "customer", col("c_mktsegment") != None, ["c_custkey"], "c_mktsegment IS NOT NULL"),  # noqa: E711
):
    _filter(f"pushdown_{_name}", _table, _p, _keep, _sql, pushed=True)
    _filter(f"where_{_name}", _table, _p, _keep, _sql)
_filter("where_ends_with", "customer", col("c_name").ends_with("7"), ["c_custkey", "c_name"], "ends_with(c_name, '7')")
_filter("where_contains", "part", col("p_name").contains("e"), ["p_partkey", "p_name"], "contains(p_name, 'e')")
_filter("where_or_residual", "lineitem", (col("l_returnflag") == "A") | (col("l_quantity") > 45.0), _KEYS, "l_returnflag = 'A' OR l_quantity > 45")
_filter("where_not_residual", "lineitem", ~(col("l_returnflag") == "A") & (col("l_tax") <= 0.04), _KEYS, "NOT (l_returnflag = 'A') AND l_tax <= 0.04")
_filter("where_reversed_operands", "part", P.constant(45, "<", col("p_size")), ["p_partkey"], "45 < p_size")
_filter("where_column_comparison", "lineitem", col("l_tax") > col("l_discount"), _KEYS, "l_tax > l_discount")
_filter("where_computed", "part", P.Opaque("length(p_name) = 12", reads=("p_name",)), ["p_partkey"], "length(p_name) = 12")
_filter("where_ordinary_null", "lineitem", col("l_quantity") < None, _KEYS, "false")


class _Even(P.Predicate):
    """A predicate of the caller's own."""

    def to_column(self):
        return F.col("o_orderkey") % 2 == 0

    def describe(self) -> str:
        return "o_orderkey is even"

    def columns(self) -> list[str]:
        return ["o_orderkey"]


_register(
    "custom_predicate",
    lambda s, d: _query(s, d, "orders").pushdown(lambda b: b.add(_Even())).select("o_orderkey").dataframe(),
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0",
)


def _with_nulls(spark: SparkSession, paths: list[str], options) -> DataFrame:
    """A reader factory whose scan has nulls."""
    return spark.read.options(**dict(options)).parquet(*paths).withColumn("flag", F.nullif("l_returnflag", F.lit("N"))).withColumn("qty", F.expr("nullif(l_quantity, 10)"))


def _nulls(name: str, condition: P.Predicate, sql: str) -> None:
    _register(
        name,
        lambda s, d: _query(s, d, "lineitem").with_reader_factory(_with_nulls).where(condition).select(*_KEYS, "flag").dataframe(),
        f"SELECT l_orderkey, l_linenumber, flag FROM (SELECT *, nullif(l_returnflag, 'N') AS flag, nullif(l_quantity, 10) AS qty FROM lineitem) WHERE {sql}",
    )


_nulls("nulls_not_eq", col("flag") != "A", "flag IS DISTINCT FROM 'A'")
_nulls("nulls_eq_null", col("flag") == None, "flag IS NULL")  # noqa: E711
_nulls("nulls_not_eq_null", col("flag") != None, "flag IS NOT NULL")  # noqa: E711
_nulls("nulls_order", col("qty") <= 20.0, "qty <= 20")
_nulls("nulls_not", ~(col("qty") <= 20.0), "NOT coalesce(qty <= 20, false)")
_nulls("nulls_or", (col("flag") == "A") | (col("qty") > 40.0), "coalesce(flag = 'A', false) OR coalesce(qty > 40, false)")

# Projections.

_register("select_scalar", lambda s, d: _query(s, d, "nation").select("n_name").dataframe(), "SELECT n_name FROM nation")
_register("select_all", lambda s, d: _query(s, d, "nation").dataframe(), "SELECT * FROM nation")
_register(
    "select_replaces", lambda s, d: _query(s, d, "nation").select("n_name").select(col("n_nationkey"), "n_regionkey").dataframe(), "SELECT n_nationkey, n_regionkey FROM nation"
)
_register(
    "select_constant_and_computed",
    lambda s, d: _query(s, d, "part").where(col("p_size") > 45).select("p_partkey", F.lit("x").alias("tag"), (F.col("p_retailprice") * 2).alias("twice")).dataframe(),
    "SELECT p_partkey, 'x' AS tag, p_retailprice * 2 AS twice FROM part WHERE p_size > 45",
)


def _nested(spark: SparkSession, paths: list[str], options) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select("s_suppkey", F.struct("s_nationkey", F.struct("s_name", "s_acctbal").alias("inner")).alias("outer"))


_register(
    "select_nested",
    lambda s, d: _query(s, d, "supplier").with_reader_factory(_nested).where(col("outer.inner.s_acctbal") > 0.0).select("s_suppkey", F.col("outer.inner.s_name").alias("name")).dataframe(),
    "SELECT s_suppkey, s_name AS name FROM supplier WHERE s_acctbal > 0",
)
_register(
    "select_struct",
    lambda s, d: _query(s, d, "supplier").with_reader_factory(_nested).select("s_suppkey", "outer").dataframe().select("s_suppkey", "outer.s_nationkey", "outer.inner.s_name"),
    "SELECT s_suppkey, s_nationkey, s_name FROM supplier",
)
_register(
    "select_array",
    lambda s, d: _query(s, d, "embeddings").where(col("label") == 3).select("vec_id", "embedding").dataframe().select("vec_id", F.size("embedding").alias("n"), F.col("embedding")[0].cast("double").alias("head")),
    "SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS head FROM embeddings WHERE label = 3",
)

# Terminals.


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


_register("count_all", lambda s, d: _one(s, n=F.lit(_query(s, d, "lineitem").count()).cast("long")), "SELECT count(*) AS n FROM lineitem")
_register(
    "count_filtered",
    lambda s, d: _one(s, n=F.lit(_query(s, d, "lineitem").where(col("l_shipdate") < _AT).select("l_tax").long_count()).cast("long")),
    "SELECT count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'",
)
_register("any_true", lambda s, d: _one(s, found=_query(s, d, "orders").where(col("o_totalprice") > 1000.0).any()), "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) AS found")
_register("any_false", lambda s, d: _one(s, found=_query(s, d, "orders").where(col("o_totalprice") < 0.0).any()), "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS found")
_register(
    "first_in_order",
    lambda s, d: _one(s, p_partkey=F.lit(_query(s, d, "part").where(col("p_size") == 7).select("p_partkey").first_or_default()[0]).cast("long")),
    "SELECT p_partkey FROM part WHERE p_size = 7 ORDER BY rowid LIMIT 1".replace("rowid", "p_partkey"),
)
_register(
    "iterate_rows",
    lambda s, d: s.createDataFrame([(r[0],) for r in _query(s, d, "region").select("r_name").to_iterator()], "r_name string"),
    "SELECT r_name FROM region",
)
_register(
    "multi_file_dedupe",
    lambda s, d: Query.from_files(s, [f"{d}/nation.parquet", " ", f"{d}/./nation.parquet"]).select("n_nationkey").dataframe(),
    "SELECT n_nationkey FROM nation",
)
_register("directory_scan", lambda s, d: Query.from_directory(s, d, "nation*.parquet").select("n_nationkey", "n_name").dataframe(), "SELECT n_nationkey, n_name FROM nation")

_POOL = ReaderPool()
_register(
    "pooled_query",
    lambda s, d: _query(s, d, "customer").with_reader_pool(_POOL).where(col("c_nationkey") == 7).select("c_custkey").dataframe(),
    "SELECT c_custkey FROM customer WHERE c_nationkey = 7",
)

# String-typed predicates.

for _op, _value, _value2, _sql in (
    ("eq", "7", None, "p_size = 7"), ("=", "7", None, "p_size = 7"), ("==", "7", None, "p_size = 7"), ("ne", "7", None, "p_size IS DISTINCT FROM 7"),
    ("!=", "7", None, "p_size IS DISTINCT FROM 7"), ("<>", "7", None, "p_size IS DISTINCT FROM 7"), ("lt", "7", None, "p_size < 7"), ("<", "7", None, "p_size < 7"),
    ("le", "7", None, "p_size <= 7"), ("<=", "7", None, "p_size <= 7"), ("gt", "44", None, "p_size > 44"), (">", "44", None, "p_size > 44"),
    ("ge", "44", None, "p_size >= 44"), (">=", "44", None, "p_size >= 44"), ("Between", "5", "9", "p_size BETWEEN 5 AND 9"),
    ("isnull", None, None, "p_size IS NULL"), ("IsNotNull", None, None, "p_size IS NOT NULL"),
):
    _label = {"=": "sign_eq", "==": "signs_eq", "!=": "sign_ne", "<>": "angle_ne", "<": "sign_lt", "<=": "sign_le", ">": "sign_gt", ">=": "sign_ge"}.get(_op, _op.lower())
    _register(
        f"dynamic_{_label}",
        lambda s, d, p=DynamicPredicate("p_size", _op, _value, _value2): _dynamic(s, d, "part").where(p).dataframe().select("p_partkey", "p_size"),
        f"SELECT p_partkey, p_size FROM part WHERE {_sql}",
    )
for _op, _value, _sql in (
    ("startswith", "Brand#1", "starts_with(p_brand, 'Brand#1')"), ("endswith", "3", "ends_with(p_brand, '3')"), ("contains", "#2", "contains(p_brand, '#2')"),
    ("eq", "Brand#12", "p_brand = 'Brand#12'"), ("lt", "Brand#2", "p_brand < 'Brand#2'"),
):
    _register(
        f"dynamic_text_{_op}",
        lambda s, d, p=DynamicPredicate("p_brand", _op, _value): _dynamic(s, d, "part").where(p).dataframe().select("p_partkey", "p_brand"),
        f"SELECT p_partkey, p_brand FROM part WHERE {_sql}",
    )
_register(
    "dynamic_timestamp",
    lambda s, d: _dynamic(s, d, "orders").where(DynamicPredicate("o_orderdate", "lt", "1995-06-01T00:00:00")).dataframe().select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'",
)
_register(
    "dynamic_unknown_column_ignored",
    lambda s, d: _dynamic(s, d, "nation").where(DynamicPredicate("nope", "eq", "1"), DynamicPredicate("n_regionkey", "eq", "2")).dataframe().select("n_name"),
    "SELECT n_name FROM nation WHERE n_regionkey = 2",
)
_PAGE = DynamicPredicate("o_orderstatus", "eq", "F")
_register(
    "dynamic_page",
    lambda s, d: _dynamic(s, d, "orders").where(_PAGE).page(1000, 500).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500 OFFSET 1000",
)
_register("dynamic_total", lambda s, d: _dynamic(s, d, "orders").where(_PAGE).with_total(), "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")

_LINES = """
// large, recent, urgent
Ge(o_totalprice, 100000)
startswith("o_orderpriority", '1-')
NotEq(o_orderstatus, "O")   // not open
"""
_register(
    "text_language_query",
    lambda s, d: _dynamic(s, d, "orders").where(*parse(_LINES).predicates).dataframe().select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND starts_with(o_orderpriority, '1-') AND o_orderstatus IS DISTINCT FROM 'O'",
)

# Text search.


def _search(name: str, match: P.Predicate, sql: str) -> None:
    _register(
        name,
        lambda s, d: _query(s, d, "documents").with_text_search().pushdown(match).select("doc_id").dataframe(),
        f"SELECT doc_id FROM documents WHERE len(list_filter({_SQL_TOKENS.format('text')}, lambda t: {sql})) > 0",
    )


_search("token_match", P.TokenMatch("text", "license"), "t = 'license'")
_search("fuzzy_lev_k1", P.TokenMatch("text", "licnse", 1, 0, False), "levenshtein(t, 'licnse') <= 1")
_search("fuzzy_lev_k2", P.TokenMatch("text", "lisense", 2, 0, False), "levenshtein(t, 'lisense') <= 2")
_search("fuzzy_prefix", P.TokenMatch("text", "apachr", 1, 3, False), "starts_with(t, 'apa') AND levenshtein(substr(t, 4), 'chr') <= 1")
_search("fuzzy_osa_k1", P.TokenMatch("text", "licesne", 1, 0, True), "damerau_levenshtein(t, 'licesne') <= 1")
_search("fuzzy_prefix_is_term", P.TokenMatch("text", "token", 1, 5, True), "starts_with(t, 'token') AND length(t) <= 6")
for _op, _value, _extra, _sql in (
    ("TokenMatch", "License", {}, "t = 'license'"),
    ("TokenFuzzy", "licnse", {"max_edits": 1, "transpositions": False}, "levenshtein(t, 'licnse') <= 1"),
    ("tokenfuzzy", "apachr", {"max_edits": 1, "prefix_length": 3, "transpositions": False}, "starts_with(t, 'apa') AND levenshtein(substr(t, 4), 'chr') <= 1"),
):
    _register(
        f"dynamic_{'token_match' if _op == 'TokenMatch' else 'token_fuzzy' if _op == 'TokenFuzzy' else 'token_fuzzy_prefix'}",
        lambda s, d, p=DynamicPredicate("text", _op, _value, **_extra): _dynamic(s, d, "documents").where(p).dataframe().select("doc_id"),
        f"SELECT doc_id FROM documents WHERE len(list_filter({_SQL_TOKENS.format('text')}, lambda t: {_sql})) > 0",
    )
_register(
    "strict_query",
    lambda s, d: _query(s, d, "orders").where((col("o_orderstatus") == "F") & (col("o_totalprice") >= 150000.0)).strict_pushdown().select("o_orderkey").dataframe(),
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000",
)
_register(
    "page_with_total",
    lambda s, d: s.createDataFrame([(r["o_orderkey"], got.total) for got in [_dynamic(s, d, "orders").where(_PAGE).execute(20, 10)] for r in got.rows], "o_orderkey long, total long"),
    "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10 OFFSET 20",
)
_register(
    "fuzzy_osa_k2",
    lambda s, d: _query(s, d, "documents").pushdown(P.TokenMatch("text", "liecsne", 2, 0, True)).select("doc_id").dataframe(),
    None,
)
_register(
    "analysed_tokens",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(text_functions.tokens(F.col("text"))).cast("long").alias("n")),
    f"SELECT doc_id, len({_SQL_TOKENS.format('text')})::BIGINT AS n FROM documents",
)


# Written datasets: indexes, partitions, plans. They go to the shared folder, once for each input.


def _place(spark: SparkSession, sf_dir: str, what: str, table: str) -> str:
    """A folder of the shared one, named by the table's path, size and time: a changed table gets another."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file:///tmp/siftlake-{os.getpid()}"
    stamp = repr(file_stamp(scan.absolute(f"{sf_dir}/{table}.parquet")))
    return f"{base.removeprefix('file://')}/siftlake-{what}-{hashlib.sha256(stamp.encode()).hexdigest()[:12]}"


#: Rows of a file of parts, about; small tables have four files all the same.
_FILE_ROWS = 50_000


def _clustered(spark: SparkSession, sf_dir: str) -> str:
    """Parts sorted by brand, in four files or more of small row groups, with a bitmap and a term index.

    Files follow the table's rows, and brands can go on in the next file, so
    that a task's share stays the same however large the table is.
    """
    path = _place(spark, sf_dir, "parts", "part")
    if not scan.exists(f"{path}/_index/terms/p_name/_SUCCESS"):
        parts = spark.read.parquet(f"{sf_dir}/part.parquet")
        files = max(4, -(-parts.count() // _FILE_ROWS))
        df = parts.repartitionByRange(files, "p_brand", "p_partkey").sortWithinPartitions("p_brand", "p_partkey")
        options = {"parquet.block.row.count.limit": "200", "parquet.page.row.count.limit": "50", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
        df.write.mode("overwrite").options(**options).parquet(path)
        indexes.build_bitmap(spark, path, "p_brand")
        indexes.build_terms(spark, path, "p_name")
    return path


_register(
    "indexed_bitmap_lookup",
    lambda s, d: Query.from_directory(s, _clustered(s, d)).with_indexes().pushdown(col("p_brand") == "Brand#22").select("p_partkey", "p_brand").dataframe(),
    "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#22'",
)
_register(
    "indexed_term_lookup",
    lambda s, d: Query.from_directory(s, _clustered(s, d)).token_fuzzy("p_name", "widgte").select("p_partkey").dataframe(),
    f"SELECT p_partkey FROM part WHERE len(list_filter({_SQL_TOKENS.format('p_name')}, lambda t: damerau_levenshtein(t, 'widgte') <= 1)) > 0",
)
_register(
    "bitmap_index_entries",
    lambda s, d: indexes.entries(s, _clustered(s, d), indexes.BITMAP, "p_brand", limit=None).select(F.col("value").alias("p_brand")),
    "SELECT DISTINCT p_brand FROM part",
)
_register(
    "term_index_entries",
    lambda s, d: indexes.entries(s, _clustered(s, d), indexes.TERMS, "p_name", limit=None).select(F.col("value").alias("term")),
    f"SELECT DISTINCT unnest({_SQL_TOKENS.format('p_name')}) AS term FROM part",
)
_register(
    "index_entries_filtered",
    lambda s, d: indexes.entries(s, _clustered(s, d), indexes.BITMAP, "p_brand", contains="BRAND#1", offset=1, limit=2).select(F.col("value").alias("p_brand")),
    "SELECT DISTINCT p_brand FROM part WHERE contains(lower(p_brand), 'brand#1') ORDER BY p_brand LIMIT 2 OFFSET 1",
)


def _partitioned(spark: SparkSession, sf_dir: str) -> str:
    path = _place(spark, sf_dir, "nations", "nation")
    if not scan.exists(f"{path}/_SUCCESS"):
        spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("Region", F.col("n_regionkey")).coalesce(1).write.mode("overwrite").partitionBy("Region").parquet(path)
    return path


_register(
    "partitioned_scan",
    lambda s, d: Query.from_directory(s, _partitioned(s, d)).where(col("Region") == 2).select("n_name", "Region").dataframe(),
    'SELECT n_name, n_regionkey AS "Region" FROM nation WHERE n_regionkey = 2',
)


def _text_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


_register("explain_report", lambda s, d: _text_lines(s, Query.from_directory(s, _clustered(s, d)).where((col("p_brand") == "Brand#22") & col("p_name").contains("e")).explain().splitlines()), None)
_register(
    "plan_groups",
    lambda s, d: s.createDataFrame(
        [(os.path.basename(f.path), g.ordinal, g.rows, g.selected, g.pages.selected, g.pages.total) for f in Query.from_directory(s, _clustered(s, d)).where(col("p_brand") == "Brand#22").plan().files for g in f.groups],
        "file string, row_group int, rows long, selected boolean, pages int, all_pages int",
    ),
    None,
)
_register("file_schema", lambda s, d: inspection.schema_listing(s, f"{d}/lineitem.parquet"), None)
_register("file_metadata", lambda s, d: inspection.metadata(s, f"{d}/orders.parquet"), None)
_register(
    "index_listing",
    lambda s, d: s.createDataFrame([(i.kind, i.column, i.detail) for i in inspection.index_listing(_clustered(s, d))], "kind string, column string, detail string"),
    None,
)
_register("schema_columns", lambda s, d: inspection.schema_listing(s, f"{d}/lineitem.parquet").select("path"), "SELECT column_name AS path FROM (DESCRIBE SELECT * FROM lineitem)")
_register(
    "footer_bounds",
    lambda s, d: inspection.metadata(s, f"{d}/orders.parquet").where("path = 'o_orderkey'").agg(
        F.min(F.col("minimum").cast("long")).alias("low"), F.max(F.col("maximum").cast("long")).alias("high"), F.sum("rows").alias("n"), F.sum("nulls").alias("nulls")
    ),
    "SELECT min(o_orderkey)::BIGINT AS low, max(o_orderkey)::BIGINT AS high, count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS nulls FROM orders",
)
_register(
    "plan_rows",
    lambda s, d: _one(s, n=F.lit(sum(g.rows for f in Query.from_directory(s, _clustered(s, d)).where(col("p_brand") == "Brand#22").plan().files for g in f.groups)).cast("long")),
    "SELECT count(*) AS n FROM part",
)
_register(
    "plan_without_match",
    lambda s, d: _one(s, groups=F.lit(Query.from_directory(s, _clustered(s, d)).with_indexes().pushdown(col("p_brand") == "Brand#2-").plan().selected_groups).cast("long")),
    "SELECT count(*) AS groups FROM part WHERE p_brand = 'Brand#2-'",
)


@write_options(compression="zstd", row_group_rows=200)
@dataclass
class _Supplier:
    """A row class with every kind of mark."""

    s_suppkey: int = column(SortKey(2))
    s_name: str = column(Bloom(), TermIndex())
    s_nationkey: int = column(BitmapIndex(), SortKey(1, descending=True), name="nation")
    s_acctbal: float = column(required=True)
    note: str = column(ignore=True, default="")


def _annotated(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers written by a plan, sorted within files, with their indexes."""
    path = _place(spark, sf_dir, "suppliers", "supplier")
    if not scan.exists(f"{path}/_index/terms/s_name/_SUCCESS"):
        rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"), "s_acctbal")
        write(spark, rows, path, _Supplier, (indexes.BitmapStrategy(), indexes.TermStrategy(), indexes.SortOrderStrategy()), sort=True, files=2, mode="overwrite")
    return path


_register("written_by_plan", lambda s, d: Query.from_directory(s, _annotated(s, d)).dataframe(), "SELECT s_suppkey, s_name, s_nationkey AS nation, s_acctbal FROM supplier")
_register(
    "written_index_lookup",
    lambda s, d: Query.from_directory(s, _annotated(s, d)).with_indexes().pushdown(col("nation") == 7).select("s_suppkey").dataframe(),
    "SELECT s_suppkey FROM supplier WHERE s_nationkey = 7",
)
_register(
    "written_sort_order",
    lambda s, d: s.createDataFrame([(k["path"], k["order"], k["direction"]) for k in indexes.sort_order(_annotated(s, d))], "path string, priority int, direction string"),
    "SELECT * FROM (VALUES ('nation', 1, 'desc'), ('s_suppkey', 2, 'asc')) t(path, priority, direction)",
)


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's filters and projection over a directory as a stream, run until it has all there is."""
    path = _clustered(spark, sf_dir)
    out = f"{path}-followed-{uuid.uuid4().hex[:8]}"
    stream = follow(Query.from_directory(spark, path).where(col("p_size") > 40).select("p_partkey", "p_size"), path)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start(f"{out}/data").awaitTermination()
    return spark.read.parquet(f"{out}/data")


_register("followed_directory", _followed, "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
_register(
    "browse_rows",
    lambda s, d: s.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in inspection.browse(s, f"{d}/nation.parquet", 5, 10)], "n_nationkey int, n_name string"),
    "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run for k, (run, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items() if sql is not None}
