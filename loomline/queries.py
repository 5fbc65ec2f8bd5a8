"""A query for each operator and plan, over the tables of a folder, with SQL that gives the
same rows."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import demo
from loomline.operators import breakpoints
from loomline.operators import relational as R
from loomline.plans.checkpoint import Checkpoints, read_stage, write_stage
from loomline.plans.compiler import Compiler, compile_workflow
from loomline.plans.workflow import Workflow
from loomline.sources.files import scan_delimited, scan_folder, scan_parquet
from loomline.sources.generate import generate
from loomline.sources.store import scratch
from loomline.streaming.control import ConditionalBreakpoint, CountBreakpoint, WorkflowRun
from loomline.streaming.plan_run import plan_run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LIMIT = 100_000
LATE = "1998-06-01"
BAD = "l_quantity > 49"


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        key = name or run.__name__
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return run

    return add


def table(spark: SparkSession, d: str, name: str, keep: list | None = None) -> DataFrame:
    return scan_parquet(spark, f"{d}/{name}.parquet", keep)


@query("SELECT n_name, n_regionkey FROM nation")
def scan_project_nation(spark: SparkSession, d: str) -> DataFrame:
    return R.project(table(spark, d, "nation", [2, 1]), [0, 1])


@query("SELECT n_name, n_nationkey, n_name AS n_name_r FROM nation")
def project_repeated_field(spark: SparkSession, d: str) -> DataFrame:
    return R.project(table(spark, d, "nation"), [1, 0, 1])


@query("SELECT c_mktsegment, c_custkey, c_custkey AS c_custkey_r FROM customer")
def project_dup_reorder(spark: SparkSession, d: str) -> DataFrame:
    return R.project(table(spark, d, "customer"), [4, 0, 0])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c0, c_name AS c1 FROM customer")
def scan_delimited_file(spark: SparkSession, d: str) -> DataFrame:
    """The customers written as a delimited file and scanned again, two fields kept."""
    path = scratch(spark, "delimited")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.options(sep="|", quote="", emptyValue="").csv(path)
    return scan_delimited(spark, path, "|", keep=[1, 0], fields=3).toDF("c0", "c1")


@query("SELECT c_custkey, c_nationkey FROM customer")
def scan_typed_delimited_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "delimited")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").write.options(sep=";", quote="", emptyValue="").csv(path)
    return scan_delimited(spark, path, ";", keep=[0, 2], fields=[("c_custkey", "long"), ("c_name", "string"), ("c_nationkey", "int")])


@query("SELECT s_suppkey, s_name FROM supplier")
def scan_checkpoint_folder(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "folder")
    write_stage(table(spark, d, "supplier", [0, 1]), path, ["s_suppkey"], 4)
    return scan_folder(spark, path)


@query(f"SELECT count(*) AS cnt FROM range(1, {LIMIT + 1})")
def generate_count(spark: SparkSession, d: str) -> DataFrame:
    return R.count_rows(generate(spark, LIMIT))


@query("SELECT CAST(range AS INTEGER) AS n FROM range(1, 1001)")
def generate_rows(spark: SparkSession, d: str) -> DataFrame:
    return generate(spark, 1000)


@query("SELECT CAST(i AS INTEGER) AS n FROM range(5) w(w), range(1, 20) s(i) UNION ALL SELECT CAST(i AS INTEGER) FROM range(20, 23) s(i)")
def generate_by_worker(spark: SparkSession, d: str) -> DataFrame:
    return generate(spark, 98, workers=5)


@query("SELECT count(*) AS cnt FROM orders")
def count_orders(spark: SparkSession, d: str) -> DataFrame:
    return R.count_rows(table(spark, d, "orders"))


@query("SELECT count(*) AS cnt FROM orders WHERE o_totalprice < 0")
def count_empty(spark: SparkSession, d: str) -> DataFrame:
    return R.count_rows(R.where(table(spark, d, "orders"), "o_totalprice", "Less", 0.0))


@query("SELECT * FROM region WHERE contains(r_name, 'ASIA')")
def keyword_region(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_match(table(spark, d, "region"), 1, "ASIA")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def keyword_part_name(spark: SparkSession, d: str) -> DataFrame:
    return R.project(R.keyword_match(table(spark, d, "part"), "p_name", "ring"), [0, 1])


@query("SELECT count(*) AS cnt FROM region WHERE contains(r_name, 'Asia')")
def keyword_case_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return R.count_rows(R.keyword_match(table(spark, d, "region"), 1, "Asia"))


@query("SELECT count(*) AS cnt FROM documents WHERE contains(text, 'the')")
def keyword_documents_count(spark: SparkSession, d: str) -> DataFrame:
    return R.count_rows(R.keyword_match(table(spark, d, "documents"), "text", "the"))


@query("SELECT count(*) AS cnt FROM pages WHERE contains(html, '<p>')")
def keyword_pages_count(spark: SparkSession, d: str) -> DataFrame:
    return R.count_rows(R.keyword_match(table(spark, d, "pages"), "html", "<p>"))


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate > TIMESTAMP '{LATE}'")
def filter_date_gt(spark: SparkSession, d: str) -> DataFrame:
    return R.where(table(spark, d, "lineitem", [0, 3, 10]), 2, "Greater", LATE)


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-02'")
def filter_events_ts(spark: SparkSession, d: str) -> DataFrame:
    return R.where(table(spark, d, "events", [0, 1]), "ts", "Greater", "2024-01-02")


@query(f"SELECT o_orderkey, CAST(o_orderdate AS VARCHAR)[1:10] AS day FROM orders WHERE o_orderdate >= TIMESTAMP '{LATE}'")
def filter_text_as_date(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    days = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return R.where(days, "day", "GreaterOrEqual", datetime.fromisoformat(LATE))


_FILTERS = {"eq": ("Equal", "="), "ne": ("NotEqual", "<>"), "gt": ("Greater", ">"), "ge": ("GreaterOrEqual", ">="), "lt": ("Less", "<"), "le": ("LessOrEqual", "<=")}
_FILTER_FIELDS = {"int": ("part", "p_partkey", "p_size", 15, "15"), "double": ("customer", "c_custkey", "c_acctbal", 1000.0, "1000.0"), "text": ("orders", "o_orderkey", "o_orderpriority", "3-MEDIUM", "'3-MEDIUM'")}
for _short, (_how, _sign) in _FILTERS.items():
    for _kind, (_table, _key, _field, _value, _literal) in _FILTER_FIELDS.items():

        def _filtered(spark: SparkSession, d: str, t: str, k: str, f: str, how: str, v: object) -> DataFrame:
            return R.where(table(spark, d, t, [k, f]), f, how, v)

        _name = f"filter_{_short}" if _kind == "int" else f"filter_{_short}_{_kind}"
        QUERIES[_name] = partial(_filtered, t=_table, k=_key, f=_field, how=_how, v=_value)
        SQL[_name] = f"SELECT {_key}, {_field} FROM {_table} WHERE {_field} {_sign} {_literal}"


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_customer_orders(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_join(table(spark, d, "customer", [0, 1, 2]), table(spark, d, "orders", [0, 1]), 0, 1)


@query("SELECT n_nationkey, n_name, n_regionkey, s_suppkey, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def join_dup_build_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_join(table(spark, d, "supplier", [0, 1, 2]), table(spark, d, "nation"), "s_nationkey", "n_nationkey")


@query("SELECT c_custkey, c_nationkey, n_name, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain_three(spark: SparkSession, d: str) -> DataFrame:
    nations = R.hash_join(table(spark, d, "nation"), table(spark, d, "customer", [0, 2]), 0, 1)
    return R.hash_join(table(spark, d, "region"), nations, 0, 3)


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_r, b.n_name AS n_name_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")
    return R.hash_join(nations, nations, 2, 2)


_SUMS = {"sum": ("Sum", "sum(l_quantity)"), "min": ("Min", "min(l_quantity)"), "max": ("Max", "max(l_quantity)"), "avg": ("Average", "avg(l_quantity)"), "count": ("Count", "count(l_quantity)")}
for _short, (_how, _call) in _SUMS.items():

    def _grouped(spark: SparkSession, d: str, how: str) -> DataFrame:
        out = R.group_by(table(spark, d, "lineitem", [4, 8]), "l_returnflag", "l_quantity", how, "value")
        return out.withColumn("value", F.round("value", 6)) if how == "Average" else out

    QUERIES[f"groupby_{_short}"] = partial(_grouped, how=_how)
    SQL[f"groupby_{_short}"] = f"SELECT l_returnflag, {f'round({_call}, 6)' if _how == 'Average' else _call} AS value FROM lineitem GROUP BY 1"


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def groupby_sum_money(spark: SparkSession, d: str) -> DataFrame:
    return R.group_by(table(spark, d, "customer", [3, 4]), "c_mktsegment", "c_acctbal", "Sum", "total").withColumn("total", F.round("total", 2))


@query("SELECT o_orderstatus, count(o_orderpriority) AS n FROM orders GROUP BY 1")
def groupby_count_text(spark: SparkSession, d: str) -> DataFrame:
    return R.group_by(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "Count", "n")


_W3 = "SELECT l_returnflag, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_shipdate > TIMESTAMP '{}' GROUP BY 1"
_W4 = "SELECT n, count(o_custkey) AS k FROM (SELECT o_custkey, count(o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1"
_W5 = (
    "SELECT n, count(o_custkey) AS k FROM (SELECT o1.o_custkey, count(o1.o_orderkey) AS n FROM orders o1 JOIN customer ON o1.o_custkey = c_custkey "
    "JOIN orders o2 ON o2.o_orderkey = o1.o_custkey GROUP BY 1) GROUP BY 1"
)


@query(_W3.format("1991-01-01"))
def w3_filter_groupby_sort(spark: SparkSession, d: str) -> DataFrame:
    late = R.where(table(spark, d, "lineitem", [4, 8, 10]), 2, "Greater", "1991-01-01")
    return R.sort_by(R.group_by(late, 1, 0, "Sum", "sum_qty"), 0)


@query(_W3.format(LATE))
def w3_selective(spark: SparkSession, d: str) -> DataFrame:
    late = R.where(table(spark, d, "lineitem", [4, 8, 10]), 2, "Greater", LATE)
    return R.sort_by(R.group_by(late, 1, 0, "Sum", "sum_qty"), 0)


@query(_W4)
def groupby_count_of_counts(spark: SparkSession, d: str) -> DataFrame:
    joined = R.hash_join(table(spark, d, "customer", [0]), table(spark, d, "orders", [0, 1]), 0, 1)
    return R.sort_by(R.group_by(R.group_by(joined, 1, 0, "Count", "n"), 1, 0, "Count", "k"), 0)


@query(_W5)
def two_join_count_of_counts(spark: SparkSession, d: str) -> DataFrame:
    first = R.hash_join(table(spark, d, "customer", [0]), table(spark, d, "orders", [0, 1]), 0, 1)
    both = R.hash_join(table(spark, d, "orders", [0, 1]), first, 0, 1)
    return R.sort_by(R.group_by(R.group_by(both, 1, 0, "Count", "n"), 1, 0, "Count", "k"), 0)


@query("SELECT count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(p_name, 'ring')")
def keyword_join_count(spark: SparkSession, d: str) -> DataFrame:
    parts = R.keyword_match(table(spark, d, "part"), 1, "ring")
    return R.count_rows(R.hash_join(parts, table(spark, d, "lineitem"), 0, 1))


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size")
def sort_numeric(spark: SparkSession, d: str) -> DataFrame:
    return R.sort_by(table(spark, d, "part", [0, 4]), "p_size")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
def sort_string(spark: SparkSession, d: str) -> DataFrame:
    return R.sort_by(table(spark, d, "nation", [0, 1]), "n_name")


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def fan_in_union_all(spark: SparkSession, d: str) -> DataFrame:
    return R.union_all([table(spark, d, "customer", [0, 1]).toDF("key", "name"), table(spark, d, "supplier", [0, 1])])


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def fan_out_two_branches(spark: SparkSession, d: str) -> DataFrame:
    rows = R.identity(table(spark, d, "lineitem", [0, 4]))
    return R.union_all([R.where(rows, 1, "Less", 5.0), R.where(rows, 1, "Greater", 45.0)])


@query("SELECT r_regionkey, r_name FROM region")
def sink_and_pass_through(spark: SparkSession, d: str) -> DataFrame:
    return R.identity(table(spark, d, "region"))


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT coalesce({BAD}, false)")
def breakpoint_good(spark: SparkSession, d: str) -> DataFrame:
    return breakpoints.split(table(spark, d, "lineitem", [0, 3, 4]), BAD)[0]


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {BAD}")
def breakpoint_bad(spark: SparkSession, d: str) -> DataFrame:
    return breakpoints.split(table(spark, d, "lineitem", [0, 3, 4]), BAD)[1]


def _json(name: str, **options: str) -> Query:
    return lambda spark, d: compile_workflow(spark, demo.plans(d, limit=LIMIT, **options)[name])


_JSON = {
    "w1": f"SELECT count(*) AS cnt FROM range(1, {LIMIT + 1})",
    "w2": "SELECT count(*) AS cnt FROM orders",
    "w3": _W3.format("1991-01-01"),
    "w4": _W4,
    "w5": _W5,
    "k1": "SELECT count(*) AS cnt FROM region WHERE contains(r_name, 'ASIA')",
    "k4": SQL["keyword_join_count"],
}
for _name, _sql in _JSON.items():
    QUERIES[f"json_{_name}"], SQL[f"json_{_name}"] = _json(_name), _sql


@query("SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty FROM lineitem GROUP BY 1")
def json_compat_groupby(spark: SparkSession, d: str) -> DataFrame:
    """The older engine's texts for sums, read back as numbers."""
    return compile_workflow(spark, demo.plans(d)["w3"], compat=True).withColumn("sum_qty", F.col("sum_qty").cast("double"))


@query(_W4)
def checkpoint_join(spark: SparkSession, d: str) -> DataFrame:
    """W4 with its join's inputs kept on disk, run twice: the second run starts from them."""
    kept, plan = Checkpoints(spark, scratch(spark, "stages")), Workflow.from_json(demo.plans(d)["w4"])
    kept.compiler().compile(plan)
    return kept.compiler().compile(plan)["Sink"]


@query("SELECT o_orderkey, o_custkey FROM orders")
def materialize_by_key(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "buckets")
    write_stage(table(spark, d, "orders", [0, 1]), path, ["o_custkey"], 8)
    return read_stage(spark, path)


def _paused(run: WorkflowRun) -> WorkflowRun:
    """Started, paused at once, and resumed to the end."""
    run.start()
    run.pause()
    while run.wait().value != "Completed":
        run.resume()
    return run


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def pause_resume_rows(spark: SparkSession, d: str) -> DataFrame:
    run = WorkflowRun(spark, scratch(spark, "run"), [("scan", R.identity)])
    return _paused(run.stage(table(spark, d, "lineitem", [0, 3, 4]), 4)).result()


@query("SELECT o_orderkey, o_custkey FROM orders")
def count_breakpoint_rows(spark: SparkSession, d: str) -> DataFrame:
    """A count breakpoint inside the second of four files; no row is lost or comes twice."""
    run = WorkflowRun(spark, scratch(spark, "run"), [("scan", R.identity)])
    run.stage(table(spark, d, "orders", [0, 1]), 4)
    run.set_breakpoint(CountBreakpoint("count", max(1, table(spark, d, "orders").count() * 3 // 8)))
    return run.run()


@query("SELECT count(*) AS at_pause FROM range(1, 5001)")
def count_breakpoint_exact(spark: SparkSession, d: str) -> DataFrame:
    run = WorkflowRun(spark, scratch(spark, "run"), [("generate", R.identity)])
    run.stage(generate(spark, 12_000), 4)
    run.set_breakpoint(CountBreakpoint("count", 5000))
    run.start().wait()
    return R.count_rows(run.output(), "at_pause")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice > 300000)")
def conditional_breakpoint_run(spark: SparkSession, d: str) -> DataFrame:
    run = WorkflowRun(spark, scratch(spark, "run"), [("scan", R.identity)])
    run.stage(table(spark, d, "orders", ["o_orderkey", "o_totalprice"]), 3)
    run.set_breakpoint(ConditionalBreakpoint("dear", "o_totalprice > 300000", "scan"))
    return run.run()


@query(_W3.format(LATE))
def plan_run_w3(spark: SparkSession, d: str) -> DataFrame:
    """W3 from JSON as a run that streams up to the filter and is paused on the way."""
    return _paused(plan_run(spark, demo.plans(d, since=LATE)["w3"], scratch(spark, "run"), files=3)).result()


@query(f"SELECT count(*) AS cnt FROM range(1, {LIMIT + 1}) t(n) WHERE n % 8973 <> 0 AND n % 6462 <> 0")
def two_conditional_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = breakpoints.split(generate(spark, LIMIT), "n % 8973 = 0")
    return R.count_rows(breakpoints.split(rows, "n % 6462 = 0")[0])


@query("SELECT count(*) AS n_stages FROM range(1, 3)")
def checkpoint_stages(spark: SparkSession, d: str) -> DataFrame:
    """How many stages W4 leaves: its join's two inputs."""
    root = scratch(spark, "stages")
    Compiler(spark, after=Checkpoints(spark, root).after).compile(Workflow.from_json(demo.plans(d)["w4"]))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("stage")).agg(F.count_distinct("stage").alias("n_stages"))


def _plan(*ops: dict, links: str) -> Workflow:
    """Operators as (id, type, parameters), and links as 'a>b c>b'."""
    pairs = [x.split(">") for x in links.split()]
    return Workflow.from_json(json.dumps({"operators": list(ops), "links": [{"origin": a, "destination": b} for a, b in pairs]}))


def _op(id_: str, kind: str, **params: object) -> dict:
    return {"operatorID": id_, "operatorType": kind, **params}


def _scan(id_: str, d: str, name: str, keep: list[int] | None = None) -> dict:
    return _op(id_, "LocalScanSource", tableName=f"{d}/{name}.parquet", delimiter="|", **({"indicesToKeep": keep} if keep else {}))


def _delimited(spark: SparkSession, d: str, name: str, columns: list[str]) -> str:
    path = scratch(spark, "delimited")
    table(spark, d, name).select(*columns).write.options(sep="|", quote="", emptyValue="").csv(path)
    return path


@query("SELECT o_orderstatus, max(CAST(o_custkey AS DOUBLE)) AS most FROM orders GROUP BY 1")
def json_compat_max(spark: SparkSession, d: str) -> DataFrame:
    """The older engine's extremes of text fields are those of the numbers they stand for."""
    path = _delimited(spark, d, "orders", ["o_custkey", "o_orderstatus"])
    plan = _plan(
        _op("Scan", "LocalScanSource", tableName=path, delimiter="|", fields=[["o_custkey", "string"], ["o_orderstatus", "string"]]),
        _op("Group", "GroupBy", groupByField=1, aggregateField=0, aggregationType="Max", name="most"),
        links="Scan>Group",
    )
    return compile_workflow(spark, plan, compat=True).withColumn("most", F.col("most").cast("double"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def json_compat_join_sides(spark: SparkSession, d: str) -> DataFrame:
    """The older engine builds on the smallest file, whichever link comes first."""
    plan = _plan(_scan("Orders", d, "orders", [0, 1]), _scan("Customers", d, "customer", [0, 1]), _op("Join", "HashJoin", innerTableIndex=0, outerTableIndex=1), links="Orders>Join Customers>Join")
    return compile_workflow(spark, plan, compat=True)


@query("SELECT l_returnflag, count(l_quantity) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def checkpoint_compat(spark: SparkSession, d: str) -> DataFrame:
    """A run with the older engine's answers and one without, over one folder of stages: each
    meets only its own."""
    scan, by = _scan("Scan", d, "lineitem", [4, 8]), {"groupByField": 1, "aggregateField": 0}
    plan = _plan(
        scan, _op("Sum", "GroupBy", aggregationType="Sum", name="qty", **by), _op("Count", "GroupBy", aggregationType="Count", name="n", **by),
        _op("Join", "HashJoin", innerTableIndex=0, outerTableIndex=0), links="Scan>Sum Scan>Count Sum>Join Count>Join",
    )
    kept = Checkpoints(spark, scratch(spark, "stages"))
    kept.compiler(compat=True).compile(plan)
    return kept.compiler().compile(plan)["Join"]


@query("SELECT CAST(c_custkey AS VARCHAR) AS c0, c_mktsegment AS c1 FROM customer WHERE contains(c_mktsegment, 'UILD')")
def json_delimited(spark: SparkSession, d: str) -> DataFrame:
    """A plan over a delimited file, through an operator that passes rows on."""
    path = _delimited(spark, d, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    plan = _plan(
        _op("Scan", "LocalScanSource", tableName=path, delimiter="|", indicesToKeep=[0, 2]), _op("Pass", "PassThrough"),
        _op("Search", "KeywordMatcher", attributeName=1, keyword="UILD"), _op("Sink", "Sink"), links="Scan>Pass Pass>Search Search>Sink",
    )
    return compile_workflow(spark, plan).toDF("c0", "c1")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS c0, s_name AS c1 FROM supplier")
def json_scan_with_host(spark: SparkSession, d: str) -> DataFrame:
    """A scan of a file in a store that is named by its host."""
    host, path = re.match(r"(\w+:/*[^/]*)?(/.*)", _delimited(spark, d, "supplier", ["s_suppkey", "s_name"])).groups()
    plan = _plan(_op("Scan", "HDFSScanSource", host=host or "file://", tableName=path, delimiter="|"), _op("Sink", "Sink"), links="Scan>Sink")
    return compile_workflow(spark, plan).toDF("c0", "c1")


@query("SELECT r_regionkey, r_name FROM region")
def scan_single_file(spark: SparkSession, d: str) -> DataFrame:
    """One file of a stage that has several."""
    path = scratch(spark, "single")
    table(spark, d, "region").select("r_regionkey", "r_name").coalesce(1).write.parquet(path)
    return scan_parquet(spark, spark.read.parquet(path).inputFiles()[0], [0, 1])


@query("SELECT CAST(i AS INTEGER) AS n FROM range(1, 41) s(i)")
def generate_delayed(spark: SparkSession, d: str) -> DataFrame:
    """A generator that waits 2 ms before each row, from JSON."""
    return compile_workflow(spark, _plan(_op("Generate", "Generate", limit=40, delay=2), _op("Sink", "Sink"), links="Generate>Sink"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def count_breakpoint_join(spark: SparkSession, d: str) -> DataFrame:
    """Breakpoints on the rows of a scan, which streams from the files as they lie, and of a join."""
    plan = _plan(_scan("Customers", d, "customer", [0, 1]), _scan("Orders", d, "orders", [0, 1]), _op("Join", "HashJoin", inner="Customers", innerTableIndex=0, outerTableIndex=1), _op("Sink", "Sink"), links="Customers>Join Orders>Join Join>Sink")
    run, half = plan_run(spark, plan, scratch(spark, "run"), files=None), max(1, table(spark, d, "orders").count() // 2)
    run.set_breakpoint(CountBreakpoint("scanned", half, "Orders"))
    run.set_breakpoint(CountBreakpoint("joined", half, "Join"))
    return run.run()


@query("SELECT count(*) AS at_pause FROM range(1, 701)")
def count_breakpoint_join_exact(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a join has put out at its breakpoint."""
    plan = _plan(_scan("Customers", d, "customer", [0]), _scan("Orders", d, "orders", [0, 1]), _op("Join", "HashJoin", inner="Customers", innerTableIndex=0, outerTableIndex=1), _op("Sink", "Sink"), links="Customers>Join Orders>Join Join>Sink")
    run = plan_run(spark, plan, scratch(spark, "run"), files=3)
    run.set_breakpoint(CountBreakpoint("joined", 700, "Join"))
    run.start().wait()
    return R.count_rows(run.output("Join"), "at_pause")


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1) WHERE NOT n > 12")
def conditional_breakpoint_groupby(spark: SparkSession, d: str) -> DataFrame:
    """A breakpoint on the groups takes those with many rows out; they come in order still."""
    plan = _plan(_scan("Scan", d, "orders", [0, 1]), _op("Group", "GroupBy", groupByField=1, aggregateField=0, aggregationType="Count", name="n"), _op("Sort", "Sort", targetField=1), links="Scan>Group Group>Sort")
    run = plan_run(spark, plan, scratch(spark, "run"), files=2)
    run.set_breakpoint(ConditionalBreakpoint("many", "n > 12", "Group"))
    return run.run()


@query("SELECT count(*) AS cnt FROM range(5) w(w), range(1, 20001) t(n) WHERE n % 8973 <> 0 AND n % 6462 <> 0")
def random_pause_two_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Five producers of 1 to 20,000, a condition on each of two operators, and pauses and
    resumes at random: 99,975 rows."""
    plan = _plan(_op("Generate", "Generate", limit=LIMIT, numWorkers=5), _op("Pass", "PassThrough"), _op("Sink", "Sink"), links="Generate>Pass Pass>Sink")
    run, draw = plan_run(spark, plan, scratch(spark, "run"), files=6, compat=True), random.Random(3)
    run.set_breakpoint(ConditionalBreakpoint("cond1", "n % 8973 = 0", "Generate"))
    run.set_breakpoint(ConditionalBreakpoint("cond2", "n % 6462 = 0", "Pass"))
    run.start()
    for _ in range(6):
        run.pause() if draw.random() < 0.5 else run.resume()
    while run.wait().value != "Completed":
        run.resume()
    return R.count_rows(run.result())


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def json_fan_out_and_in(spark: SparkSession, d: str) -> DataFrame:
    """One scan read by two filters, whose rows meet again at a sink."""
    plan = _plan(
        _scan("Scan", d, "lineitem", [0, 4]), _op("Few", "Filter", targetField=1, filterType="Less", threshold=5.0),
        _op("Many", "Filter", targetField=1, filterType="Greater", threshold=45.0), _op("Sink", "Sink"), links="Scan>Few Scan>Many Few>Sink Many>Sink",
    )
    return compile_workflow(spark, plan)


@query("SELECT key, n_name FROM (SELECT s_suppkey AS key, s_nationkey AS n FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer) JOIN nation ON n = n_nationkey")
def json_join_three_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Two inputs probe one that is built."""
    plan = _plan(
        _scan("Nations", d, "nation", [0, 1]), _scan("Suppliers", d, "supplier", [0, 2]), _scan("Customers", d, "customer", [0, 2]),
        _op("Join", "HashJoin", inner="Nations", innerTableIndex=0, outerTableIndex=1), _op("Keep", "Projection", targetFields=[0, 2]),
        links="Nations>Join Suppliers>Join Customers>Join Join>Keep",
    )
    return compile_workflow(spark, plan).toDF("key", "n_name")
