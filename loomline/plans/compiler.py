"""From a workflow to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomline.functions.fields import FieldError
from loomline.functions.predicates import COMPARISONS
from loomline.operators import relational
from loomline.plans.workflow import Op, PlanError, Workflow
from loomline.sources import files
from loomline.sources.generate import generate

#: The operator types that read files.
FILE_SCANS = ("LocalScanSource", "HDFSScanSource")
#: What an operator type is compiled by: (compiler, operator, named inputs) -> DataFrame.
Builder = Callable[["Compiler", Op, dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Kind:
    build: Builder
    #: Least and most inputs; more links than one into a one-input operator are a union.
    inputs: tuple[int, int | None]
    needs: tuple[str, ...] = ()
    #: Whether rows pass one by one, so that the operator can run on a stream.
    stateless: bool = False


REGISTRY: dict[str, Kind] = {}


def register(name: str, inputs: tuple[int, int | None] = (1, None), needs: tuple[str, ...] = (), stateless: bool = False) -> Callable[[Builder], Builder]:
    """Add an operator type to the plans' language."""

    def add(build: Builder) -> Builder:
        REGISTRY[name] = Kind(build, inputs, needs, stateless)
        return build

    return add


@dataclass
class Compiler:
    """tables: path of a table name, if it isn't a path itself. compat: the older engine's
    answers where they differ (texts for aggregates and sort keys, no groups without values,
    empty rows left out, generators that count by worker, join sides by size)."""

    spark: SparkSession
    tables: Callable[[str], str] = lambda name: name
    compat: bool = False
    workers: int = 1
    #: Called on each operator's result, for checkpoints and breakpoints.
    after: Callable[[Workflow, str, DataFrame], DataFrame] = lambda plan, op, df: df
    made: dict[str, DataFrame] = field(default_factory=dict)
    #: Types of the plan's operators.
    kinds: dict[str, str] = field(default_factory=dict)

    def compile(self, plan: Workflow) -> dict[str, DataFrame]:
        """The result of each sink; every operator is compiled once, whatever reads it."""
        check(plan)
        for op in plan.order:
            if op not in self.made:
                self.made[op] = self.after(plan, op, self.build(plan, op))
        return {i: self.made[i] for i in plan.sinks}

    def build(self, plan: Workflow, op_id: str) -> DataFrame:
        op = plan.ops[op_id]
        self.kinds = {i: o.type for i, o in plan.ops.items()}
        inputs = {i: self.made[i] for i in plan.inputs[op_id]}
        try:
            return REGISTRY[op.type].build(self, op, inputs)
        except FieldError as error:
            raise PlanError(f"{op_id}: {error}") from error


def check(plan: Workflow) -> None:
    """Unknown types, missing parameters and wrong numbers of inputs, before anything runs."""
    for op in plan.ops.values():
        if op.type not in REGISTRY:
            raise PlanError(f"{op.id}: unknown operator type {op.type}")
        kind, n = REGISTRY[op.type], len(plan.inputs[op.id])
        if missing := [p for p in kind.needs if p not in op.params]:
            raise PlanError(f"{op.id}: {op.type} needs {missing}")
        least, most = kind.inputs
        if n < least or most is not None and n > most:
            raise PlanError(f"{op.id}: {op.type} has {n} inputs, not {least} to {most if most is not None else 'any number'}")


def compile_workflow(spark: SparkSession, plan: Workflow | str, **options: Any) -> DataFrame:
    """The result of a plan with one sink."""
    plan = Workflow.from_json(plan) if isinstance(plan, str) else plan
    results = Compiler(spark, **options).compile(plan)
    if len(results) != 1:
        raise PlanError(f"the plan has {len(results)} sinks: {sorted(results)}")
    return next(iter(results.values()))


def _one(inputs: dict[str, DataFrame]) -> DataFrame:
    try:
        return relational.union_all(list(inputs.values()))
    except ValueError as error:
        raise PlanError(str(error)) from error


def _scan(c: Compiler, op: Op, host: str) -> DataFrame:
    name, keep = op.params["tableName"], op.params.get("indicesToKeep")
    path = c.tables(name)
    if op.params.get("format", "parquet" if path.endswith(".parquet") else "delimited") == "parquet":
        return files.scan_parquet(c.spark, path, keep)
    return files.scan_delimited(c.spark, path, op.params["delimiter"][:1], keep, op.params.get("fields"), c.compat, host)


@register("LocalScanSource", (0, 0), ("tableName", "delimiter"), stateless=True)
def _local(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return _scan(c, op, "")


@register("HDFSScanSource", (0, 0), ("host", "tableName", "delimiter"), stateless=True)
def _remote(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return _scan(c, op, op.params["host"])


@register("Generate", (0, 0), ("limit",), stateless=True)
def _generate(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return generate(c.spark, op.params["limit"], op.params.get("numWorkers", c.workers) if c.compat else None, delay=op.params.get("delay", 0))


@register("KeywordMatcher", needs=("attributeName", "keyword"), stateless=True)
def _keyword(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return relational.keyword_match(_one(inputs), op.params["attributeName"], op.params["keyword"])


@register("Filter", needs=("targetField", "filterType", "threshold"), stateless=True)
def _filter(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    if op.params["filterType"] not in COMPARISONS:
        raise PlanError(f"{op.id}: unknown filter type {op.params['filterType']}")
    df, target, value = _one(inputs), op.params["targetField"], op.params["threshold"]
    name = relational.field_name(df, target)
    if isinstance(df.schema[name].dataType, T.StringType) and isinstance(value, str) and not op.params.get("asText"):
        value = as_time(value) or value
    return relational.where(df, target, op.params["filterType"], value)


def as_time(text: str) -> date | datetime | None:
    """The date or time that an ISO text stands for, if it does."""
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        return None


@register("Projection", needs=("targetFields",), stateless=True)
def _projection(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return relational.project(_one(inputs), op.params["targetFields"])


@register("HashJoin", (2, None), ("innerTableIndex", "outerTableIndex"))
def _join(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    """inner: the id of the build input; else the first link's, or, with compat, that of the
    smallest file if some inputs are file scans."""
    inner = op.params.get("inner")
    if inner is None:
        inner = next(iter(inputs))
        if c.compat and (scans := [i for i in inputs if c.kinds.get(i) in FILE_SCANS]):
            inner = min(scans, key=lambda i: files.total_bytes(inputs[i]))
    if inner not in inputs:
        raise PlanError(f"{op.id}: no input {inner}")
    rest = {i: df for i, df in inputs.items() if i != inner}
    return relational.hash_join(inputs[inner], _one(rest), op.params["innerTableIndex"], op.params["outerTableIndex"])


@register("Aggregation", stateless=False)
def _count(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return relational.count_rows(_one(inputs), op.params.get("name", "cnt"))


@register("GroupBy", needs=("groupByField", "aggregateField", "aggregationType"))
def _group(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    p = op.params
    if p["aggregationType"] not in relational.AGGREGATES:
        raise PlanError(f"{op.id}: unknown aggregation type {p['aggregationType']}")
    return relational.group_by(_one(inputs), p["groupByField"], p["aggregateField"], p["aggregationType"], p.get("name"), as_text=c.compat, drop_null_groups=c.compat)


@register("Sort", needs=("targetField",))
def _sort(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return relational.sort_by(_one(inputs), op.params["targetField"], as_text=c.compat)


@register("Sink", stateless=True)
def _sink(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return _one(inputs)


@register("PassThrough", stateless=True)
def _pass(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return relational.identity(_one(inputs))


@register("Union", stateless=True)
def _union(c: Compiler, op: Op, inputs: dict[str, DataFrame]) -> DataFrame:
    return _one(inputs)
