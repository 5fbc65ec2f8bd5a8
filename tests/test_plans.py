from __future__ import annotations

import json

import pytest

from loomline import demo
from loomline.plans import Compiler, PlanError, Workflow, compile_workflow, register
from loomline.plans.checkpoint import Checkpoints
from loomline.plans.workflow import Link, Op
from loomline.sources.generate import generate


# The keys and operator names of plans.
def plan(ops, links):
    return json.dumps({"operators": ops, "links": [{"origin": a, "destination": b} for a, b in links]})


GEN = {"operatorID": "Gen", "operatorType": "Generate", "limit": 10, "delay": 0}
COUNT = {"operatorID": "Count", "operatorType": "Aggregation"}
SINK = {"operatorID": "Sink", "operatorType": "Sink"}


def test_generate_count_sink(spark, rows):
    assert rows(compile_workflow(spark, plan([GEN, COUNT, SINK], [("Gen", "Count"), ("Count", "Sink")]))) == [(10,)]


def test_fan_in_is_union_all_and_equal_links_count_once(spark, rows):
    two = [GEN, {**GEN, "operatorID": "Gen2"}, COUNT, SINK]
    links = [("Gen", "Count"), ("Gen2", "Count"), ("Gen", "Count"), ("Count", "Sink")]
    assert rows(compile_workflow(spark, plan(two, links))) == [(20,)]


def test_compat_counts_by_worker(spark, rows):
    made = compile_workflow(spark, plan([GEN, SINK], [("Gen", "Sink")]), compat=True, workers=5)
    assert rows(made) == sorted([(1,), (2,)] * 5)


@pytest.mark.parametrize(
    ("ops", "links", "why"),
    [
        ([{**GEN, "operatorType": "Nope"}], [], "unknown operator type"),
        ([GEN], [("Gen", "Lost")], "names no operator"),
        ([GEN, GEN], [], "listed twice"),
        ([COUNT, SINK], [("Count", "Sink"), ("Sink", "Count")], "cycle"),
        ([COUNT], [], "inputs"),
        ([GEN, {"operatorID": "J", "operatorType": "HashJoin", "innerTableIndex": 0, "outerTableIndex": 0}], [("Gen", "J")], "inputs"),
        ([GEN, {"operatorID": "P", "operatorType": "Projection", "targetFields": [4]}], [("Gen", "P")], "field 4"),
        ([GEN, {"operatorID": "P", "operatorType": "Projection"}], [("Gen", "P")], "needs"),
        ([GEN, {"operatorID": "F", "operatorType": "Filter", "targetField": 0, "filterType": "Odd", "threshold": 1}], [("Gen", "F")], "filter type"),
    ],
)
def test_bad_plans(spark, ops, links, why):
    with pytest.raises(PlanError, match=why):
        compile_workflow(spark, plan(ops, links))
    with pytest.raises(PlanError):
        Workflow.from_json("{")


def test_plan_survives_json():
    flow = Workflow.from_json(demo.plans("/x")["w5"])
    assert Workflow.from_json(flow.to_json()).inputs == flow.inputs
    assert flow.sources == ["Scan1", "Scan2", "Scan3"] and flow.sinks == ["Sink"]


def test_registered_operator(spark, rows):
    @register("Double")
    def double(c, op, inputs):
        return next(iter(inputs.values())).selectExpr("n * 2 AS n")

    made = compile_workflow(spark, plan([GEN, {"operatorID": "D", "operatorType": "Double"}], [("Gen", "D")]))
    assert rows(made) == [(2 * n,) for n in range(1, 11)]


def test_checkpoint_is_used_again(spark, tmp_path, rows):
    for name in ("orders", "customer"):
        generate(spark, 20).selectExpr("n AS a", "n % 5 + 1 AS b").write.parquet(str(tmp_path / f"{name}.parquet"))
    flow = Workflow.from_json(demo.plans(str(tmp_path))["w4"])
    kept = Checkpoints(spark, str(tmp_path / "stages"))
    first = rows(kept.compiler().compile(flow)["Sink"])
    assert first == rows(Compiler(spark).compile(flow)["Sink"]) == [(4, 5)]
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "stages").rglob("*.parquet")}
    assert rows(kept.compiler().compile(flow)["Sink"]) == first
    assert stamps == {p: p.stat().st_mtime_ns for p in (tmp_path / "stages").rglob("*.parquet")}


def test_stages_of_options_and_changed_files_are_apart(spark, tmp_path, rows):
    for folder, last in (("a", 4), ("a", 6)):
        path = f"{tmp_path}/{folder}.parquet"
        spark.range(1, last).selectExpr("id AS k", "cast(id * 2 AS int) AS v").coalesce(1).write.mode("overwrite").parquet(path)
        plan = Workflow.of(
            [
                Op("S", "LocalScanSource", {"tableName": path, "delimiter": "|"}),
                Op("G", "GroupBy", {"groupByField": 0, "aggregateField": 1, "aggregationType": "Sum", "name": "s"}),
                Op("J", "HashJoin", {"innerTableIndex": 0, "outerTableIndex": 0}),
            ],
            [Link("S", "G"), Link("G", "J"), Link("S", "J")],
        )
        kept = Checkpoints(spark, f"{tmp_path}/stages")
        old, new = (kept.compiler(compat=c).compile(plan)["J"] for c in (True, False))
        assert dict(old.dtypes)["s"] == "string" and dict(new.dtypes)["s"] == "double"
        assert rows(new.select("k", "s")) == [(k, 2.0 * k) for k in range(1, last)]


def test_compat_builds_on_the_smallest_file(spark, tmp_path):
    spark.range(1000).selectExpr("id AS big", "id AS b2").coalesce(1).write.parquet(f"{tmp_path}/big.parquet")
    spark.range(3).selectExpr("id AS small", "id AS s2").coalesce(1).write.parquet(f"{tmp_path}/small.parquet")
    scan = lambda i: Op(i, "LocalScanSource", {"tableName": f"{tmp_path}/{i}.parquet", "delimiter": "|"})
    join = Op("J", "HashJoin", {"innerTableIndex": 0, "outerTableIndex": 0})
    for first, second in (("big", "small"), ("small", "big")):
        plan = Workflow.of([scan("big"), scan("small"), join], [Link(first, "J"), Link(second, "J")])
        assert compile_workflow(spark, plan, compat=True).columns == ["big", "b2", "s2"]
    # an input that isn't a file scan isn't weighed, however small
    few = Op("F", "Filter", {"targetField": 0, "filterType": "Less", "threshold": 1})
    plan = Workflow.of([scan("big"), scan("small"), few, join], [Link("small", "F"), Link("F", "J"), Link("big", "J")])
    assert compile_workflow(spark, plan, compat=True).columns == ["small", "s2", "b2"]
