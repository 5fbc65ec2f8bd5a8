from __future__ import annotations

import pytest

from loomline.cli import Console
from loomline.plans.workflow import Link, Op, Workflow
from loomline.sources.generate import generate
from loomline.streaming import BreakpointError, ConditionalBreakpoint, CountBreakpoint, RunState, WorkflowRun
from loomline.streaming.plan_run import plan_run

EVEN = ("even", lambda df: df.filter("n % 2 = 0"))


def ready(spark, path, limit=1000, files=4, steps=(EVEN,)):
    return WorkflowRun(spark, str(path), list(steps)).stage(generate(spark, limit), files)


def test_pause_and_resume_keep_every_row(spark, tmp_path, rows):
    run = ready(spark, tmp_path).start()
    assert run.pause() in (RunState.PAUSED, RunState.COMPLETED)
    assert run.wait() is run.state
    while run.wait() is not RunState.COMPLETED:
        run.resume()
    assert rows(run.result()) == [(n,) for n in range(2, 1001, 2)]
    assert run.pause() is RunState.COMPLETED and run.resume() is RunState.COMPLETED


def test_pause_before_start(spark, tmp_path):
    run = ready(spark, tmp_path, 10)
    assert run.pause() is RunState.PAUSED
    assert run.resume() is RunState.READY


def test_count_breakpoint_is_exact_and_fires_once(spark, tmp_path, rows):
    run = ready(spark, tmp_path)
    run.set_breakpoint(CountBreakpoint("c", 333))
    assert run.start().wait() is RunState.PAUSED
    assert run.output().count() == 333
    run.resume()
    assert run.wait() is RunState.COMPLETED
    assert rows(run.result()) == [(n,) for n in range(2, 1001, 2)]


def test_count_breakpoint_at_the_total(spark, tmp_path):
    run = ready(spark, tmp_path)
    run.set_breakpoint(CountBreakpoint("c", 500))
    assert run.start().wait() is RunState.PAUSED
    run.resume()
    assert run.wait() is RunState.COMPLETED and run.result().count() == 500


def test_run_goes_on_in_another_process(spark, tmp_path, rows):
    run = ready(spark, tmp_path)
    run.set_breakpoint(CountBreakpoint("c", 100))
    run.start().wait()
    other = WorkflowRun(spark, str(tmp_path), [EVEN])
    other.set_breakpoint(CountBreakpoint("c", 100))
    other.start()
    assert other.wait() is RunState.COMPLETED
    assert rows(other.result()) == [(n,) for n in range(2, 1001, 2)]


def test_conditional_breakpoints_on_two_steps(spark, tmp_path, rows):
    run = ready(spark, tmp_path, 100, 2, [("all", lambda df: df), EVEN])
    run.set_breakpoint(ConditionalBreakpoint("low", "n <= 4", "all"))
    run.set_breakpoint(ConditionalBreakpoint("high", "n >= 98", "even"))
    pauses = 0
    run.start()
    while run.wait() is not RunState.COMPLETED:
        pauses += 1
        run.resume()
    assert pauses >= 1
    assert rows(run.result()) == [(n,) for n in range(6, 98, 2)]
    assert rows(run.reported("low")) == [(1,), (2,), (3,), (4,)]
    assert rows(run.reported("high")) == [(98,), (100,)]


def test_breakpoints_are_checked(spark, tmp_path):
    run = ready(spark, tmp_path, 10)
    with pytest.raises(BreakpointError, match="no step"):
        run.set_breakpoint(ConditionalBreakpoint("x", "n > 1", "lost"))
    run.set_breakpoint(ConditionalBreakpoint("a", "n > 1"))
    run.set_breakpoint(ConditionalBreakpoint("b", "n > 2"))
    with pytest.raises(BreakpointError, match="there is"):
        run.set_breakpoint(ConditionalBreakpoint("b", "n > 2"))
    run.remove_breakpoint("a")
    assert list(run.conditions) == ["b"]
    run.remove_breakpoint("b")
    run.run()
    with pytest.raises(BreakpointError, match="Completed"):
        run.set_breakpoint(CountBreakpoint("c", 1))


def test_console(spark, tmp_path):
    generate(spark, 30).selectExpr("n AS r_regionkey", "concat('ASIA', n) AS r_name").write.parquet(str(tmp_path / "region.parquet"))
    console = Console(spark, str(tmp_path))
    assert "w5" in console.do("list")
    console.do("choose k1")
    assert console.do("set condition KeywordSearch 'r_regionkey = 3'") == "condition-1"
    assert console.do("run") == "Running"
    while console.do("wait") != "Completed":
        console.do("resume")
    assert console.do("result") == "Row(cnt=29)"


def join_plan(spark, path):
    spark.range(40).selectExpr("id AS k", "id % 7 AS g").repartition(3).write.parquet(f"{path}/left.parquet")
    spark.range(20).selectExpr("id AS k", "id * 10 AS v").coalesce(1).write.parquet(f"{path}/right.parquet")
    scan = lambda i: Op(i, "LocalScanSource", {"tableName": f"{path}/{i}.parquet", "delimiter": "|"})
    return Workflow.of(
        [
            scan("left"), scan("right"), Op("join", "HashJoin", {"inner": "right", "innerTableIndex": 0, "outerTableIndex": 0}),
            Op("low", "Filter", {"targetField": 0, "filterType": "Less", "threshold": 15}),
            Op("sort", "Sort", {"targetField": 2}), Op("sink", "Sink"),
        ],
        [Link("left", "join"), Link("right", "join"), Link("join", "low"), Link("low", "sort"), Link("sort", "sink")],
    )


@pytest.mark.parametrize("files", [None, 3])
def test_breakpoints_on_every_operator_of_a_plan(spark, tmp_path, files):
    run = plan_run(spark, join_plan(spark, tmp_path), f"{tmp_path}/run", files)
    for step, target in (("left", 25), ("right", 11), ("join", 13), ("sort", 9)):
        run.set_breakpoint(CountBreakpoint(f"c-{step}", target, step))
    run.set_breakpoint(ConditionalBreakpoint("odd", "k = 3", "low"))
    seen = {}
    run.start()
    while run.wait() is not RunState.COMPLETED:
        for step in ("left", "right", "join", "sort"):
            if step in run.runs and run.runs[step].state is RunState.PAUSED:
                seen.setdefault(step, run.output(step).count())
        run.resume()
    assert seen == {"left": 25, "right": 11, "join": 13, "sort": 9}
    assert [r.k for r in run.reported("odd").collect()] == [3]
    assert [tuple(r) for r in run.result().collect()] == [(k, k % 7, k * 10) for k in range(15) if k != 3]


def test_breakpoints_set_while_paused(spark, tmp_path):
    run = plan_run(spark, join_plan(spark, tmp_path), f"{tmp_path}/run")
    run.set_breakpoint(CountBreakpoint("c", 5, "right"))
    assert run.start().wait() is RunState.PAUSED
    run.set_breakpoint(CountBreakpoint("later", 4, "join"))
    states = []
    while run.wait() is not RunState.COMPLETED:
        if "join" in run.runs:
            states.append(run.output("join").count())
            with pytest.raises(BreakpointError, match="all its rows"):
                run.set_breakpoint(CountBreakpoint("late", 1, "right"))
        run.resume()
    assert states == [4] and run.result().count() == 15


def test_plan_run_goes_on_in_another_process(spark, tmp_path):
    plan = join_plan(spark, tmp_path)
    first = plan_run(spark, plan, f"{tmp_path}/run", None)
    first.set_breakpoint(CountBreakpoint("c", 30, "left"))
    assert first.start().wait() is RunState.PAUSED
    again = plan_run(spark, plan, f"{tmp_path}/run", None)
    again.set_breakpoint(CountBreakpoint("c", 30, "left"))
    assert again.run().count() == 15


def test_files_stream_as_they_lie(spark, tmp_path, rows):
    generate(spark, 100).repartition(4).write.parquet(f"{tmp_path}/in.parquet")
    run = WorkflowRun(spark, f"{tmp_path}/run", [EVEN]).stream_files(f"{tmp_path}/in.parquet")
    run.set_breakpoint(CountBreakpoint("a", 17))
    run.set_breakpoint(CountBreakpoint("b", 18))
    counts = []
    run.start()
    while run.wait() is not RunState.COMPLETED:
        counts.append(run.output().count())
        run.resume()
    assert counts == [17, 18] and rows(run.result()) == [(n,) for n in range(2, 101, 2)]
    assert not (tmp_path / "run/staged").exists()


def test_one_operator_is_held(spark, tmp_path):
    run = plan_run(spark, join_plan(spark, tmp_path), f"{tmp_path}/run")
    run.pause("right")
    assert run.start().wait() is RunState.PAUSED
    assert run.runs["left"].state is RunState.COMPLETED and not run.runs["right"].output().count()
    run.pause("left")  # has put out all its rows, so nothing is left to hold
    assert run.resume("left") is RunState.PAUSED
    assert run.resume("right") is RunState.RUNNING
    assert run.wait() is RunState.COMPLETED and run.result().count() == 15
    with pytest.raises(BreakpointError, match="no step"):
        run.pause("lost")
