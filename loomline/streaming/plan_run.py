"""A JSON plan as a run that can be paused, with breakpoints on any operator.

The plan is cut into chains. A chain begins at a source or at an operator that needs all rows
of its inputs, goes on through operators that pass rows one by one, and ends before the next
that doesn't, where a result is read twice, and after an operator whose rows are counted. The
chains of all sources stream, one after the other, then those that breakpoints lie on: their
first operator runs as one job over what earlier chains have put out, and its rows stream
through the chain. All that is left is one last job.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomline.operators import relational
from loomline.plans.compiler import REGISTRY, Compiler, check
from loomline.plans.workflow import PlanError, Workflow
from loomline.sources.files import scan_parquet
from loomline.streaming.control import FOLLOWS, BreakpointError, ConditionalBreakpoint, CountBreakpoint, RunState, WorkflowRun


class PlanRun:
    """Breakpoints name an operator, or else stand on the first source's chain. files: how many
    files a chain's input is written as; None: sources that are Parquet files stream as they lie."""

    def __init__(self, spark: SparkSession, plan: Workflow, root: str, files: int | None = 8, **options: Any):
        check(plan)
        if len(plan.sinks) != 1:
            raise PlanError(f"the plan has {len(plan.sinks)} sinks")
        self.spark, self.plan, self.root, self.files, self.options = spark, plan, root.rstrip("/"), files, options
        self.state = RunState.READY
        self.marks: dict[str, CountBreakpoint | ConditionalBreakpoint] = {}
        self.runs: dict[str, WorkflowRun] = {}
        self.held: set[str] = set()
        self._at: str | None = None
        self._early = False

    # -- breakpoints

    def set_breakpoint(self, breakpoint_: CountBreakpoint | ConditionalBreakpoint) -> None:
        """Allowed when ready and when paused, on an operator that hasn't put out all its rows;
        rows are counted where a chain ends, and one that is under way ends where it does."""
        if self.state not in (RunState.READY, RunState.PAUSED):
            raise BreakpointError(f"a breakpoint can't be set when {self.state.value}")
        if breakpoint_.id in self.marks:
            raise BreakpointError(f"there is a breakpoint {breakpoint_.id!r}")
        step = breakpoint_.step or self._chain(self.plan.sources[0])[-1]
        if step not in self.plan.ops:
            raise BreakpointError(f"no step {step!r} in {list(self.plan.ops)}")
        mark = type(breakpoint_)(breakpoint_.id, *((breakpoint_.target,) if isinstance(breakpoint_, CountBreakpoint) else (breakpoint_.predicate,)), step)
        if isinstance(mark, CountBreakpoint) and mark.target < 1:
            raise BreakpointError("a count breakpoint's target is at least 1")
        for head, run in self.runs.items():
            if step in [name for name, _ in run.steps]:
                if run.state is RunState.COMPLETED:
                    raise BreakpointError(f"{step!r} has put out all its rows")
                run.set_breakpoint(mark)
            elif head == step:
                raise BreakpointError(f"{step!r} is under way")
        self.marks[mark.id] = mark

    def remove_breakpoint(self, id_: str) -> None:
        """Remove this one; others stay."""
        self.marks.pop(id_, None)
        for run in self.runs.values():
            run.remove_breakpoint(id_)

    # -- chains

    def _begins(self, op: str) -> bool:
        above = self.plan.inputs[op]
        if len(above) != 1 or not REGISTRY[self.plan.ops[op].type].stateless or len(self.plan.outputs[above[0]]) != 1:
            return True
        return any(isinstance(m, CountBreakpoint) and m.step == above[0] for m in self.marks.values())

    def _chain(self, head: str) -> list[str]:
        chain = [head]
        if head in self.runs:
            return [name for name, _ in self.runs[head].steps]
        while len(self.plan.outputs[chain[-1]]) == 1 and not self._begins(below := self.plan.outputs[chain[-1]][0]):
            chain.append(below)
        return chain

    def _heads(self) -> list[str]:
        """The first operators of the chains to run, inputs first; one that has begun stays."""
        wanted = {*self.plan.sources, *self.runs, *(self._head(m.step) for m in self.marks.values())}
        return [op for op in self.plan.order if op in wanted]

    def _head(self, op: str) -> str:
        while not self._begins(op):
            op = self.plan.inputs[op][0]
        return op

    def _made(self) -> dict[str, DataFrame]:
        """What chains that are complete have put out, by their last operators. Rows of a sort
        come in its order again."""
        made = {}
        for head, run in self.runs.items():
            if run.state is RunState.COMPLETED:
                op, chain = self.plan.ops[head], [name for name, _ in run.steps]
                rows = run.output()
                if op.type == "Sort" and (key := run.input_field(op.params["targetField"])) in rows.columns:
                    rows = relational.sort_by(rows, key, as_text=self.options.get("compat", False))
                made[chain[-1]] = rows
        return made

    def _compiler(self, made: dict[str, DataFrame]) -> Compiler:
        return Compiler(self.spark, made=made, **self.options)

    def _through(self, made: dict[str, DataFrame], ops: list[str]) -> dict[str, DataFrame]:
        """made with the operators that lead to ops, as far as nothing has made them."""
        compiler = self._compiler(dict(made))

        def reach(op: str) -> None:
            if op not in compiler.made:
                for i in self.plan.inputs[op]:
                    reach(i)
                compiler.made[op] = compiler.build(self.plan, op)

        for op in ops:
            reach(op)
        return compiler.made

    def _run_of(self, head: str) -> WorkflowRun:
        chain = self._chain(head)

        def step(op: str, above: str) -> tuple[str, Any]:
            return op, lambda df: self._compiler({above: df}).build(self.plan, op)

        op, first = self.plan.ops[head], lambda df: df
        path = self.options.get("tables", lambda name: name)(op.params["tableName"]) if "tableName" in op.params else ""
        direct = self.files is None and path.endswith(".parquet")
        if direct:
            columns = scan_parquet(self.spark, path, op.params.get("indicesToKeep")).columns
            first = lambda df: df.select(*columns)
        run = WorkflowRun(self.spark, f"{self.root}/{head}", [(head, first), *(step(op, above) for above, op in zip(chain, chain[1:], strict=False))])
        if run.state is RunState.UNINITIALIZED and direct:
            run.stream_files(path)
        elif run.state is RunState.UNINITIALIZED:
            run.stage(self._through(self._made(), [head])[head], self.files or 8)
        for mark in self.marks.values():
            if mark.step in chain and run.state is RunState.READY:
                run.set_breakpoint(mark)
        return run

    # -- control

    def _to(self, state: RunState) -> RunState:
        if state is not self.state and state not in FOLLOWS[self.state]:
            raise BreakpointError(f"{self.state.value} isn't followed by {state.value}")
        self.state = state
        return state

    def start(self) -> PlanRun:
        if self.state is RunState.READY:
            self._to(RunState.RUNNING)
            self._next()
        return self

    def _next(self) -> None:
        """Start the first chain that isn't complete."""
        self._at = None
        for head in self._heads():
            run = self.runs.get(head) or self._run_of(head)
            self.runs[head] = run
            if run.state is not RunState.COMPLETED and self.held.intersection(self._chain(head)):
                self._to(RunState.PAUSED)
                return
            if run.state is not RunState.COMPLETED:
                self._at = head
                if run.state is RunState.PAUSED:
                    run.resume()
                run.start()
                return
        self._to(RunState.COMPLETED)

    def pause(self, step: str | None = None) -> RunState:
        """End the chain's query between batches; a completed run stays so. With an operator:
        now, if its chain is under way, else before that starts."""
        if step is not None:
            if step not in self.plan.ops:
                raise BreakpointError(f"no step {step!r} in {list(self.plan.ops)}")
            self.held.add(step)
            if not self._at or step not in self._chain(self._at):
                return self.state
        if self.state is RunState.READY:
            self._early = True
            return self._to(RunState.PAUSED)
        if self.state is RunState.RUNNING and self._at:
            self._to(RunState.PAUSING)
            self.runs[self._at].pause()
            self._to(RunState.PAUSED)
        return self.state

    def resume(self, step: str | None = None) -> RunState:
        """Go on; with an operator: let it go on, and the run if nothing else holds it."""
        self.held = self.held - {step} if step is not None else set()
        if self.state is RunState.PAUSED:
            self._to(RunState.RESUMING)
            if self._early:
                self._early = False
                return self._to(RunState.READY)
            self._to(RunState.RUNNING)
            self._next()
        return self.state

    def wait(self, timeout: float | None = None) -> RunState:
        """Until the run completes or a breakpoint pauses it."""
        while self.state is RunState.RUNNING and self._at:
            ended = self.runs[self._at].wait(timeout)
            if ended is RunState.PAUSED:
                return self._to(RunState.PAUSED)
            if ended is not RunState.COMPLETED:
                return self.state
            self._next()
        return self.state

    def run(self) -> DataFrame:
        """To the end, resuming at every breakpoint."""
        self.start()
        while self.wait() is not RunState.COMPLETED:
            self.resume()
        return self.result()

    # -- results

    @property
    def timings(self) -> dict[str, float]:
        return self.runs[self._at].timings if self._at else {}

    def output(self, step: str | None = None) -> DataFrame:
        """Rows that an operator at a chain's end has put out so far; by default the one under way."""
        head = self._head(step) if step else self._at or next(reversed(self.runs))
        return self.runs[head].output()

    def reported(self, id_: str) -> DataFrame:
        """Rows that a conditional breakpoint has taken out."""
        return self.runs[self._head(self.marks[id_].step)].reported(id_)

    def result(self) -> DataFrame:
        if self.state is not RunState.COMPLETED:
            raise BreakpointError(f"no result when {self.state.value}")
        sink = self.plan.sinks[0]
        return self._through(self._made(), [sink])[sink]


def plan_run(spark: SparkSession, plan: Workflow | str, root: str, files: int | None = 8, **options: Any) -> PlanRun:
    """A ready run of the plan."""
    return PlanRun(spark, Workflow.from_json(plan) if isinstance(plan, str) else plan, root, files, **options)
