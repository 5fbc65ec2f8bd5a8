"""Interactive control of a chain of steps: pause, resume, count and conditional breakpoints.

The input is read as a stream of files, one to a micro-batch; the checkpoint of the stream
remembers which batches are done. A pause ends the query, a resume starts it from its
checkpoint. What a batch puts out is written once, under the batch's number, and counts as
output once the run's notes say that the batch is done; so a batch that is delivered again
counts once, and a run goes on after the driver's process ends, too.

A count breakpoint is exact: rows have places in their batch, and of the batch that it falls
into those up to the breakpoint are output until the run is resumed. Places are numbered
within the batch's files, so a cut is a filter and moves nothing.

Row-by-row steps run on the stream; what needs all rows (groups, counts, sorts) runs as one
job over the stream's output once it is complete. A pause is granted between batches and at
the border to that job. ``plan_run`` makes a run of such chains for a whole workflow.
"""

from __future__ import annotations

import enum
import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.fields import Field, field_name
from loomline.operators.breakpoints import condition
from loomline.sources import store

Step = Callable[[DataFrame], DataFrame]
#: Columns of a batch's files: the batch, and a row's file and place there.
BATCH, PLACE = "loomline_batch", "loomline_place"


class RunState(enum.Enum):
    UNINITIALIZED = "Uninitialized"
    READY = "Ready"
    RUNNING = "Running"
    PAUSING = "Pausing"
    PAUSED = "Paused"
    RESUMING = "Resuming"
    COMPLETED = "Completed"


#: The states that may follow each state.
FOLLOWS: dict[RunState, set[RunState]] = {
    RunState.UNINITIALIZED: {RunState.READY},
    RunState.READY: {RunState.RUNNING, RunState.PAUSED},
    RunState.RUNNING: {RunState.PAUSING, RunState.PAUSED, RunState.COMPLETED},
    RunState.PAUSING: {RunState.PAUSED, RunState.COMPLETED},
    RunState.PAUSED: {RunState.RESUMING},
    RunState.RESUMING: {RunState.RUNNING, RunState.READY, RunState.COMPLETED},
    RunState.COMPLETED: {RunState.COMPLETED},
}


class BreakpointError(RuntimeError):
    """A breakpoint that can't be set, or a step that isn't there."""


class _Stop(Exception):
    """Ends a batch at a breakpoint; the batch is delivered again on resume."""


@dataclass(frozen=True)
class CountBreakpoint:
    """Pauses once a step has put out exactly so many rows. No row is lost; fires once."""

    id: str
    target: int
    step: str | None = None


@dataclass(frozen=True)
class ConditionalBreakpoint:
    """Takes rows that meet the predicate out of a step's output, reports them and pauses;
    armed again on resume."""

    id: str
    predicate: Column | str
    step: str | None = None


@dataclass
class _Notes:
    """What a run must know after a restart."""

    sizes: dict[str, int] = field(default_factory=dict)
    #: By breakpoint: batch, rows of it before the cut, and the cut's file and place there.
    fired: dict[str, list[int]] = field(default_factory=dict)
    reported: list[int] = field(default_factory=list)
    done: bool = False


class WorkflowRun:
    """steps: (name, function) in order, row by row; finish: what needs all rows."""

    def __init__(self, spark: SparkSession, root: str, steps: list[tuple[str, Step]], finish: Step = lambda df: df):
        self.spark, self.root, self.steps, self.finish = spark, root.rstrip("/"), steps, finish
        self.state = RunState.UNINITIALIZED
        self.counts: dict[str, CountBreakpoint] = {}
        self.conditions: dict[str, ConditionalBreakpoint] = {}
        self.timings: dict[str, float] = {}
        self._query, self._lock, self._hit = None, threading.RLock(), False
        self._notes = self._load()
        text = store.read_text(spark, f"{self.root}/source.json")
        self._source: dict[str, str] = json.loads(text) if text else {}
        if self._source:
            self._to(RunState.READY)
            if self._notes.done:
                self.state = RunState.COMPLETED

    # -- set-up

    def stage(self, df: DataFrame, files: int = 8) -> WorkflowRun:
        """Write the input as so many files; a batch reads one."""
        df.repartition(files).write.mode("overwrite").parquet(f"{self.root}/staged")
        return self._from({"path": f"{self.root}/staged", "glob": "*"})

    def stream_files(self, path: str) -> WorkflowRun:
        """Read the Parquet files at path, a file or a folder, as they lie; a batch reads one."""
        if store.is_file(self.spark, path):
            folder, _, name = path.rpartition("/")
            return self._from({"path": folder, "glob": name})
        return self._from({"path": path, "glob": "*"})

    def _from(self, source: dict[str, str]) -> WorkflowRun:
        self._source = source
        store.write_text(self.spark, f"{self.root}/source.json", json.dumps(source))
        self._to(RunState.READY)
        return self

    def input_field(self, field: Field) -> str:
        """The name of a field of the input."""
        return field_name(self._input(), field)

    def _input(self) -> DataFrame:
        return self.spark.read.option("pathGlobFilter", self._source["glob"]).parquet(self._source["path"])

    def set_breakpoint(self, breakpoint_: CountBreakpoint | ConditionalBreakpoint) -> None:
        """Allowed when ready and when paused."""
        if self.state not in (RunState.READY, RunState.PAUSED):
            raise BreakpointError(f"a breakpoint can't be set when {self.state.value}")
        names = [n for n, _ in self.steps]
        if breakpoint_.step is not None and breakpoint_.step not in names:
            raise BreakpointError(f"no step {breakpoint_.step!r} in {names}")
        if breakpoint_.id in self.counts or breakpoint_.id in self.conditions:
            raise BreakpointError(f"there is a breakpoint {breakpoint_.id!r}")
        if isinstance(breakpoint_, CountBreakpoint):
            if breakpoint_.target < 1:
                raise BreakpointError("a count breakpoint's target is at least 1")
            if breakpoint_.step not in (None, names[-1] if names else None):
                raise BreakpointError("a chain counts the rows of its last step")
            self.counts[breakpoint_.id] = breakpoint_
        else:
            self.conditions[breakpoint_.id] = breakpoint_

    def remove_breakpoint(self, id_: str) -> None:
        """Remove this one; others stay."""
        self.counts.pop(id_, None)
        self.conditions.pop(id_, None)

    # -- control

    def start(self) -> WorkflowRun:
        if self.state is RunState.READY:
            self._to(RunState.RUNNING)
            self._launch()
        return self

    def pause(self) -> RunState:
        """End the query between batches; a completed run stays so."""
        if self.state is RunState.READY:
            self._to(RunState.PAUSED)
            self._paused_early = True
        elif self.state is RunState.RUNNING:
            began = time.perf_counter()
            self._to(RunState.PAUSING)
            query = self._query
            query.stop()
            self._settle(stopped=True)
            self.timings["pause"] = time.perf_counter() - began
        return self.state

    def resume(self) -> RunState:
        if self.state is RunState.PAUSED:
            self._to(RunState.RESUMING)
            if getattr(self, "_paused_early", False):
                self._paused_early = False
                self._to(RunState.READY)
            else:
                self._to(RunState.RUNNING)
                self._launch()
        return self.state

    def wait(self, timeout: float | None = None) -> RunState:
        """Until the run completes or a breakpoint pauses it."""
        if self.state is RunState.RUNNING:
            try:
                ended = self._query.awaitTermination(timeout) if timeout else self._query.awaitTermination()
            except StreamingQueryException:
                if not self._hit:
                    raise
                ended = True
            if ended is not False:
                self._settle()
        return self.state

    def run(self) -> DataFrame:
        """To the end, resuming at every breakpoint."""
        self.start()
        while self.wait() is not RunState.COMPLETED:
            self.resume()
        return self.result()

    # -- results

    def output(self) -> DataFrame:
        """Rows put out so far by the last step before finish."""
        return self._rows("out")

    def result(self) -> DataFrame:
        if self.state is not RunState.COMPLETED:
            raise BreakpointError(f"no result when {self.state.value}")
        return self.finish(self.output())

    def reported(self, id_: str) -> DataFrame:
        """Rows that a conditional breakpoint has taken out."""
        return self._rows(f"taken/{id_}")

    def batches_done(self) -> int:
        return len(self._notes.sizes)

    # -- inside

    def _to(self, state: RunState) -> None:
        with self._lock:
            if state not in FOLLOWS[self.state]:
                raise BreakpointError(f"{self.state.value} isn't followed by {state.value}")
            self.state = state

    def _load(self) -> _Notes:
        text = store.read_text(self.spark, f"{self.root}/notes.json")
        return _Notes(**json.loads(text)) if text else _Notes()

    def _save(self) -> None:
        store.write_text(self.spark, f"{self.root}/notes.json", json.dumps(self._notes.__dict__))

    def _launch(self) -> None:
        self._hit = False
        rows = self.spark.readStream.schema(self._input().schema).options(maxFilesPerTrigger=1, pathGlobFilter=self._source["glob"]).parquet(self._source["path"])
        self._query = rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def _settle(self, stopped: bool = False) -> None:
        """Where the run stands once its query has ended."""
        if self._hit or stopped and not self._finished():
            if self.state is not RunState.PAUSED:
                self._to(RunState.PAUSED)
            return
        self._notes.done = True
        self._save()
        self._to(RunState.COMPLETED)

    def _finished(self) -> bool:
        return len(self._notes.sizes) >= len(self._input().inputFiles())

    def _rows(self, name: str) -> DataFrame:
        """What lies under name: output, of batches that are done and of a batch up to the
        last cut, or rows taken out."""
        path, done = f"{self.root}/{name}", len(self._notes.sizes)  # batches come in order
        cuts = [(file, place) for batch, _, file, place in self._notes.fired.values() if batch == done]
        if not store.exists(self.spark, path) or name == "out" and not done and not cuts:
            empty = self._input().limit(0)
            for step, run in self.steps:
                empty = run(empty)
                if any(name == f"taken/{c.id}" and c.step == step for c in self.conditions.values()):
                    break
            return empty
        rows = self.spark.read.parquet(path)
        if name == "out":
            shown = F.col(BATCH) < done
            if cuts:
                file, place = max(cuts)
                shown |= (F.col(BATCH) == done) & (F.col(PLACE) <= (file << 33) + place)
            rows = rows.filter(shown).drop(PLACE)
        return rows.drop(BATCH)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/{BATCH}={batch}")

    def _batch(self, rows: DataFrame, batch: int) -> None:
        if str(batch) in self._notes.sizes:
            return
        last, out = self.steps[-1][0] if self.steps else None, f"{self.root}/out/{BATCH}={batch}"
        if not store.exists(self.spark, f"{out}/_SUCCESS"):
            taken: list[tuple[str, DataFrame]] = []
            for name, step in self.steps or [(None, lambda df: df)]:
                rows = step(rows)
                for b in self.conditions.values():
                    if b.step == name or b.step is None and name == last:
                        bad = condition(b.predicate)
                        taken.append((b.id, rows.filter(bad)))
                        rows = rows.filter(~bad)
            for id_, bad in taken:
                self._write(bad, f"taken/{id_}", batch)
            # places of rows are fixed once, for a batch that is delivered again
            self._write(rows.withColumn(PLACE, F.monotonically_increasing_id()), "out", batch)
        files = self.spark.read.parquet(out).groupBy(F.shiftright(PLACE, 33).alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()
        total = sum(r.n for r in files)
        before = sum(n for b, n in self._notes.sizes.items() if int(b) < batch)
        due = [b for b in self.counts.values() if b.id not in self._notes.fired and before < b.target <= before + total]
        if due:
            first = min(due, key=lambda b: b.target)
            left = first.target - before
            for r in files:
                if left <= r.n:
                    self._notes.fired[first.id] = [batch, first.target - before, r.file, left - 1]
                    break
                left -= r.n
            self._stop()
        self._notes.sizes[str(batch)] = total
        if batch not in self._notes.reported and self._has_taken(batch):
            self._notes.reported.append(batch)
            self._stop()
        self._save()

    def _has_taken(self, batch: int) -> bool:
        for b in self.conditions.values():
            path = f"{self.root}/taken/{b.id}/{BATCH}={batch}"
            if store.exists(self.spark, path) and self.spark.read.parquet(path).limit(1).count():
                return True
        return False

    def _stop(self) -> None:
        self._save()
        self._hit = True
        raise _Stop
