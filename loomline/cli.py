"""Console: choose and run a plan, with breakpoints, pauses and resumes.

python -m loomline.cli --sf-dir DIR, then: list, choose N|FILE, show, run, pause [STEP], resume [STEP],
set condition STEP PREDICATE, set count [STEP] N, wait, result (its first ROWS rows), quit."""

from __future__ import annotations

import argparse
import shlex
from pathlib import Path

from pyspark.sql import SparkSession

from loomline import demo
from loomline.sources.store import scratch
from loomline.streaming.control import ConditionalBreakpoint, CountBreakpoint
from loomline.streaming.plan_run import PlanRun, plan_run

#: Rows of a result that are shown.
ROWS = 100


class Console:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.plan, self.run, self.marks = demo.plans(sf_dir)["w5"], None, 0

    def _ready(self) -> PlanRun:
        if self.run is None:
            self.run = plan_run(self.spark, self.plan, scratch(self.spark, "run"))
        return self.run

    def do(self, line: str) -> str:
        """The answer to one command."""
        words = shlex.split(line)
        match words:
            case ["list"]:
                return " ".join(demo.plans(self.sf_dir))
            case ["choose", name]:
                known = demo.plans(self.sf_dir)
                self.plan, self.run = known[name] if name in known else Path(name).read_text(), None
                return f"chose {name}"
            case ["show"]:
                return self.plan
            case ["run"]:
                return self._ready().start().state.value
            case ["pause", *step]:
                return self._ready().pause(*step).value
            case ["resume", *step]:
                return self._ready().resume(*step).value
            case ["wait"]:
                return self._ready().wait().value
            case ["set", "condition", step, *predicate]:
                self.marks += 1
                self._ready().set_breakpoint(ConditionalBreakpoint(f"condition-{self.marks}", " ".join(predicate), step))
                return f"condition-{self.marks}"
            case ["set", "count", *step, target]:
                self.marks += 1
                self._ready().set_breakpoint(CountBreakpoint(f"count-{self.marks}", int(target), *step))
                return f"count-{self.marks}"
            case ["result"]:
                rows = self._ready().result().limit(ROWS + 1).collect()
                return "\n".join([*map(str, rows[:ROWS]), *([f"... and more than these {ROWS} rows"] if len(rows) > ROWS else [])])
            case _:
                return __doc__ or ""


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--sf-dir", required=True)
    console = Console(SparkSession.builder.appName("loomline").getOrCreate(), parser.parse_args().sf_dir)
    while (line := input("> ").strip()) != "quit":
        try:
            print(console.do(line))
        except Exception as error:  # noqa: BLE001  the console goes on
            print(f"{type(error).__name__}: {error}")


if __name__ == "__main__":
    main()
