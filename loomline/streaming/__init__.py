"""Runs that can be paused, resumed and stopped at breakpoints."""

from loomline.streaming.control import BreakpointError, ConditionalBreakpoint, CountBreakpoint, RunState, WorkflowRun

__all__ = ["BreakpointError", "ConditionalBreakpoint", "CountBreakpoint", "RunState", "WorkflowRun"]
