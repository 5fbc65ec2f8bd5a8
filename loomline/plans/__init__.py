"""Workflows: the graph, its checks, its compilation, and stages kept on disk."""

from loomline.plans.compiler import Compiler, compile_workflow, register
from loomline.plans.workflow import Link, Op, PlanError, Workflow

__all__ = ["Compiler", "Link", "Op", "PlanError", "Workflow", "compile_workflow", "register"]
