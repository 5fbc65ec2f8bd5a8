"""Operators: functions from DataFrames and parameters to a DataFrame."""

from loomline.operators.relational import (
    count_rows,
    group_by,
    hash_join,
    identity,
    keyword_match,
    project,
    sort_by,
    union_all,
    where,
)

__all__ = ["count_rows", "group_by", "hash_join", "identity", "keyword_match", "project", "sort_by", "union_all", "where"]
