"""The demo plans over the Parquet tables of a folder."""

from __future__ import annotations

import json


def _plan(ops: list[dict], links: list[tuple[str, str]]) -> str:
    return json.dumps({"operators": ops, "links": [{"origin": a, "destination": b} for a, b in links]})


def _scan(name: str, sf_dir: str, table: str, keep: list[int] | None = None) -> dict:
    return {"operatorID": name, "operatorType": "LocalScanSource", "tableName": f"{sf_dir}/{table}.parquet", "delimiter": "|", "indicesToKeep": keep}


def _op(op_id: str, kind: str, /, **params) -> dict:  # noqa: ANN003
    return {"operatorID": op_id, "operatorType": kind, **params}


def plans(sf_dir: str, limit: int = 100_000, since: str = "1991-01-01") -> dict[str, str]:
    """W1 to W5 and the keyword plans, by name."""
    count, sink = _op("Count", "Aggregation"), _op("Sink", "Sink")
    scan = lambda n, t, k=None: _scan(n, sf_dir, t, k)
    groups = [
        _op("GroupBy1", "GroupBy", groupByField=1, aggregateField=0, aggregationType="Count", name="n"),
        _op("GroupBy2", "GroupBy", groupByField=1, aggregateField=0, aggregationType="Count", name="k"),
        _op("Sort", "Sort", targetField=0),
        sink,
    ]
    tail = [("GroupBy1", "GroupBy2"), ("GroupBy2", "Sort"), ("Sort", "Sink")]
    return {
        "w1": _plan([_op("Gen", "Generate", limit=limit, delay=0), count, sink], [("Gen", "Count"), ("Count", "Sink")]),
        "w2": _plan([scan("Scan", "orders"), count, sink], [("Scan", "Count"), ("Count", "Sink")]),
        "w3": _plan(
            [
                scan("Scan", "lineitem", [4, 8, 10]),
                _op("Filter", "Filter", targetField=2, filterType="Greater", threshold=since),
                _op("GroupBy", "GroupBy", groupByField=1, aggregateField=0, aggregationType="Sum", name="sum_qty"),
                _op("Sort", "Sort", targetField=0),
                sink,
            ],
            [("Scan", "Filter"), ("Filter", "GroupBy"), ("GroupBy", "Sort"), ("Sort", "Sink")],
        ),
        "w4": _plan(
            [scan("Scan1", "customer", [0]), scan("Scan2", "orders", [0, 1]), _op("Join", "HashJoin", innerTableIndex=0, outerTableIndex=1), *groups],
            [("Scan1", "Join"), ("Scan2", "Join"), ("Join", "GroupBy1"), *tail],
        ),
        "w5": _plan(
            [
                scan("Scan1", "customer", [0]),
                scan("Scan2", "orders", [0, 1]),
                scan("Scan3", "orders", [0, 1]),
                _op("Join1", "HashJoin", innerTableIndex=0, outerTableIndex=1),
                _op("Join2", "HashJoin", innerTableIndex=0, outerTableIndex=1, inner="Scan3"),
                *groups,
            ],
            [("Scan1", "Join1"), ("Scan2", "Join1"), ("Join1", "Join2"), ("Scan3", "Join2"), ("Join2", "GroupBy1"), *tail],
        ),
        "k1": _plan([scan("Scan", "region"), _op("KeywordSearch", "KeywordMatcher", attributeName=1, keyword="ASIA"), count, sink], [("Scan", "KeywordSearch"), ("KeywordSearch", "Count"), ("Count", "Sink")]),
        "k4": _plan(
            [
                scan("Scan1", "part"),
                scan("Scan2", "lineitem"),
                _op("KeywordSearch", "KeywordMatcher", attributeName=1, keyword="ring"),
                _op("Join", "HashJoin", innerTableIndex=0, outerTableIndex=1),
                count,
                sink,
            ],
            [("Scan1", "KeywordSearch"), ("KeywordSearch", "Join"), ("Scan2", "Join"), ("Join", "Count"), ("Count", "Sink")],
        ),
    }
