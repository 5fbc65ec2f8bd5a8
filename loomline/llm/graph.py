"""Connected components of a link table, by contraction where links lie."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import stored


def roots_of(links: Iterator[tuple]) -> dict:
    """Each node of the links that isn't the least of its component, with that least."""
    above: dict = {}

    def top(x):  # noqa: ANN001, ANN202
        path = []
        while (y := above.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            above[p] = x
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(above)}


def _contract(links: DataFrame) -> DataFrame:
    """u and v: for each part of the links, dealt by u, each node and the least of its part's
    component. Nodes are connected as before; links to a hub are spread over all parts. The
    same is done where the links lie before they are dealt, so a hub sends a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        found = roots_of(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), kind), pa.array(found.values(), kind)], ["u", "v"])

    name = dict(links.dtypes)["u"]
    kind = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]
    schema = f"u {name}, v {name}"
    return links.select("u", "v").mapInArrow(run, schema).repartition("u").mapInArrow(run, schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the least node that it reaches, for every node of a link between two
    different nodes. A round deals each node's links downward together and contracts them
    there, then points each node past its neighbour to that one's own; it ends when nothing
    changes, as no neighbour leads further and no node has two. Rounds grow with the logarithm
    of the longest path; each is written to the shared folder, and only a count and a checksum
    come to the driver."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    before = None
    while True:
        near = _contract(edges)
        past = near.select(F.col("u").alias("x"), F.col("v").alias("w"))
        edges = stored(near.join(past, F.col("v") == F.col("x"), "left").select("u", F.coalesce("w", "v").alias("v")).distinct(), "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
