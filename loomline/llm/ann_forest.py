"""Approximate nearest neighbours by forests of random-projection trees.

One tree, fitted on a bounded sample, parts the space into blocks. Every vector is filed in
its block once; a query goes to the blocks that lie nearest to it. A block grows a forest of
its own over its vectors, and each query walks all its trees through one priority queue that
orders the branches by the squared distances to the planes that part the query from them. It
takes leaves in that order until its budget is spent; the vectors in them are reranked by
exact distances. As a branch never comes nearer on the way down, the queue gives the leaves in
ascending order of their own distances; ``Forest.queue`` lays out that order for many queries
at once.

Neither how many blocks nor how many vectors a query looks at is fixed. Up to PROBED of the
queries are answered by brute force over the whole table, and so many blocks are taken, by
their sizes, that all but 1 - REACH of their true neighbours lie in them. And each block
answers its first PROBED queries by brute force over its own vectors: the budget is the least
number of filings, over all trees, that meets RECALL of those. So recall holds at every size.

Blocks hold a 64th of the table, from LEAST_BLOCK vectors up to as many as fit MOST_BYTES;
a block that grows beyond twice that is dealt to several. A task holds one block; queries
stream past it. Equal vectors of a block are one class, with its k + 1 least ids, which is all
that an answer can name; a task files no more of them than that from a batch of rows, so
copies don't pile up.

Defined results: rows with a null id, or whose vector is null, empty, zero, of another length
than the table's longest, or holds nulls or values that aren't finite take no part; of rows
that repeat an id the least vector counts; ties go to the smaller id; fewer vectors than k
give fewer rows; an empty table gives none. Columns other than id and vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.common import stored

TREES = 16
LEAF = 32
#: Most vectors that a tree is fitted on.
SAMPLE = 16_384
#: The least budget of a query in a block.
SEARCH = 256
#: Shares of true neighbours that the budget and the blocks must reach; queries that they are measured on.
RECALL, REACH = 0.98, 0.99
PROBED = 128
BLOCKS, LEAST_BLOCK, MOST_BYTES = 64, 4096, 1 << 27
#: Queries that a block answers together.
TOGETHER = 64


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: node i has the children 2i + 1 and 2i + 2."""

    depth: int
    normals: np.ndarray
    thresholds: np.ndarray

    @property
    def width(self) -> int:
        """Leaves of all trees."""
        return len(self.normals) << self.depth

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered over all trees."""
        out = np.empty((len(x), len(self.normals)), np.int64)
        for t, (normals, thresholds) in enumerate(zip(self.normals, self.thresholds, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, normals[node]) > thresholds[node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1) + (t << self.depth)
        return out

    def queue(self, q: np.ndarray) -> np.ndarray:
        """For each query the leaves of all trees in the order in which the queue gives them."""
        parts = []
        for normals, thresholds in zip(self.normals, self.thresholds, strict=True):
            far = np.zeros((len(q), 1))
            for level in range(self.depth):
                nodes = slice((1 << level) - 1, (2 << level) - 1)
                margin = q @ normals[nodes].T - thresholds[nodes]
                square = np.square(margin, dtype=np.float64)
                right = margin > 0
                far = np.stack([far + np.where(right, square, 0), far + np.where(right, 0, square)], 2).reshape(len(q), -1)
            parts.append(far)
        return np.argsort(np.concatenate(parts, axis=1), axis=1, kind="stable")


def grow(sample: np.ndarray, depth: int, trees: int = TREES) -> Forest:
    """Trees of a depth on a sample: a node's direction joins two of its sample points, its
    threshold is the sample's median along it."""
    width, nodes = sample.shape[1] if len(sample) else 1, (1 << depth) - 1
    normals, thresholds = np.zeros((trees, nodes, width), np.float32), np.zeros((trees, nodes), np.float32)
    for t in range(trees):
        draw, node = np.random.default_rng(t), np.zeros(len(sample), np.int64)
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            lo = (1 << level) - 1
            edges = np.searchsorted(node[order], np.arange(lo, lo + (1 << level) + 1))
            for i in range(1 << level):
                own = order[edges[i] : edges[i + 1]]
                size = 0.0
                if len(own) > 1:
                    a = int(draw.integers(len(own)))
                    b = (a + 1 + int(draw.integers(len(own) - 1))) % len(own)
                    line = sample[own[a]].astype(np.float64) - sample[own[b]]
                    size = float(np.sqrt(line @ line))
                if not (size > 0 and np.isfinite(size)):
                    line = draw.standard_normal(width)
                    size = float(np.sqrt(line @ line))
                normals[t, lo + i] = line / size
                if len(own):
                    thresholds[t, lo + i] = np.median(sample[own] @ normals[t, lo + i])
            side = np.einsum("ij,ij->i", sample, normals[t][node]) > thresholds[t][node]
            node = 2 * node + 1 + side
    return Forest(depth, normals, thresholds)


def fitting_depth(n: int, leaf: int, sample: int) -> int:
    """Levels after which a leaf holds about `leaf` of n vectors, or two of the sample."""
    return max(0, min(int(np.ceil(np.log2(max(n, 1) / leaf))), int(np.log2(max(min(n, sample), 2) / 2))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield batch.slice(k, most)


def equal_rows(x: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal ones."""
    raw = np.ascontiguousarray(x + 0)
    return np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)[1].ravel()


def least_ids(classes: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` least ids of each class, by class and id."""
    order = np.lexsort((ids, classes))
    own = classes[order]
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(heads, np.diff(np.append(heads, len(own))))
    return order[nth < most]


class Block:
    """The classes of a block, their forest, and the budget that its first queries need."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, trees: int, leaf: int, search: int, sample: int, recall: float, exact: bool):
        number = equal_rows(x)
        own = least_ids(number, ids, k + 1)
        self.k, self.search, self.recall, self.exact = k, search, recall, exact
        self.ids, heads = ids[own], np.flatnonzero(np.append(True, np.diff(number[own]) != 0))
        self.at = np.append(heads, len(own))
        self.first = self.ids[heads]
        self.x = x[own[heads]]
        self.fast = self.x.astype(np.float32)
        self.squares = np.square(self.fast, dtype=np.float64).sum(axis=1)
        n = len(self.x)
        fitted = self.fast if n <= sample else self.fast[np.random.default_rng(n).choice(n, sample, replace=False)]
        self.forest = grow(fitted, fitting_depth(n, leaf, sample), trees)
        leaves = self.forest.leaves(self.fast)
        self.leaves, flat = leaves, leaves.ravel()
        self.members = np.argsort(flat, kind="stable") // max(trees, 1)
        self.edges = np.searchsorted(np.sort(flat), np.arange(self.forest.width + 1))
        self.budget: int | None = None

    def nearest(self, q: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k + 1 nearest classes among the candidates and their distances. Rough distances
        leave out those that can't be among them."""
        if len(candidates) > 4 * (self.k + 1):
            fast = q.astype(np.float32)
            rough = self.squares[candidates] - 2 * (self.fast[candidates] @ fast)
            scale = float(self.squares[candidates].max() + np.square(fast, dtype=np.float64).sum())
            candidates = candidates[rough <= np.partition(rough, self.k)[self.k] + 1e-5 * scale]
        far = np.sqrt(np.square(self.x[candidates].astype(np.float64) - q).sum(axis=1))
        best = np.lexsort((self.first[candidates], far))[: self.k + 1]
        return candidates[best], far[best]

    def measure(self, q: np.ndarray, order: np.ndarray) -> int:
        """The least budget that meets the share recall of the queries' true neighbours here."""
        sizes = np.diff(self.edges)
        needs, everything = [], np.arange(len(self.x))
        for i in range(len(q)):
            held = np.cumsum(sizes[order[i]]) - sizes[order[i]]
            before = np.empty(self.forest.width, np.int64)
            before[order[i]] = held
            near, far = self.nearest(q[i], everything)
            near = near[far > 0][: self.k]  # equal vectors are met at once
            needs.append(before[self.leaves[near]].min(axis=1) + 1)
        needs = np.sort(np.concatenate(needs)) if needs else np.zeros(0, np.int64)
        return int(needs[max(int(np.ceil(self.recall * len(needs))), 1) - 1]) if len(needs) else 0

    def answers(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest classes found of each query, and their distances."""
        out = []
        if self.exact:
            everything = np.arange(len(self.x))
            return [self.nearest(row, everything) for row in q]
        sizes = np.diff(self.edges)
        for lo in range(0, len(q), TOGETHER):
            some = q[lo : lo + TOGETHER]
            order = self.forest.queue(some.astype(np.float32))
            if self.budget is None:
                probes = q[:PROBED]
                self.budget = max(self.search, self.measure(probes, self.forest.queue(probes.astype(np.float32))))
            for row, leaves in zip(some, order, strict=True):
                taken = leaves[: int(np.searchsorted(np.cumsum(sizes[leaves]), self.budget)) + 1]
                met = np.zeros(len(self.x), bool)
                starts, lengths = self.edges[taken], sizes[taken]
                at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
                met[self.members[at]] = True
                out.append(self.nearest(row, np.flatnonzero(met)))
        return out

    def named(self, query: int, classes: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest ids but the query's own, and their distances."""
        ids = np.concatenate([self.ids[self.at[c] : self.at[c + 1]] for c in classes.tolist()]) if len(classes) else np.zeros(0, np.int64)
        far = np.repeat(far, self.at[classes + 1] - self.at[classes])
        best = np.lexsort((ids, far))
        best = best[ids[best] != query][: self.k]
        return ids[best], far[best]


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector: str) -> DataFrame:
    """id, vec and asked (whether is_query holds) of the rows that take part. Only where ids
    repeat are vectors dealt by id, to find the least of each."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    if not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rows = stored(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    return rows.withColumn("asked", F.coalesce(is_query, F.lit(False)))


def _drawn(rows: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """Some of the rows: those of least hash, about `most` of n."""
    if n <= most:
        return rows
    return rows.filter(F.pmod(key, F.lit(1 << 40)) < int((1 << 40) * most / n))


def nearest(rows: DataFrame, queries: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """no and vec of the k nearest other rows of each of the queries (of the ids own), by brute
    force over all rows."""
    q, kind = queries.astype(np.float64), dict(rows.dtypes)["vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, q.shape[1]))) for _ in q]
        for batch in _slices(batches, 4096):
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1)).astype(np.float64)
            rough = np.square(x).sum(axis=1)[:, None] - 2 * (x @ q.T)
            rough[ids[:, None] == own] = np.inf
            some = np.argpartition(rough, k, axis=0)[:k] if len(x) > k else np.tile(np.arange(len(x))[:, None], len(q))
            for i in range(len(q)):
                pick = some[:, i][np.isfinite(rough[some[:, i], i])]
                far, vec = (np.concatenate(two) for two in zip(held[i], (np.square(x[pick] - q[i]).sum(axis=1), x[pick]), strict=True))
                best = np.argsort(far, kind="stable")[:k]
                held[i] = far[best], vec[best]
        no = np.repeat(np.arange(len(q)), [len(h[0]) for h in held])
        far, vec = (np.concatenate(parts) for parts in zip(*held, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(far), _vectors(vec.astype(np.float32 if "float" in kind else np.float64))], ["no", "far", "vec"])

    found = rows.select("id", "vec").mapInArrow(run, f"no long, far double, vec {kind}")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("no").orderBy("far"))).filter(F.col("nth") <= k).select("no", "vec")


def reach(rows: DataFrame, asked: int, router: Forest, sizes: np.ndarray, k: int, share: float) -> int:
    """How many vectors the blocks that a query goes to must hold, so that they hold the share
    of the true neighbours of up to about PROBED queries."""
    probes = _drawn(rows.filter("asked"), F.xxhash64("id", F.lit(1)), asked, PROBED).select("id", "vec").toArrow()
    if not probes.num_rows:
        return 0
    queries = _matrix(probes["vec"].combine_chunks())
    near = nearest(rows, queries, probes["id"].to_numpy(), k).toArrow()
    goals = router.leaves(_matrix(near["vec"].combine_chunks()).astype(np.float32))[:, 0]
    order = router.queue(queries.astype(np.float32))
    before = np.empty(order.shape, np.int64)
    np.put_along_axis(before, order, np.cumsum(sizes[order], axis=1) - sizes[order], 1)
    needs = np.sort(before[near["no"].to_numpy(), goals] + 1)
    return int(needs[max(int(np.ceil(share * len(needs))), 1) - 1]) if len(needs) else 0


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, search: int = SEARCH, sample: int = SAMPLE, recall: float = RECALL, exact: bool = False, blocks: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id and score (Euclidean distance) of the k nearest found of
    every row for which is_query (over the column id) holds. search: the least budget in a
    block. exact: look at all vectors of all blocks. blocks: their number, a power of 2."""
    rows = usable(vectors, is_query, id_col, vector)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = width or 1
    rows = rows.filter(F.size("vec") == width)
    kind = dict(rows.dtypes)["vec"]
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    largest = max(LEAST_BLOCK, MOST_BYTES // (4 * width))
    if blocks is None:
        blocks = 1 << int(np.ceil(np.log2(max(1, n / min(largest, max(LEAST_BLOCK, n // BLOCKS))))))
    picked = _drawn(rows, F.xxhash64("vec"), n, sample).select("vec").distinct().limit(4 * sample).toArrow()["vec"].combine_chunks()
    fitted = _matrix(picked).astype(np.float32) if len(picked) else np.zeros((0, width), np.float32)
    router = grow(fitted, min(int(np.log2(blocks)), fitting_depth(len(fitted), 1, len(fitted))), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(router.width, np.int64)
        for batch in batches:
            total += np.bincount(router.leaves(_matrix(batch.column(0)).astype(np.float32))[:, 0], minlength=router.width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(router.width)), pa.array(total)], ["block", "n"])

    sizes, most = np.array([n]), n
    if router.depth:
        held = rows.select("vec").mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).toArrow()
        sizes = np.zeros(router.width, np.int64)
        sizes[held["block"].to_numpy()] = held["n"].to_numpy()
        most = n if exact else reach(rows, asked, router, sizes, k, REACH)
    salts = np.maximum(1, -(-sizes // (2 * largest)))
    first = np.cumsum(salts) - salts

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 8192):
            ids, x, ask = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            home = router.leaves(x.astype(np.float32))[:, 0]
            own = least_ids(equal_rows(x), ids, k + 1)
            block, take, asks = [first[home[own]] + ids[own] % salts[home[own]]], [own], [np.zeros(len(own), np.int32)]
            who = np.flatnonzero(ask)
            for i, order in zip(who.tolist(), router.queue(x[who].astype(np.float32)), strict=True):
                near = order[: int(np.searchsorted(np.cumsum(sizes[order]), most)) + 1]
                near = near[sizes[near] > 0]
                goes = np.concatenate([first[b] + np.arange(salts[b]) for b in near.tolist()])
                block.append(goes)
                take.append(np.full(len(goes), i))
                asks.append(np.ones(len(goes), np.int32))
            take = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block)), pa.array(np.concatenate(asks)), batch.column(0).take(take), batch.column(1).take(take)], ["block", "ask", "id", "vec"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vecs, block = -1, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, ask = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (ask[1:] != ask[:-1])) + 1, [len(own)]]).tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if own[lo] != at:
                    at, ids, vecs, block = own[lo], [], [], None
                rows_id, x = batch.column(2).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(3).slice(lo, hi - lo))
                if not ask[lo]:
                    ids.append(rows_id)
                    vecs.append(x)
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(vecs), k, trees, leaf, search, sample, recall, exact)
                    ids, vecs = [], []
                if block is None:
                    continue
                number = equal_rows(x)
                heads = np.unique(number, return_index=True)[1]
                found = block.answers(x[heads].astype(np.float64))
                named = [block.named(q, *found[c]) for q, c in zip(rows_id.tolist(), number.tolist(), strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in named])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[j] for x in named]))) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(rows_id), *lists], ["query_id", "ids", "scores"])

    filed = rows.select("id", "vec", "asked").mapInArrow(file, f"block long, ask int, id long, vec {kind}")
    dealt = filed.repartition("block").sortWithinPartitions("block", "ask", "id")
    found = dealt.mapInArrow(answer, "query_id long, ids array<long>, scores array<double>")
    hits = found.select("query_id", F.inline(F.arrays_zip("ids", "scores")))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("scores", "ids"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("ids").alias("id"), F.col("scores").alias("score"))
