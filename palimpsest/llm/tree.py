"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Nearness is the largest inner product. A further component makes all vectors equally long
(the square root of the greatest squared length less their own; 0 for queries), so that it
is nearness by distance too. The tree is fitted on a bounded sample and every row goes to
the leaf that it descends to. A query visits leaves in the order of a priority queue of
nodes by distance to their centres. How many it visits is found on the sample: the visits
widen until the mean recall of held-out queries reaches TARGET. Sample neighbours lie
farther apart than those among all rows, so the figure errs to the safe side.

The visits widen in two steps: the k-th best score in a query's first leaves bounds the
result from below, and of the other leaves only what reaches it is passed on.

Leaves with many rows are cut into parts, and the queries that visit one into chunks; both
sides of every part fit in memory however many rows share a vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written
from palimpsest.llm.vectors import dimensions, matrix

#: The tree is fitted on at most this many rows, those with the least hashes of their ids.
SAMPLE_ROWS = 32_768
#: Rows of a leaf that the tree aims at, and sampled rows that a leaf has at least.
LEAF_ROWS = 512
LEAF_SAMPLE = 16
BRANCHES = 8
#: Recall that calibration must reach, and its queries.
TARGET = 0.96
TRIALS = 400
PART_ROWS = 1024
#: Leaves of the first step.
FIRST_LEAVES = 4
QUERY_CHUNK = 1024


@dataclass
class Tree:
    """Nodes in arrays: ``children[i]`` are the numbers of node i's children, none for a leaf."""

    centres: np.ndarray
    children: list[np.ndarray] = field(default_factory=list)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids) or not len(rows):
                at[rows] = node
                continue
            c = self.centres[kids]
            near = np.argmin((c * c).sum(axis=1) - 2 * (x[rows] @ c.T), axis=1)
            todo += [(int(kid), rows[near == i]) for i, kid in enumerate(kids)]
        return at

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        queue, out = [(0.0, 0)], []
        far = self.lengths - 2 * (self.centres @ q)
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not len(kids):
                out.append(node)
            for kid in kids.tolist():
                heapq.heappush(queue, (far[kid], kid))
        return out

    @property
    def lengths(self) -> np.ndarray:
        if "_lengths" not in self.__dict__:
            self._lengths = (self.centres**2).sum(axis=1)
        return self._lengths

    @property
    def leaves(self) -> int:
        return sum(not len(kids) for kids in self.children)


def k_means(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest centre of each row); fewer centres where rows coincide."""
    centres = x[draw.choice(len(x), 1)]
    gap = np.full(len(x), np.inf)
    while len(centres) < k:
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
        if gap.sum() <= 1e-12 * len(x):
            break
        centres = np.vstack([centres, x[draw.choice(len(x), p=gap / gap.sum())]])
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = (sums / np.maximum(sizes, 1)[:, None])[sizes > 0]
    near = np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
    return centres, near


def grow(sample: np.ndarray, total: int) -> Tree:
    """A tree over ``sample`` whose leaves hold about LEAF_ROWS of ``total`` rows each."""
    draw = np.random.default_rng(5)
    most = max(LEAF_SAMPLE, LEAF_ROWS * len(sample) / max(total, 1))
    centres, children = [sample.mean(axis=0)], [np.zeros(0, np.int64)]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= most:
            continue
        found, near = k_means(sample[rows], min(BRANCHES, -(-len(rows) // int(most))) if len(rows) < BRANCHES * most else BRANCHES, draw)
        if len(found) < 2:
            continue
        children[node] = np.arange(len(centres), len(centres) + len(found))
        for i, centre in enumerate(found):
            todo.append((len(centres), rows[near == i]))
            centres.append(centre)
            children.append(np.zeros(0, np.int64))
    return Tree(np.array(centres), children)


def calibrate(tree: Tree, sample: np.ndarray, k: int) -> int:
    """Leaf visits after which TARGET of the ``k`` nearest in the sample are found, on average."""
    if len(sample) <= k or tree.leaves == 1:
        return tree.leaves
    leaf, length = tree.descend(sample), sample[:, :-1]
    trials = np.arange(0, len(sample), max(1, len(sample) // TRIALS))[:TRIALS]
    ranks = []
    for t in trials:
        scores = length @ length[t]
        scores[t] = -np.inf
        best = np.argpartition(-scores, k)[:k]
        order = {n: i for i, n in enumerate(tree.visit(np.append(length[t], 0.0), tree.leaves))}
        ranks += [order[n] for n in leaf[best].tolist()]
    seen = np.cumsum(np.bincount(ranks, minlength=tree.leaves)) / len(ranks)
    visits = 1
    while visits < tree.leaves and seen[visits - 1] < TARGET:
        visits += 1
    return visits


def lengthened(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))])


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's ``k`` best rows with another id that reach its ``least`` score, ties by smaller id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rough = q @ x.T
    for i, (own, bound) in enumerate(zip(query.tolist(), least.tolist(), strict=True)):
        row = rough[i]
        row[ids == own] = -np.inf
        if len(row) > k:
            bound = max(bound, float(np.partition(row, len(row) - k)[len(row) - k]))
        near = np.flatnonzero((row >= (bound - 1e-9 * (1 + abs(bound)) if np.isfinite(bound) else bound)) & (row > -np.inf))
        exact = (x[near] * q[i]).sum(axis=1)  # a product's rounding may depend on its place in a matrix, this sum's doesn't
        order = np.lexsort((ids[near], -exact))[:k]
        out.append((np.full(len(order), own), ids[near][order], exact[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(rows: DataFrame, every: int, k: int) -> DataFrame:
    """For each row whose vec_id ``every`` divides: the ``k`` nearest other rows that were found.

    Rows with a null vec_id, and vectors that are null, zero or hold null or non-finite
    components, or not as many components as most, take no part. Rows with the query's
    vec_id are not its candidates; a vec_id that repeats is a candidate with each vector, and
    as a query it has one list, of the best over its vectors. Returns query_id, rank, vec_id,
    score; nothing for an empty table.
    """
    spark, size = rows.sparkSession, dimensions(rows)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at, x = matrix(batch.column("embedding"), size, nonzero=True)
            slot = (np.arange(n, n + len(at), dtype=np.int64) << 24) + task
            n += len(at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(slot), pa.array((x * x).sum(axis=1) if len(x) else np.zeros(0)), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "slot", "squared", "v"])

    values = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null").mapInArrow(clean, "vec_id long, slot long, squared double, v binary"), "vectors")
    total, most = values.agg(F.count("*"), F.max("squared")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    drawn = values.orderBy(F.xxhash64("vec_id", "slot"), "slot").limit(SAMPLE_ROWS).select("v").collect()
    sample = lengthened(np.stack([np.frombuffer(r.v) for r in drawn]), most)
    tree = grow(sample, total)
    shared = spark.sparkContext.broadcast((tree, calibrate(tree, sample, k)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, _ = shared.value
        for batch in batches:
            x = np.stack([np.frombuffer(v) for v in batch.column("v").to_pylist()]) if len(batch) else np.zeros((0, held.centres.shape[1] - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "slot", "v")), pa.array(held.descend(lengthened(x, most)))], names=["vec_id", "slot", "v", "leaf"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = shared.value
        for batch in batches:
            found = [held.visit(np.append(np.frombuffer(v), 0.0), n) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "slot", "v")), pa.array(found, pa.list_(pa.int64()))], names=["query_id", "slot", "q", "leaves"])

    index = written(values.mapInArrow(place, "vec_id long, slot long, v binary, leaf long"), "leaves")
    asked = written(values.filter(F.col("vec_id") % every == 0).mapInArrow(visits, "query_id long, slot long, q binary, leaves array<long>"), "visits")
    # One row for each leaf of the bounded tree.
    parts = F.broadcast(written(index.groupBy("leaf").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")), "parts"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        x, q = (np.stack([np.frombuffer(v) for v in t.column(c).to_pylist()]) if len(t) else None for t, c in ((a, "v"), (b, "q")))
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found = nearest(x, a.column("vec_id").to_numpy(), q, b.column("query_id").to_numpy(), b.column("least").to_numpy(), k) if len(a) and len(b) else nothing
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    def visited(queries: DataFrame) -> DataFrame:
        """Best rows of ``queries`` (query_id, slot, q, least, leaf) in their leaves."""
        sizes = F.broadcast(written(queries.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_CHUNK).alias("chunks")), "chunks").join(parts, "leaf"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = index.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("slot"), "parts").alias("part"), upto("chunks").alias("chunk"), "vec_id", "v")
        right = queries.join(sizes, "leaf").select("leaf", upto("parts").alias("part"), F.pmod(F.xxhash64("slot"), "chunks").alias("chunk"), "query_id", "q", "least")
        return left.groupBy("leaf", "part", "chunk").cogroup(right.groupBy("leaf", "part", "chunk")).applyInArrow(best, "query_id long, vec_id long, score double")

    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)
    n = F.lit(FIRST_LEAVES)
    anything = F.lit(float("-inf"))
    first = written(ranked(visited(asked.select("query_id", "slot", "q", anything.alias("least"), F.explode(F.slice("leaves", 1, FIRST_LEAVES)).alias("leaf")))), "first")
    bound = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(anything).alias("least"))
    more = asked.filter(F.size("leaves") > n).select("query_id", "slot", "q", F.explode(F.slice("leaves", n + 1, F.size("leaves") - n)).alias("leaf"))
    rest = visited(written(more.join(bound, "query_id", "left").select("query_id", "slot", "q", F.coalesce("least", anything).alias("least"), "leaf"), "more"))
    return ranked(first.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def op3_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)
