"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

Nearness is the inner product.  The tree is fitted on at most SAMPLE vectors (those with the least hash of
vec_id; a documented bound) and split until a leaf stands for about LEAF_ROWS rows, so that the number of
leaves follows that of the rows; where the sample is too thin for that, executors grow a subtree under each
leaf of more than CELL rows, from a sample of that leaf's rows.  Vectors get one more component,
sqrt(M^2 - |x|^2), so that nearest by distance is largest by inner product; every vector is put into a leaf.
A query walks the tree with a priority queue of nodes, those first whose centre and spread promise the
largest product, and collects leaves until it has the calibrated number of them: the least number at which
CALIBRATION queries find TARGET of their true neighbours, found by brute force over all rows.

Leaves are dealt into cells of about CELL vectors; large leaves are split over several cells.  A query goes
once to each cell that holds one of its leaves.  Rows of a cell come first, then its queries in batches, which
are multiplied with the rows of their leaves; a cell returns a query's best k as one row.  A cell with more
than QUERIES queries is copied, once per QUERIES of them, so rows are sent in proportion to queries at most.

Scores are sums of double-precision products of the original vectors, added alike for every row, so that
equal vectors have equal scores; ties go to the smaller vec_id.  Vectors that are null, empty, zero or hold
null or non-finite components take no part; so do those whose length is not the most common one (of equally
common ones the least), since they have no inner product with the others.  Repeated rows are candidates each;
of repeated query ids the least vector asks; a query never finds its own vec_id.
"""

from __future__ import annotations

import heapq
import logging
import math
import pickle
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import partitions, stage

log = logging.getLogger(__name__)

#: Vectors that the tree is fitted on, and of one leaf those that its subtree is fitted on (with twice as much at most).
SAMPLE, SUB_SAMPLE = 20_000, 512
BRANCHES = 8
LEAF_ROWS = 96
#: Sampled vectors that a leaf has at least, so that its centre means something.
LEAF_SAMPLE = 8
CALIBRATION = 128
TARGET = 0.95
CELL = 2048
QUERIES = 65_536
#: Queries that are multiplied at a time.
BLOCK = 512
TOP = 20
#: Standard deviations above a node's centre that the queue reckons with.
REACH = 3.0


class Tree(NamedTuple):
    """Nodes, parents before children; the children of node i are first[i] .. first[i] + number[i]."""

    centres: np.ndarray
    #: Standard deviation of a node's vectors along one direction.
    spread: np.ndarray
    first: np.ndarray
    number: np.ndarray
    leaf: np.ndarray
    bound: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.bound**2 - (x * x).sum(1), 0))[:, None]], 1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into, going down to the nearest centre."""
        x, out = self.lifted(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            lo, n = int(self.first[node]), int(self.number[node])
            if not n:
                out[rows] = self.leaf[node]
                continue
            centres = self.centres[lo : lo + n].astype(float)
            own = ((centres**2).sum(1) - 2 * x[rows] @ centres.T).argmin(1)
            todo += [(lo + k, rows[own == k]) for k in range(n) if (own == k).any()]
        return out

    def promise(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the product that its better vectors may have."""
        size = np.sqrt((queries * queries).sum(1))
        return queries @ self.centres[:, : queries.shape[1]].T.astype(float) + REACH * size[:, None] * self.spread

    def best_bins(self, promise: list[float], most: int, sizes: list[int] | None = None, rows: int = 0) -> list[int]:
        """Leaves by a queue of nodes, most promising first: `most` of them, and more until they hold `rows` rows."""
        queue, found, held, first, number, leaf = [(0.0, 0)], [], 0, self.first, self.number, self.leaf
        while queue and (len(found) < most or held < rows):
            node = heapq.heappop(queue)[1]
            if n := number[node]:
                for child in range(first[node], first[node] + n):
                    heapq.heappush(queue, (-promise[child], child))
            else:
                found.append(leaf[node])
                held += sizes[leaf[node]] if sizes else 0
        return found

    def listed(self) -> Tree:
        """The same with lists in place of the arrays that best_bins() reads one by one."""
        return self._replace(first=self.first.tolist(), number=self.number.tolist(), leaf=self.leaf.tolist())


def _means(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.stack([np.bincount(own, weights=c, minlength=k) for c in x.T], 1)
        sizes = np.bincount(own, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
    return centres, own


def grow(sample: np.ndarray, bound: float, leaf_sample: int = LEAF_SAMPLE, seed: int = 1) -> Tree:
    """A tree over the sample; a node of at most `leaf_sample` sampled vectors, or of equal ones, is a leaf."""
    rng = np.random.default_rng(seed)
    none = np.zeros(0)
    x = Tree(none, none, none, none, none, bound).lifted(sample)
    d = x.shape[1] - 1

    def spread(rows: np.ndarray) -> float:
        return float(np.sqrt(x[rows, :d].var(0).mean()))

    every = np.arange(len(x))
    centres, spreads, first, number, queue = [x.mean(0)], [spread(every)], [0], [0], deque([(0, every)])
    while queue:
        node, rows = queue.popleft()
        if len(rows) <= leaf_sample or (x[rows] == x[rows[0]]).all():
            continue
        mid, own = _means(x[rows], min(BRANCHES, len(rows)), rng)
        used = np.unique(own)
        if len(used) < 2:
            continue
        first[node], number[node] = len(centres), len(used)
        for k in used:
            queue.append((len(centres), rows[own == k]))
            centres.append(mid[k])
            spreads.append(spread(rows[own == k]))
            first.append(0)
            number.append(0)
    return _numbered(np.array(centres, np.float32), np.array(spreads), np.array(first), np.array(number), bound)


def _numbered(centres, spreads, first, number, bound: float) -> Tree:
    return Tree(centres, spreads, first, number, np.where(number == 0, np.cumsum(number == 0) - 1, -1), bound)


def grafted(tree: Tree, subtrees: dict[int, Tree]) -> Tree:
    """`tree` with a tree in place of each of some leaves."""
    centres, spreads, first, number = [tree.centres], [tree.spread], [tree.first.copy()], [tree.number.copy()]
    node_of, at = {int(n): i for i, n in enumerate(tree.leaf) if n >= 0}, len(tree.first)
    for leaf, sub in sorted(subtrees.items()):
        if len(sub.first) > 1:
            # the subtree's root is the leaf itself
            first[0][node_of[leaf]], number[0][node_of[leaf]] = sub.first[0] - 1 + at, sub.number[0]
            centres.append(sub.centres[1:])
            spreads.append(sub.spread[1:])
            first.append(np.where(sub.number[1:] > 0, sub.first[1:] - 1 + at, 0))
            number.append(sub.number[1:])
            at += len(sub.first) - 1
    return _numbered(np.concatenate(centres), np.concatenate(spreads), np.concatenate(first), np.concatenate(number), tree.bound)


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; v keeps its own kind of number."""
    v = F.col(f"`{column}`")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added in one fixed order for every row."""
    return (rows * query).sum(1)


def best(x: np.ndarray, ids: np.ndarray, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of `x`, by exact score, ties to smaller ids; `rough` are the products, -inf where a row is out."""
    near = np.flatnonzero(rough > -np.inf)
    if len(near) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= least - 1e-9 * (1 + abs(least)))
    score = exact_scores(x[near], query)
    order = np.lexsort((ids[near], -score))[:k]
    return ids[near][order], score[order]


def fit(rows: DataFrame) -> tuple[Tree, int] | None:
    """The tree over a bounded sample of `rows` (vec_id, v), and how many rows there are."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total = rows.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    if not total["n"]:
        return None
    share = int(1e6 * min(1.0, 1.2 * SAMPLE / total["n"])) + 1
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE)
    x = _matrix(some.select("v").toArrow().column(0))
    return grow(x, math.sqrt(total["m"]), max(LEAF_SAMPLE, round(LEAF_ROWS * len(x) / total["n"]))), total["n"]


def refined(rows: DataFrame, tree: Tree, most: int = CELL, sub_sample: int = SUB_SAMPLE) -> Tree:
    """`tree` with a subtree under each leaf of more than `most` rows, grown on executors from a sample of its rows."""
    spark = rows.sparkSession
    placed = _placed(rows, spark.sparkContext.broadcast(tree))
    sizes = [(r["leaf"], r["count"]) for r in placed.groupBy("leaf").count().collect() if r["count"] > most]  # no more than leaves
    if not sizes:
        return tree
    shares = spark.createDataFrame([(leaf, min(1.0, sub_sample / n)) for leaf, n in sizes], "leaf int, share double")
    mixed = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
    some = placed.join(F.broadcast(shares), "leaf").where(mixed < F.col("share") * (1 << 30)).select("leaf", "vec_id", "v")
    bound, n_of = tree.bound, dict(sizes)

    def run(key, table):
        leaf, table = key[0].as_py(), table.sort_by([("vec_id", "ascending")])
        x = _matrix(table.column("v"))[: 2 * sub_sample]
        sub = grow(x, bound, max(LEAF_SAMPLE, round(LEAF_ROWS * len(x) / n_of[leaf])))
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(tuple(sub))], pa.binary())})

    return grafted(tree, {r["leaf"]: Tree(*pickle.loads(r["tree"])) for r in some.groupBy("leaf").applyInArrow(run, "leaf int, tree binary").collect()})


def _placed(rows: DataFrame, tree) -> DataFrame:
    """`rows` with their leaf."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tree.value.leaf_of(_matrix(batch.column(1))).astype(np.int32))], names=["vec_id", "v", "leaf"])

    return rows.mapInArrow(run, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, leaf int")


def _merge_best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, ids, scores) rows into one row per query with its k best."""
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("ids").alias("id"))))
    return found.groupBy("query_id").agg(F.slice(F.array_sort(pairs), 1, k).alias("top"))


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> dict[int, list[int]]:
    """By brute force over all of `rows`, for a few `queries`: the k nearest vec_id of each."""
    some = queries.select("vec_id", "v").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((some.column("vec_id").to_numpy(), _matrix(some.column("v"))))

    def run(batches):
        ids, q = shared.value
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
                rough = np.where(own[:, None] == ids, -np.inf, x @ q.T)
                top = [best(x, own, q[j], rough[:, j], k) for j in range(len(ids))]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids), "ids": pa.array([t[0].tolist() for t in top], pa.list_(pa.int64())), "scores": pa.array([t[1].tolist() for t in top], pa.list_(pa.float64()))})

    found = _merge_best(rows.select("vec_id", "v").mapInArrow(run, "query_id long, ids array<long>, scores array<double>"), k)
    return {r["query_id"]: [t["id"] for t in r["top"]] for r in found.collect()}


def calibrate(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float = TARGET) -> tuple[int, float]:
    """The least number of leaves at which calibration queries find `target` of their true neighbours, and what they find."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION)
    true = nearest(rows, some, k)
    wanted = rows.sparkSession.createDataFrame([(i,) for i in sorted({i for ids in true.values() for i in ids})], "vec_id long")
    leaf_of = {r["vec_id"]: r["leaf"] for r in rows.join(F.broadcast(wanted), "vec_id").select("vec_id", "leaf").collect()}
    listed, needed = tree.listed(), []
    asked = some.select("vec_id", "v").toArrow()
    for i, promise in zip(asked.column("vec_id").to_pylist(), tree.promise(_matrix(asked.column("v"))).tolist() if asked.num_rows else [], strict=True):
        order = {leaf: n for n, leaf in enumerate(listed.best_bins(promise, tree.leaves), 1)}
        needed += [order[leaf_of[j]] for j in true.get(i, ())]
    if not needed:
        return tree.leaves, 1.0
    visits = sorted(needed)[min(len(needed), math.ceil(target * len(needed))) - 1]
    return visits, sum(n <= visits for n in needed) / len(needed)


class Layout(NamedTuple):
    """What queries need to know: leaves to visit, the first and last cell of each leaf and its rows."""

    visits: int
    first: list[int]
    last: list[int]
    sizes: list[int]


def layout(visits: int, sizes: list[int], cell: int = CELL) -> Layout:
    """Leaves in order fill cells evenly; a leaf larger than a cell spans several."""
    total = max(1, sum(sizes))
    cells = max(48, math.ceil(total / cell))
    ends = np.cumsum(sizes, dtype=np.int64)
    first = (ends - sizes) * cells // total
    return Layout(visits, first.tolist(), np.maximum(first, (ends - 1) * cells // total).tolist(), list(sizes))


def _mixed(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _routed(queries: DataFrame, tree, plan, kind: str, k: int) -> DataFrame:
    """cell, vec_id, v, leaves of each cell that a query visits."""

    def run(batches):
        t, p = tree.value.listed(), plan.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                cells, at, leaves = [], [], []
                for j, promise in enumerate(tree.value.promise(_matrix(part.column(1))).tolist()):
                    by_cell: dict[int, list[int]] = {}
                    # neighbours may be fewer than k in the calibrated leaves: those widen until k are there
                    for leaf in t.best_bins(promise, p.visits, p.sizes, k + 1):
                        if p.sizes[leaf]:
                            for cell in range(p.first[leaf], p.last[leaf] + 1):
                                by_cell.setdefault(cell, []).append(leaf)
                    cells += by_cell
                    leaves += by_cell.values()
                    at += [j] * len(by_cell)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), part.column(0).take(at), part.column(1).take(at), pa.array(leaves, pa.list_(pa.int32()))], names=["cell", "vec_id", "v", "leaves"])

    return queries.mapInArrow(run, f"cell long, vec_id long, v {kind}, leaves array<int>")


def _dealt(rows: DataFrame, plan, kind: str) -> DataFrame:
    """cell, vec_id, v, leaf of each row."""

    def run(batches):
        first, last = np.array(plan.value.first), np.array(plan.value.last)
        for batch in batches:
            leaf, ids = batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy()
            cell = first[leaf] + _mixed(ids) % (last[leaf] - first[leaf] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("vec_id"), batch.column("v"), batch.column("leaf")], names=["cell", "vec_id", "v", "leaf"])

    return rows.mapInArrow(run, f"cell long, vec_id long, v {kind}, leaf int")


class _Cell:
    """The rows of one cell, ordered by leaf."""

    def __init__(self, table: pa.Table):
        leaf = table.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        self.x, self.ids = _matrix(table.column("v"))[order], table.column("vec_id").to_numpy()[order]
        self.leaves, self.starts = np.unique(leaf[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(leaf))

    def answer(self, table: pa.Table, k: int) -> pa.RecordBatch:
        """The best k of the cell's visited leaves for each of the queries of `table` (vec_id, v, leaves)."""
        own, q = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        leaves = table.column("leaves").combine_chunks()
        asker = np.repeat(np.arange(len(own)), np.diff(leaves.offsets.to_numpy()))
        place = np.searchsorted(self.leaves, leaves.flatten().to_numpy())
        order = np.argsort(place, kind="stable")
        asker, place = asker[order], place[order]
        rough = np.full((len(own), len(self.ids)), -np.inf)
        for lo, hi in zip(*[np.searchsorted(place, np.arange(len(self.leaves)), side=s) for s in ("left", "right")], strict=True):
            if hi > lo:
                a, b = self.starts[place[lo]], self.ends[place[lo]]
                rough[asker[lo:hi], a:b] = q[asker[lo:hi]] @ self.x[a:b].T
        rough[own[:, None] == self.ids] = -np.inf
        top = [best(self.x, self.ids, q[j], rough[j], k) for j in range(len(own))]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array([t[0].tolist() for t in top], pa.list_(pa.int64())), pa.array([t[1].tolist() for t in top], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])


def _compared(batches, k: int):
    """Best k of each query in its cell; batches come sorted by (cell, copy), rows before queries."""
    key, rows, cell = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column("cell").to_numpy(), batch.column("copy").to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if (now := tuple(keys[:, lo].tolist())) != key:
                key, rows, cell = now, [], None
            part = batch.slice(lo, hi - lo)
            is_query = part.column("leaf").is_null()
            if (own := part.filter(pc.invert(is_query))).num_rows:
                rows.append(own)
            asked = pa.Table.from_batches([part.filter(is_query)])
            if asked.num_rows and cell is None and rows:
                cell, rows = _Cell(pa.Table.from_batches(rows)), []
            if cell is not None:
                for at in range(0, asked.num_rows, BLOCK):
                    yield cell.answer(asked.slice(at, BLOCK), k)


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that each row of `queries` (vec_id, v) finds among `vectors`."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if (fitted := fit(vectors)) is None:
        return spark.createDataFrame([], schema)
    tree, total = fitted
    if total > tree.leaves * LEAF_ROWS * 4:
        tree = refined(vectors, tree)
    shared = spark.sparkContext.broadcast(tree)
    rows = stage(_placed(vectors, shared))
    parts = max(partitions(spark), math.ceil(total / (32 * CELL)))
    queries = queries.repartition(parts, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    counted = dict(rows.groupBy("leaf").count().collect())  # as many rows as the tree has leaves
    visits, recall = calibrate(rows, queries, tree, k, target)
    sizes = [counted.get(leaf, 0) for leaf in range(tree.leaves)]
    log.info("%s leaves of %s rows, %s visited, recall of calibration queries %.3f", tree.leaves, total, visits, recall)
    plan = spark.sparkContext.broadcast(layout(visits, sizes))
    kind = vectors.schema["v"].dataType.simpleString()
    routed = stage(_routed(queries, shared, plan, kind, k))
    # few cells are copied; their table is small enough to be broadcast, or Spark joins it otherwise
    copied = stage(routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies")).where("copies > 1"))
    copies = F.coalesce("copies", F.lit(1))
    asked = routed.join(copied, "cell", "left").withColumn("copy", F.pmod(F.xxhash64("vec_id"), copies).cast("int"))
    sent = _dealt(rows, plan, kind).join(copied, "cell", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    both = sent.select("cell", "copy", "vec_id", "v", "leaf", F.lit(None).cast("array<int>").alias("leaves")).unionByName(asked.select("cell", "copy", "vec_id", "v", F.lit(None).cast("int").alias("leaf"), "leaves"))
    both = both.repartition(parts, "cell", "copy").sortWithinPartitions("cell", "copy", F.col("leaf").isNull())
    found = both.mapInArrow(lambda batches: _compared(batches, k), "query_id long, ids array<long>, scores array<double>")
    top = _merge_best(found, k).select("query_id", F.posexplode("top").alias("at", "t"))
    return top.select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def report(embeddings: DataFrame, every: int = 20) -> DataFrame:
    rows = usable(embeddings, "vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % every == 0))
