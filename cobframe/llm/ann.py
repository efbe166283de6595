"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is indexed by its leaf.  A
query walks the tree best bin first: a priority queue holds the open nodes by
the inner product with their centroids, and leaves are visited in the order
they leave it.  How many leaves a query visits is calibrated: for a bounded set
of queries the true neighbours among all rows are found, and the visits widen
until their recall reaches the target.

Equal vectors fold into one, which keeps its ``k + 1`` smallest ids: enough for
any answer, as they tie.  A large leaf is dealt over blocks, as are its queries.

Defined results: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do those of another length than the most frequent
one (of equally frequent ones, the smallest); rows without an id take no part;
repeated rows count once; a query's own rows are those of its id; ties go to
the smaller id; fewer candidates than ``k`` are all returned; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobframe.llm import common


@dataclass
class Tree:
    """``children[i]``: node numbers below node ``i``, empty for a leaf;
    ``leaf[i]``: a leaf's number, -1 inside."""
    centroids: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centroid at every level."""
        node, out = np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64)
        todo = [0]
        while todo:
            n = todo.pop()
            at = np.flatnonzero(node == n)
            if not self.children[n]:
                out[at] = self.leaf[n]
                continue
            if len(at):
                c = self.centroids[self.children[n]]
                far = (c ** 2).sum(1)[None, :] - 2 * np.einsum("ij,kj->ik", x[at], c)
                node[at] = np.array(self.children[n])[far.argmin(axis=1)]
            todo += self.children[n]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        near = self.centroids @ q
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, n = heapq.heappop(queue)
            if not self.children[n]:
                out.append(self.leaf[n])
            for c in self.children[n]:
                heapq.heappush(queue, (-float(near[c]), c))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 12) -> np.ndarray:
    """The cluster of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        own = ((c ** 2).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return own


def fit(sample: np.ndarray, leaves: int, branch: int = 8, seed: int = 5) -> Tree:
    """Split the largest leaf by k-means until there are ``leaves`` of them."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if sample.ndim == 2 else 0
    centroids, children, rows = [sample.mean(axis=0) if len(sample) else np.zeros(dim)], [[]], [np.arange(len(sample))]
    queue, count = [(-len(sample), 0)], 1
    while queue and count < leaves:
        _, n = heapq.heappop(queue)
        x = sample[rows[n]]
        k = min(branch, leaves - count + 1, len(x))
        own = kmeans(x, k, rng) if k > 1 else np.zeros(len(x), np.int64)
        parts = [rows[n][own == j] for j in range(k)]
        parts = [p for p in parts if len(p)]
        if len(parts) < 2:
            continue
        for p in parts:
            children[n].append(len(centroids))
            centroids.append(sample[p].mean(axis=0))
            children.append([])
            heapq.heappush(queue, (-len(p), len(rows)))
            rows.append(p)
        count += len(parts) - 1
    leaf, number = [], 0
    for c in children:
        leaf.append(-1 if c else number)
        number += not c
    return Tree(np.array(centroids), children, leaf)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` largest inner products, ties to the smaller id."""
    rough = vectors @ query
    at = np.arange(len(rough))
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    score = (vectors[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return at[order], score[order]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    sound = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    sizes = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return sound.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def fold(rows: DataFrame, keep: int) -> DataFrame:
    """``cls, v, ids``: distinct vectors, their smallest id, their ``keep`` smallest ids."""
    # -0.0 and 0.0 are one value
    by = Window.partitionBy("v").orderBy("vec_id")
    plain = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    some = plain.withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep)
    return some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("cls"), "v", "ids")


def search(rows: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, sample_rows: int = 20_000,
           most_leaves: int = 2048, calibration_queries: int = 200, block_rows: int = 4096,
           block_queries: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of each query row.

    ``is_query``: condition on ``vec_id``.
    """
    spark = rows.sparkSession
    common.prepare(spark)
    sound = common.staged(usable(rows, id_col, vector_col), "vectors")
    classes = common.staged(fold(sound, k + 1), "classes")
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = classes.orderBy(F.xxhash64("cls")).limit(sample_rows).select("cls", "v").toArrow().sort_by("cls")
    # leaves grow slower than rows, so that a query's leaves do
    tree = fit(matrix(sample.column("v")), int(min(most_leaves, max(1, total ** 0.4))))
    held = spark.sparkContext.broadcast(tree)

    def place(batch: pa.RecordBatch):
        leaf = held.value.assign(matrix(batch.column("v")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], ["cls", "v", "ids", "leaf"])

    indexed = common.staged(common.map_batches(classes, place, "cls long, v array<double>, ids array<long>, leaf int"), "indexed")
    mine = sound.where(is_query).select(F.col("vec_id").alias("query_id"),
                                        F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    asked = common.staged(mine.join(indexed.select("v", "cls"), "v").select("query_id", "cls"), "asked")
    queries = common.staged(asked.select("cls").distinct().join(indexed.select("cls", "v"), "cls"), "queries")
    most = calibrate(indexed, queries, tree, k, recall, calibration_queries)

    def walk(batch: pa.RecordBatch):
        vectors = matrix(batch.column("v"))
        leaves = [held.value.visits(q, most) for q in vectors]
        at = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        yield pa.RecordBatch.from_arrays(
            [batch.column("cls").take(pa.array(at)), batch.column("v").take(pa.array(at)),
             pa.array(np.concatenate(leaves).astype(np.int32))], ["cls", "v", "leaf"])

    visits = common.map_batches(queries.select("cls", "v"), walk, "cls long, v array<double>, leaf int")
    room = indexed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    calls = visits.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / block_queries).cast("int").alias("spans"))
    plan = F.broadcast(common.staged(room.join(calls, "leaf"), "plan"))  # a row a leaf, ``most_leaves`` at most
    left = (indexed.join(plan, "leaf").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
            .withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).select("leaf", "block", "span", "cls", "v"))
    right = (visits.join(plan, "leaf").withColumn("span", F.pmod(F.xxhash64("cls"), F.col("spans")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leaf", "block", "span", "cls", "v"))
    wide = k + 1

    def match(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        found = [[], [], []]
        if vectors.num_rows and asking.num_rows:
            x, ids = matrix(vectors.column("v")), vectors.column("cls").to_numpy()
            for cls, q in zip(asking.column("cls").to_pylist(), matrix(asking.column("v")), strict=True):
                at, score = best(q, x, ids, wide)
                found[0] += [cls] * len(at)
                found[1] += ids[at].tolist()
                found[2] += score.tolist()
        return pa.table({"q": pa.array(found[0], pa.int64()), "cls": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.float64())})

    key = ("leaf", "block", "span")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(match, "q long, cls long, score double")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    top = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= wide).drop("r")
    answers = top.join(indexed.select("cls", "ids"), "cls").select("q", F.explode(
        F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))).alias("c"))
    answers = answers.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("c")), 1, wide).alias("found"))
    own = asked.join(answers, F.col("cls") == F.col("q")).select(
        "query_id", F.slice(F.filter("found", lambda c: c["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("p", "c")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"),
        (-F.col("c.far")).alias("score"))


def calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, most: int) -> int:
    """Leaves to visit: the fewest that hold the wanted share of the true ``k``
    nearest classes of up to ``most`` queries, sought among all rows."""
    some = queries.orderBy(F.xxhash64("cls"), "cls").limit(most).select("cls", "v").toArrow().sort_by("cls")
    if not some.num_rows:
        return 1
    x, own = matrix(some.column("v")), some.column("cls").to_pylist()
    held = indexed.sparkSession.sparkContext.broadcast((x, own))

    def brute(batch: pa.RecordBatch):
        x, own = held.value
        vectors, ids = matrix(batch.column("v")), batch.column("cls").to_numpy()
        leaf, out = batch.column("leaf").to_numpy(), []
        for q, cls in zip(x, own, strict=True):
            at, score = best(q, vectors, ids, k + 1)
            out += [(cls, int(leaf[i]), int(ids[i]), float(s)) for i, s in zip(at.tolist(), score.tolist(), strict=True) if ids[i] != cls]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["q", "leaf", "cls", "score"])

    by = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    true = (common.map_batches(indexed.select("cls", "v", "leaf"), brute, "q long, leaf int, cls long, score double")
            .withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("q", "leaf").collect())  # most * k rows at most
    order = {cls: {leaf: i for i, leaf in enumerate(tree.visits(q, tree.leaves))} for q, cls in zip(x, own, strict=True)}
    needed = sorted(order[r["q"]][r["leaf"]] + 1 for r in true)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1
