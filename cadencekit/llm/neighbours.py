"""Approximate nearest neighbours by cosine: a tree of k-means splits searched best bin first.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or with vectors of
another length than most, to which the cosine is undefined.  Every other row is indexed.  Rows with the same id are
candidates each; as a query the least of their vectors counts, and none of them is its candidate.  Ties go to
the smaller id.  Fewer candidates than asked for are all returned.  Other columns may have any names.  Empty tables give
empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencekit.llm.common import opened, record_batches, share, unit_hash
from cadencekit.session import materialise


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of floats as a matrix of doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def k_means(points: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the centre of each point; centres that lose all points are left out."""
    centres = points[random.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        owner = np.argmax(points @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        centres = np.array([points[owner == c].mean(axis=0) for c in np.unique(owner)])
    owner = np.argmax(points @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
    return centres, owner


class Tree:
    """Nodes hold the centres of their children; a child is a node's number or, below zero, a leaf's."""

    def __init__(self, points: np.ndarray, branches: int, leaf_points: int, seed: int = 0, rounds: int = 8):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        random = np.random.default_rng(seed)
        waiting = [(points, None)]
        while waiting:
            here, parent = waiting.pop()
            splits = None
            if len(here) > leaf_points:
                splits = k_means(here, min(branches, len(here)), rounds, random)
            # Equal points can't be split: they make one leaf.
            if splits is None or len(splits[0]) < 2 or len(np.unique(splits[1])) < 2:
                self.leaves += 1
                number = -self.leaves
            else:
                number = len(self.centres)
                self.centres.append(splits[0])
                self.children.append([])
                slots = [(here[splits[1] == c], (number, c)) for c in range(len(splits[0]))]
                self.children[number] = [0] * len(slots)
                waiting += slots
            if parent is not None:
                self.children[parent[0]][parent[1]] = number

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: at every node the child whose centre is nearest."""
        out = np.zeros(len(points), np.int64)
        if not self.centres:
            return out
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            centres = self.centres[node]
            nearest = np.argmax(points[rows] @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
            waiting += [(child, rows[nearest == c]) for c, child in enumerate(self.children[node]) if (nearest == c).any()]
        return out

    def visits(self, point: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first: the nearest centre seen so far is opened next."""
        if not self.centres:
            return [0]
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(-node - 1)
                continue
            far = ((self.centres[node] - point) ** 2).sum(axis=1)
            for child, distance in zip(self.children[node], far.tolist()):
                heapq.heappush(heap, (distance, child))
        return out


def calibrate(tree: Tree, points: np.ndarray, k: int, recall: float, probes: int = 300, seed: int = 1) -> int:
    """Leaf visits, widened step by step until the probes' own neighbours in the sample are found with the recall."""
    probes = np.random.default_rng(seed).choice(len(points), min(probes, len(points)), replace=False)
    leaves = tree.assign(points)
    near = points[probes] @ points.T
    near[np.arange(len(probes)), probes] = -np.inf
    k = min(k, len(points) - 1)
    if k < 1:
        return tree.leaves
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    rank = np.empty((len(probes), k))
    for i, probe in enumerate(probes):
        order = np.empty(max(1, tree.leaves))
        order[tree.visits(points[probe], tree.leaves)] = np.arange(max(1, tree.leaves))
        rank[i] = order[leaves[best[i]]]
    visits = 1
    while visits < tree.leaves and (rank < visits).mean() < recall:
        visits += 1
    return min(tree.leaves, visits)


def best_pairs(query_ids, queries, visited, ids, vectors, leaves, k, block=4096):
    """The k nearest rows of each query among the leaves that it visits (``visited``: queries x leaves), as (query id, id,
    score).  The product of the matrices, block by block, only picks what can be among them; scores and ties come
    from row-wise sums, which are the same for equal vectors."""
    lengths, own = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    found = [[] for _ in query_ids]
    for start in range(0, len(ids), block):
        part = slice(start, start + block)
        rough = (queries / own[:, None]) @ (vectors[part] / lengths[part, None]).T
        rough[~visited[:, leaves[part]]] = -np.inf
        rough[query_ids[:, None] == ids[None, part]] = -np.inf
        for i, row in enumerate(rough):
            n = min(k, int(np.isfinite(row).sum()))
            if n == 0:
                continue
            least = np.partition(row, len(row) - n)[len(row) - n]
            at = start + np.flatnonzero(row >= least - 1e-9)
            exact = (vectors[at] * queries[i]).sum(axis=1) / (own[i] * lengths[at])
            found[i] += [(-float(exact[j]), int(ids[at[j]])) for j in np.lexsort((ids[at], -exact))[:n]]
    for query_id, nearest in zip(query_ids.tolist(), found):
        for score, row in sorted(nearest)[:k]:
            yield query_id, row, -score


def nearest(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            most_sample: int = 20_000, branches: int = 8, leaf_points: int = 40, recall: float = 0.97, groups: int = 16,
            chunk_bytes: int = 64 << 20, query_chunk: int = 4096, seed: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest rows found for every row that ``is_query`` picks.

    The tree and the number of leaf visits come from a sample of about ``most_sample`` rows, picked by a hash of
    the id; every row is indexed.  Neighbouring leaves form ``groups``: a query is sent once to each group, with the leaves that it
    visits there, and brings back k rows.  Groups with many rows or many visitors are cut into chunks."""
    spark = table.sparkSession
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = materialise(rows.where(usable & F.col("id").isNotNull()))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == sizes["d"])
    # A hash of id and vector: rows that share an id are not all picked or none.
    drawn = unit_hash(F.col("id"), F.col("v"), seed=seed)
    sample = rows.where(drawn * sizes["n"] < most_sample).orderBy(drawn, "id", "v").limit(2 * most_sample).select("v").toArrow()
    points = unit(matrix(sample["v"].combine_chunks())) if sample.num_rows else np.ones((1, sizes["d"]))
    tree = Tree(points, branches, leaf_points, seed)
    shared = share(spark, (tree, calibrate(tree, points, k, recall)))
    leaves = max(1, tree.leaves)
    # Leaves are numbered subtree by subtree.
    group_of = np.arange(leaves) * min(groups, leaves) // leaves

    def index(batches):
        tree, _ = opened(shared)
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(unit(matrix(batch.column("v"))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaf), pa.array(group_of[leaf])],
                                                 names=["id", "v", "leaf", "grp"])

    def visit(batches):
        tree, visits = opened(shared)

        def parts():
            for batch in batches:
                if batch.num_rows:
                    for one, point in zip(batch.column("id").to_pylist(), unit(matrix(batch.column("v")))):
                        seen = np.sort(np.array(tree.visits(point, visits)))
                        cuts = np.flatnonzero(np.diff(group_of[seen])) + 1
                        for some in np.split(seen, cuts):
                            yield one, int(group_of[some[0]]), some.tolist()
        yield from record_batches(parts(), pa.schema([("query", pa.int64()), ("grp", pa.int64()), ("seen", pa.list_(pa.int64()))]))

    indexed = materialise(rows.select("id", "v").mapInArrow(index, "id long, v array<double>, leaf long, grp long"))
    asked = materialise(rows.where("q").groupBy("id").agg(F.min("v").alias("v")))
    visited = materialise(asked.mapInArrow(visit, "query long, grp long, seen array<long>"))
    row_chunk = max(1, chunk_bytes // (8 * sizes["d"]))
    parts = (indexed.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / row_chunk).alias("n_rows"))
             .join(visited.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / query_chunk).alias("n_queries")), "grp"))
    left = (visited.join(asked.withColumnRenamed("id", "query"), "query").join(parts, "grp")
            .select("grp", F.pmod(F.xxhash64("query"), "n_queries").alias("qc"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("rc"), "query", "seen", "v"))
    # The running number of a written row deals out rows that share an id, too.
    right = indexed.withColumn("_row", F.monotonically_increasing_id()).join(parts, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_queries") - 1)).alias("qc"),
        F.pmod(F.xxhash64("_row"), "n_rows").alias("rc"), "leaf", "id", "v")

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and candidates.num_rows:
            seen = queries["seen"].combine_chunks()
            visited = np.zeros((queries.num_rows, leaves), bool)
            visited[np.repeat(np.arange(queries.num_rows), seen.value_lengths().to_numpy()), seen.flatten().to_numpy()] = True
            found = list(best_pairs(queries["query"].to_numpy(), matrix(queries["v"].combine_chunks()), visited, candidates["id"].to_numpy(),
                                    matrix(candidates["v"].combine_chunks()), candidates["leaf"].to_numpy(), k))
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    keys = ["grp", "qc", "rc"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
