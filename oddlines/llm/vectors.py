"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is put into the leaf that
descending to the nearest centre leads to. A query keeps a priority queue of
unvisited branches by the cosine of their centres and visits leaves in that
order. How many is calibrated: for held-out queries the true neighbours are
found among all rows, and visits widen until the wanted recall is reached; a
query goes on until the visited leaves hold enough rows. Queries and rows meet
by leaf. Leaves and query lists over ``BLOCK`` entries are cut, and each two
pieces meet in a task of their own, so no task holds a whole leaf.

Scores are cosines in double precision of the original vectors, summed for
each pair in the same way; neighbours are ordered by score, then id. Vectors
that are null or zero, hold a null, NaN or infinite component, have no id, or
another length than most take no part. Rows that repeat an id are candidates
of their own; a query id with several rows is asked once, for the smallest
vector. An empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oddlines.llm.common import partitions
from oddlines.storage import materialize

SAMPLE = 8192  # vectors the tree is fitted on
BRANCHES = 16
LEAF = 48  # sampled vectors below which a node is not split
HELD_OUT = 64  # queries whose true neighbours calibrate the visits
RECALL = 0.96
BLOCK = 4096
PAIRS = 1 << 18  # of queries and rows compared in one step


@dataclass
class Tree:
    centers: np.ndarray  # unit vectors, one a node; node 0 is the root
    children: list[list[int]]  # none: a leaf
    leaf: list[int]  # number of the leaf, -1 within the tree

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        node = np.zeros(len(unit), np.int64)
        out = np.full(len(unit), -1)
        todo = [0]
        while todo:
            at = todo.pop()
            rows = np.flatnonzero(node == at) if at else np.arange(len(unit))
            if not len(rows):
                continue
            if not self.children[at]:
                out[rows] = self.leaf[at]
                node[rows] = -1
                continue
            kids = np.array(self.children[at])
            node[rows] = kids[(unit[rows] @ self.centers[kids].T).argmax(axis=1)]
            todo.extend(self.children[at])
        return out

    def visits(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first search."""
        queue = [(0.0, 0)]
        while queue:
            _, at = heapq.heappop(queue)
            if not self.children[at]:
                yield self.leaf[at]
                continue
            kids = self.children[at]
            for kid, near in zip(kids, (self.centers[kids] @ unit).tolist()):
                heapq.heappush(queue, (-near, kid))


def _kmeans(unit: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Cluster of each unit vector; starts from rows that lie far from those before."""
    centers, near = [unit[0]], unit @ unit[0]
    for _ in range(k - 1):
        centers.append(unit[near.argmin()])
        near = np.maximum(near, unit @ centers[-1])
    centers = np.array(centers)
    for _ in range(rounds):
        label = (unit @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return (unit @ centers.T).argmax(axis=1)


def fit_tree(unit: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF) -> Tree:
    tree = Tree(np.zeros((0, unit.shape[1])), [], [])
    centers: list[np.ndarray] = []

    def add(rows: np.ndarray) -> int:
        mean = unit[rows].sum(axis=0)
        norm = np.linalg.norm(mean)
        centers.append(mean / norm if norm > 0 else mean)
        tree.children.append([])
        tree.leaf.append(-1)
        return len(centers) - 1

    todo, leaves = [(add(np.arange(len(unit))), np.arange(len(unit)))], 0
    while todo:
        at, rows = todo.pop()
        label = _kmeans(unit[rows], min(branches, max(1, len(rows) // 2))) if len(rows) > leaf else np.zeros(len(rows))
        groups = [rows[label == g] for g in np.unique(label)]
        if len(groups) < 2:
            tree.leaf[at], leaves = leaves, leaves + 1
            continue
        for group in groups:
            kid = add(group)
            tree.children[at].append(kid)
            todo.append((kid, group))
    tree.centers = np.array(centers)
    return tree


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the vectors in equal rows; the same for a pair in whatever batch."""
    return (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum(axis=1)))


def best(asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, at (position of the row) and score of the ``k`` nearest rows of another id for each query."""
    found = [pd.DataFrame({"query_id": asked[:0], "at": np.zeros(0, np.int64), "score": np.zeros(0)})]
    unit, step = _unit(rows), max(1, PAIRS // len(rows))
    for begin in range(0, len(asked), step):
        part = queries[begin : begin + step]
        near = _unit(part) @ unit.T
        near[asked[begin : begin + step, None] == ids] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] - 1e-9 if len(rows) > k else np.full(len(part), -2.0)
        i, j = np.nonzero(near >= np.maximum(least, -2.0)[:, None])
        score = cosine(part[i], rows[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        keep = rank < k
        found.append(pd.DataFrame({"query_id": asked[begin + i[keep]], "at": j[keep], "score": score[keep]}))
    return pd.concat(found, ignore_index=True)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, with vectors as doubles."""
    rows = rows.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    rows = rows.filter("exists(v, x -> x != 0)")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (lengths["d"] if lengths else 0))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def true_neighbours(rows: DataFrame, queries: pd.DataFrame, k: int, tree: Tree | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, leaf) by comparing a bounded set of queries with all rows."""
    asked, vectors = queries["id"].to_numpy(), _matrix(queries["v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ids, block = batch["id"].to_numpy(), _matrix(batch["v"])
            leaf = tree.place(_unit(block)) if tree else np.zeros(len(ids), np.int64)
            out = best(asked, vectors, ids, block, k)
            yield out.assign(vec_id=ids[out["at"]], leaf=leaf[out["at"]])[["query_id", "vec_id", "score", "leaf"]]

    return _top(rows.mapInPandas(run, "query_id long, vec_id long, score double, leaf long"), k)


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of the rows for which ``is_query`` holds.

    ``is_query`` is an expression over the column ``id``.
    """
    spark = rows.sparkSession
    rows = usable(rows, vec_id, vector)
    queries = rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    empty = "query_id long, rank int, vec_id long, score double"
    by_hash = F.xxhash64("id", "v")
    sample = rows.orderBy(by_hash).limit(SAMPLE).toPandas()  # SAMPLE rows at most
    held_out = queries.orderBy(by_hash).limit(HELD_OUT).toPandas()
    if not len(sample) or not len(held_out):
        return spark.createDataFrame([], empty)
    tree = fit_tree(_unit(_matrix(sample["v"])))
    truth = true_neighbours(rows, held_out, k, tree).select("query_id", "leaf").toPandas()
    ranks = []
    for query, vector_ in zip(held_out["id"], _unit(_matrix(held_out["v"]))):
        order = {leaf: n for n, leaf in enumerate(tree.visits(vector_), 1)}
        ranks += [order[leaf] for leaf in truth["leaf"][truth["query_id"] == query]]
    visits = int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) if ranks else 1
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * SAMPLE centres

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.place(_unit(_matrix(batch["v"]))))

    schema = "id long, v array<double>, leaf int"
    placed = materialize(rows.mapInPandas(place, schema), "leaves")
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row a leaf

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, v in zip(batch["id"], batch["v"]):
                reached, leaves = 0, []
                for n, leaf in enumerate(shared.value.visits(_unit(np.asarray(v, np.float64)[None])[0]), 1):
                    reached += held.get(leaf, 0)
                    if leaf in held:
                        leaves.append(leaf)
                    if n >= visits and reached > k + 1:
                        break
                # a frame a query: the vector goes along to every leaf
                yield pd.DataFrame({"id": query, "v": [v] * len(leaves), "leaf": leaves})

    asked = materialize(queries.repartition(partitions(spark)).mapInPandas(visit, schema), "visits")
    asking = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}
    sizes = [(leaf, -(-n // BLOCK), -(-asking.get(leaf, 0) // BLOCK)) for leaf, n in held.items() if leaf in asking]
    pieces = F.broadcast(spark.createDataFrame(sizes, "leaf int, row_parts int, query_parts int"))  # a row a leaf

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(pieces, "leaf").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        return df.select("leaf", "row_part", "query_part", "id", "v")

    task = ["leaf", "row_part", "query_part"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids = right["id"].to_numpy()
        out = best(left["id"].to_numpy(), _matrix(left["v"]), ids, _matrix(right["v"]), k)
        return out.assign(vec_id=ids[out["at"]])[["query_id", "vec_id", "score"]]

    found = (
        cut(asked, "query_part", "row_part")
        .groupBy(*task)
        .cogroup(cut(placed, "row_part", "query_part").groupBy(*task))
        .applyInPandas(meet, "query_id long, vec_id long, score double")
    )
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
