"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are cut into blocks of bounded size, and every query block
meets every data block in one task: a stated query set against all rows. There
both sides are indexed by a cover tree and searched together. A pair of nodes
is skipped if the largest inner product their centres and covering radii allow
is below the worst k-th score in the query node. What is left per query and
data block is k rows, merged at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.common import cut_lineage, ship

LEAF = 32
SHRINK = 0.7
LONGEST = (1 << 63) - 1


class Node:
    """A ball: centre, covering radius, own points, and children with smaller radii."""

    __slots__ = ("centre", "norm", "radius", "points", "children", "all")

    def __init__(self, x: np.ndarray, at: np.ndarray, centre: int):
        self.centre, self.all = x[centre], at
        self.norm = float(np.sqrt(self.centre @ self.centre))
        gap = x[at] - self.centre
        distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        self.radius = float(distance.max())
        self.children: list[Node] = []
        if len(at) <= LEAF or self.radius == 0:
            self.points = at
            return
        # Cover the points by balls of a smaller radius, greedily; the parent's
        # centre is the first. Balls of a few points stay with their parent.
        reach, rest, own = SHRINK * self.radius, at, []
        while len(rest):
            gap = x[rest] - (self.centre if len(rest) == len(at) else x[rest[0]])
            inside = np.einsum("ij,ij->i", gap, gap) <= reach * reach
            if len(rest) < len(at):
                inside[0] = True
            members = rest[inside]
            if len(members) >= 8:
                self.children.append(Node(x, members, centre if len(rest) == len(at) else int(members[0])))
            else:
                own.append(members)
            if not inside.any():
                rest = rest.copy()
                own.append(rest[:1])
                rest = rest[1:]
            else:
                rest = rest[~inside]
        self.points = np.concatenate(own) if own else np.empty(0, np.int64)


def cover_tree(x: np.ndarray) -> Node:
    middle = x.mean(axis=0)
    gap = x - middle
    return Node(x, np.arange(len(x)), int(np.argmin(np.einsum("ij,ij->i", gap, gap))))


class Search:
    """Top k of every query over one data block; ties go to the smaller id."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
        self.q, self.q_ids, self.x, self.x_ids, self.k = q, q_ids, x, x_ids, k
        self.best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
        self.worst = np.full(len(q_ids), -np.inf)

    def run(self) -> None:
        self.pair(cover_tree(self.q), cover_tree(self.x))

    def bound(self, a: Node, b: Node) -> float:
        most = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return most + 1e-9 * abs(most) + 1e-6

    def pair(self, a: Node, b: Node) -> None:
        if self.bound(a, b) < self.worst[a.all].min():
            return
        if len(b.points):
            self.compare(a.all, b.points)
        for child in sorted(b.children, key=lambda c: -self.bound(a, c)):
            if a.children and a.radius > child.radius:
                for part in a.children:
                    self.pair(part, child)
                if len(a.points):
                    self.single(a.points, child)
            else:
                self.pair(a, child)

    def single(self, rows: np.ndarray, b: Node) -> None:
        """Queries without a node of their own: each is a ball of radius 0."""
        dots = self.q[rows] @ b.centre
        most = dots + b.radius * np.sqrt(np.einsum("ij,ij->i", self.q[rows], self.q[rows]))
        rows = rows[most + 1e-9 * np.abs(most) + 1e-6 >= self.worst[rows]]
        if not len(rows):
            return
        if len(b.points):
            self.compare(rows, b.points)
        for child in b.children:
            self.single(rows, child)

    def compare(self, rows: np.ndarray, points: np.ndarray) -> None:
        score = self.q[rows] @ self.x[points].T
        ids = self.x_ids[points]
        for i, row in zip(rows.tolist(), score):
            good = np.flatnonzero((row >= self.worst[i]) & (ids != self.q_ids[i]))
            if not len(good):
                continue
            if len(good) > 4 * self.k:
                # Rows below the k-th of these cannot win; ties with it stay.
                limit = np.partition(row[good], len(good) - self.k)[len(good) - self.k]
                good = good[row[good] >= limit]
            merged = self.best[i] + [(-s, v) for s, v in zip(row[good].tolist(), ids[good].tolist())]
            merged.sort()
            self.best[i] = merged[:self.k]
            if len(self.best[i]) == self.k:
                self.worst[i] = -self.best[i][-1][0]


def top_in_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best per query. Vectors are integers; scores
    are exact, and saturate at the limits of 64 bits."""
    largest = max(int(np.abs(q.astype(object)).max(initial=0)), 1) * max(int(np.abs(x.astype(object)).max(initial=0)), 1) * max(1, q.shape[1])
    if largest < 1 << 53:
        search = Search(q.astype(float), q_ids, x.astype(float), x_ids, k)
        search.run()
        return [(int(i), v, int(-s)) for i, found in zip(q_ids, search.best) for s, v in found]
    out = []
    for i, row in zip(q_ids.tolist(), q.astype(object)):
        score = [max(-LONGEST - 1, min(LONGEST, int(s))) for s in x.astype(object) @ row]
        found = sorted((-s, v) for s, v in zip(score, x_ids.tolist()) if v != i)[:k]
        out += [(i, v, -s) for s, v in found]
    return out


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def top_k(queries: DataFrame, data: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 1024.0, query_rows: int = 4096, data_rows: int = 4096) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k best candidates per query.

    Components become floor(scale * x). Candidates are all rows of ``data`` with
    another id than the query's. Rows with a NULL id or an unusable vector take
    no part; only vectors of equal dimension are compared. Repeated query rows
    count once; repeated data rows are candidates as often as they occur.
    """
    spark = data.sparkSession
    ship(spark)

    def whole(df: DataFrame) -> DataFrame:
        vector = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(F.lit(float(scale)) * v))
        kept = df.where(usable(F.col(vector_col).cast("array<double>")) & F.col(id_col).isNotNull())
        return cut_lineage(kept.select(F.col(id_col).cast("bigint").alias("_id"), vector.alias("_v"), F.size(vector_col).alias("_dim")))

    q, x = whole(queries.dropDuplicates([id_col])), whole(data)
    n_q, n_x = max(1, -(-q.count() // query_rows)), max(1, -(-x.count() // data_rows))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("_id"), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            # Sorted, so that a re-run task meets the rows in the same order.
            left, right = left.sort_values("_id"), right.sort_values("_id")
            rows = top_in_block(np.stack(left["_v"].to_list()).astype(np.int64), left["_id"].to_numpy(),
                                np.stack(right["_v"].to_list()).astype(np.int64), right["_id"].to_numpy(), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    keys = ["_dim", "_qb", "_xb"]
    found = dealt(q, "_qb", n_q, "_xb", n_x).groupBy(*keys).cogroup(dealt(x, "_xb", n_x, "_qb", n_q).groupBy(*keys)).applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows per query and data block
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
