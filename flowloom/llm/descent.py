"""Near-duplicate embeddings by NN-descent.

A neighbour graph over distinct vectors starts from small random-hyperplane
buckets and is refined: the neighbours (forward and reverse) of every node are
compared with each other, and each keeps its best K. A neighbour of a neighbour
is likely a neighbour, so few rounds suffice. The number of start tables follows
the chance that a pair at the threshold shares a bucket, so pairs without other
neighbours meet at any size. An audit compares some nodes with all others;
while too many of their links cross components, other tables are added, lists
doubled and refined again.

Edges at or above the threshold stay. A list full of such edges is saturated:
it may hide more of them. All links of a node lie in its component, so the
lists of a component's nodes are enlarged to the whole component, compared
tile by tile; only counts leave a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm.common import components, cut_lineage, release, ship
from flowloom.llm.topk import usable

SEED = 7
BUCKET = 64
BATCH = 4
PIVOT = 32
TILE = 512
EDGES = "a bigint, b bigint, sim float"


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def _best(ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> pd.DataFrame:
    """Directed edges of each row to its k most similar other rows (above its floor)."""
    sim = (x @ x.T).astype(np.float32)
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    if k <= 0:
        return pd.DataFrame({"a": ids[:0], "b": ids[:0], "sim": sim[:0, 0]})
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    a = np.repeat(np.arange(len(ids)), k)
    b = top.reshape(-1)
    s = sim[a, b]
    if floor is not None:
        better = s > floor[a]
        a, b, s = a[better], b[better], s[better]
    return pd.DataFrame({"a": ids[a], "b": ids[b], "sim": s})


def _keep_best(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of every node."""
    distinct = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return distinct.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _bits(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n / BUCKET)))))


def table_count(n: int, threshold: float, target: float) -> int:
    """Tables in which a pair at ``threshold`` shares a bucket at least once with
    a chance halfway between ``target`` and 1; it shares a sign with 1 - angle / pi."""
    meet = (1 - np.arccos(min(1.0, max(-1.0, threshold))) / np.pi) ** _bits(n)
    return BATCH if meet >= 1 else max(BATCH, int(np.ceil(np.log((1 - target) / 2) / np.log1p(-meet))))


def start_graph(nodes: DataFrame, n: int, k: int, tables: int = BATCH, first: int = 0) -> DataFrame:
    """Edges of the tables from ``first`` on: the best neighbours inside buckets of about BUCKET nodes.

    Buckets come from the signs of random projections, their number from ``n``;
    a bucket with more nodes is cut by a hash, so no group grows with a cluster.
    A few tables are laid out at a time.
    """
    graph = None
    for at in range(first, first + tables, BATCH):
        new, placed = _bucket_edges(nodes, _bits(n), k, range(at, min(at + BATCH, first + tables)))
        kept = cut_lineage(_keep_best(new if graph is None else graph.unionByName(new), k))
        release(placed, *([] if graph is None else [graph]))
        graph = kept
    return graph


def _bucket_edges(nodes: DataFrame, bits: int, k: int, tables: range) -> tuple[DataFrame, DataFrame]:

    def place(frames):
        for pdf in frames:
            for dim, part in pdf.groupby("_dim"):
                x = np.stack([np.frombuffer(w, np.float32) for w in part["_w"]])
                for t in tables:
                    planes = np.random.default_rng([SEED, t, int(dim)]).standard_normal((int(dim), bits))
                    code = ((x @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    yield pd.DataFrame({"node": part["node"], "_w": part["_w"], "_dim": part["_dim"], "_t": t, "_code": code})

    placed = nodes.select("node", "_w", "_dim").mapInPandas(place, "node bigint, _w binary, _dim int, _t int, _code bigint")
    placed = cut_lineage(placed)
    keys = ["_dim", "_t", "_code"]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_size"))
    cut = placed.join(sizes, keys).withColumn("_cut", F.pmod(F.xxhash64("node", "_t"), F.ceil(F.col("_size") / (2 * BUCKET))).cast("int"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        return _best(pdf["node"].to_numpy(), np.stack([np.frombuffer(w, np.float32) for w in pdf["_w"]]), k)

    return cut.groupBy(*keys, "_cut").applyInPandas(inside, EDGES), placed


def refine(graph: DataFrame, nodes: DataFrame, n: int, k: int, salt: int = 0) -> DataFrame:
    """One round: compare the neighbours of every node with each other.

    Forward and reverse neighbours of a node are its pivot group. A node that is
    in very many lists has its group cut by a hash into parts of about PIVOT, so
    no group is large; another ``salt`` in each round cuts it elsewhere.
    """
    both = graph.select(F.col("a").alias("pivot"), F.col("b").alias("node")).unionByName(
        graph.select(F.col("b").alias("pivot"), F.col("a").alias("node"))).distinct()
    sizes = both.groupBy("pivot").agg(F.count("*").alias("_size"))
    floors = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).cast("float").alias("_floor"))
    members = (
        both.join(sizes, "pivot").withColumn("_cut", F.pmod(F.xxhash64("node", "pivot", F.lit(salt)), F.ceil(F.col("_size") / PIVOT)).cast("int")).drop("_size")
        .join(nodes.select("node", F.col("_w")), "node").join(floors.withColumnRenamed("a", "node"), "node", "left"))
    tasks = max(1, -(-n * 2 * k // 100_000))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pivot groups of a bucket; groups of one size are compared at once."""
        pdf = pdf.sort_values(["pivot", "_cut", "node"], kind="stable", ignore_index=True)
        group = pdf["pivot"].to_numpy() * 1_000_003 + pdf["_cut"].to_numpy()
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(pdf)])
        ids, floor = pdf["node"].to_numpy(), pdf["_floor"].fillna(-2.0).to_numpy(np.float32)
        width = len(pdf["_w"].iloc[0]) // 4
        out = []
        lengths = pdf["_w"].map(len).to_numpy() // 4
        for s in np.unique(size):
            if s < 2:
                continue
            for at in np.array_split(start[size == s], max(1, int((size == s).sum() * s * s // 2_000_000))):
                rows = at[:, None] + np.arange(s)
                for dim in np.unique(lengths[at]):
                    part = rows[lengths[at] == dim]
                    x = np.frombuffer(b"".join(pdf["_w"].to_numpy()[part.reshape(-1)]), np.float32).reshape(len(part), s, dim)
                    sim = x @ x.transpose(0, 2, 1)
                    sim[:, np.arange(s), np.arange(s)] = -2
                    g, i, j = np.nonzero(sim > floor[part][:, :, None])
                    a, b, v = ids[part[g, i]], ids[part[g, j]], sim[g, i, j]
                    out.append(pd.DataFrame({"a": a, "b": b, "sim": v}))
        if not out:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "sim": floor[:0]})
        found = pd.concat(out)
        # Only the best k of this bucket can enter a list.
        found = found.drop_duplicates(["a", "b"]).sort_values(["a", "sim"], ascending=[True, False])
        return found[found.groupby("a").cumcount() < k]

    found = members.withColumn("_task", F.pmod(F.xxhash64("pivot", "_cut"), F.lit(tasks)).cast("int")).groupBy("_task").applyInPandas(local, EDGES)
    return _keep_best(graph.unionByName(found), k)


def true_links(nodes: DataFrame, threshold: float, sample: int = 2048, piece: int = 1024, most: int = 4) -> DataFrame:
    """True links ``a``, ``b`` of ``sample`` nodes (taken by hash), by comparing them with all
    nodes in a scan. At most ``most`` of a node enter from a piece of the table, so
    pairs without other neighbours count and a cluster does not outweigh them."""
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "_v", "_dim").toPandas()

    def compare(frames):
        for whole in frames:
            for at in range(0, len(whole), piece):
                for dim, part in whole.iloc[at:at + piece].groupby("_dim"):
                    mine = chosen[chosen["_dim"] == dim]
                    if len(mine):
                        i, j = np.nonzero(_matrix(mine["_v"]) @ _matrix(part["_v"]).T >= threshold)
                        a, b = mine["node"].to_numpy()[i], part["node"].to_numpy()[j]
                        found = pd.DataFrame({"a": a[a != b], "b": b[a != b]})
                        yield found[found.groupby("a").cumcount() < most]

    return cut_lineage(nodes.select("node", "_v", "_dim").mapInPandas(compare, "a bigint, b bigint"))


def audit(groups: DataFrame, true: DataFrame) -> float:
    """Share of the ``true`` links with both ends in one component, whose links are
    all counted; 1 if there are none."""
    total = true.count()
    if not total:
        return 1.0
    ends = true.join(groups.select(F.col("node").alias("a"), F.col("component").alias("_ca")), "a").join(
        groups.select(F.col("node").alias("b"), F.col("component").alias("_cb")), "b")
    return ends.where("_ca = _cb").count() / total


def link_counts(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``node`` and ``links``: vectors linked to it, those of its own class left out.

    ``groups`` has ``node`` and ``component`` of the nodes with an edge. Small
    components share tasks; larger ones are cut into tiles.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("_size"))
    rows = cut_lineage(groups.join(sizes, "component").join(nodes, "node").select("node", "component", "_size", "_v", "_n", "_dim"))
    shared = max(1, -(-rows.where(F.col("_size") <= TILE).count() // (2 * TILE)))
    parts = F.ceil(F.col("_size") / TILE).cast("int")
    mine = F.when(F.col("_size") <= TILE, 0).otherwise(F.pmod(F.xxhash64("node"), parts)).cast("int")
    task = F.when(F.col("_size") <= TILE, F.pmod(F.xxhash64("component"), F.lit(shared))).otherwise(F.col("component"))
    laid = rows.withColumns({"_parts": parts, "_mine": mine, "_key": task, "_big": F.col("_size") > TILE})
    laid = laid.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    laid = laid.withColumns({"_i": F.least("_mine", "_other"), "_j": F.greatest("_mine", "_other")})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        out = []
        for _, part in pdf.groupby("_dim"):
            x, weight = _matrix(part["_v"]), part["_n"].to_numpy()
            side, where, node = part["_mine"].to_numpy(), part["component"].to_numpy(), part["node"].to_numpy()
            left, right = (side == i), (side == j)
            close = (x[left] @ x[right].T >= threshold) & (where[left][:, None] == where[right][None, :])
            close &= node[left][:, None] != node[right][None, :]
            out.append(pd.DataFrame({"node": node[left], "links": close @ weight[right]}))
            if i != j:
                out.append(pd.DataFrame({"node": node[right], "links": close.T @ weight[left]}))
        return pd.concat(out)

    counted = laid.groupBy("_big", "_key", "_i", "_j").applyInPandas(count, "node bigint, links bigint")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, neighbours: int = 10, rounds: int = 3, target: float = 0.98,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows with a NULL id or with a vector that is NULL, empty, zero or not
    finite link with nothing: no links, their own component, kept. Equal
    vectors are one node of the graph and count as often as they occur; vectors
    of different dimension never link. An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("_id"), v.alias("_raw"))
    # Squares of small components would vanish; a vector is zero if all of them are.
    good = rows.where(F.col("_id").isNotNull() & usable(F.col("_raw"))).where(F.exists("_raw", lambda x: F.abs(x) > 0))
    classes = good.groupBy("_raw").agg(F.min("_id").alias("node"), F.count("*").alias("_n"))

    def unit(frames):
        for pdf in frames:
            x = [np.asarray(r, np.float64) for r in pdf["_raw"]]
            x = [r / np.abs(r).max() for r in x]
            x = [r / np.sqrt(r @ r) for r in x]
            yield pd.DataFrame({"node": pdf["node"], "_n": pdf["_n"], "_dim": [len(r) for r in x], "_v": [r.tobytes() for r in x],
                                "_w": [r.astype(np.float32).tobytes() for r in x]})

    nodes = cut_lineage(classes.mapInPandas(unit, "node bigint, _n bigint, _dim int, _v binary, _w binary"))
    n, k = nodes.count(), neighbours
    tables = table_count(n, threshold, target)
    graph = start_graph(nodes, n, k, tables)
    salt = 0
    for salt in range(rounds):
        graph = cut_lineage(refine(graph, nodes, n, k, salt))

    def exact(frames):
        for pdf in frames:
            keep = [np.frombuffer(x) @ np.frombuffer(y) >= threshold for x, y in zip(pdf["_va"], pdf["_vb"])]
            yield pdf.loc[keep, ["a", "b"]]

    def grouped() -> DataFrame:
        # Edges near the threshold are decided in double precision.
        close = graph.where(F.col("sim") >= threshold - 1e-4).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = close.join(nodes.select(F.col("node").alias("a"), F.col("_v").alias("_va")), "a").join(
            nodes.select(F.col("node").alias("b"), F.col("_v").alias("_vb")), "b")
        edges = cut_lineage(pairs.select("a", "b", "_va", "_vb").mapInPandas(exact, "a bigint, b bigint"))
        return cut_lineage(components(edges, "a", "b"))

    true, groups, used = true_links(nodes, threshold), grouped(), tables
    # Each turn gives every pair new tables, so the audit passes in the end.
    while audit(groups, true) < target:
        k, salt = min(2 * k, max(n - 1, 1)), salt + 1
        more = start_graph(nodes, n, k, tables, used)
        used += tables
        graph = cut_lineage(refine(_keep_best(graph.unionByName(more), k), nodes, n, k, salt))
        groups = grouped()
    release(true)
    links = link_counts(nodes, groups, threshold)
    by_node = nodes.select("node", "_n").join(groups, "node", "left").join(links, "node", "left")
    placed = good.join(classes.select("_raw", "node"), "_raw").select("_id", "node").join(by_node, "node").select(
        "_id", (F.coalesce("links", F.lit(0)) + F.col("_n") - 1).alias("_links"), F.coalesce("component", "node").alias("_component"))
    # A repeated id has one place for each of its vectors; the first counts.
    placed = placed.groupBy("_id").agg(F.min("_component").alias("_component"), F.max("_links").alias("_links"))
    component = F.coalesce("_component", "_id")
    return rows.select("_id").join(placed, "_id", "left").select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
