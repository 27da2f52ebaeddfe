"""Operators on node and edge tables: neighbour sums, pooling, perturbation.

Tables are keyed by graph (``scenario, window_start`` or other ``keys``); nodes
carry ``node_idx``, edges ``src_idx, dst_idx``. A graph has at most
``max_nodes`` nodes, so windows inside one graph are small; sums over edges are
partial aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import fixed
from flowloom.functions.scalars import hash_unit
from flowloom.operators.windows import WIN
from flowloom.session import cut_lineage

KEYS = tuple(WIN)


def _end(nodes: DataFrame, keys: Sequence[str], idx: str, cols: dict[str, str]) -> DataFrame:
    return nodes.select(*keys, F.col("node_idx").alias(idx), *[F.col(c).alias(n) for n, c in cols.items()])


def with_source_values(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with the values of their source node as ``src_<column>``."""
    side = _end(nodes, keys, "src_idx", {f"src_{c}": c for c in columns})
    return edges.join(side, [*keys, "src_idx"])


def neighbour_classes(nodes: DataFrame, edges: DataFrame, classes: Sequence[int] = (0, 1), label: str = "y",
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """In-degree (at least 1) and the share of each class among in-neighbours."""
    e = with_source_values(edges, nodes, [label], keys)
    agg = e.groupBy(*keys, F.col("dst_idx").alias("node_idx")).agg(
        F.count("*").alias("_deg"), *[F.count(F.when(F.col(f"src_{label}") == c, 1)).alias(f"_n{c}") for c in classes])
    deg = F.greatest(F.coalesce("_deg", F.lit(0)), F.lit(1)).cast("bigint")
    return nodes.join(agg, [*keys, "node_idx"], "left").withColumns({
        "in_degree": deg,
        **{f"share_{c}": F.coalesce(f"_n{c}", F.lit(0)) / deg for c in classes},
    }).drop("_deg", *[f"_n{c}" for c in classes])


def class_prior(nodes: DataFrame, label: str = "y") -> tuple[float, float]:
    """Global frequencies of the two classes."""
    r = nodes.agg(F.avg((F.col(label) == 0).cast("double")), F.avg((F.col(label) == 1).cast("double"))).first()
    return r[0], r[1]


def topology_margin(shares: DataFrame, prior: tuple[float, float], alpha: float = fixed.MARGIN_ALPHA,
                    scale_by_class: bool = True, beta: float = fixed.MARGIN_BETA,
                    logits: tuple[str, str] = ("logit0", "logit1")) -> DataFrame:
    """Logits moved against the class that is over-represented nearby.

    ``shares`` comes from :func:`neighbour_classes`. With ``scale_by_class``
    the move is larger for the globally rarer class.
    """
    inverse = [1.0 / max(p, 1e-6) for p in prior]
    mean = sum(inverse) / len(inverse)
    out = {}
    for c in (0, 1):
        margin = -alpha * (F.col(f"share_{c}") - F.lit(prior[c]))
        if scale_by_class:
            margin = margin * F.lit(1.0 + beta * (inverse[c] / mean - 1.0))
        out[f"adjusted{c}"] = F.col(logits[c]) + margin
    return shares.withColumns(out)


def neighbourhood_sum(nodes: DataFrame, edges: DataFrame, columns: Sequence[str], edge_column: str | None = None,
                      eps: float = 0.0, hops: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(1 + eps) * x + sum of relu(x_source + e)`` over incoming edges.

    Each hop is one join and one partial aggregate. With more than one hop both
    tables are written first, so that no hop derives them anew; between hops
    the node table is checkpointed so that the plan does not grow with the hop
    count.
    """
    current = nodes
    if hops > 1:
        current, edges = cut_lineage(nodes), cut_lineage(
            edges.select(*keys, "src_idx", "dst_idx", *([edge_column] if edge_column else [])))
    for hop in range(hops):
        if hop:
            current = cut_lineage(current)
        e = with_source_values(edges, current, columns, keys)
        extra = F.col(edge_column) if edge_column else F.lit(0.0)
        sums = e.groupBy(*keys, F.col("dst_idx").alias("node_idx")).agg(*[
            F.sum(F.greatest(F.col(f"src_{c}") + extra, F.lit(0.0))).alias(f"_in_{c}") for c in columns])
        current = current.join(sums, [*keys, "node_idx"], "left").withColumns({
            c: (1.0 + eps) * F.col(c) + F.coalesce(f"_in_{c}", F.lit(0.0)) for c in columns
        }).drop(*[f"_in_{c}" for c in columns])
    return current


# --- readout and pooling --------------------------------------------------

def readout(nodes: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and maximum of node values per graph."""
    return nodes.groupBy(*keys).agg(*[
        f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("max", F.max)) for c in columns])


def readout_vectors(nodes: DataFrame, vector: str = "emb", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and maximum per graph and vector position, as a long table."""
    dims = nodes.select(*keys, F.posexplode(vector).alias("dim", "v"))
    return dims.groupBy(*keys, "dim").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))


def summary_to_nodes(nodes: DataFrame, summary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Give every node the summary row of its graph."""
    return nodes.join(summary, list(keys))


def top_ratio(nodes: DataFrame, score: str, ratio: float = fixed.POOL_RATIO, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep the ``ceil(ratio * n)`` best nodes of each graph, best first.

    ``pool_idx`` renumbers the survivors; equal scores go by node position.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc("node_idx"))
    n = F.count("*").over(Window.partitionBy(*keys))
    return (
        nodes.withColumns({"pool_idx": (F.row_number().over(w) - 1).cast("int"), "_n": n})
        .where(F.col("pool_idx") < F.ceil(F.lit(ratio) * F.col("_n"))).drop("_n"))


def induced_edges(edges: DataFrame, survivors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges between survivors, with both ends renumbered."""
    for end in ("src_idx", "dst_idx"):
        side = survivors.select(*keys, F.col("node_idx").alias(end), F.col("pool_idx").alias(f"_{end}"))
        edges = edges.join(side, [*keys, end])
    return edges.drop("src_idx", "dst_idx").withColumnsRenamed({"_src_idx": "src_idx", "_dst_idx": "dst_idx"})


def pool_survival(nodes: DataFrame, survivors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How many positives and negatives survive pooling, with the prediction
    outcome of each graph (``nodes`` has ``y`` and ``y_pred``)."""
    kept = survivors.select(*keys, "node_idx", F.lit(1).alias("_kept"))
    y, p, k = F.col("y") == 1, F.col("y_pred") == 1, F.col("_kept").isNotNull()

    def n(cond):
        return F.count(F.when(cond, 1))

    g = nodes.join(kept, [*keys, "node_idx"], "left").groupBy(*keys).agg(
        F.count("*").alias("n"), n(y).alias("n_pos"), n(k).alias("n_kept"), n(k & y).alias("n_pos_kept"),
        n(y & p).alias("pred_tp"), n(y & ~p).alias("pred_fn"), n(~y & p).alias("pred_fp"))
    return g.withColumns({
        "bot_keep_rate": F.col("n_pos_kept") / F.greatest("n_pos", F.lit(1)),
        "benign_keep_rate": (F.col("n_kept") - F.col("n_pos_kept")) / F.greatest(F.col("n") - F.col("n_pos"), F.lit(1)),
    })


# --- soft clusters --------------------------------------------------------

def soft_assignment(logits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Softmax of ``logit`` over the clusters of a node; long table
    ``(keys, node_idx, cluster, s)``."""
    w = Window.partitionBy(*keys, "node_idx")
    e = F.exp(F.col("logit") - F.max("logit").over(w))
    return logits.withColumn("_e", e).withColumn("s", F.col("_e") / F.sum("_e").over(w)).drop("_e", "logit")


def coarsen_values(assign: DataFrame, nodes: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Cluster values: sum over nodes of ``s * x``."""
    j = assign.join(nodes.select(*keys, "node_idx", *columns), [*keys, "node_idx"])
    return j.groupBy(*keys, "cluster").agg(*[F.sum(F.col("s") * F.col(c)).alias(c) for c in columns])


def coarsen_edges(assign: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cluster adjacency: sum over edges of ``s_source * s_target``.

    The first join is summed per (source cluster, target node) before the
    second, which keeps the row count at edges times clusters.
    """
    src = assign.select(*keys, F.col("node_idx").alias("src_idx"), F.col("cluster").alias("src_cluster"), F.col("s").alias("_s"))
    half = edges.select(*keys, "src_idx", "dst_idx").join(src, [*keys, "src_idx"]).groupBy(
        *keys, "dst_idx", "src_cluster").agg(F.sum("_s").alias("_w"))
    dst = assign.select(*keys, F.col("node_idx").alias("dst_idx"), F.col("cluster").alias("dst_cluster"), F.col("s").alias("_t"))
    return half.join(dst, [*keys, "dst_idx"]).groupBy(*keys, "src_cluster", "dst_cluster").agg(
        F.sum(F.col("_w") * F.col("_t")).alias("weight"))


def cluster_mean(clusters: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return clusters.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def project_back(assign: DataFrame, clusters: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Node values from clusters: sum over clusters of ``s * x``."""
    return assign.join(clusters, [*keys, "cluster"]).groupBy(*keys, "node_idx").agg(*[
        F.sum(F.col("s") * F.col(c)).alias(c) for c in columns])


# --- perturbation and augmentation ----------------------------------------

def edge_hash(seed: int = fixed.SEED, keys: Sequence[str] = KEYS) -> Column:
    return hash_unit(*keys, F.col("src_idx"), F.col("dst_idx"), seed=seed)


def drop_edges(edges: DataFrame, rate: float | Column, unit: Column | None = None) -> DataFrame:
    """Keep an edge when its repeatable uniform number is at least ``rate``."""
    unit = edge_hash() if unit is None else unit
    return edges.where(unit >= rate)


def drop_edges_at(edges: DataFrame, rates: Sequence[float] = tuple(fixed.EDGE_DROP_RATES), unit: Column | None = None) -> DataFrame:
    """The edge set at every drop rate, tagged with ``rate``."""
    each = edges.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return drop_edges(each, F.col("rate"), unit)


def robustness(nodes: DataFrame, edges: DataFrame, score: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame],
               rates: Sequence[float] = tuple(fixed.EDGE_DROP_RATES), unit: Column | None = None,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Metrics of ``score(nodes, edges, keys)`` at every drop rate, with the F1
    change to the smallest rate. ``score`` returns ``y_true`` and ``y_pred``
    and keeps the keys."""
    from flowloom.operators.metrics import sweep

    at = nodes.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    kept = drop_edges_at(edges, rates, unit)
    return sweep(lambda n: score(n, kept, ["rate", *keys]), at, "rate")


def degree_robustness(nodes: DataFrame, edges: DataFrame, predict: Callable[[Column], Column],
                      rates: Sequence[float] = tuple(fixed.EDGE_DROP_RATES), unit: Column | None = None,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """:func:`robustness` of a score that depends on the in-degree, in one pass.

    An edge is there at every rate up to its uniform number, so the degrees at
    all rates are counts of one aggregation by node; neither edges nor nodes are
    copied per rate. The confusion counts of all rates are one further row.
    ``nodes`` has ``y``; ``predict`` turns a degree into 0 or 1.
    """
    from flowloom.operators.metrics import add_baseline, rates as with_rates

    unit = edge_hash() if unit is None else unit
    degrees = edges.groupBy(*keys, F.col("dst_idx").alias("node_idx")).agg(
        *[F.count_if(unit >= float(r)).alias(f"_d{i}") for i, r in enumerate(rates)])
    met = nodes.select(*keys, "node_idx", "y").join(degrees, [*keys, "node_idx"], "left")
    cells = []
    for i, r in enumerate(rates):
        p = predict(F.coalesce(F.col(f"_d{i}"), F.lit(0)))
        cell = lambda t, v: F.count_if((F.col("y") == t) & (p == v))
        cells.append(F.struct(F.lit(float(r)).alias("rate"), F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"),
                              cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")))
    return add_baseline(with_rates(met.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")), "rate")


def _uniforms(n: int, seed: int, keys: Sequence[str]) -> list[Column]:
    return [hash_unit(*keys, F.col("node_idx"), seed=seed + i) for i in range(n)]


def mix_positives(nodes: DataFrame, columns: Sequence[str] = (), vectors: Sequence[str] = (), beta: int = 1,
                  mix_prob: float = 1.0, max_share: float = 0.5, seed: int = fixed.SEED, label: str = "y",
                  shift: Column | None = None, lam: Column | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Interpolate each positive node with another positive of its graph.

    Partners are a per-graph shift of 1..n-1 positions. Graphs with fewer than
    two positives, or with more than ``max_share`` of them, stay as they are.
    The mixing weight is Beta(beta, beta): for whole ``beta`` the middle one of
    ``2*beta-1`` uniforms.
    """
    if int(beta) != beta or beta < 1:
        raise ValueError("beta must be a whole number >= 1")
    uniforms = _uniforms(2 * int(beta) - 1, seed + 1, keys)
    lam = F.array_sort(F.array(*uniforms))[int(beta) - 1] if lam is None else lam
    if mix_prob < 1.0:
        lam = F.when(hash_unit(*keys, F.col("node_idx"), seed=seed + 101) < mix_prob, lam).otherwise(1.0)
    per_graph = Window.partitionBy(*keys)
    is_pos = F.col(label) == 1
    n_pos, size = F.count(F.when(is_pos, 1)).over(per_graph), F.count("*").over(per_graph)
    sized = nodes.withColumns({"_n": n_pos, "_size": size})
    mixed = is_pos & (F.col("_n") >= 2) & (F.col("_n") / F.col("_size") <= max_share)
    shift = F.lit(1) + F.pmod(F.xxhash64(*keys, F.lit(seed)), F.col("_n") - 1) if shift is None else shift
    pos = sized.where(mixed).withColumn("_r", F.row_number().over(per_graph.orderBy("node_idx")) - 1)
    wanted = pos.select(*keys, "node_idx", F.pmod(F.col("_r") + shift, F.col("_n")).alias("_r"), lam.alias("_lam"))
    donor = pos.select(*keys, "_r", *[F.col(c).alias(f"_p_{c}") for c in (*columns, *vectors)])
    partner = wanted.join(donor, [*keys, "_r"]).drop("_r")
    joined = nodes.join(partner, [*keys, "node_idx"], "left")
    has = F.col("_lam").isNotNull()

    def blend(a, b):
        return F.col("_lam") * a + (1 - F.col("_lam")) * b

    new = {c: F.when(has, blend(F.col(c), F.col(f"_p_{c}"))).otherwise(F.col(c)) for c in columns}
    new |= {v: F.when(has, F.zip_with(v, f"_p_{v}", blend)).otherwise(F.col(v)) for v in vectors}
    return joined.withColumns(new).withColumn("mixed", has).drop("_lam", *[f"_p_{c}" for c in (*columns, *vectors)])


# --- masked sequences -----------------------------------------------------

def mask_positions(sequences: DataFrame, ratio: float = fixed.MASK_RATIO, unit: Column | None = None,
                   keys: Sequence[str] = (*WIN, "ip"), seed: int = fixed.SEED) -> DataFrame:
    """Mark about ``ratio`` of the real positions, at least the first one.

    A sequence has at most ``max_flows`` positions.
    """
    unit = hash_unit(*keys, F.col("pos"), seed=seed) if unit is None else unit
    picked = unit < ratio
    w = Window.partitionBy(*keys)
    none = F.max(F.col("_m").cast("int")).over(w) == 0
    first = F.col("pos") == F.min("pos").over(w)
    return sequences.withColumn("_m", picked).withColumn("masked", F.col("_m") | (none & first)).drop("_m")


def masked_error(sequences: DataFrame, pairs: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Mean squared error over masked rows; ``pairs`` maps value to reconstruction."""
    squared = [F.pow(F.col(r) - F.col(v), F.lit(2.0)) for v, r in pairs.items()]
    per_pos = sum(squared[1:], squared[0]) / len(squared)
    n = F.count(F.when(F.col("masked"), 1))
    return sequences.groupBy(*group).agg(
        n.alias("masked_rows"),
        F.coalesce(F.sum(F.when(F.col("masked"), per_pos)) / F.greatest(n, F.lit(1)), F.lit(0.0)).alias("mse"))
