"""Time-ordered, capped flow sequences of every node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import fixed
from flowloom.config import SequenceConfig, WindowConfig
from flowloom.functions.ordered import running, top_per_group
from flowloom.functions.scalars import log1p_or_zero, micros, protocol_flags
from flowloom.operators.windows import WIN

NODE = [*WIN, "ip"]
_TIME = ["start_time", "flow_id"]


def touching(windowed: DataFrame) -> DataFrame:
    """Every flow once per host it touches (once for a self-flow), as ``ip``."""
    return windowed.withColumn("ip", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))))


def focal_flows(windowed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every flow of a node, whatever its peer."""
    return touching(windowed).join(nodes.select(*NODE, "node_idx"), NODE)


def flow_features(window_s: float) -> list[Column]:
    """The thirteen per-flow features, seen from the host in column ``ip``."""
    win_us = max(float(window_s), 1e-9) * 1_000_000
    since = (micros(F.col("start_time")) - micros(F.col("window_start"))) / F.lit(win_us)
    features = [
        *protocol_flags(F.col("protocol")),
        (F.col("src_ip") == F.col("ip")).cast("double"),
        log1p_or_zero(F.col("duration_s")),
        F.log1p((F.col("bytes_fwd") + F.col("bytes_bwd")).cast("double")),
        F.log1p((F.col("pkts_fwd") + F.col("pkts_bwd")).cast("double")),
        log1p_or_zero(F.col("mean_iat_ms")),
        F.isnotnull("mean_iat_ms").cast("double"),
        log1p_or_zero(F.col("max_pkt_size")),
        F.isnotnull("max_pkt_size").cast("double"),
        F.least(F.greatest(since, F.lit(0.0)), F.lit(1.0)),
    ]
    return [c.alias(name) for c, name in zip(features, fixed.FLOW_FEATURES)]


def evenly_picked(rank0: Column, n: Column, m: int) -> Column:
    """Is 0-based ``rank0`` among ``m`` evenly spaced picks of ``n`` rows?

    Pick k is ``k * (n-1)/(m-1)`` rounded half to even, ends included. Only the
    picks next to the row's own position can hit it.
    """
    if m == 1:
        return (rank0 == 0) | (n <= 1)
    step = F.greatest(n - 1, F.lit(1)) / F.lit(float(m - 1))
    near = F.rint(rank0 / step)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        k = near + d
        pick = F.when(k == m - 1, (n - 1).cast("double")).otherwise(F.rint(k * step))
        hit = hit | ((k >= 0) & (k <= m - 1) & (pick == rank0))
    return (n <= m) | hit


def sample_sequences(rows: DataFrame, cfg: SequenceConfig, spread: bool = True, by: Column | None = None) -> DataFrame:
    """At most ``max_flows`` rows per host.

    Hash sample (by a hash of flow, seed and host, or by the given column): the
    first rows per host in hash order, pruned before the shuffle. Even picks:
    rank and size of a host come from one ordered pass, so a host with a third
    of all flows is cut over many tasks.
    """
    m = cfg.max_flows
    if not cfg.even:
        h = F.xxhash64("flow_id", F.lit(cfg.seed), "ip") if by is None else by
        return top_per_group(rows, NODE, [h, F.col("flow_id")], m, spread)

    ranked = running(rows, NODE, [F.col(c) for c in _TIME], {"_p": ("position", None), "_n": ("total", F.lit(1))}, spread=spread)
    return ranked.where(evenly_picked(F.col("_p") - 1, F.col("_n"), m)).drop("_p", "_n")


def build_sequences(windowed: DataFrame, nodes: DataFrame, win_cfg: WindowConfig | None = None,
                    cfg: SequenceConfig | None = None, spread: bool = True,
                    by: Column | None = None, few_nodes: bool = False) -> DataFrame:
    """Long sequence table: one row per node and position, oldest flow first.

    The cap is applied before the join with the nodes, so that the join never
    meets more than ``max_flows`` rows per host. With ``few_nodes`` (the caller
    has counted them) they are broadcast instead and drop most flows while
    these are scanned.
    """
    win_cfg, cfg = win_cfg or WindowConfig(), cfg or SequenceConfig()
    wanted = nodes.select(*NODE, "node_idx")
    rows = touching(windowed)
    if few_nodes:
        rows = rows.join(F.broadcast(wanted), NODE)
    index = ["node_idx"] if few_nodes else []
    kept = sample_sequences(
        rows.select(*NODE, *index, *_TIME, *flow_features(win_cfg.window_s)), cfg, spread, by)
    if not few_nodes:
        kept = kept.join(wanted, NODE)
    # At most max_flows rows per node are left here.
    w = Window.partitionBy(*NODE).orderBy(*_TIME)
    return kept.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).select(
        *NODE, "node_idx", "pos", "flow_id", *fixed.FLOW_FEATURES)


def as_arrays(sequences: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per node with the ordered array ``flows``; empty without flows."""
    item = F.struct("pos", *fixed.FLOW_FEATURES)
    arrays = sequences.groupBy(*NODE).agg(F.sort_array(F.collect_list(item)).alias("flows"))
    return (
        nodes.select(*NODE, "node_idx").join(arrays, NODE, "left")
        .withColumn("flows", F.coalesce("flows", F.array().cast(arrays.schema["flows"].dataType)))
    )


def sequence_lengths(sequences: DataFrame, nodes: DataFrame) -> DataFrame:
    """Number of real flows per node, 0 for nodes without any."""
    n = sequences.groupBy(*NODE).agg(F.count("*").alias("seq_len"))
    return nodes.join(n, NODE, "left").withColumn("seq_len", F.coalesce("seq_len", F.lit(0).cast("bigint")))


def unmatched_nodes(nodes: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side that has them."""
    a, b = nodes.select(*keys).distinct(), stored.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("only_in", F.lit("nodes")).unionByName(
        b.join(a, keys, "left_anti").withColumn("only_in", F.lit("stored")))


def attach(nodes: DataFrame, stored: DataFrame, keys: list[str] = NODE, check: bool = True) -> DataFrame:
    """Join stored per-node data to nodes; both must list the same nodes.

    A mismatch is an error, never a silent zero-fill. It is raised by the join
    itself, which keeps both sides, when a row is met that one of them lacks; so
    planning runs no job and the sides are read once. Without ``check`` the
    common nodes are returned.
    """
    extra = [c for c in stored.columns if c in keys or c not in nodes.columns]
    if not check:
        return nodes.join(stored.select(*extra), keys)
    both = nodes.withColumn("_in_nodes", F.lit(1)).join(stored.select(*extra).withColumn("_in_stored", F.lit(1)), keys, "full")
    where = F.when(F.col("_in_nodes").isNull(), "stored").otherwise("nodes")
    message = F.concat(F.lit("stored rows and nodes differ, for example only in "), where, F.lit(": "), F.to_json(F.struct(*keys)))
    matched = F.col("_in_nodes").isNotNull() & F.col("_in_stored").isNotNull()
    # Every column carries the test, so none of them can be read without it.
    tested = [F.when(matched, F.col(c)).otherwise(F.raise_error(message).cast(both.schema[c].dataType)).alias(c)
              for c in both.columns if c not in ("_in_nodes", "_in_stored")]
    return both.select(*tested)
