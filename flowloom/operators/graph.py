"""Host graphs per window: nodes, edges, labels.

The flows are aggregated once, to (window, source, destination, port); edges
and features all come from that reduced table. No step groups raw flows by
host, so a host that takes part in a third of all flows is spread over its
peers and ports.

Restricting flows to the selected hosts happens in one of two places. If the
selected hosts are few (their number is checked), they are broadcast and the
flows are filtered while they are scanned, before any shuffle. Otherwise the
aggregated table is joined with them, which moves reduced rows only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import fixed
from flowloom.config import GraphConfig, WindowConfig
from flowloom.functions.ordered import small_side, top_per_group
from flowloom.functions.scalars import entropy_bits, protocol_flags
from flowloom.operators.windows import (
    WIN, assign_windows, drop_background, endpoints, host_activity, large_enough,
    number_windows, window_sizes,
)
from flowloom.session import cut_lineage

PAIR = [*WIN, "src_ip", "dst_ip"]
NODE = [*WIN, "ip"]
# A broadcast host row takes about 100 bytes: 50 MB at most per executor.
BROADCAST_NODES = 500_000
_SUMS = ["n_flows", "bytes_fwd", "bytes_bwd", "packets", "duration", "n_duration", "iat", "n_iat", "n_bot"]


def port_table(windowed: DataFrame) -> DataFrame:
    """Partial sums per (window, source, destination, destination port)."""
    known = ", ".join(f"'{p}'" for p in fixed.PROTOCOLS)
    per_protocol = []
    for p in fixed.PROTOCOLS:
        mine = f"protocol NOT IN ({known}) OR protocol IS NULL OR protocol = 'other'" if p == "other" else f"protocol = '{p}'"
        per_protocol += [f"count_if({mine}) AS n_{p}", f"min(flow_id) FILTER (WHERE {mine}) AS first_{p}"]
    return windowed.groupBy(*PAIR, "dst_port").agg(*map(F.expr, [
        "count(*) AS n_flows",
        "sum(bytes_fwd) AS bytes_fwd", "sum(bytes_bwd) AS bytes_bwd", "sum(pkts_fwd + pkts_bwd) AS packets",
        "sum(duration_s) AS duration", "count(duration_s) AS n_duration",
        "sum(mean_iat_ms) AS iat", "count(mean_iat_ms) AS n_iat",
        "count_if(label = 'bot') AS n_bot",
        *per_protocol,
    ]))


def pair_table(ports: DataFrame) -> DataFrame:
    """Roll the port table up to one row per (window, source, destination)."""
    sums = [*_SUMS, *[f"n_{p}" for p in fixed.PROTOCOLS]]
    # Node positions depend on the pair alone; they ride along if present.
    idx = [c for c in ("src_idx", "dst_idx") if c in ports.columns]
    return ports.groupBy(*PAIR).agg(*map(F.expr, [
        *[f"sum({c}) AS {c}" for c in sums],
        "count(dst_port) AS distinct_dst_ports",
        *[f"min(first_{p}) AS first_{p}" for p in fixed.PROTOCOLS],
        *[f"max({c}) AS {c}" for c in idx],
    ]))


def source_ports(windowed: DataFrame) -> DataFrame:
    """Distinct source ports per pair, in two levels so that a busy pair is
    counted on many tasks."""
    return (
        windowed.select(*PAIR, "src_port").distinct()
        .groupBy(*PAIR).agg(F.count("src_port").alias("distinct_src_ports"))
    )


def dominant_protocol() -> Column:
    """Most frequent protocol of a pair; the one seen first wins a tie."""
    ranked = ", ".join(f"struct(n_{p} AS n, -first_{p} AS first, '{p}' AS name)" for p in fixed.PROTOCOLS)
    return F.expr(f"array_max(array({ranked})).name")


def select_nodes(activity: DataFrame, win_cfg: WindowConfig | None = None,
                 cfg: GraphConfig | None = None) -> DataFrame:
    """Active hosts (see ``host_activity``) of the windows that are large enough, at most ``max_nodes``
    per window, numbered by address."""
    cfg = cfg or GraphConfig()
    # A counted side is joined without a shuffle, so the limit below runs
    # before the rows of a window meet in one task.
    kept = small_side(large_enough(window_sizes(activity), win_cfg).select(*WIN))
    eligible = activity.where(F.col("activity") >= cfg.min_flows_per_node).join(kept, WIN, "left_semi")
    busiest = top_per_group(eligible, WIN, [F.desc("activity"), F.asc("ip")], cfg.max_nodes)
    by_name = Window.partitionBy(*WIN).orderBy("ip")
    return busiest.withColumn("node_idx", (F.row_number().over(by_name) - 1).cast("int"))


def restrict_to_nodes(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose two endpoints are both nodes of their window."""
    for end in ("src_ip", "dst_ip"):
        side = nodes.select(*WIN, F.col("ip").alias(end))
        flows = flows.join(side, [*WIN, end], "left_semi")
    return flows


def with_node_index(table: DataFrame, nodes: DataFrame, split_hot: bool = False) -> DataFrame:
    """Inner-join both endpoints to their node position; drops other rows.

    With ``split_hot`` an endpoint with a large share of the rows is no single
    task of the join, also if the nodes are too many to broadcast.
    """
    for end, idx in (("src_ip", "src_idx"), ("dst_ip", "dst_idx")):
        side = nodes.select(*WIN, F.col("ip").alias(end), F.col("node_idx").alias(idx))
        table = join_splitting_hot(cut_lineage(table), side, [*WIN, end]) if split_hot else table.join(side, [*WIN, end])
    return table


def join_splitting_hot(table: DataFrame, side: DataFrame, keys: list[str], parts: int = 1000) -> DataFrame:
    """Inner join with a side that has one row per key, whatever key holds most of ``table``.

    Keys with more than one row in ``parts`` are fewer than ``parts``, so their
    rows of ``side`` are broadcast and the table's rows stay where they are. No
    key of the shuffled rest has a larger share. ``table`` is read three times;
    keep or write it before. NULL keys match nothing and are not shuffled.
    """
    known = table.dropna(subset=keys)
    counts = known.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * parts > F.col("_all")).select(*keys)
    marked = known.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    few = side.join(F.broadcast(hot), keys, "left_semi")
    spread = marked.where("_hot").drop("_hot").join(F.broadcast(few), keys)
    rest = marked.where("_hot IS NULL").drop("_hot").join(side, keys)
    return spread.unionByName(rest)


def edge_features(pairs: DataFrame) -> DataFrame:
    """The ten edge features from pair sums with both port counts."""
    top = dominant_protocol()
    return (
        pairs.withColumn("dominant_protocol", top)
        .withColumns({
            "total_bytes": (F.col("bytes_fwd") + F.col("bytes_bwd")).cast("double"),
            "total_packets": F.col("packets").cast("double"),
            "distinct_dst_ports": F.col("distinct_dst_ports").cast("double"),
            "distinct_src_ports": F.col("distinct_src_ports").cast("double"),
            "mean_flow_duration": F.col("duration") / F.col("n_duration"),
            "mean_iat_ms": F.when(F.col("n_iat") > 0, F.col("iat") / F.col("n_iat")).otherwise(0.0),
        })
        .withColumns({f"proto_{p}": c for p, c in zip(
            fixed.PROTOCOLS, protocol_flags(F.col("dominant_protocol")))})
    )


def compute_edges(windowed: DataFrame, nodes: DataFrame) -> DataFrame:
    """One directed edge per (source, destination) of a window."""
    return edge_table(pair_table(with_node_index(port_table(windowed), nodes)), windowed)


def edge_table(pairs: DataFrame, windowed: DataFrame) -> DataFrame:
    """Edges from the pairs among nodes; source ports come from the flows."""
    both = pairs.join(source_ports(windowed), PAIR)
    return edge_features(both).select(*PAIR, "src_idx", "dst_idx", *fixed.EDGE_FEATURES)


def port_entropy(ports: DataFrame) -> DataFrame:
    """Entropy in bits of the destination ports each source contacts."""
    counts = ports.where("dst_port IS NOT NULL").groupBy(*WIN, "src_ip", "dst_port").agg(F.sum("n_flows").alias("c"))
    total, weighted = F.sum("c"), F.sum(F.col("c") * F.log2(F.col("c").cast("double")))
    return counts.groupBy(*WIN, F.col("src_ip").alias("ip")).agg(
        F.greatest(F.log2(total.cast("double")) - weighted / total, F.lit(0.0)).alias("port_entropy"))


def role_sums(pairs: DataFrame) -> DataFrame:
    """Outgoing and incoming sums of every host in one pass over the pairs."""
    both = pairs.withColumn("_r", F.expr(
        "explode(array(struct(true AS out, src_ip AS ip), struct(false AS out, dst_ip AS ip)))"))
    return both.groupBy(*WIN, F.col("_r.ip").alias("ip")).agg(*map(F.expr, [
        "count_if(_r.out) AS fan_out", "count_if(NOT _r.out) AS fan_in",
        "coalesce(sum(n_flows) FILTER (WHERE _r.out), 0) AS flows_out",
        "coalesce(sum(n_flows) FILTER (WHERE NOT _r.out), 0) AS flows_in",
        "sum(duration) FILTER (WHERE _r.out) / nullif(sum(n_duration) FILTER (WHERE _r.out), 0) AS mean_out",
        "sum(duration) FILTER (WHERE NOT _r.out) / nullif(sum(n_duration) FILTER (WHERE NOT _r.out), 0) AS mean_in",
        "sum(if(_r.out, bytes_fwd, bytes_bwd)) AS sent", "sum(if(_r.out, bytes_bwd, bytes_fwd)) AS received",
        "sum(packets) AS packets", "sum(n_bot) AS bot_flows", "sum(n_flows) AS all_flows",
        *[f"coalesce(sum(n_{p}) FILTER (WHERE _r.out), 0) AS n_{p}" for p in fixed.PROTOCOLS],
    ]))


def labelled_nodes(nodes: DataFrame, pairs: DataFrame, cfg: GraphConfig | None = None) -> DataFrame:
    """Nodes with their role sums (NULL without a flow) and the label ``y``."""
    cfg = cfg or GraphConfig()
    if cfg.label_rule == "majority":
        label = F.col("bot_flows") * 2 > F.col("all_flows")
    else:
        label = F.col("bot_flows") > 0
    return nodes.join(role_sums(pairs), NODE, "left").withColumn("y", F.coalesce(label.cast("int"), F.lit(0)))


def node_features(labelled: DataFrame, ports: DataFrame, window_s: float) -> DataFrame:
    """Nine features of every node, from the flows among nodes.

    A node without a remaining flow keeps zeros. Durations and flow counts use
    the outgoing flows and fall back to incoming ones only if there are none.
    """
    win = max(float(window_s), fixed.RATIO_EPS)
    volume = F.col("sent") + F.col("received")
    has_out = F.col("flows_out") > 0
    features = {
        "fan_out": F.col("fan_out").cast("double"),
        "fan_in": F.col("fan_in").cast("double"),
        "port_entropy": F.col("port_entropy"),
        "byte_rate": volume / F.lit(win),
        "packet_rate": F.col("packets") / F.lit(win),
        "protocol_entropy": entropy_bits([F.col(f"n_{p}") for p in fixed.PROTOCOLS]),
        "out_in_ratio": F.when(volume > 0, F.col("sent") / (volume + F.lit(fixed.RATIO_EPS))).otherwise(0.0),
        "avg_flow_duration": F.when(has_out, F.col("mean_out")).otherwise(F.col("mean_in")),
        "log1p_total_flows": F.log1p(F.when(has_out, F.col("flows_out")).otherwise(F.col("flows_in")).cast("double")),
    }
    return labelled.join(port_entropy(ports), NODE, "left").select(
        *NODE, "node_idx",
        *[F.coalesce(features[f], F.lit(0.0)).alias(f) for f in fixed.NODE_FEATURES], "y")


def compute_node_features(windowed: DataFrame, nodes: DataFrame, window_s: float,
                          cfg: GraphConfig | None = None) -> DataFrame:
    """Features and label of given nodes."""
    ports = with_node_index(port_table(windowed), nodes)
    return node_features(labelled_nodes(nodes, pair_table(ports), cfg), ports, window_s)


def graph_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per built graph: size, label and dense number in time order."""
    per_node = nodes.groupBy(*WIN).agg(
        F.count("*").alias("n_nodes"), F.sum("y").alias("n_bot_nodes"), F.max("y").alias("graph_y"))
    per_edge = edges.groupBy(*WIN).agg(F.count("*").alias("n_edges"))
    graphs = per_node.join(per_edge, WIN, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("bigint")))
    return number_windows(graphs)


@dataclass
class GraphTables:
    """Node, edge and graph tables, for example read back from a store."""

    nodes: DataFrame
    edges: DataFrame
    graphs: DataFrame


class GraphBuild:
    """A graph build over one flow table; each result is planned on first use.

    ``share=True`` keeps the reduced tables that all results use in executor
    storage (spilling to disk, recomputed if lost); use it when more
    than one result is written, and call :meth:`release` afterwards. The host
    activity then comes from the port table, else from a narrow scan of its
    own. ``only`` restricts the build to some windows (one row each).
    """

    def __init__(self, flows: DataFrame, win_cfg: WindowConfig | None = None, cfg: GraphConfig | None = None,
                 keep_background: bool = False, share: bool = False, broadcast_nodes: int = BROADCAST_NODES,
                 only: DataFrame | None = None):
        self.win_cfg, self.cfg, self._share = win_cfg or WindowConfig(), cfg or GraphConfig(), share
        self._broadcast_nodes = broadcast_nodes
        self.windowed = assign_windows(flows if keep_background else drop_background(flows), self.win_cfg)
        if only is not None:
            self.windowed = self.windowed.join(only, WIN, "left_semi")

    def _keep(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self._share else df

    @cached_property
    def selected(self) -> DataFrame:
        return self._keep(select_nodes(host_activity(self.windowed), self.win_cfg, self.cfg))

    @cached_property
    def _few_nodes(self) -> bool:
        return self._share and self.selected.count() <= self._broadcast_nodes

    @cached_property
    def candidates(self) -> DataFrame:
        """Windowed flows; only those among nodes if these are few."""
        if self._few_nodes:
            return restrict_to_nodes(self.windowed, F.broadcast(self.selected))
        return self.windowed

    @cached_property
    def kept_ports(self) -> DataFrame:
        if self._few_nodes:
            return self._keep(with_node_index(port_table(self.candidates), F.broadcast(self.selected)))
        return self._keep(with_node_index(port_table(self.candidates), self.selected, split_hot=self._share))

    @cached_property
    def pairs(self) -> DataFrame:
        return pair_table(self.kept_ports)

    @cached_property
    def labelled(self) -> DataFrame:
        return labelled_nodes(self.selected, self.pairs, self.cfg)

    @cached_property
    def nodes(self) -> DataFrame:
        return node_features(self.labelled, self.kept_ports, self.win_cfg.window_s)

    @cached_property
    def edges(self) -> DataFrame:
        return edge_table(self.pairs, self.candidates)

    @cached_property
    def graphs(self) -> DataFrame:
        # Sizes and labels need neither features nor source ports.
        return self._keep(graph_table(self.labelled, self.pairs))

    def release(self) -> None:
        for name in ("graphs", "kept_ports", "selected"):
            if self._share and name in self.__dict__:
                getattr(self, name).unpersist()


def build_graphs(flows: DataFrame, win_cfg: WindowConfig | None = None, cfg: GraphConfig | None = None,
                 keep_background: bool = False, share: bool = False) -> GraphBuild:
    """Flows -> node, edge and graph tables."""
    return GraphBuild(flows, win_cfg, cfg, keep_background, share)


def with_window_idx(table: DataFrame, graphs: DataFrame) -> DataFrame:
    """Attach the dense graph number to a node, edge or sequence table."""
    return table.join(graphs.select(*WIN, "window_idx"), WIN)


def graph_summary(graphs: DataFrame) -> DataFrame:
    return graphs.select("scenario", "window_idx", F.col("n_nodes").alias("num_nodes"),
                         F.col("n_edges").alias("num_edges"), "n_bot_nodes",
                         F.col("graph_y").alias("graph_label"))


def build_summary(flows: DataFrame, graphs: DataFrame, sizes: DataFrame,
                  win_cfg: WindowConfig | None = None, keep_background: bool = False) -> DataFrame:
    """Per-scenario totals of a build.

    ``flows_used`` counts the flows that entered windowing;
    ``flows_in_sized_windows`` only those in windows with enough flows.
    """
    win_cfg = win_cfg or WindowConfig()
    used = F.lit(True) if keep_background else F.col("label").isin("bot", "benign")
    totals = flows.groupBy("scenario").agg(
        F.count("*").alias("flows_in"), F.count(F.when(used, 1)).alias("flows_used"))
    sized = sizes.where(F.col("n_flows") >= win_cfg.min_flows).groupBy("scenario").agg(
        F.sum("n_flows").alias("flows_in_sized_windows"))
    built = graphs.groupBy("scenario").agg(
        F.count("*").alias("graphs"), F.sum("graph_y").alias("bot_graphs"),
        F.sum("n_bot_nodes").alias("total_bot_nodes"))
    zero = F.lit(0).cast("bigint")
    counts = ["flows_in_sized_windows", "graphs", "bot_graphs", "total_bot_nodes"]
    joined = reduce(lambda a, b: a.join(b, "scenario", "left"), (sized, built), totals)
    return joined.select("scenario", "flows_in", "flows_used",
                         *[F.coalesce(F.col(c).cast("bigint"), zero).alias(c) for c in counts])
