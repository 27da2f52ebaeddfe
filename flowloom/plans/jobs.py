"""End-to-end jobs: raw logs -> flow table -> graph tables -> sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.config import GraphConfig, SequenceConfig, SplitSpec, WindowConfig
from flowloom.operators import profile
from flowloom.operators.graph import BROADCAST_NODES, build_graphs
from flowloom.operators.scaling import fit_edge_scaler, fit_feature_scaler
from flowloom.operators.sequences import build_sequences
from flowloom.operators.splits import assign_splits, load_split
from flowloom.operators.windows import assign_windows, drop_background
from flowloom.session import stages
from flowloom.sources import stores
from flowloom.sources.logs import parse_binetflow, parse_zeek

PARSERS = {"ctu13": parse_binetflow, "iot23": parse_zeek}


def parse_logs(spark: SparkSession, kind: str, path: str, out: str, scenario_id: str | None = None) -> DataFrame:
    """Parse every log of one kind below ``path`` into the flow store."""
    with stages(spark):
        stores.write_flows(PARSERS[kind](spark, path, scenario_id), out, in_slabs=True)
    return profile.label_totals(stores.read_flows(spark, out))


def graphs_job(spark: SparkSession, flow_path: str, out: str, win_cfg: WindowConfig | None = None,
               cfg: GraphConfig | None = None, keep_background: bool = False, skip_existing: bool = False) -> None:
    """Build and store the graphs of all scenarios in one job.

    There is no per-window read and no size switch: one scan, shuffled by
    window and pair, spills where memory ends.
    """
    flows = stores.read_flows(spark, flow_path)
    if skip_existing:
        flows = stores.not_yet_written(flows, f"{out}/graphs")
    tables = build_graphs(flows, win_cfg, cfg, keep_background, share=True)
    try:
        with stages(spark):
            stores.write_graphs(tables, out)
    finally:
        tables.release()


def sequences_job(spark: SparkSession, flow_path: str, graph_path: str, out: str, win_cfg: WindowConfig | None = None,
                  cfg: SequenceConfig | None = None, keep_background: bool = False, skip_existing: bool = False) -> None:
    """Build and store the sequences of the windows that have graphs."""
    flows = stores.read_flows(spark, flow_path)
    nodes = stores.read_graphs(spark, graph_path).nodes
    if skip_existing:
        nodes = stores.not_yet_written(nodes, out)
    windowed = assign_windows(flows if keep_background else drop_background(flows), win_cfg)
    few = nodes.count() <= BROADCAST_NODES
    with stages(spark):
        stores.write_sequences(build_sequences(windowed, nodes, win_cfg, cfg, few_nodes=few), out)


def scaled_split(spark: SparkSession, graph_path: str, spec: SplitSpec, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one split, standardised with training statistics."""
    tables = stores.read_graphs(spark, graph_path, spec.scenarios)
    assigned = assign_splits(tables.graphs, spec)
    node_scaler = fit_feature_scaler(load_split(assigned, "train", tables.nodes))
    edge_scaler = fit_edge_scaler(load_split(assigned, "train", tables.edges))
    return (node_scaler.apply(load_split(assigned, name, tables.nodes)),
            edge_scaler.apply(load_split(assigned, name, tables.edges)))
