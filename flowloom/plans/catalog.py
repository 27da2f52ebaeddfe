"""The registered queries: one or more per operator, each over whole tables.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE`` maps the
same name to SQL with the same columns where the result can be stated in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from flowloom import fixed
from flowloom.config import GraphConfig, SequenceConfig, SplitSpec, WindowConfig
from flowloom.functions import scalars as S
from flowloom.functions.ordered import exact_quantiles, running
from flowloom.operators import (
    graph as G, metrics as M, models, neighbourhood as N, packets as P, profile as R, reports,
    scaling, sequences as Q, splits, windows as W,
)
from flowloom.plans import views as V
from flowloom.plans.oracle import r, sql
from flowloom import schema
from flowloom.session import checkpoint_dir, cut_lineage
from flowloom.sources import incremental, logs, progress, stores
from flowloom.streaming import edges as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SPLIT = SplitSpec(train_scenarios=("sc-a",), holdout_test_scenarios=("sc-b",))
SEQ = SequenceConfig(max_flows=8)


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return fn
    return register


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles; window starts become epoch seconds, other times micros."""
    cols = []
    for name, kind in df.dtypes:
        if name == "window_start":
            cols.append(F.unix_seconds(name).alias("ws"))
        elif kind == "timestamp":
            cols.append(F.unix_micros(name).alias(name))
        elif kind in ("double", "float"):
            cols.append((F.round(F.col(name).cast("double"), 6) + 0.0).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def md5_unit(*parts) -> Column:
    """Uniform number from md5, which both engines compute alike."""
    text = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def windowed(spark, sf) -> DataFrame:
    return W.assign_windows(W.drop_background(V.flows(spark, sf)), V.WINDOWS)


def built(spark, sf, cfg: GraphConfig = V.GRAPHS) -> G.GraphBuild:
    return G.build_graphs(V.flows(spark, sf), V.WINDOWS, cfg)


def stored(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges written once, for queries that read them several times."""
    g = built(spark, sf)
    return cut_lineage(g.nodes), cut_lineage(g.edges)


def selected(spark, sf, cfg: GraphConfig = V.GRAPHS) -> DataFrame:
    return G.select_nodes(W.host_activity(windowed(spark, sf)), V.WINDOWS, cfg)


def rounded(cols: list[str], prefix: str = "") -> str:
    return ", ".join(r(prefix + c, c) for c in cols)


_E, _N = fixed.EDGE_FEATURES, fixed.NODE_FEATURES
_FLOW_OUT = ["flow_id", "scenario", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time", "end_time",
             "duration_s", "bytes_fwd", "bytes_bwd", "pkts_fwd", "pkts_bwd", "label", "detailed_label"]


# --- scans, sources, sinks -------------------------------------------------

_RAW_PORT = ("CASE flow_id % 4 WHEN 0 THEN src_port WHEN 1 THEN src_port WHEN 2 THEN 0 ELSE 65535 END")


def _binetflow_text(spark, sf, wall_us: Column | None = None) -> DataFrame:
    """Flows written as binetflow text columns: Prague wall time (of winter, or
    the given one), decimal, hex, empty and oversized ports, and rows without packets."""
    f = V.flows(spark, sf)
    wall_us = F.unix_micros("start_time") + 3_600_000_000 if wall_us is None else wall_us
    k = F.pmod(F.col("flow_id"), F.lit(4))
    port = F.col("src_port").cast("string")
    wall = F.date_format(F.timestamp_micros(wall_us), "yyyy/MM/dd HH:mm:ss.SSSSSS")
    tot = F.col("bytes_fwd") + F.col("bytes_bwd")
    return f.select(
        "flow_id", "scenario", wall.alias("StartTime"), F.col("duration_s").cast("string").alias("Dur"),
        F.upper("protocol").alias("Proto"), F.col("src_ip").alias("SrcAddr"),
        F.when(k == 0, port).when(k == 1, F.concat(F.lit("0x"), F.hex("src_port"))).when(k == 2, F.lit("")).otherwise("99999").alias("Sport"),
        F.lit("<->").alias("Dir"), F.col("dst_ip").alias("DstAddr"), F.col("dst_port").cast("string").alias("Dport"),
        F.lit("CON").alias("State"), F.lit("0").alias("sTos"), F.lit("0").alias("dTos"),
        F.when(k == 3, F.lit("0")).otherwise(F.col("pkts_fwd") + F.col("pkts_bwd")).cast("string").alias("TotPkts"),
        tot.cast("string").alias("TotBytes"), F.col("bytes_fwd").cast("string").alias("SrcBytes"),
        F.when(F.col("label") == "bot", "flow=From-Botnet-V52").when(F.col("label") == "benign", "flow=Normal-V52")
        .otherwise("flow=Background-x").alias("Label"),
        F.concat(F.lit("file:/raw/"), F.col("scenario"), F.lit("/x.binetflow")).alias("file_path"))


@query("binetflow_projection", f"""
SELECT CAST(row_number() OVER (PARTITION BY scenario ORDER BY us) - 1 AS BIGINT) AS flow_id,
       concat('ctu13-', scenario) AS scenario, src_ip, dst_ip, CAST({_RAW_PORT} AS INT) AS src_port, dst_port, protocol,
       us AS start_time, {r('duration_s')}, bytes_fwd, bytes_bwd, pf AS pkts_fwd, tp - pf AS pkts_bwd, label,
       CASE label WHEN 'bot' THEN 'flow=From-Botnet-V52' WHEN 'benign' THEN 'flow=Normal-V52' ELSE 'flow=Background-x' END AS detailed_label
FROM (SELECT *, pkts_fwd + pkts_bwd AS tp, CAST(round_even((pkts_fwd + pkts_bwd) *
        (CASE WHEN bytes_fwd + bytes_bwd > 0 THEN CAST(bytes_fwd AS DOUBLE) / (bytes_fwd + bytes_bwd) ELSE 0.5 END), 0) AS BIGINT) AS pf
      FROM flows WHERE flow_id % 4 <> 3)""")
def _(spark, sf):
    flows = logs.assign_flow_ids(logs.binetflow_to_flows(logs.binetflow_rows(_binetflow_text(spark, sf))))
    return tidy(flows.select(*[c for c in _FLOW_OUT if c != "end_time"]))


def _zeek_lines(spark, sf) -> DataFrame:
    """Flows written as Zeek connection lines, with comment lines and both
    null texts."""
    f = V.flows(spark, sf)
    us = F.unix_micros("start_time")
    ts = F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))
    label = F.when(F.col("label") == "bot", "Malicious").when(F.col("label") == "benign", "Benign").otherwise("-")
    detail = F.when(F.col("label") == "bot", "C&C").otherwise("-")
    no_bytes = F.pmod(F.col("flow_id"), F.lit(5)) == 0
    tab = F.lit("\t")
    fields = [
        ts, F.lit("C1"), F.col("src_ip"), F.col("src_port").cast("string"), F.col("dst_ip"), F.col("dst_port").cast("string"),
        F.col("protocol"), F.lit("-"), F.when(no_bytes, "-").otherwise(F.col("duration_s").cast("string")),
        F.when(no_bytes, "-").otherwise(F.col("bytes_fwd").cast("string")), F.col("bytes_bwd").cast("string"),
        F.lit("S0"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("(empty)"),
        F.when(F.pmod(F.col("flow_id"), F.lit(6)) == 1, 0).otherwise(F.col("pkts_fwd")).cast("string"), F.lit("40"),
        F.col("pkts_bwd").cast("string"), F.lit("40"),
        F.concat_ws("   ", F.lit("-"), label, detail)]
    line = F.concat_ws("\t", *fields)
    both = F.explode(F.array(line, F.lit("#separator")))
    return f.select("flow_id", "scenario", both.alias("value"), F.concat(F.lit("file:/raw/CTU-IoT-Malware-Capture-"), F.col("scenario"), F.lit("/bro/conn.log.labeled")).alias("file_path"))


_ZEEK_SQL = f"""
SELECT CAST(row_number() OVER (PARTITION BY scenario ORDER BY us) - 1 AS BIGINT) AS flow_id,
       concat('iot23-', scenario) AS scenario, src_ip, dst_ip, src_port, dst_port, protocol, us AS start_time,
       {r('CASE WHEN flow_id % 5 = 0 THEN 0.0 ELSE duration_s END', 'duration_s')},
       CASE WHEN flow_id % 5 = 0 THEN 0 ELSE bytes_fwd END AS bytes_fwd, bytes_bwd,
       CASE WHEN flow_id % 6 = 1 THEN 0 ELSE pkts_fwd END AS pkts_fwd, pkts_bwd, label,
       CASE WHEN label = 'bot' THEN 'C&C' ELSE '-' END AS detailed_label
FROM flows WHERE flow_id % 6 <> 1 OR pkts_bwd > 0"""


@query("zeek_projection", _ZEEK_SQL)
def _(spark, sf):
    flows = logs.assign_flow_ids(logs.zeek_to_flows(logs.zeek_rows(_zeek_lines(spark, sf))))
    return tidy(flows.select(*[c for c in _FLOW_OUT if c != "end_time"]))


@query("flow_store", f"""
SELECT flow_id, scenario, src_ip, dst_ip, us AS start_time, {r('duration_s')}, {r('mean_iat_ms')}, bytes_fwd, label FROM flows""")
def _(spark, sf):
    path = scratch(spark, "flows")
    stores.write_flows(V.flows(spark, sf), path)
    return tidy(stores.read_flows(spark, path).select(
        "flow_id", "scenario", "src_ip", "dst_ip", "start_time", "duration_s", "mean_iat_ms", "bytes_fwd", "label"))


@query("time_bounds", "SELECT scenario, min(us) AS t_min, max(us) AS t_max, count(*) AS rows FROM flows GROUP BY scenario")
def _(spark, sf):
    return tidy(W.time_bounds(V.flows(spark, sf)))


@query("window_starts", """
SELECT scenario, k AS window_no, b + k * 86400 AS ws
FROM (SELECT scenario, b, unnest(range(0, n + 1)) AS k
      FROM (SELECT scenario, min(us) // 86400000000 * 86400 AS b,
                   (max(us) - min(us) // 86400000000 * 86400000000) // 86400000000 AS n FROM flows GROUP BY scenario))""")
def _(spark, sf):
    return tidy(W.window_starts(W.time_bounds(V.flows(spark, sf)), V.WINDOWS))


@query("graph_store", "SELECT scenario, ws, window_idx, n_nodes, n_edges, n_bot_nodes, graph_y FROM graphs")
def _(spark, sf):
    root = scratch(spark, "graphs")
    tables = G.build_graphs(V.flows(spark, sf), V.WINDOWS, V.GRAPHS, share=True)
    stores.write_graphs(tables, root)
    tables.release()
    stored = stores.read_graphs(spark, root)
    n = stored.nodes.groupBy("scenario", "window_idx").agg(F.count("*").alias("n_nodes"), F.sum("y").alias("n_bot_nodes"))
    e = stored.edges.groupBy("scenario", "window_idx").agg(F.count("*").alias("n_edges"))
    keys = ["scenario", "window_idx"]
    return tidy(stored.graphs.select(*keys, "window_start", "graph_y").join(n, keys).join(e, keys, "left").fillna(0, ["n_edges"]))


@query("sequence_store", "SELECT scenario, ws, ip, count(*) AS seq_len FROM seq_hash GROUP BY scenario, ws, ip")
def _(spark, sf):
    path = scratch(spark, "sequences")
    nodes = selected(spark, sf)
    seqs = Q.build_sequences(windowed(spark, sf), nodes, V.WINDOWS, SEQ)
    stores.write_sequences(Q.as_arrays(seqs, nodes), path)
    joined = stores.attach_sequences(spark, nodes, path)
    return tidy(joined.select("scenario", "window_start", "ip", F.size("flows").cast("bigint").alias("seq_len")))


@query("embedding_store", f"""
SELECT vec_id AS node_idx, unnest(range(0, 64)) AS dim, {r('unnest(embedding)', 'v')} FROM embeddings""")
def _(spark, sf):
    path = scratch(spark, "embeddings")
    nodes = V.embeddings(spark, sf)
    keys = ["scenario", "window_idx", "ip"]
    stores.write_embeddings(nodes.select(*keys, "node_idx", "emb"), path, 64)
    joined = stores.attach_embeddings(nodes.drop("emb"), spark.read.parquet(path), keys)
    return tidy(joined.select("node_idx", F.posexplode("emb").alias("dim", "v")).withColumn("dim", F.col("dim").cast("bigint")))


@query("resume_skips_stored", "SELECT scenario, count(*) AS rows FROM flows WHERE scenario = 'sc-b' GROUP BY scenario")
def _(spark, sf):
    path, f = scratch(spark, "done"), V.flows(spark, sf)
    stores.write_flows(f.where("scenario = 'sc-a'"), path)
    return stores.not_yet_written(f, path).groupBy("scenario").agg(F.count("*").alias("rows"))


def _run_results(spark, sf) -> DataFrame:
    """One result document per value of ``run``, written and read back."""
    s, path = V.scored(spark, sf), scratch(spark, "results")
    pack = [F.col(f.name).cast(f.dataType).alias(f.name) for f in stores._METRICS]
    per_run = M.evaluate(s, ["run"]).select("run", F.struct(*pack).alias("test"))
    per_sc = M.evaluate(s, ["run", "scenario"]).groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct(
        "scenario", F.struct(*[F.col(c).cast("double").alias(c) for c in ("n", "n_pos", "f1", "pr_auc")])))).alias("test_per_scenario"))
    docs = per_run.join(per_sc, "run").select(
        F.concat(F.lit("run-"), F.col("run").cast("string")).alias("model"), "test", "test_per_scenario")
    docs.write.json(path)
    return spark.read.schema(stores.RESULT_SCHEMA).json(path).withColumn("tag", F.col("model"))


@query("run_results", f"SELECT concat('run-', run) AS tag, {r('f1')}, {r('precision')}, {r('recall')}, fn, fp, tp, tn FROM runs")
def _(spark, sf):
    return tidy(_run_results(spark, sf).select("tag", *[f"test.{c}" for c in ("f1", "precision", "recall", "fn", "fp", "tp", "tn")]))


@query("spot_check", """
SELECT src_ip, dst_ip, dst_port, protocol, bytes_fwd, bytes_bwd, detailed_label
FROM flows WHERE scenario = 'sc-b' AND label = 'bot' ORDER BY flow_id LIMIT 20""")
def _(spark, sf):
    return stores.spot_check(V.flows(spark, sf))


@query("metrics_sink", f"SELECT run, {r('f1')} FROM runs")
def _(spark, sf):
    path = scratch(spark, "metrics")
    stores.write_metrics(M.rates(M.confusion(V.scored(spark, sf), ["run"])).select("run", "f1"), path)
    return tidy(spark.read.schema("run int, f1 double").json(path))


# --- schema, predicates ----------------------------------------------------

@query("invalid_values", """
SELECT 'protocol' AS "column", event_type AS value, count(*) AS rows FROM events GROUP BY event_type
UNION ALL SELECT 'label', concat('u', user_id), count(*) FROM events GROUP BY user_id""")
def _(spark, sf):
    f = V.flows(spark, sf)
    return schema.invalid_values(f.withColumns({"protocol": F.col("detailed_label"), "label": F.col("src_ip")}))


@query("duplicate_flow_ids", """
SELECT scenario, flow_id, count(*) AS rows FROM (SELECT scenario, src_port AS flow_id FROM flows) GROUP BY scenario, flow_id HAVING count(*) > 1""")
def _(spark, sf):
    return schema.duplicate_ids(V.flows(spark, sf).withColumn("flow_id", F.col("src_port").cast("bigint")))


@query("coerced_flows", f"SELECT flow_id, src_port, bytes_fwd, {r('mean_iat_ms')} FROM flows")
def _(spark, sf):
    loose = V.flows(spark, sf).withColumns({
        "flow_id": F.col("flow_id").cast("string"), "src_port": F.col("src_port").cast("double"),
        "bytes_fwd": F.col("bytes_fwd").cast("decimal(20,0)"),
        "mean_iat_ms": F.coalesce("mean_iat_ms", F.lit(float("nan")))})
    return tidy(schema.coerce_to_schema(loose).select("flow_id", "src_port", "bytes_fwd", "mean_iat_ms"))


@query("drop_background", "SELECT scenario, label, count(*) AS rows FROM flows WHERE label IN ('bot', 'benign') GROUP BY scenario, label")
def _(spark, sf):
    return W.drop_background(V.flows(spark, sf)).groupBy("scenario", "label").agg(F.count("*").alias("rows"))


@query("time_range", f"""
SELECT flow_id, scenario, us AS start_time FROM flows WHERE us >= 1704844800000000 AND us < 1704931200000000""")
def _(spark, sf):
    f = W.in_time_range(V.flows(spark, sf), pd.Timestamp("2024-01-10", tz="UTC").to_pydatetime(), pd.Timestamp("2024-01-11", tz="UTC").to_pydatetime())
    return tidy(f.select("flow_id", "scenario", "start_time"))


@query("selected_peer_flows", "SELECT scenario, ws, flow_id FROM rf")
def _(spark, sf):
    return tidy(G.restrict_to_nodes(windowed(spark, sf), selected(spark, sf)).select("scenario", "window_start", "flow_id"))


@query("host_scan_counts", "SELECT CASE WHEN src = 'h7' THEN 'matched' ELSE 'skipped_other_src' END AS outcome, count(*) AS packets FROM packets GROUP BY 1")
def _(spark, sf):
    return P.scan_counts(V.packets(spark, sf), "h7")


@query("packet_cap", "SELECT file, count(*) AS packets, max(packet_no) AS last FROM packets WHERE packet_no < 500 GROUP BY file")
def _(spark, sf):
    return P.first_packets(V.packets(spark, sf), 500).groupBy("file").agg(F.count("*").alias("packets"), F.max("packet_no").alias("last"))


@query("large_windows", "SELECT scenario, ws, n_flows, n_hosts FROM sizes WHERE n_flows >= 150 AND n_hosts >= 60")
def _(spark, sf):
    sizes = W.window_sizes(W.host_activity(windowed(spark, sf)))
    return tidy(W.large_enough(sizes, WindowConfig(86400, None, 150, 60)))


@query("flows_of_large_windows", "SELECT k.scenario, k.ws, count(*) AS rows FROM kept k JOIN sizes USING (scenario, ws) WHERE n_flows >= 150 AND n_hosts >= 60 GROUP BY k.scenario, k.ws")
def _(spark, sf):
    kept = W.keep_large_windows(windowed(spark, sf), WindowConfig(86400, None, 150, 60))
    return tidy(kept.groupBy(*W.WIN).agg(F.count("*").alias("rows")))


# --- windows ---------------------------------------------------------------

@query("tumbling_windows", "SELECT scenario, ws, count(*) AS rows, min(flow_id) AS first_flow FROM kept GROUP BY scenario, ws")
def _(spark, sf):
    return tidy(windowed(spark, sf).groupBy(*W.WIN).agg(F.count("*").alias("rows"), F.min("flow_id").alias("first_flow")))


_SLIDE = """
SELECT scenario, (b + k * {stride}) // 1000000 AS ws, count(*) AS rows, min(flow_id) AS first_flow
FROM (SELECT f.scenario, flow_id, us, b, unnest(range(0, 800)) AS k
      FROM flows f JOIN (SELECT scenario, min(us) // {w} * {w} AS b FROM flows WHERE label <> 'background' GROUP BY scenario) USING (scenario)
      WHERE label <> 'background')
WHERE b + k * {stride} <= us AND us < b + k * {stride} + {w}
GROUP BY 1, 2"""


def _slide(spark, sf, stride):
    w = W.assign_windows(W.drop_background(V.flows(spark, sf)), WindowConfig(86400, stride))
    return tidy(w.groupBy(*W.WIN).agg(F.count("*").alias("rows"), F.min("flow_id").alias("first_flow")))


@query("sliding_windows", _SLIDE.format(stride=43200 * 10**6, w=86400 * 10**6))
def _(spark, sf):
    return _slide(spark, sf, 43200)


@query("uneven_stride_windows", _SLIDE.format(stride=50000 * 10**6, w=86400 * 10**6))
def _(spark, sf):
    return _slide(spark, sf, 50000)


@query("gapped_windows", _SLIDE.format(stride=200000 * 10**6, w=86400 * 10**6))
def _(spark, sf):
    return _slide(spark, sf, 200000)


@query("window_numbers", """
SELECT scenario, ws, CAST(row_number() OVER (PARTITION BY scenario ORDER BY ws) - 1 AS INT) AS window_idx FROM big""")
def _(spark, sf):
    sizes = W.window_sizes(W.host_activity(windowed(spark, sf)))
    return tidy(W.number_windows(W.large_enough(sizes, V.WINDOWS).select(*W.WIN)))


# --- graphs ----------------------------------------------------------------

@query("host_activity", "SELECT scenario, ws, ip, activity FROM act")
def _(spark, sf):
    return tidy(W.host_activity(windowed(spark, sf)))


@query("node_selection", "SELECT scenario, ws, ip, activity, node_idx FROM sel")
def _(spark, sf):
    return tidy(selected(spark, sf))


@query("node_selection_capped", "SELECT scenario, ws, ip, activity, node_idx FROM sel20")
def _(spark, sf):
    return tidy(selected(spark, sf, GraphConfig(3, 20)))


@query("edge_table", f"SELECT scenario, ws, src_ip, dst_ip, src_idx, dst_idx, {rounded(_E)} FROM edges")
def edge_table(spark, sf):
    return tidy(built(spark, sf).edges)


@query("edges_from_given_nodes", f"SELECT scenario, ws, src_ip, dst_ip, src_idx, dst_idx, {rounded(_E)} FROM edges")
def _(spark, sf):
    return tidy(G.compute_edges(windowed(spark, sf), selected(spark, sf)))


@query("dominant_protocol", "SELECT scenario, ws, src_ip, dst_ip, dominant FROM dom")
def _(spark, sf):
    kept = G.restrict_to_nodes(G.pair_table(G.port_table(windowed(spark, sf))), selected(spark, sf))
    return tidy(kept.select(*G.PAIR, G.dominant_protocol().alias("dominant")))


@query("node_features", f"SELECT scenario, ws, ip, node_idx, {rounded(_N)}, y FROM nodes")
def _(spark, sf):
    return tidy(built(spark, sf).nodes)


@query("node_labels_majority", """
SELECT s.scenario, s.ws, s.ip, CASE WHEN coalesce(bots, 0) * 2 > coalesce(n, 0) THEN 1 ELSE 0 END AS y
FROM sel s LEFT JOIN (
  SELECT scenario, ws, ip, count(*) AS n, count(*) FILTER (label = 'bot') AS bots
  FROM (SELECT scenario, ws, src_ip AS ip, label FROM rf UNION ALL SELECT scenario, ws, dst_ip, label FROM rf)
  GROUP BY scenario, ws, ip) USING (scenario, ws, ip)""")
def _(spark, sf):
    nodes = built(spark, sf, GraphConfig(3, 400, "majority")).nodes
    return tidy(nodes.select(*W.WIN, "ip", "y"))


@query("port_entropy", f"SELECT scenario, ws, ip, {r('greatest(h, 0.0)', 'port_entropy')} FROM pent")
def _(spark, sf):
    return tidy(G.port_entropy(G.restrict_to_nodes(G.port_table(windowed(spark, sf)), selected(spark, sf))))


@query("graph_table", "SELECT scenario, ws, window_idx, n_nodes, n_edges, n_bot_nodes, graph_y FROM graphs")
def _(spark, sf):
    return tidy(built(spark, sf).graphs)


@query("graph_summary", "SELECT scenario, window_idx, n_nodes AS num_nodes, n_edges AS num_edges, n_bot_nodes, graph_y AS graph_label FROM graphs")
def _(spark, sf):
    return G.graph_summary(built(spark, sf).graphs)


@query("build_summary", """
SELECT f.scenario, flows_in, flows_used, coalesce(sized, 0) AS flows_in_sized_windows, graphs, bot_graphs, total_bot_nodes
FROM (SELECT scenario, count(*) AS flows_in, count(*) FILTER (label <> 'background') AS flows_used FROM flows GROUP BY scenario) f
LEFT JOIN (SELECT scenario, CAST(sum(n_flows) AS BIGINT) AS sized FROM sizes WHERE n_flows >= 5 GROUP BY scenario) s USING (scenario)
LEFT JOIN (SELECT scenario, count(*) AS graphs, CAST(sum(graph_y) AS BIGINT) AS bot_graphs,
                  CAST(sum(n_bot_nodes) AS BIGINT) AS total_bot_nodes FROM graphs GROUP BY scenario) g USING (scenario)""")
def _(spark, sf):
    sizes = W.window_sizes(W.host_activity(windowed(spark, sf)))
    return G.build_summary(V.flows(spark, sf), built(spark, sf).graphs, sizes, V.WINDOWS)


# --- sequences -------------------------------------------------------------

_SEQ_COLS = f"scenario, ws, ip, node_idx, pos, flow_id, {rounded(fixed.FLOW_FEATURES)}"


@query("flow_features", f"SELECT {_SEQ_COLS} FROM seq_all")
def _(spark, sf):
    return tidy(Q.build_sequences(windowed(spark, sf), selected(spark, sf), V.WINDOWS, SequenceConfig(100_000)))


@query("sequences_even", f"SELECT {_SEQ_COLS} FROM seq_even")
def _(spark, sf):
    return tidy(Q.build_sequences(windowed(spark, sf), selected(spark, sf), V.WINDOWS, SequenceConfig(8, even=True)))


@query("sequences_hashed", f"SELECT {_SEQ_COLS} FROM seq_hash")
def _(spark, sf):
    by = F.md5(F.concat_ws("|", "flow_id", "ip"))
    return tidy(Q.build_sequences(windowed(spark, sf), selected(spark, sf), V.WINDOWS, SEQ, by=by))


@query("focal_flows", "SELECT scenario, ws, ip, flow_id FROM focal")
def _(spark, sf):
    return tidy(Q.focal_flows(windowed(spark, sf), selected(spark, sf)).select(*W.WIN, "ip", "flow_id"))


@query("sequence_lengths", "SELECT s.scenario, s.ws, s.ip, count(q.flow_id) AS seq_len FROM sel s LEFT JOIN seq_hash q USING (scenario, ws, ip) GROUP BY s.scenario, s.ws, s.ip")
def _(spark, sf):
    nodes = selected(spark, sf)
    seqs = Q.build_sequences(windowed(spark, sf), nodes, V.WINDOWS, SEQ)
    return tidy(Q.sequence_lengths(seqs, nodes).select(*W.WIN, "ip", "seq_len"))


@query("attach_sequences", f"SELECT scenario, ws, ip, node_idx, count(*) AS seq_len, {r('sum(log1p_total_bytes)', 'bytes_sum')} FROM seq_even GROUP BY scenario, ws, ip, node_idx")
def _(spark, sf):
    nodes = selected(spark, sf)
    arrays = Q.as_arrays(Q.build_sequences(windowed(spark, sf), nodes, V.WINDOWS, SequenceConfig(8, even=True)), nodes)
    joined = Q.attach(nodes, arrays)
    total = F.aggregate("flows", F.lit(0.0), lambda a, x: a + x["log1p_total_bytes"])
    return tidy(joined.select(*W.WIN, "ip", "node_idx", F.size("flows").cast("bigint").alias("seq_len"), total.alias("bytes_sum")))


@query("unmatched_nodes", "SELECT s.scenario, s.ws, s.ip, 'nodes' AS only_in FROM sel s LEFT JOIN sel20 USING (scenario, ws, ip) WHERE sel20.activity IS NULL")
def _(spark, sf):
    return tidy(Q.unmatched_nodes(selected(spark, sf), selected(spark, sf, GraphConfig(3, 20)), [*W.WIN, "ip"]))


# --- splits, scaling -------------------------------------------------------

def _assigned(spark, sf):
    g = built(spark, sf)
    return g, splits.assign_splits(g.graphs, SPLIT)


@query("split_assignment", "SELECT scenario, ws, window_idx, split FROM splits")
def _(spark, sf):
    return tidy(_assigned(spark, sf)[1].select("scenario", "window_start", "window_idx", "split"))


@query("split_summary", f"""
SELECT split, count(*) AS graphs, CAST(sum(n_nodes) AS BIGINT) AS nodes, CAST(sum(n_bot_nodes) AS BIGINT) AS bot_nodes,
       CAST(sum(graph_y) AS BIGINT) AS bot_graphs, {r('sum(n_bot_nodes) / sum(n_nodes)', 'bot_node_frac')} FROM splits GROUP BY split""")
def _(spark, sf):
    return tidy(splits.split_summary(_assigned(spark, sf)[1]))


@query("split_overlaps", "SELECT scenario, ws, count(DISTINCT split) AS splits FROM splits GROUP BY scenario, ws HAVING count(DISTINCT split) > 1")
def _(spark, sf):
    return tidy(splits.split_overlaps(_assigned(spark, sf)[1]))


def _stats_sql(cols, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg({c})', 'mean')}, {r(f'greatest(stddev_samp({c}), 1e-6)', 'std')} FROM {source}" for c in cols)


@query("node_scaler", _stats_sql(_N, "nodes JOIN splits USING (scenario, ws) WHERE split = 'train'"))
def _(spark, sf):
    g, a = _assigned(spark, sf)
    return tidy(scaling.scaler_stats(splits.load_split(a, "train", g.nodes), _N))


@query("edge_scaler", _stats_sql(_E, "edges JOIN splits USING (scenario, ws) WHERE split = 'train'"))
def _(spark, sf):
    g, a = _assigned(spark, sf)
    return tidy(scaling.scaler_stats(splits.load_split(a, "train", g.edges), _E))


_STD = ", ".join(r(f"({c} - (SELECT avg({c}) FROM tr)) / (SELECT greatest(stddev_samp({c}), 1e-6) FROM tr)", c) for c in _N)


@query("standardised_nodes", f"""
WITH tr AS (SELECT nodes.* FROM nodes JOIN splits USING (scenario, ws) WHERE split = 'train')
SELECT n.scenario, n.ws, n.ip, {_STD} FROM nodes n JOIN splits USING (scenario, ws) WHERE split = 'test'""")
def _(spark, sf):
    g, a = _assigned(spark, sf)
    nodes, a = cut_lineage(g.nodes), cut_lineage(a)
    scaler = scaling.fit_feature_scaler(splits.load_split(a, "train", nodes))
    return tidy(scaler.apply(splits.load_split(a, "test", nodes)).select(*W.WIN, "ip", *_N))


@query("class_weights", f"""
SELECT count(*) AS n, count(*) FILTER (y = 1) AS n_pos, {r('count(*) / (2.0 * (count(*) - count(*) FILTER (y = 1)))', 'w_neg')},
       {r('count(*) / (2.0 * count(*) FILTER (y = 1))', 'w_pos')},
       {r('count(*) FILTER (y = 0) / CAST(count(*) FILTER (y = 1) AS DOUBLE)', 'scale_pos_weight')} FROM nodes""")
def _(spark, sf):
    return tidy(scaling.class_weights(built(spark, sf).nodes))


# --- metrics ---------------------------------------------------------------

_CURVE = """
SELECT {g} proba, pos, neg, CAST(sum(pos) OVER (PARTITION BY {p} ORDER BY proba DESC) AS BIGINT) AS tp_cum,
       CAST(sum(neg) OVER (PARTITION BY {p} ORDER BY proba DESC) AS BIGINT) AS fp_cum
FROM (SELECT {g} proba, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM scored GROUP BY {g} proba)"""


@query("ranking_curve", f"WITH c AS ({_CURVE.format(g='scenario,', p='scenario')}) SELECT scenario, {r('proba')}, pos, neg, tp_cum, fp_cum FROM c")
def _(spark, sf):
    return tidy(M.ranking_curve(V.scored(spark, sf), ["scenario"]))


def _eval_sql(g: str, p: str, cols: str) -> str:
    on = f"USING ({g})" if g else "ON 1 = 1"
    gc, grp = (f"{g}," if g else ""), (f"GROUP BY {g}" if g else "")
    return f"""
WITH c AS ({_CURVE.format(g=gc, p=p)}),
a AS (SELECT {gc} sum(pos * tp_cum / CAST(tp_cum + fp_cum AS DOUBLE)) / sum(pos) AS pr_auc,
             sum(neg * (tp_cum - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc FROM c {grp}),
b AS (SELECT {gc} count(*) AS n, count(*) FILTER (y_true = 1) AS n_pos,
             count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
             count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM scored {grp})
SELECT {gc} {cols} FROM b JOIN a {on}"""


_F1 = r("2.0 * tp / (2 * tp + fp + fn)", "f1")


@query("evaluate_overall", _eval_sql("", "1", f"""n, n_pos, {r('(tp + tn) / CAST(n AS DOUBLE)', 'accuracy')}, {r('tp / CAST(tp + fp AS DOUBLE)', 'precision')},
       {r('tp / CAST(tp + fn AS DOUBLE)', 'recall')}, {_F1}, {r('pr_auc')}, {r('roc_auc')}, tn, fp, fn, tp"""))
def _(spark, sf):
    return tidy(M.evaluate(V.scored(spark, sf)))


def _missing(spark, sf) -> DataFrame:
    """Scored nodes of which run 2 has NULL and run 3 NaN scores."""
    s = V.scored(spark, sf).withColumn("proba", F.when(F.col("run") == 3, F.lit(float("nan"))).when(F.col("run") != 2, F.col("proba")))
    return s.withColumn("y_pred", S.at_threshold(F.col("proba"), 0.5))


@query("evaluate_missing_scores", _eval_sql("scenario", "scenario", f"n, n_pos, {_F1}, {r('pr_auc')}").replace("scored", "missing"))
def _(spark, sf):
    return tidy(M.evaluate_per_scenario(_missing(spark, sf)))


@query("evaluate_per_scenario", _eval_sql("scenario", "scenario", f"n, n_pos, {_F1}, {r('pr_auc')}"))
def _(spark, sf):
    return tidy(M.evaluate_per_scenario(V.scored(spark, sf)))


# Thresholds as running sums of the step, like the grid itself.
_GRID = "SELECT k, 0.05::DOUBLE + k * ((0.95::DOUBLE - 0.05::DOUBLE) / 90) AS t FROM (SELECT unnest(range(0, 91)) AS k)"


def _best_sql(g: str) -> str:
    gc, grp = (f"{g}," if g else ""), (f"GROUP BY {g}" if g else "")
    return f"""
WITH grid AS ({_GRID}),
m AS (SELECT {gc} k, t, CAST(sum(c) FILTER (y_true = 1 AND proba >= t) AS DOUBLE) AS tp, sum(c) FILTER (y_true = 0 AND proba >= t) AS fp,
             sum(c) FILTER (y_true = 1) AS pos
      FROM (SELECT {gc} proba, y_true, count(*) AS c FROM scored GROUP BY {gc} proba, y_true), grid GROUP BY {gc} k, t)
SELECT {gc} CAST(any_value(pos) AS BIGINT) AS n_pos, {r('arg_max(t, (round(2 * tp / (tp + coalesce(fp, 0) + pos), 12), -k))', 'threshold')},
       {r('max(2 * tp / (tp + coalesce(fp, 0) + pos))', 'f1')} FROM m WHERE tp > 0 {grp}"""


@query("best_threshold", _best_sql(""))
def _(spark, sf):
    return tidy(M.best_threshold(V.scored(spark, sf)))


@query("best_threshold_missing_scores", _best_sql("scenario").replace("scored", "missing"))
def _(spark, sf):
    return tidy(M.best_threshold(_missing(spark, sf), ["scenario"]))


@query("best_threshold_per_scenario", _best_sql("scenario"))
def _(spark, sf):
    return tidy(M.best_threshold(V.scored(spark, sf), ["scenario"]))


_STRATEGIES = f"""
WITH grid AS ({_GRID}), val AS (SELECT * FROM scored WHERE run <= 3), test AS (SELECT * FROM scored WHERE run > 3),
m AS (SELECT scenario, k, t, CAST(count(*) FILTER (y_true = 1 AND proba >= t) AS DOUBLE) AS tp,
             count(*) FILTER (y_true = 0 AND proba >= t) AS fp, count(*) FILTER (y_true = 1) AS pos
      FROM val, grid GROUP BY scenario, k, t),
gm AS (SELECT k, t, sum(tp) AS tp, sum(fp) AS fp, sum(pos) AS pos FROM m GROUP BY k, t),
gt AS (SELECT arg_max(t, (round(2 * tp / (tp + fp + pos), 12), -k)) AS t FROM gm WHERE tp > 0),
st AS (SELECT scenario, arg_max(t, (round(2 * tp / (tp + fp + pos), 12), -k)) AS t FROM m WHERE tp > 0 AND scenario <> 'F' GROUP BY scenario),
p AS (SELECT 'fixed' AS strategy, scenario, y_true, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS yp FROM test
      UNION ALL SELECT 'global', scenario, y_true, CASE WHEN proba >= t THEN 1 ELSE 0 END FROM test, gt
      UNION ALL SELECT 'per_scenario', test.scenario, y_true, CASE WHEN proba >= coalesce(st.t, gt.t) THEN 1 ELSE 0 END
                FROM test CROSS JOIN gt LEFT JOIN st ON test.scenario = st.scenario),
c AS (SELECT strategy, count(*) AS n, count(*) FILTER (y_true = 1) AS n_pos, count(*) FILTER (y_true = 1 AND yp = 1) AS tp,
             count(*) FILTER (y_true = 0 AND yp = 1) AS fp FROM p GROUP BY strategy)
SELECT strategy, n, n_pos, {r('tp / CAST(tp + fp AS DOUBLE)', 'precision')}, {r('tp / CAST(n_pos AS DOUBLE)', 'recall')},
       {r('2.0 * tp / (tp + fp + n_pos)', 'f1')} FROM c"""


@query("calibration_strategies", _STRATEGIES.replace(" AND scenario <> 'F'", ""))
def _(spark, sf):
    s = V.scored(spark, sf)
    return tidy(M.calibrate(s.where("run <= 3"), s.where("run > 3")))


@query("threshold_fallback", """
SELECT scenario, count(*) AS n, count(*) FILTER (proba >= CASE WHEN scenario = 'F' THEN 0.3 ELSE 0.7 END) AS predicted FROM scored GROUP BY scenario""")
def _(spark, sf):
    known = spark.createDataFrame([("F", 0.3)], "scenario string, threshold double")
    return M.apply_thresholds(V.scored(spark, sf), known, 0.7).groupBy("scenario").agg(
        F.count("*").alias("n"), F.sum("y_pred").alias("predicted"))


@query("before_after", f"""
WITH a AS (SELECT CAST(run AS STRING) AS scenario, f1 FROM runs WHERE run <= 5), b AS (SELECT CAST(run AS STRING) AS scenario, recall AS f1 FROM runs WHERE run >= 3)
SELECT scenario, {r('a.f1', 'f1_before')}, {r('b.f1', 'f1_after')}, {r('b.f1 - a.f1', 'delta')} FROM a FULL JOIN b USING (scenario)""")
def _(spark, sf):
    m = M.rates(M.confusion(V.scored(spark, sf), ["run"])).withColumn("scenario", F.col("run").cast("string"))
    return tidy(M.compare_scenarios(m.where("run <= 5"), m.where("run >= 3").select("scenario", F.col("recall").alias("f1"))))


# --- packets ---------------------------------------------------------------

_DIR = """SELECT file, conv, proto, CAST(coalesce(sum(size) FILTER (src = src_ip AND sport = src_port), 0) AS BIGINT) AS bytes_fwd,
       CAST(coalesce(sum(size) FILTER (NOT (src = src_ip AND sport = src_port)), 0) AS BIGINT) AS bytes_bwd,
       count(*) FILTER (src = src_ip AND sport = src_port) AS pkts_fwd,
       count(*) FILTER (NOT (src = src_ip AND sport = src_port)) AS pkts_bwd
FROM keyed k JOIN convs c USING (file, conv, proto) GROUP BY file, conv, proto"""


def _flows_sql(end: str, mean: str, std: str, extra: str = "") -> str:
    return f"""
WITH d AS ({_DIR}) {extra}
SELECT CAST(row_number() OVER (PARTITION BY c.file ORDER BY CAST(round_even(t_first * 1000000, 0) AS BIGINT), src_ip, src_port, dst_ip, dst_port,
         CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'other' END) - 1 AS BIGINT) AS flow_id,
       CASE WHEN c.file LIKE '%mirai%' THEN 'medbiot-mirai_mal_CC_all' ELSE 'medbiot-torii_leg' END AS scenario,
       src_ip, dst_ip, src_port, dst_port, CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'other' END AS protocol,
       CAST(round_even(t_first * 1000000, 0) AS BIGINT) AS start_time, CAST(round_even({end} * 1000000, 0) AS BIGINT) AS end_time,
       {r(f'{end} - t_first', 'duration_s')}, bytes_fwd, bytes_bwd, pkts_fwd, pkts_bwd,
       round(CAST({mean} AS DOUBLE), 3) AS mean_iat_ms, round(CAST({std} AS DOUBLE), 3) AS std_iat_ms,
       CAST(min_size AS DOUBLE) AS min_pkt_size, CAST(max_size AS DOUBLE) AS max_pkt_size,
       CASE WHEN c.file LIKE '%mirai%' THEN 'bot' ELSE 'benign' END AS label,
       CASE WHEN c.file LIKE '%mirai%' THEN 'mirai-mirai_mal_CC_all' ELSE 'torii-torii_leg' END AS detailed_label
FROM convs c JOIN d USING (file, conv, proto)"""


def _packet_flows(spark, sf, compat):
    f = P.packets_to_flows(V.packets(spark, sf), compat_first_ts=compat)
    iat = {c: F.round(c, 3) for c in ("mean_iat_ms", "std_iat_ms")}
    return tidy(f.withColumns(iat))


@query("packet_flows", _flows_sql("t_last", "mean_iat", "std_iat"))
def _(spark, sf):
    return _packet_flows(spark, sf, False)


@query("packet_flows_first_timestamp", _flows_sql("ts0", "g.m", "g.s", """,
q AS (SELECT k.*, c.ts0 FROM keyed k JOIN convs c USING (file, conv, proto) WHERE k.ts > c.ts0 OR k.packet_no = c.first_packet),
g AS (SELECT file, conv, proto, avg(gap) AS m, stddev_pop(gap) AS s FROM (
        SELECT *, (ts - lag(ts) OVER (PARTITION BY file, conv, proto ORDER BY packet_no)) * 1000 AS gap FROM q) GROUP BY file, conv, proto)
""").replace("USING (file, conv, proto)\n", "USING (file, conv, proto)\n") + " JOIN g USING (file, conv, proto)")
def _(spark, sf):
    return _packet_flows(spark, sf, True)


@query("conversations", f"""
SELECT file, src_ip, dst_ip, src_port, dst_port, proto AS protocol, {r('t_first', 'first_seen_s')}, {r('t_last', 'last_seen_s')}, packets, bytes,
       {r('t_last - t_first', 'duration_s')}, CASE WHEN file LIKE '%mirai%' THEN 'bot' ELSE 'benign' END AS class,
       CASE WHEN file LIKE '%mirai%' THEN 'mirai' ELSE 'torii' END AS family FROM convs""")
def _(spark, sf):
    return tidy(P.conversations(V.packets(spark, sf)).drop("first_packet", "first_seen", "last_seen"))


@query("flow_cap", """
SELECT file, src_ip, dst_ip, protocol, packets FROM (SELECT *, proto AS protocol, row_number() OVER (PARTITION BY file ORDER BY first_packet) AS k FROM convs) WHERE k <= 50""")
def _(spark, sf):
    return P.conversations(V.packets(spark, sf), max_flows=50).select("file", "src_ip", "dst_ip", "protocol", "packets")


@query("packet_gaps", f"SELECT file, packet_no, round(gap_ms, 3) + 0.0 AS gap_ms FROM pgaps")
def _(spark, sf):
    return P.packet_gaps(V.packets(spark, sf)).select("file", "packet_no", (F.round("gap_ms", 3) + 0.0).alias("gap_ms"))


@query("host_packets", "SELECT * FROM hostp")
def _(spark, sf):
    return P.host_packets(V.packets(spark, sf)).select(
        "src", "file", "packet_no", "ts", "dst_ip", "dst_port", "protocol", "size")


# --- profiles --------------------------------------------------------------

@query("dataset_overview", f"""
SELECT scenario, count(*) AS rows, count(DISTINCT src_ip) AS distinct_src, count(DISTINCT dst_ip) AS distinct_dst,
       (SELECT count(*) FROM (SELECT src_ip FROM flows g WHERE g.scenario = f.scenario UNION SELECT dst_ip FROM flows g WHERE g.scenario = f.scenario)) AS distinct_ips,
       min(us) AS t_min, max(us) AS t_max, {r('(max(us) - min(us)) / 1000000.0', 'duration_s')} FROM flows f GROUP BY scenario""")
def _(spark, sf):
    return tidy(R.overview(V.flows(spark, sf), "src_ip", "dst_ip", "start_time", ["scenario"]))


@query("class_counts", f"""
SELECT label AS class, count(*) AS rows, {r('count(*) * 100.0 / (SELECT count(*) FROM flows)', 'percent')} FROM flows GROUP BY label""")
def _(spark, sf):
    return tidy(R.class_counts(V.flows(spark, sf)))


@query("label_totals", """
SELECT scenario, count(*) FILTER (label = 'bot') AS bot, count(*) FILTER (label = 'benign') AS benign,
       count(*) FILTER (label = 'background') AS background FROM flows GROUP BY scenario""")
def _(spark, sf):
    return R.label_totals(V.flows(spark, sf))


@query("top_sources", """
SELECT src_ip, flows, bot_flows, dominant_class FROM (
  SELECT src_ip, CAST(sum(c) AS BIGINT) AS flows, CAST(coalesce(sum(c) FILTER (label = 'bot'), 0) AS BIGINT) AS bot_flows,
         arg_max(label, (c, -f)) AS dominant_class
  FROM (SELECT src_ip, label, count(*) AS c, min(flow_id) AS f FROM flows GROUP BY src_ip, label) GROUP BY src_ip)
ORDER BY flows DESC, src_ip LIMIT 10""")
def _(spark, sf):
    return R.top_sources(V.flows(spark, sf))


@query("bot_sources", "SELECT src_ip, count(*) AS bot_flows FROM flows WHERE label = 'bot' GROUP BY src_ip")
def _(spark, sf):
    return R.bot_sources(V.flows(spark, sf))


@query("top_detailed_labels", "SELECT detailed_label, count(*) AS rows FROM flows WHERE label = 'bot' GROUP BY detailed_label ORDER BY rows DESC, detailed_label LIMIT 8")
def _(spark, sf):
    return R.detailed_labels(V.flows(spark, sf))


@query("top_destination_ports", "SELECT dst_port, count(*) AS rows FROM flows GROUP BY dst_port ORDER BY rows DESC, dst_port LIMIT 10")
def _(spark, sf):
    return R.top_values(V.flows(spark, sf), "dst_port", 10)


@query("endpoint_union", "SELECT scenario, src_ip AS ip FROM flows UNION SELECT scenario, dst_ip FROM flows")
def _(spark, sf):
    return V.flows(spark, sf).select(*W.endpoints(F.col("scenario"))).distinct()


@query("capture_overview", f"""
SELECT file, count(*) AS flows, count(DISTINCT src_ip) AS distinct_src, count(DISTINCT dst_ip) AS distinct_dst,
       (SELECT count(*) FROM (SELECT src_ip FROM convs g WHERE g.file = c.file UNION SELECT dst_ip FROM convs g WHERE g.file = c.file)) AS distinct_ips,
       {r('max(t_last) - min(t_first)', 'duration_s')}, CASE WHEN file LIKE '%mirai%' THEN 'bot' ELSE 'benign' END AS class,
       CASE WHEN file LIKE '%mirai%' THEN 'mirai' ELSE 'torii' END AS family,
       CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(packets) AS BIGINT) AS total_packets FROM convs c GROUP BY file""")
def _(spark, sf):
    return tidy(R.capture_overview(P.conversations(V.packets(spark, sf))).drop("t_min", "t_max"))


@query("top_capture_sources", """
SELECT src_ip, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes
FROM convs GROUP BY src_ip ORDER BY flows DESC, src_ip LIMIT 10""")
def _(spark, sf):
    return R.top_capture_sources(P.conversations(V.packets(spark, sf)))


def _q(col, qs, scale=""):
    return ", ".join(r(f"quantile_cont({col}, {q}){scale}", n) for n, q in qs.items())


_PROFILE = f"""
SELECT src, count(*) AS packets, round(max(ts) - min(ts), 3) AS span_s, CAST(min(size) AS DOUBLE) AS size_min, CAST(max(size) AS DOUBLE) AS size_max,
       {r('avg(size)', 'size_mean')}, {r('stddev_samp(size)', 'size_std')}, round(max(gap_s) FILTER (gap_s > 0), 3) AS gap_max_s,
       count(DISTINCT dst_ip) AS distinct_peers,
       {', '.join(r(f'quantile_cont(size, {q})', f'size_p{int(q * 100)}') for q in fixed.SIZE_QUANTILES)},
       {', '.join(f'round(quantile_cont(gap_s, {q}) FILTER (gap_s > 0) * 1000, 2) AS gap_p{int(q * 100)}_ms' for q in fixed.GAP_QUANTILES)},
       {r('count(*) / (max(ts) - min(ts))', 'packets_per_s')}, round(avg(gap_s) FILTER (gap_s > 0) * 1000, 2) AS gap_mean_ms,
       {r('stddev_samp(gap_s) FILTER (gap_s > 0) / avg(gap_s) FILTER (gap_s > 0)', 'gap_cv')},
       CASE WHEN stddev_samp(gap_s) FILTER (gap_s > 0) / avg(gap_s) FILTER (gap_s > 0) > 1 THEN 'bursty' ELSE 'regular' END AS rhythm
FROM hgaps GROUP BY src"""


@query("host_profile", _PROFILE)
def _(spark, sf):
    p = R.host_profile(P.host_packets(V.packets(spark, sf)))
    coarse = {c: F.round(c, 2) for c in p.columns if c.startswith("gap_") and c.endswith("_ms")}
    return tidy(p.withColumns({**coarse, "span_s": F.round("span_s", 3), "gap_max_s": F.round("gap_max_s", 3)}))


@query("protocol_shares", f"""
SELECT src, protocol, count(*) AS packets, {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY src)', 'percent')} FROM hostp GROUP BY src, protocol""")
def _(spark, sf):
    return tidy(R.protocol_shares(P.host_packets(V.packets(spark, sf))))


@query("host_gaps", "SELECT src, packet_no, round(gap_s, 3) + 0.0 AS gap_s FROM hgaps")
def _(spark, sf):
    return R.host_gaps(P.host_packets(V.packets(spark, sf))).select("src", "packet_no", (F.round("gap_s", 3) + 0.0).alias("gap_s"))


# A NULL group with a third of the rows.
_NULLED = "CASE WHEN {k} % 3 > 0 THEN {c} END AS {c}"


def _nulled(df: DataFrame, k: str, c: str) -> DataFrame:
    return df.withColumn(c, F.when(F.col(k) % 3 > 0, F.col(c)))


@query("host_gaps_spread", f"""
SELECT src, packet_no, round(ts - lag(ts) OVER (PARTITION BY src ORDER BY file, packet_no), 3) + 0.0 AS gap_s
FROM (SELECT {_NULLED.format(k='packet_no', c='src')}, file, packet_no, ts FROM hostp)""")
def _(spark, sf):
    gaps = R.host_gaps(_nulled(P.host_packets(V.packets(spark, sf)), "packet_no", "src"))
    return gaps.select("src", "packet_no", (F.round("gap_s", 3) + 0.0).alias("gap_s"))


@query("ordered_null_groups", f"""
SELECT flow_id, src_ip, row_number() OVER o AS position, CAST(sum(bytes_fwd) OVER o AS BIGINT) AS running,
       max(bytes_fwd) OVER (PARTITION BY src_ip ORDER BY us, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before,
       lag(bytes_fwd) OVER o AS previous, CAST(sum(bytes_fwd) OVER (PARTITION BY src_ip) AS BIGINT) AS total
FROM (SELECT flow_id, us, bytes_fwd, {_NULLED.format(k='flow_id', c='src_ip')} FROM flows)
WINDOW o AS (PARTITION BY src_ip ORDER BY us, flow_id)""")
def _(spark, sf):
    v = F.col("bytes_fwd")
    f = _nulled(V.flows(spark, sf), "flow_id", "src_ip").select("flow_id", "src_ip", "start_time", "bytes_fwd")
    out = running(f, ["src_ip"], [F.col("start_time"), F.col("flow_id")], {
        "position": ("position", None), "running": ("sum", v), "max_before": ("max_before", v),
        "previous": ("previous", v), "total": ("total", v)})
    return out.drop("start_time", "bytes_fwd").withColumn("position", F.col("position").cast("bigint"))


@query("flow_ids_spread", f"""
SELECT CAST(row_number() OVER (PARTITION BY scenario ORDER BY us) - 1 AS BIGINT) AS flow_id, scenario, us AS start_time
FROM (SELECT us, {_NULLED.format(k='flow_id', c='scenario')} FROM flows)""")
def _(spark, sf):
    return tidy(logs.assign_flow_ids(_nulled(V.flows(spark, sf), "flow_id", "scenario")).select("flow_id", "scenario", "start_time"))


@query("quantiles_spread", f"""
SELECT src_ip, {r('quantile_cont(CAST(bytes_fwd AS DOUBLE), 0.5)', 'bytes_median')}, {r('quantile_cont(duration_s, 0.9)', 'duration_p90')}
FROM (SELECT bytes_fwd, duration_s, {_NULLED.format(k='flow_id', c='src_ip')} FROM flows) GROUP BY src_ip""")
def _(spark, sf):
    f = _nulled(V.flows(spark, sf), "flow_id", "src_ip")
    return tidy(exact_quantiles(f, ["src_ip"], {"bytes_median": ("bytes_fwd", 0.5), "duration_p90": ("duration_s", 0.9)}))


@query("peer_churn", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, file, packet_no) AS pos, count(*) OVER (PARTITION BY src) AS n,
                  min(ts) OVER (PARTITION BY src) AS t0 FROM hostp),
f AS (SELECT src, dst_ip, min(pos) AS fp FROM o GROUP BY src, dst_ip),
c AS (SELECT src, q AS quarter, pos, ts - t0 AS rel FROM o, (SELECT unnest(range(1, 5)) AS q) WHERE pos = q * greatest(n // 4, 1))
SELECT c.src, CAST(quarter AS INT) AS quarter, round(any_value(rel), 3) + 0.0 AS t_rel_s, count(*) AS peers
FROM c JOIN f ON c.src = f.src AND f.fp <= c.pos GROUP BY c.src, quarter""")
def _(spark, sf):
    c = R.peer_churn(P.host_packets(V.packets(spark, sf)))
    return c.withColumn("t_rel_s", F.round("t_rel_s", 3) + 0.0)


_HIST = """
WITH s AS (SELECT {g} min(v) AS lo, max(v) AS hi FROM ({src}) GROUP BY {gn})
SELECT {o} CAST(least(floor((v - lo) / ((hi - lo) / 80.0)), 79) AS INT) AS bin, count(*) AS rows
FROM ({src}) JOIN s ON {on} GROUP BY ALL"""


@query("size_histogram", _HIST.format(g="src,", gn="src", o="src,", src="SELECT src, CAST(size AS DOUBLE) AS v FROM hostp", on="TRUE").replace(
    "FROM (SELECT src, CAST(size AS DOUBLE) AS v FROM hostp) JOIN s ON TRUE", "FROM (SELECT src, CAST(size AS DOUBLE) AS v FROM hostp) JOIN s USING (src)"))
def _(spark, sf):
    return R.histogram(P.host_packets(V.packets(spark, sf)), "size", ["src"]).select("src", "bin", "rows")


@query("gap_histogram_total", "SELECT src, count(*) AS rows FROM hgaps WHERE gap_s > 0 GROUP BY src")
def _(spark, sf):
    h = R.histogram(R.log_gaps(R.host_gaps(P.host_packets(V.packets(spark, sf)))), "log10_ms", ["src"])
    return h.groupBy("src").agg(F.sum("rows").alias("rows"))


def _ticks(source: str) -> str:
    """Whole-tick histogram of (src, v) rows, 80 bins."""
    return f"""
WITH h AS ({source}), s AS (SELECT src, min(v) AS lo, max(v) AS hi FROM h GROUP BY src),
b AS (SELECT src, lo, hi, CASE WHEN lo = hi THEN 40 ELSE least((v - lo) * 80 // (hi - lo), 79) END AS bin FROM h JOIN s USING (src))
SELECT src, CAST(bin AS INT) AS bin, CASE WHEN lo = hi THEN lo ELSE lo + (bin * (hi - lo) + 79) // 80 END AS bin_start, count(*) AS rows
FROM b GROUP BY src, lo, hi, bin"""


@query("gap_histogram", _ticks("SELECT src, CAST(round(log10(gap_s * 1000 + 1e-6) * 1000000) AS BIGINT) AS v FROM hgaps WHERE gap_s > 0"))
def _(spark, sf):
    gaps = R.log_gap_ticks(R.host_gaps(P.host_packets(V.packets(spark, sf))))
    return R.histogram_ticks(gaps, "log10_ms_ticks", ["src"])


@query("size_histogram_ticks", _ticks("SELECT src, CAST(size AS BIGINT) AS v FROM hostp"))
def _(spark, sf):
    return R.histogram_ticks(P.host_packets(V.packets(spark, sf)), "size", ["src"])


@query("top_ports_15", "SELECT dst_port, count(*) AS rows FROM hostp GROUP BY dst_port ORDER BY rows DESC, dst_port LIMIT 15")
def _(spark, sf):
    return R.top_values(P.host_packets(V.packets(spark, sf)), "dst_port", 15)


@query("representative_window", """
SELECT scenario, ws, window_idx, n_bot_nodes FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY n_bot_nodes DESC, ws) AS k FROM graphs) WHERE k = 1""")
def _(spark, sf):
    return tidy(R.representative_window(built(spark, sf).graphs))


@query("first_positive_window", """
SELECT scenario, ws, window_idx, n_bot_nodes FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY n_bot_nodes < 1, ws) AS k FROM graphs) WHERE k = 1""")
def _(spark, sf):
    return tidy(R.first_positive_window(built(spark, sf).graphs))


@query("window_size_stats", f"""
SELECT scenario, count(*) AS windows, CAST(sum(n_nodes) AS BIGINT) AS n_total, CAST(sum(n_bot_nodes) AS BIGINT) AS n_pos, {r('avg(n_nodes)', 'nodes_mean')},
       min(n_nodes) AS nodes_min, max(n_nodes) AS nodes_max, {r('avg(n_edges)', 'edges_mean')},
       {r('median(n_nodes)', 'nodes_median')}, {r('median(n_edges)', 'edges_median')} FROM graphs GROUP BY scenario""")
def _(spark, sf):
    return tidy(R.window_size_stats(built(spark, sf).graphs))


_MATCHED = "SELECT n.scenario, n.ws, n.ip, n.y, count(*) AS seq_len FROM nodes n JOIN seq_hash q USING (scenario, ws, ip) GROUP BY n.scenario, n.ws, n.ip, n.y"


def _matched(spark, sf):
    g = built(spark, sf)
    seqs = Q.build_sequences(windowed(spark, sf), selected(spark, sf), V.WINDOWS, SEQ)
    lengths = seqs.groupBy(*W.WIN, "ip").agg(F.count("*").alias("seq_len"))
    return g, R.matched_windows(g.nodes, lengths)


@query("matched_windows", _MATCHED)
def _(spark, sf):
    return tidy(_matched(spark, sf)[1].select(*W.WIN, "ip", "y", "seq_len"))


@query("flows_per_node", f"""
WITH m AS ({_MATCHED})
SELECT scenario, y, count(*) AS nodes, {r('avg(seq_len)', 'mean')}, {r('avg(CASE WHEN seq_len <= 1 THEN 1.0 ELSE 0.0 END)', 'share_le1')},
       {r('avg(CASE WHEN seq_len <= 3 THEN 1.0 ELSE 0.0 END)', 'share_le3')}, {_q('seq_len', dict(p10=0.1, median=0.5, p90=0.9))} FROM m GROUP BY scenario, y""")
def _(spark, sf):
    return tidy(R.flows_per_node_stats(_matched(spark, sf)[1]))


def _sep_sql():
    parts = []
    for f in _N:
        b, n = f"{f}) FILTER (y = 1", f"{f}) FILTER (y = 0"
        d = (f"(avg({b}) - avg({n})) / sqrt((pow(stddev_pop({b}), 2) + pow(stddev_pop({n}), 2)) / 2 + 1e-9)")
        parts.append(f"SELECT scenario, '{f}' AS feature, avg({b}) AS bm, stddev_pop({b}) AS bs, avg({n}) AS nm, stddev_pop({n}) AS ns, {d} AS d FROM nodes GROUP BY scenario")
    return f"""WITH x AS ({' UNION ALL '.join(parts)})
SELECT scenario, feature, {r('bm', 'bot_mean')}, {r('bs', 'bot_std')}, {r('nm', 'benign_mean')}, {r('ns', 'benign_std')}, {r('d', 'cohen_d')},
       {r('max(abs(d)) OVER (PARTITION BY scenario)', 'max_abs_d')} FROM x"""


@query("class_separation", _sep_sql())
def _(spark, sf):
    return tidy(R.class_separation(built(spark, sf).nodes))


# --- neighbourhood operators ----------------------------------------------

@query("edges_with_source_values", f"""
SELECT e.scenario, e.ws, e.src_idx, e.dst_idx, {r('n.fan_in', 'src_fan_in')}, n.y AS src_y FROM edges e
JOIN nodes n ON e.scenario = n.scenario AND e.ws = n.ws AND e.src_idx = n.node_idx""")
def _(spark, sf):
    g = built(spark, sf)
    return tidy(N.with_source_values(g.edges, g.nodes, ["fan_in", "y"]).select(*W.WIN, "src_idx", "dst_idx", "src_fan_in", "src_y"))


_SHARES = """
SELECT n.*, greatest(coalesce(d, 0), 1) AS in_degree, coalesce(n0, 0) / CAST(greatest(coalesce(d, 0), 1) AS DOUBLE) AS share_0,
       coalesce(n1, 0) / CAST(greatest(coalesce(d, 0), 1) AS DOUBLE) AS share_1
FROM nlogits n LEFT JOIN (
  SELECT e.scenario, e.ws, e.dst_idx AS node_idx, count(*) AS d, count(*) FILTER (s.y = 0) AS n0, count(*) FILTER (s.y = 1) AS n1
  FROM edges e JOIN nodes s ON e.scenario = s.scenario AND e.ws = s.ws AND e.src_idx = s.node_idx GROUP BY e.scenario, e.ws, e.dst_idx
) a USING (scenario, ws, node_idx)"""


def _logits(nodes):
    return nodes.withColumns({"logit0": F.col("fan_out") / 10 - F.col("port_entropy"),
                              "logit1": F.col("fan_in") / 10 - F.col("protocol_entropy")})


@query("neighbour_classes", f"WITH s AS ({_SHARES}) SELECT scenario, ws, node_idx, in_degree, {r('share_0')}, {r('share_1')} FROM s")
def _(spark, sf):
    g = built(spark, sf)
    return tidy(N.neighbour_classes(g.nodes, g.edges).select(*W.WIN, "node_idx", "in_degree", "share_0", "share_1"))


@query("topology_margin", f"""
WITH s AS ({_SHARES}), p AS (SELECT avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS p0, avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS p1 FROM nodes),
w AS (SELECT p0, p1, 1 + 0.5 * ((1 / p0) / ((1 / p0 + 1 / p1) / 2) - 1) AS w0, 1 + 0.5 * ((1 / p1) / ((1 / p0 + 1 / p1) / 2) - 1) AS w1 FROM p)
SELECT scenario, ws, node_idx, {r('logit0 - 1.5 * (share_0 - p0) * w0', 'adjusted0')}, {r('logit1 - 1.5 * (share_1 - p1) * w1', 'adjusted1')} FROM s, w""")
def _(spark, sf):
    nodes, edges = stored(spark, sf)
    shares = N.neighbour_classes(_logits(nodes), edges)
    return tidy(N.topology_margin(shares, N.class_prior(nodes)).select(*W.WIN, "node_idx", "adjusted0", "adjusted1"))


_FOCAL = "CASE WHEN y = 1 THEN {a}logit1 ELSE {b}logit0 END"
_P = "1 / (1 + exp(CASE WHEN y = 1 THEN logit0 - logit1 ELSE logit1 - logit0 END))"


@query("focal_loss", f"SELECT scenario, {r(f'avg(-pow(1 - {_P}, 2) * ln({_P}) * CASE WHEN y = 1 THEN 2.0 ELSE 0.5 END)', 'loss')} FROM nlogits GROUP BY scenario")
def _(spark, sf):
    n = _logits(built(spark, sf).nodes)
    loss = S.focal_loss(F.col("logit0"), F.col("logit1"), F.col("y"), alpha=(0.5, 2.0))
    return tidy(n.groupBy("scenario").agg(F.avg(loss).alias("loss")))


@query("two_class_scores", f"""
SELECT scenario, ws, node_idx, {r('1 / (1 + exp(logit0 - logit1))', 'proba')}, CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS y_pred,
       CASE WHEN 1 / (1 + exp(logit0 - logit1)) >= 0.7 THEN 1 ELSE 0 END AS at_70 FROM nlogits""")
def _(spark, sf):
    n = _logits(built(spark, sf).nodes)
    proba = S.positive_probability(F.col("logit0"), F.col("logit1"))
    return tidy(n.select(*W.WIN, "node_idx", proba.alias("proba"),
                         S.predicted_class(F.col("logit0"), F.col("logit1")).alias("y_pred"), S.at_threshold(proba, 0.7).alias("at_70")))


def _hop(src):
    return f"""SELECT n.scenario, n.ws, n.node_idx, 1.5 * n.v + coalesce(a.s, 0) AS v FROM {src} n LEFT JOIN (
  SELECT e.scenario, e.ws, e.dst_idx AS node_idx, sum(greatest(s.v + e.mean_iat_ms - 20, 0)) AS s FROM edges e
  JOIN {src} s ON e.scenario = s.scenario AND e.ws = s.ws AND e.src_idx = s.node_idx GROUP BY e.scenario, e.ws, e.dst_idx) a
USING (scenario, ws, node_idx)"""


@query("neighbourhood_sum", f"""
WITH h0 AS (SELECT scenario, ws, node_idx, fan_in AS v FROM nodes), h1 AS ({_hop('h0')}), h2 AS ({_hop('h1')})
SELECT scenario, ws, node_idx, {r('v')} FROM h2""")
def _(spark, sf):
    g = built(spark, sf)
    nodes = g.nodes.select(*W.WIN, "node_idx", F.col("fan_in").alias("v"))
    edges = g.edges.withColumn("e", F.col("mean_iat_ms") - 20)
    return tidy(N.neighbourhood_sum(nodes, edges, ["v"], "e", eps=0.5, hops=2))


@query("graph_readout", f"""
SELECT scenario, ws, {r('avg(fan_in)', 'mean_fan_in')}, {r('avg(byte_rate)', 'mean_byte_rate')}, {r('max(fan_in)', 'max_fan_in')}, {r('max(byte_rate)', 'max_byte_rate')}
FROM nodes GROUP BY scenario, ws""")
def _(spark, sf):
    return tidy(N.readout(built(spark, sf).nodes, ["fan_in", "byte_rate"]))


@query("vector_readout", f"""
SELECT window_idx, dim, {r('avg(v)', 'mean')}, {r('max(v)', 'max')} FROM (
  SELECT CAST(vec_id // 100 AS INT) AS window_idx, CAST(unnest(range(0, 64)) AS INT) AS dim, unnest(embedding) AS v FROM embeddings) GROUP BY window_idx, dim""")
def _(spark, sf):
    return tidy(N.readout_vectors(V.embeddings(spark, sf), "emb", ["window_idx"]))


@query("summary_to_nodes", f"""
SELECT n.scenario, n.ws, n.node_idx, {r('m', 'mean_fan_in')} FROM nodes n JOIN (SELECT scenario, ws, avg(fan_in) AS m FROM nodes GROUP BY scenario, ws) USING (scenario, ws)""")
def _(spark, sf):
    n = built(spark, sf).nodes
    summary = N.readout(n, ["fan_in"])
    return tidy(N.summary_to_nodes(n, summary).select(*W.WIN, "node_idx", "mean_fan_in"))


_POOL = """SELECT scenario, ws, node_idx, y, fan_in, fan_out, CAST(k - 1 AS INT) AS pool_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario, ws ORDER BY round(byte_rate, 9) DESC, node_idx) AS k, count(*) OVER (PARTITION BY scenario, ws) AS n FROM nodes)
WHERE k <= ceil(0.5 * n)"""


def _pooled(spark, sf):
    g = built(spark, sf)
    # Rounded, so that both engines order nearly equal sums alike.
    return g, N.top_ratio(g.nodes.withColumn("score", F.round("byte_rate", 9)), "score")


@query("top_ratio_pooling", f"SELECT scenario, ws, node_idx, pool_idx FROM ({_POOL})")
def _(spark, sf):
    return tidy(_pooled(spark, sf)[1].select(*W.WIN, "node_idx", "pool_idx"))


@query("induced_edges", f"""
WITH p AS ({_POOL}) SELECT e.scenario, e.ws, e.src_ip, e.dst_ip, s.pool_idx AS src_idx, d.pool_idx AS dst_idx FROM edges e
JOIN p s ON e.scenario = s.scenario AND e.ws = s.ws AND e.src_idx = s.node_idx JOIN p d ON e.scenario = d.scenario AND e.ws = d.ws AND e.dst_idx = d.node_idx""")
def _(spark, sf):
    g, kept = _pooled(spark, sf)
    return tidy(N.induced_edges(g.edges, kept).select(*W.WIN, "src_ip", "dst_ip", "src_idx", "dst_idx"))


@query("pool_survival", f"""
WITH p AS ({_POOL}), a AS (SELECT n.*, CASE WHEN n.fan_in > n.fan_out THEN 1 ELSE 0 END AS y_pred, p.node_idx IS NOT NULL AS kept
  FROM nodes n LEFT JOIN p ON n.scenario = p.scenario AND n.ws = p.ws AND n.node_idx = p.node_idx),
c AS (SELECT scenario, ws, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (kept) AS n_kept, count(*) FILTER (kept AND y = 1) AS n_pos_kept,
        count(*) FILTER (y = 1 AND y_pred = 1) AS pred_tp, count(*) FILTER (y = 1 AND y_pred = 0) AS pred_fn, count(*) FILTER (y = 0 AND y_pred = 1) AS pred_fp
      FROM a GROUP BY scenario, ws)
SELECT *, {r('n_pos_kept / CAST(greatest(n_pos, 1) AS DOUBLE)', 'bot_keep_rate')},
       {r('(n_kept - n_pos_kept) / CAST(greatest(n - n_pos, 1) AS DOUBLE)', 'benign_keep_rate')} FROM c""")
def _(spark, sf):
    g, kept = _pooled(spark, sf)
    return tidy(N.pool_survival(g.nodes.withColumn("y_pred", (F.col("fan_in") > F.col("fan_out")).cast("int")), kept))


_ASSIGN = """
SELECT scenario, ws, node_idx, cluster, exp(logit) / sum(exp(logit)) OVER (PARTITION BY scenario, ws, node_idx) AS s
FROM (SELECT scenario, ws, node_idx, unnest([0, 1, 2]) AS cluster, unnest([fan_in / 10, fan_out / 5, port_entropy]) AS logit FROM nodes)"""


def _assign(nodes):
    logits = F.posexplode(F.array(F.col("fan_in") / 10, F.col("fan_out") / 5, F.col("port_entropy"))).alias("cluster", "logit")
    return N.soft_assignment(nodes.select(*W.WIN, "node_idx", logits))


@query("coarsened_values", f"""
WITH a AS ({_ASSIGN}) SELECT a.scenario, a.ws, cluster, {r('sum(s * fan_in)', 'fan_in')}, {r('sum(s * byte_rate)', 'byte_rate')}
FROM a JOIN nodes USING (scenario, ws, node_idx) GROUP BY a.scenario, a.ws, cluster""")
def _(spark, sf):
    n = built(spark, sf).nodes
    return tidy(N.coarsen_values(_assign(n), n, ["fan_in", "byte_rate"]))


@query("coarsened_edges", f"""
WITH a AS ({_ASSIGN}) SELECT e.scenario, e.ws, s.cluster AS src_cluster, d.cluster AS dst_cluster, {r('sum(s.s * d.s)', 'weight')} FROM edges e
JOIN a s ON e.scenario = s.scenario AND e.ws = s.ws AND e.src_idx = s.node_idx JOIN a d ON e.scenario = d.scenario AND e.ws = d.ws AND e.dst_idx = d.node_idx
GROUP BY e.scenario, e.ws, s.cluster, d.cluster""")
def _(spark, sf):
    g = built(spark, sf)
    return tidy(N.coarsen_edges(_assign(g.nodes), g.edges))


@query("cluster_projection", f"""
WITH a AS ({_ASSIGN}), x AS (SELECT a.scenario, a.ws, cluster, sum(s * fan_in) AS v FROM a JOIN nodes USING (scenario, ws, node_idx) GROUP BY a.scenario, a.ws, cluster),
m AS (SELECT scenario, ws, avg(v) AS m FROM x GROUP BY scenario, ws)
SELECT a.scenario, a.ws, a.node_idx, {r('sum(s * v)', 'fan_in')}, {r('any_value(m)', 'graph_mean')} FROM a JOIN x USING (scenario, ws, cluster) JOIN m USING (scenario, ws)
GROUP BY a.scenario, a.ws, a.node_idx""")
def _(spark, sf):
    n = built(spark, sf).nodes
    a = _assign(n)
    clusters = N.coarsen_values(a, n, ["fan_in"])
    mean = N.cluster_mean(clusters, ["fan_in"]).withColumnRenamed("fan_in", "graph_mean")
    return tidy(N.summary_to_nodes(N.project_back(a, clusters, ["fan_in"]), mean))


def _edge_unit():
    return md5_unit("scenario", F.unix_seconds("window_start").cast("string"), F.col("src_idx").cast("string"), F.col("dst_idx").cast("string"))


@query("drop_edges", "SELECT scenario, ws, src_idx, dst_idx FROM eunit WHERE unit >= 0.3")
def _(spark, sf):
    return tidy(N.drop_edges(built(spark, sf).edges, 0.3, _edge_unit()).select(*W.WIN, "src_idx", "dst_idx"))


_RATES = "[0.0, 0.05, 0.10, 0.20, 0.30]"


@query("robustness_sweep", f"""
WITH rt AS (SELECT CAST(unnest({_RATES}) AS DOUBLE) AS rate),
d AS (SELECT rate, e.scenario, e.ws, e.dst_idx AS node_idx, count(*) AS deg FROM eunit e, rt WHERE unit >= rate GROUP BY rate, e.scenario, e.ws, e.dst_idx),
s AS (SELECT rt.rate, n.y AS y_true, CASE WHEN coalesce(deg, 0) >= 2 THEN 1 ELSE 0 END AS y_pred FROM nodes n CROSS JOIN rt
      LEFT JOIN d ON d.rate = rt.rate AND d.scenario = n.scenario AND d.ws = n.ws AND d.node_idx = n.node_idx),
c AS (SELECT rate, count(*) AS n, count(*) FILTER (y_true = 1) AS n_pos, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
        count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn FROM s GROUP BY rate),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)
SELECT {r('rate')}, n, n_pos, tp, fp, fn, tn, {r('f1')}, {r('f1 - (SELECT arg_min(f1, rate) FROM f)', 'delta_f1')} FROM f""")
def _(spark, sf):
    g = built(spark, sf)
    # Labels and pairs are enough: no feature and no source port is computed.
    out = N.degree_robustness(g.labelled, g.pairs, lambda d: (d >= 2).cast("int"), unit=_edge_unit(), keys=W.WIN)
    return tidy(out.select("rate", "n", "n_pos", "tp", "fp", "fn", "tn", "f1", "delta_f1"))


_LAM = "CAST(concat('0x', substr(md5(concat_ws('|', scenario, ws, node_idx)), 1, 8)) AS BIGINT) / 4294967296.0"


@query("mixed_positives", f"""
WITH z AS (SELECT *, count(*) FILTER (y = 1) OVER (PARTITION BY scenario, ws) AS np, count(*) OVER (PARTITION BY scenario, ws) AS nn FROM nodes),
p AS (SELECT *, row_number() OVER (PARTITION BY scenario, ws ORDER BY node_idx) - 1 AS k, {_LAM} AS lam FROM z WHERE y = 1 AND np >= 2 AND np / CAST(nn AS DOUBLE) <= 0.5),
b AS (SELECT a.scenario, a.ws, a.node_idx, a.lam * a.fan_in + (1 - a.lam) * q.fan_in AS v FROM p a JOIN p q
      ON a.scenario = q.scenario AND a.ws = q.ws AND q.k = (a.k + 1 + a.np % (a.np - 1)) % a.np)
SELECT n.scenario, n.ws, n.node_idx, {r('coalesce(b.v, n.fan_in)', 'fan_in')}, b.v IS NOT NULL AS mixed FROM nodes n LEFT JOIN b
ON n.scenario = b.scenario AND n.ws = b.ws AND n.node_idx = b.node_idx""")
def _(spark, sf):
    lam = md5_unit("scenario", F.unix_seconds("window_start").cast("string"), F.col("node_idx").cast("string"))
    shift = F.lit(1) + F.pmod(F.col("_n"), F.col("_n") - 1)
    mixed = N.mix_positives(built(spark, sf).nodes, ["fan_in"], shift=shift, lam=lam)
    return tidy(mixed.select(*W.WIN, "node_idx", "fan_in", "mixed"))


_MASKED = """
SELECT *, u < 0.15 OR (pos = 0 AND max(CASE WHEN u < 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY scenario, ws, ip) = 0) AS masked
FROM (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', scenario, ws, ip, pos)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM seq_even)"""


def _masked(spark, sf):
    seqs = Q.build_sequences(windowed(spark, sf), selected(spark, sf), V.WINDOWS, SequenceConfig(8, even=True))
    unit = md5_unit("scenario", F.unix_seconds("window_start").cast("string"), "ip", F.col("pos").cast("string"))
    return N.mask_positions(seqs, unit=unit)


@query("masked_positions", f"SELECT scenario, ws, ip, pos, masked FROM ({_MASKED})")
def _(spark, sf):
    return tidy(_masked(spark, sf).select(*W.WIN, "ip", "pos", "masked"))


@query("masked_error", f"""
SELECT scenario, count(*) FILTER (masked) AS masked_rows,
       {r('avg((pow(norm_time - 0.5, 2) + pow(log1p_total_bytes - 5, 2)) / 2) FILTER (masked)', 'mse')} FROM ({_MASKED}) GROUP BY scenario""")
def _(spark, sf):
    m = _masked(spark, sf).withColumns({"r1": F.lit(0.5), "r2": F.lit(5.0)})
    return tidy(N.masked_error(m, {"norm_time": "r1", "log1p_total_bytes": "r2"}, ["scenario"]))


@query("attach_embeddings", """
SELECT vec_id AS node_idx, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, CAST(len(embedding) AS INT) AS dims FROM embeddings""")
def _(spark, sf):
    e = V.embeddings(spark, sf)
    joined = stores.attach_embeddings(e.drop("emb"), stores.widen_embeddings(e.select("window_idx", "ip", "emb"), 64), ["window_idx", "ip"])
    return joined.select("node_idx", "y", F.size("emb").alias("dims"))


# --- models and reports ----------------------------------------------------

@query("scored_graphs", f"""
WITH d AS (SELECT scenario, ws, dst_idx AS node_idx, count(*) AS deg FROM edges GROUP BY scenario, ws, dst_idx)
SELECT n.scenario, g.window_idx, n.node_idx, n.y AS y_true, CASE WHEN coalesce(deg, 0) / CAST(g.n_nodes AS DOUBLE) >= 0.1 THEN 1 ELSE 0 END AS y_pred,
       {r('coalesce(deg, 0) / CAST(g.n_nodes AS DOUBLE)', 'proba')}
FROM nodes n JOIN graphs g USING (scenario, ws) LEFT JOIN d ON n.scenario = d.scenario AND n.ws = d.ws AND n.node_idx = d.node_idx""")
def _(spark, sf):
    g = built(spark, sf)
    nodes = G.with_window_idx(g.nodes, g.graphs).select("scenario", "window_idx", "node_idx", "y")
    edges = G.with_window_idx(g.edges, g.graphs).select("scenario", "window_idx", "dst_idx")

    def in_degree_share(n, e):
        proba = n["node_idx"].map(e["dst_idx"].value_counts()).fillna(0) / max(len(n), 1)
        return pd.DataFrame({"scenario": n["scenario"], "window_idx": n["window_idx"], "node_idx": n["node_idx"],
                             "y_true": n["y"], "y_pred": (proba >= 0.1).astype("int32"), "proba": proba})

    return tidy(models.score_graphs(nodes, edges, in_degree_share))


@query("stratified_split", """
SELECT scenario, ws, ip, y FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', scenario, ws, ip)), scenario, ws, ip) AS k, count(*) OVER (PARTITION BY y) AS n FROM nodes)
WHERE k <= round_even(n * 0.25, 0)""")
def _(spark, sf):
    by = F.md5(F.concat_ws("|", "scenario", F.unix_seconds("window_start").cast("string"), "ip"))
    return tidy(models.stratified_split(built(spark, sf).nodes, by=by)[1].select(*W.WIN, "ip", "y"))


def _trained(spark, sf):
    g, a = _assigned(spark, sf)
    return g, [splits.load_split(a, s, g.nodes) for s in splits.SPLITS]


@query("forest_baseline")
def _(spark, sf):
    _, (train, _, test) = _trained(spark, sf)
    model = models.fit_forest(cut_lineage(train))
    return tidy(M.evaluate(cut_lineage(models.score_table(model, test))))  # read several times


@query("forest_importances")
def _(spark, sf):
    _, (train, _, _) = _trained(spark, sf)
    return tidy(models.importances(spark, models.fit_forest(cut_lineage(train))))


@query("boosted_baseline")
def _(spark, sf):
    _, (train, val, test) = _trained(spark, sf)
    return tidy(M.evaluate(cut_lineage(models.score_table(models.fit_boosted(train, val), test))))


@query("sanity_check")
def _(spark, sf):
    return tidy(models.sanity_check(cut_lineage(built(spark, sf).nodes)))


_METRIC_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM runs" for m in ("f1", "precision", "recall", "fn"))


@query("seed_summary", f"""
SELECT metric, count(*) AS runs, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM ({_METRIC_ROWS}) GROUP BY metric""")
def _(spark, sf):
    return tidy(reports.spread_over_runs(reports.unpivot_metrics(_run_results(spark, sf), ["f1", "precision", "recall", "fn"])))


@query("seed_summary_by_scenario", f"""
SELECT scenario, count(*) AS runs, {r('avg(f1)', 'mean')}, {r('stddev_pop(f1)', 'std')}, {r('min(f1)', 'min')}, {r('max(f1)', 'max')} FROM (
  SELECT run, scenario, 2.0 * count(*) FILTER (y_true = 1 AND y_pred = 1) / (count(*) FILTER (y_true = 1) + count(*) FILTER (y_pred = 1)) AS f1
  FROM scored GROUP BY run, scenario) GROUP BY scenario""")
def _(spark, sf):
    return tidy(reports.spread_over_runs(reports.scenario_metrics(_run_results(spark, sf)), "scenario"))


@query("ablation_table", f"""
WITH l AS (SELECT concat('run-', k) AS label, CASE WHEN k <= 3 THEN 'first' ELSE 'rest' END AS category, k FROM (SELECT unnest(range(1, 9)) AS k))
SELECT label, category, run IS NULL AS missing, {r('f1')}, {r('precision')}, {r('recall')}, fn FROM l LEFT JOIN runs ON l.k = run""")
def _(spark, sf):
    runs = _run_results(spark, sf).withColumn("file", F.col("tag"))
    listed = spark.createDataFrame([(f"run-{k}", f"run-{k}", "first" if k <= 3 else "rest") for k in range(1, 9)],
                                   "label string, file string, category string")
    return tidy(reports.result_table(listed, runs).select("label", "category", "missing", "f1", "precision", "recall", "fn"))


@query("streamed_edges", f"""
SELECT e.scenario, ws, src_ip, dst_ip, {r('total_bytes')}, {r('total_packets')}, {r('mean_flow_duration')}, {r('mean_iat_ms')} FROM (
  SELECT scenario, ws, src_ip, dst_ip, sum(bytes_fwd + bytes_bwd) AS total_bytes, sum(pkts_fwd + pkts_bwd) AS total_packets,
         avg(duration_s) AS mean_flow_duration, coalesce(avg(mean_iat_ms), 0) AS mean_iat_ms FROM kept GROUP BY scenario, ws, src_ip, dst_ip) e""")
def _(spark, sf):
    """Flows written as files, then read as a stream until nothing is left.

    A last row far in the future moves the watermark past every window.
    """
    src, out, state = scratch(spark, "stream-in"), scratch(spark, "stream-out"), scratch(spark, "stream-state")
    f = V.flows(spark, sf)
    f.write.parquet(src)
    last = f.orderBy(F.desc("start_time")).limit(1).withColumns({
        "start_time": F.col("start_time") + F.make_dt_interval(days=F.lit(100)), "scenario": F.lit("end"), "label": F.lit("benign")})
    last.write.mode("append").parquet(src)
    q = stream.run_available(stream.edge_stream(stream.flow_stream(spark, src), V.WINDOWS, "40 days"), out, state)
    q.awaitTermination()
    cols = ["scenario", "window_start", "src_ip", "dst_ip", "total_bytes", "total_packets", "mean_flow_duration", "mean_iat_ms"]
    return tidy(spark.read.parquet(out).where("scenario <> 'end'").select(*cols))


# --- log files, incremental stores, resume, hot keys -----------------------

LOG_PARTS = 8  # files that a scenario's log is cut into


def _log_files(spark, rows: DataFrame, name: Callable[[str, int], str], parts: Column, root: str | None = None) -> str:
    """Store rows as log files of the expected names: lines (``value``), or CSV with a
    header in every file. Only file names pass through the driver."""
    raw, root = scratch(spark, "lines"), root or scratch(spark, "logs")
    columns = ["value"] if "value" in rows.columns else fixed.BINETFLOW_COLUMNS
    writer = rows.select(*columns, "scenario", parts.alias("part")).repartition("scenario", "part").write.partitionBy("scenario", "part")
    (writer.text if columns == ["value"] else writer.option("header", True).csv)(raw)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(raw).select("path").collect()
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(raw).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for row in found:
        scenario, part = (x.split("=", 1)[1] for x in row.path.split("/")[-3:-1])
        target = path(f"{root}/{name(scenario, int(part))}")
        fs.mkdirs(target.getParent())
        fs.rename(path(row.path), target)
    return root


def _binetflow_name(scenario: str, part: int) -> str:
    return f"{scenario}/capture-{part}.binetflow"


def _zeek_name(scenario: str, part: int) -> str:
    return f"CTU-IoT-Malware-Capture-{scenario}/part-{part}/conn.log.labeled"


def _part() -> Column:
    return F.pmod(F.col("flow_id"), F.lit(2 * LOG_PARTS)).cast("int")


def _without_sources(text: DataFrame) -> DataFrame:
    """Every eleventh row loses its source address."""
    return text.withColumn("SrcAddr", F.when(F.col("flow_id") % 11 != 0, F.col("SrcAddr")))


def _odd_zeek_lines(spark, sf) -> DataFrame:
    """Zeek lines; every eleventh has no source, every thirteenth is cut off by ``#`` behind its label."""
    source = F.when(F.col("flow_id") % 11 == 0, F.regexp_replace("value", r"\tC1\t[^\t]*\t", "\tC1\t-\t")).otherwise(F.col("value"))
    lines = _zeek_lines(spark, sf).withColumn("value", source)
    return lines.withColumn("value", F.when(F.col("flow_id") % 13 == 0, F.concat("value", F.lit("# Malicious"))).otherwise(F.col("value")))


_END = "us + CAST(round_even({d} * 1000000, 0) AS BIGINT) AS end_time"
_FILE_SQL = ORACLE["binetflow_projection"].replace("flow_id % 4 <> 3)", "flow_id % 4 <> 3 AND flow_id % 11 <> 0)").replace(
    "us AS start_time,", "us AS start_time, " + _END.format(d="duration_s") + ",")
_ZEEK_END = _END.format(d="CASE WHEN flow_id % 5 = 0 THEN 0.0 ELSE duration_s END")
_ZEEK_FILE_SQL = _ZEEK_SQL.replace("us AS start_time,", f"us AS start_time, {_ZEEK_END},").replace(
    "WHERE flow_id % 6 <> 1 OR pkts_bwd > 0", "WHERE (flow_id % 6 <> 1 OR pkts_bwd > 0) AND flow_id % 11 <> 0")


@query("binetflow_files")
def _(spark, sf):
    root = _log_files(spark, _without_sources(_binetflow_text(spark, sf)), _binetflow_name, _part())
    return tidy(logs.parse_binetflow(spark, root).select(*_FLOW_OUT))


ORACLE["binetflow_files"] = _FILE_SQL


@query("zeek_files", _ZEEK_FILE_SQL)
def _(spark, sf):
    root = _log_files(spark, _odd_zeek_lines(spark, sf), _zeek_name, _part())
    return tidy(logs.parse_zeek(spark, root).select(*_FLOW_OUT))


@query("found_files", """
SELECT DISTINCT concat('iot23-', scenario) AS scenario, concat('part-', flow_id % 16, '/conn.log.labeled') AS file FROM flows""")
def _(spark, sf):
    root = _log_files(spark, _odd_zeek_lines(spark, sf), _zeek_name, _part())
    _log_files(spark, _binetflow_text(spark, sf), _binetflow_name, _part(), root)  # other names in the same folder
    return logs.find_zeek_files(spark, root).select("scenario", F.substring_index("path", "/", -2).alias("file"))


# Six hours around both changes of the clock, in two scenarios.
_SPRING, _AUTUMN = 1711843200, 1729987200


@query("binetflow_dst_files", f"""
SELECT concat('ctu13-', scenario) AS scenario, src_ip, dst_ip, t AS start_time, t + CAST(round_even(duration_s * 1000000, 0) AS BIGINT) AS end_time
FROM (SELECT *, CASE WHEN scenario = 'sc-a' THEN CASE WHEN k < 7200 THEN ({_SPRING}::BIGINT + k - 3600) * 1000000 + f
                          WHEN k < 10800 THEN ({_SPRING}::BIGINT + 3600) * 1000000 ELSE ({_SPRING}::BIGINT + k - 7200) * 1000000 + f END
                     ELSE CASE WHEN k < 7200 THEN ({_AUTUMN}::BIGINT + k - 7200) * 1000000 + f
                          WHEN k < 10800 THEN NULL ELSE ({_AUTUMN}::BIGINT + k - 3600) * 1000000 + f END END AS t
      FROM (SELECT *, flow_id * 977 % 21600 AS k, flow_id % 1000000 AS f FROM flows WHERE flow_id % 4 <> 3))""")
def _(spark, sf):
    base = F.when(F.col("scenario") == "sc-a", F.lit(_SPRING)).otherwise(F.lit(_AUTUMN))
    wall = (base + F.col("flow_id") * 977 % 21600) * 1_000_000 + F.col("flow_id") % 1_000_000
    root = _log_files(spark, _binetflow_text(spark, sf, wall), _binetflow_name, _part())
    return tidy(logs.parse_binetflow(spark, root).select("scenario", "src_ip", "dst_ip", "start_time", "end_time"))


@query("incremental_parse", f"""
WITH z AS (SELECT *, CASE WHEN old % 16 < 10 THEN 0 ELSE 1 END AS batch FROM ({{zeek}}))
SELECT z.* EXCLUDE (old, flow_id), CAST(batch AS BIGINT) AS batch,
       CAST(row_number() OVER (PARTITION BY scenario ORDER BY batch, start_time) - 1 AS BIGINT) AS flow_id FROM z""".replace(
    "{zeek}", _ZEEK_FILE_SQL.replace("SELECT CAST(row_number()", "SELECT flow_id AS old, CAST(row_number()", 1)).replace("z.* EXCLUDE (old, flow_id), CAST(batch AS BIGINT) AS batch,", "z.* EXCLUDE (old, flow_id, batch), CAST(batch AS BIGINT) AS batch,"))
def _(spark, sf):
    """Two waves of files arrive in one folder; the second run parses the second wave only."""
    lines, store = _odd_zeek_lines(spark, sf), scratch(spark, "ingested")
    root = _log_files(spark, lines.where(_part() < 10), _zeek_name, _part())
    incremental.ingest(spark, "iot23", root, store)
    _log_files(spark, lines.where(_part() >= 10), _zeek_name, _part(), root)
    incremental.ingest(spark, "iot23", root, store)
    incremental.ingest(spark, "iot23", root, store)  # nothing new
    return tidy(incremental.read_store(spark, store).select(*_FLOW_OUT, "batch"))


@query("resume_windows", """
SELECT scenario, ws, window_idx, n_nodes, n_edges, n_bot_nodes, graph_y, CASE WHEN ws < 1705276800 THEN 0 ELSE 1 END AS run FROM graphs""")
def _(spark, sf):
    """Graphs of the days before 15 January, then, from the grown flow store, those of the others."""
    flows, path, root = V.flows(spark, sf), scratch(spark, "flows"), scratch(spark, "graphs")
    early = F.unix_seconds("start_time") < 1_705_276_800
    stores.write_flows(flows.where(early), path)
    progress.graphs_by_window(spark, path, root, V.WINDOWS, V.GRAPHS)
    stores.write_flows(flows.where(~early), path, mode="append")
    progress.graphs_by_window(spark, path, root, V.WINDOWS, V.GRAPHS)
    t = progress.read_graphs_by_window(spark, root)
    keys = ["scenario", "window_idx"]
    n = t.nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"), F.sum("y").alias("n_bot_nodes"))
    e = t.edges.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    return tidy(t.graphs.select(*keys, "window_start", "graph_y", "run").join(n, keys).join(e, keys, "left").fillna(0, ["n_edges"]))


@query("resume_sequences", """
SELECT scenario, ws, ip, count(*) AS seq_len, CASE WHEN ws < 1705276800 THEN 0 ELSE 1 END AS run FROM seq_hash GROUP BY scenario, ws, ip""")
def _(spark, sf):
    flows, path, root, seqs = V.flows(spark, sf), scratch(spark, "flows"), scratch(spark, "graphs"), scratch(spark, "sequences")
    early = F.unix_seconds("start_time") < 1_705_276_800
    for part, mode in ((early, "overwrite"), (~early, "append")):
        stores.write_flows(flows.where(part), path, mode=mode)
        progress.graphs_by_window(spark, path, root, V.WINDOWS, V.GRAPHS)
        progress.sequences_by_window(spark, path, root, seqs, V.WINDOWS, SEQ)
    stored_rows = progress.WindowProgress(spark, seqs).read("sequences")
    return tidy(stored_rows.groupBy("scenario", "window_start", "ip", "run").agg(F.count("*").alias("seq_len")))


_HUB = "CASE WHEN flow_id % 5 < 4 THEN 'hub' ELSE dst_ip END"


@query("hot_destination_pairs", f"""
SELECT scenario, ws, src_ip, dst_ip, count(*) AS flows, sum(bytes_fwd)::BIGINT AS bytes_fwd, count(DISTINCT dst_port) AS ports
FROM (SELECT * EXCLUDE (dst_ip), {_HUB} AS dst_ip FROM kept) k
WHERE EXISTS (SELECT 1 FROM sel WHERE sel.scenario = k.scenario AND sel.ws = k.ws AND sel.ip = k.src_ip)
GROUP BY scenario, ws, src_ip, dst_ip HAVING dst_ip = 'hub'""")
def _(spark, sf):
    """Four of five flows go to one host; its key is split in the endpoint join."""
    flows = windowed(spark, sf).withColumn("dst_ip", F.expr(_HUB))
    hub = windowed(spark, sf).select(*W.WIN).distinct().withColumns({"ip": F.lit("hub"), "node_idx": F.lit(-1)})
    nodes = selected(spark, sf).select(*W.WIN, "ip", "node_idx").unionByName(hub)
    joined = G.with_node_index(G.port_table(flows), nodes, split_hot=True).where("dst_ip = 'hub' AND src_ip <> 'hub'")
    return tidy(G.pair_table(joined).select("scenario", "window_start", "src_ip", "dst_ip", F.col("n_flows").alias("flows"),
                                           F.col("bytes_fwd").cast("bigint").alias("bytes_fwd"), F.col("distinct_dst_ports").alias("ports")))
