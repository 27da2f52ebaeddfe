import math

import pytest
from pyspark.sql import functions as F

from flowloom.config import GraphConfig, WindowConfig
from flowloom.operators import graph as G, windows as W
from flowloom.plans import views as V
from helpers import flow, table, two_windows

WIN = WindowConfig(300, None, 5, 2)


def test_window_counts(spark):
    f = W.assign_windows(two_windows(spark), WIN)
    sizes = W.window_sizes(W.host_activity(f))
    idx = W.number_windows(W.large_enough(sizes, WIN)).orderBy("window_start").collect()
    assert [(r["window_idx"], r["n_flows"], r["n_hosts"]) for r in idx] == [(0, 30, 4), (1, 30, 4)]
    assert W.large_enough(sizes, WindowConfig(300, None, 31, 2)).isEmpty()
    assert W.large_enough(sizes, WindowConfig(300, None, 5, 5)).isEmpty()


def test_graph_values(spark):
    b = G.build_graphs(two_windows(spark), WIN, GraphConfig(1))
    first = {r["ip"]: r for r in b.nodes.where(F.unix_seconds("window_start") == 1577836800).collect()}
    assert sorted(first) == ["10.0.0.1", "10.0.0.2", "10.0.0.3", "8.8.8.8"]
    assert [first[ip]["y"] for ip in sorted(first)] == [1, 1, 0, 0]
    n = first["10.0.0.1"]
    assert (n["fan_out"], n["fan_in"], n["port_entropy"], n["protocol_entropy"]) == (1, 1, 0, 0)
    assert (n["byte_rate"], n["packet_rate"], n["avg_flow_duration"]) == (100, 1, 0.5)
    assert n["out_in_ratio"] == pytest.approx(0.5) and n["log1p_total_flows"] == pytest.approx(math.log(11))
    e = b.edges.where("src_ip = '10.0.0.1'").first()
    assert (e["total_bytes"], e["total_packets"], e["distinct_dst_ports"], e["mean_flow_duration"], e["mean_iat_ms"], e["proto_tcp"]) == (
        15000, 150, 1, 0.5, 0, 1)
    assert [(r["n_nodes"], r["n_edges"], r["graph_y"]) for r in b.graphs.orderBy("window_idx").collect()] == [(4, 3, 1), (4, 2, 0)]


def test_node_cap_and_zero_rows(spark):
    b = G.build_graphs(two_windows(spark), WIN, GraphConfig(1, 3))
    assert b.graphs.agg(F.max("n_nodes")).first()[0] == 3
    # 8.8.8.8 lost its slot in window 1: 10.0.0.3 keeps a row of zeros.
    row = b.nodes.where("ip = '10.0.0.3'").first()
    assert row["log1p_total_flows"] == 0 and row["y"] == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_shared_and_broadcast_builds_agree(spark, sf, limit):
    flows = V.flows(spark, sf)
    plain = G.build_graphs(flows, V.WINDOWS, V.GRAPHS)
    shared = G.GraphBuild(flows, V.WINDOWS, V.GRAPHS, share=True, broadcast_nodes=limit)

    def r(df):
        return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    for name in ("nodes", "edges", "graphs"):
        a, b = r(getattr(plain, name)), r(getattr(shared, name))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name
    shared.release()


def test_self_flow_counts_twice_and_in_both_roles(spark):
    df = table(spark, [flow(i, "a", "a", i) for i in range(3)] + [flow(9, "b", "a", 5)])
    w = W.assign_windows(df, WindowConfig(300, None, 1, 1))
    act = {r["ip"]: r["activity"] for r in W.host_activity(w).collect()}
    assert act == {"a": 7, "b": 1}
    nodes = G.select_nodes(W.host_activity(w), WindowConfig(300, None, 1, 1), GraphConfig(1))
    a = G.compute_node_features(w, nodes, 300).where("ip = 'a'").first()
    assert a["byte_rate"] == pytest.approx((3 * 2 + 1) * 1500 / 300) and a["fan_in"] == 2 and a["fan_out"] == 1


def test_dominant_protocol_tie_goes_to_the_first_flow(spark):
    df = table(spark, [flow(0, "a", "b", 0, proto="udp"), flow(1, "a", "b", 1, proto="tcp"),
                       flow(2, "a", "b", 2, proto="tcp"), flow(3, "a", "b", 3, proto="udp")])
    p = G.pair_table(G.port_table(W.assign_windows(df, WIN)))
    assert p.select(G.dominant_protocol()).first()[0] == "udp"


def test_no_eligible_node_leaves_no_gap(spark):
    rows = [flow(i, "a", "b", i) for i in range(5)]
    rows += [flow(10 + i, f"x{i}", f"y{i}", 300 + i) for i in range(5)]     # every host once
    rows += [flow(20 + i, "a", "b", 600 + i) for i in range(5)]
    b = G.build_graphs(table(spark, rows), WindowConfig(300, None, 5, 2), GraphConfig(3))
    assert [(r["window_idx"], r["window_start"].minute) for r in b.graphs.orderBy("window_idx").collect()] == [(0, 0), (1, 10)]


def test_sliding_windows_start_at_the_first_flow(spark):
    df = table(spark, [flow(0, "a", "b", 310), flow(1, "a", "b", 500), flow(2, "a", "b", 910)])
    got = W.assign_windows(df, WindowConfig(300, 150, 1, 1)).select("flow_id", (F.unix_seconds("window_start") - 1577836800).alias("w"))
    assert sorted(map(tuple, got.collect())) == [(0, 300), (1, 300), (1, 450), (2, 750), (2, 900)]


def test_rows_without_time_fall_in_no_window(spark):
    df = two_windows(spark).withColumn("start_time", F.when(F.col("flow_id") > 0, F.col("start_time")))
    assert W.assign_windows(df, WIN).count() == 59
    assert W.assign_windows(df, WindowConfig(300, 150)).where("flow_id = 0").isEmpty()


def test_time_filter_reaches_the_scan(spark, tmp_path):
    from flowloom.sources import stores

    stores.write_flows(two_windows(spark), str(tmp_path / "f"))
    df = W.in_time_range(W.drop_background(stores.read_flows(spark, str(tmp_path / "f"))), "2020-01-01", "2020-01-02")
    plan = df.where("scenario = 's'").select("src_ip")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(start_time" in plan and "PartitionFilters: [isnotnull(scenario" in plan
    assert "bytes_fwd" not in plan
