"""Incremental log folders, stores that grow by window, split hot keys."""

import datetime as dt

import pytest
from helpers import flow, table
from pyspark.sql import functions as F
from test_logs import HEADER, ROWS, _zeek

from flowloom import fixed
from flowloom.config import GraphConfig, SequenceConfig, WindowConfig
from flowloom.operators import graph as G
from flowloom.sources import incremental, logs, progress, stores

WIN_CFG, CFG = WindowConfig(300, None, 1, 2), GraphConfig(min_flows_per_node=1)


def put(root, scenario, name, lines):
    d = root / f"CTU-IoT-Malware-Capture-{scenario}" / name
    d.mkdir(parents=True)
    (d / "conn.log.labeled").write_text("\n".join(lines) + "\n")


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_new_files_are_parsed_once_and_ids_go_on(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "store")
    put(src, "1-1", "a", ["#x", _zeek(ts="1525879832.0"), _zeek(ts="1525879831.0")])
    put(src, "2-1", "a", [_zeek(ts="1525879840.0")])
    assert incremental.ingest(spark, "iot23", str(src), root) == 1
    first = content(incremental.read_store(spark, root))
    assert incremental.ingest(spark, "iot23", str(src), root) == 0
    assert content(incremental.read_store(spark, root)) == first
    put(src, "1-1", "b", [_zeek(ts="1525879800.0"), _zeek(ts="1525879900.0")])
    assert incremental.ingest(spark, "iot23", str(src), root) == 1
    df = incremental.read_store(spark, root)
    ids = [(r.scenario, r.flow_id, r.batch) for r in df.orderBy("scenario", "flow_id").collect()]
    assert ids == [("iot23-1-1", 0, 0), ("iot23-1-1", 1, 0), ("iot23-1-1", 2, 1), ("iot23-1-1", 3, 1), ("iot23-2-1", 0, 0)]
    whole = logs.parse_zeek(spark, str(src))
    assert content(df.drop("flow_id", "batch")) == content(whole.drop("flow_id"))


def test_small_batches_give_the_same_rows(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        put(src, "1-1", f"p{k}", [_zeek(ts=f"15258798{k}{j}.0") for j in range(4)])
    assert incremental.ingest(spark, "iot23", str(src), str(tmp_path / "store"), files_per_batch=1) == 3
    df = incremental.read_store(spark, str(tmp_path / "store"))
    assert [r.flow_id for r in df.orderBy("flow_id").collect()] == list(range(12))
    known = incremental.ranges(spark, str(tmp_path / "store")).orderBy("batch").collect()
    assert [(r.batch, r.rows, r.first_id, r.last_id) for r in known] == [(0, 4, 0, 3), (1, 4, 4, 7), (2, 4, 8, 11)]


def test_a_broken_batch_is_taken_again(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "in", str(tmp_path / "store")
    put(src, "1-1", "a", [_zeek(ts="1525879832.0")])
    incremental.ingest(spark, "iot23", str(src), root)
    put(src, "1-1", "b", [_zeek(ts="1525879900.0")])
    real = incremental.exists

    def broken(session, path):
        if path.endswith("/flows"):
            raise RuntimeError("lost between flows and ranges")
        return real(session, path)

    monkeypatch.setattr(incremental, "exists", broken)
    with pytest.raises(Exception, match="lost between"):
        incremental.ingest(spark, "iot23", str(src), root)
    monkeypatch.setattr(incremental, "exists", real)
    assert incremental.read_store(spark, root).count() == 1  # the half batch is not visible
    put(src, "1-1", "c", [_zeek(ts="1525879950.0")])
    incremental.ingest(spark, "iot23", str(src), root)
    rows = incremental.read_store(spark, root).orderBy("flow_id").collect()
    assert [(r.flow_id, r.batch) for r in rows] == [(0, 0), (1, 1), (2, 2)]


def test_every_header_is_checked(spark, tmp_path):
    (tmp_path / "in" / "10").mkdir(parents=True)
    good, bad = tmp_path / "in" / "10" / "a.binetflow", tmp_path / "in" / "10" / "b.binetflow"
    good.write_text("\n".join([HEADER, *ROWS[:3]]) + "\n")
    # State is read by no later step; its name counts all the same.
    bad.write_text("\n".join([HEADER.replace("State", "Status"), *ROWS[3:]]) + "\n")
    root = str(tmp_path / "store")
    with pytest.raises(Exception):
        incremental.ingest(spark, "ctu13", str(tmp_path / "in"), root)
    assert incremental.read_store(spark, root).count() == 0
    with pytest.raises(Exception):
        logs.parse_binetflow(spark, str(tmp_path / "in")).count()
    bad.write_text("\n".join([HEADER, *ROWS[3:]]) + "\n")
    incremental.ingest(spark, "ctu13", str(tmp_path / "in"), root)
    df = incremental.read_store(spark, root)
    assert [r.flow_id for r in df.orderBy("flow_id").collect()] == [0, 1, 2] and df.columns == [*fixed.FLOW_COLUMNS, "batch"]


def test_time_ranges_skip_batches(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "store")
    for k, day in enumerate((0, 86400, 172800)):
        put(src, "1-1", f"p{k}", [_zeek(ts=f"{1525824000 + day + 5}.0")])
        incremental.ingest(spark, "iot23", str(src), root)
    start = dt.datetime(2018, 5, 10, tzinfo=dt.timezone.utc)
    some = incremental.read_store(spark, root, start, start + dt.timedelta(days=1))
    assert [r.batch for r in some.collect()] == [1]
    assert incremental.read_store(spark, str(tmp_path / "nothing")).count() == 0


def window_flows(spark, windows, scenario="s", hosts=4, first_id=0):
    rows = [(w, i) for w in windows for i in range(12)]
    return table(spark, [flow(first_id + k, f"h{i % hosts}", f"h{(i + 1) % hosts}", 300 * w + i, scenario=scenario, port=i % 3, label="bot" if i == w else "benign")
                         for k, (w, i) in enumerate(rows)])


def graphs(spark, root):
    t = progress.read_graphs_by_window(spark, root)
    return content(t.nodes.drop("run")), content(t.edges.drop("run")), content(t.graphs.drop("run"))


def test_windows_are_built_once(spark, tmp_path):
    path, root, once = (str(tmp_path / x) for x in ("flows", "graphs", "once"))
    stores.write_flows(window_flows(spark, [0, 2]), path)
    assert progress.graphs_by_window(spark, path, root, WIN_CFG, CFG) == 2
    assert progress.graphs_by_window(spark, path, root, WIN_CFG, CFG) == 0
    # A window in between, one of another scenario, and one too small for a graph.
    stores.write_flows(window_flows(spark, [1], first_id=100), path, mode="append")
    stores.write_flows(window_flows(spark, [1], "t"), path, mode="append")
    stores.write_flows(table(spark, [flow(500, "a", "a", 300 * 7)]), path, mode="append")
    assert progress.graphs_by_window(spark, path, root, WIN_CFG, CFG) == 3
    assert progress.graphs_by_window(spark, path, root, WIN_CFG, CFG) == 0  # the small one is finished as well
    state = {(r.scenario, r.window_start.minute): (r.built, r.run) for r in progress.WindowProgress(spark, root).finished().collect()}
    assert state == {("s", 0): (True, 0), ("s", 10): (True, 0), ("s", 5): (True, 1), ("t", 5): (True, 1), ("s", 35): (False, 1)}
    assert progress.graphs_by_window(spark, path, once, WIN_CFG, CFG) == 5
    assert graphs(spark, root) == graphs(spark, once)


@pytest.mark.parametrize("table_that_breaks", ["edges"])
def test_a_crash_between_two_tables_leaves_no_half_window(spark, tmp_path, monkeypatch, table_that_breaks):
    path, root, once = (str(tmp_path / x) for x in ("flows", "graphs", "once"))
    stores.write_flows(window_flows(spark, [0]), path)
    progress.graphs_by_window(spark, path, root, WIN_CFG, CFG)
    before = graphs(spark, root)
    stores.write_flows(window_flows(spark, [1, 2], first_id=100), path, mode="append")
    real = progress.WindowProgress.write

    def broken(self, df, name, run):
        real(self, df, name, run)
        if name == table_that_breaks:
            raise RuntimeError("lost")

    monkeypatch.setattr(progress.WindowProgress, "write", broken)
    with pytest.raises(RuntimeError, match="lost"):
        progress.graphs_by_window(spark, path, root, WIN_CFG, CFG)
    assert graphs(spark, root) == before
    monkeypatch.setattr(progress.WindowProgress, "write", real)
    assert progress.graphs_by_window(spark, path, root, WIN_CFG, CFG) == 2
    progress.graphs_by_window(spark, path, once, WIN_CFG, CFG)
    assert graphs(spark, root) == graphs(spark, once)


def test_sequences_follow_the_graphs(spark, tmp_path):
    path, root, seqs = (str(tmp_path / x) for x in ("flows", "graphs", "seqs"))
    cfg = SequenceConfig(max_flows=4)
    stores.write_flows(window_flows(spark, [0]), path)
    progress.graphs_by_window(spark, path, root, WIN_CFG, CFG)
    assert progress.sequences_by_window(spark, path, root, seqs, WIN_CFG, cfg) == 1
    stores.write_flows(window_flows(spark, [1], first_id=100), path, mode="append")
    progress.graphs_by_window(spark, path, root, WIN_CFG, CFG)
    assert progress.sequences_by_window(spark, path, root, seqs, WIN_CFG, cfg) == 1
    assert progress.sequences_by_window(spark, path, root, seqs, WIN_CFG, cfg) == 0
    per_run = progress.WindowProgress(spark, seqs).read("sequences").groupBy("run").count().orderBy("run").collect()
    assert [tuple(r) for r in per_run] == [(0, 16), (1, 16)]


def test_finished_windows_are_no_exchange_of_flows(spark, tmp_path):
    path, root = str(tmp_path / "flows"), str(tmp_path / "graphs")
    stores.write_flows(window_flows(spark, [0, 1]), path)
    progress.graphs_by_window(spark, path, root, WIN_CFG, CFG)
    p = progress.WindowProgress(spark, root)
    flows = stores.read_flows(spark, path)
    narrow = progress._narrowed(flows, p.finished(), WIN_CFG)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(scenario" in plan and "PushedFilters: [IsNotNull(start_time), GreaterThanOrEqual(start_time" in plan


def test_a_hot_destination_is_no_single_task(spark):
    keys = [*G.WIN, "dst_ip"]
    rows = spark.range(40_000).selectExpr("'s' AS scenario", "timestamp_seconds(0) AS window_start", "concat('h', id % 5000) AS src_ip",
                                         "CASE WHEN id % 5 < 4 THEN 'hub' ELSE concat('h', id % 700) END AS dst_ip", "id").repartition(8)
    side = rows.select(*G.WIN, "dst_ip").distinct().withColumn("dst_idx", F.hash("dst_ip")).where("dst_ip <> 'h3'")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k in old:
            spark.conf.set(k, "-1" if "Broadcast" in k else "false")
        plain, split = rows.join(side, keys), G.join_splitting_hot(rows, side, keys)
        share = lambda df: df.groupBy(F.spark_partition_id()).count().agg((F.max("count") / F.sum("count")).alias("s")).first().s
        assert share(plain) > 0.79 and share(split) < 0.25
        assert content(split.select(*plain.columns)) == content(plain)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    with_null = rows.withColumn("dst_ip", F.when(F.col("id") % 2 == 0, F.col("dst_ip")))
    assert G.join_splitting_hot(with_null, side, keys).count() == with_null.join(side, keys).count()
    assert G.join_splitting_hot(rows.limit(0), side, keys).count() == 0
    nodes = rows.select(*G.WIN, F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().withColumn("node_idx", F.hash("ip"))
    assert content(G.with_node_index(rows, nodes, split_hot=True)) == content(G.with_node_index(rows, nodes).select(*G.with_node_index(rows, nodes, split_hot=True).columns))


def test_graph_rows_are_counted_from_the_written_tables(spark, tmp_path, monkeypatch):
    """The third table of a run does not aggregate the flows again; its rows are those of a plain build."""
    path, root = f"{tmp_path}/flows", f"{tmp_path}/graphs"
    stores.write_flows(window_flows(spark, [0, 1, 2]), path)
    plans, write = {}, progress.WindowProgress.write
    monkeypatch.setattr(progress.WindowProgress, "write", lambda self, df, table, run: plans.update(
        {table: df._jdf.queryExecution().optimizedPlan().toString()}) or write(self, df, table, run))
    progress.graphs_by_window(spark, path, root, WIN_CFG, CFG)
    assert "bytes_fwd" in plans["edges"] and "bytes_fwd" not in plans["graphs"]
    columns = ["scenario", "window_start", "n_nodes", "n_edges", "n_bot_nodes", "graph_y", "window_idx"]
    want = G.build_graphs(stores.read_flows(spark, path), WIN_CFG, CFG).graphs.select(*columns)
    got = progress.read_graphs_by_window(spark, root).graphs.select(*columns)
    assert got.count() == 3 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
