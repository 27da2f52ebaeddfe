import json

import pytest
from pyspark.sql import functions as F

from flowloom.config import GraphConfig, SequenceConfig, SplitSpec
from flowloom.operators import metrics as M, models, neighbourhood as N
from flowloom.operators.graph import build_graphs
from flowloom.plans import jobs, views as V
from flowloom.sources import stores
from flowloom.streaming import edges as stream


def r(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])


def same(a, b):
    return r(a).exceptAll(r(b)).isEmpty() and r(b).exceptAll(r(a)).isEmpty()


def test_full_run_and_resume(spark, sf, tmp_path):
    flow_path, graphs, seqs = (str(tmp_path / x) for x in ("flows", "graphs", "seqs"))
    flows = V.flows(spark, sf)
    stores.write_flows(flows, flow_path, validate=True)
    jobs.graphs_job(spark, flow_path, graphs, V.WINDOWS, V.GRAPHS)
    b = build_graphs(flows, V.WINDOWS, V.GRAPHS)
    stored = stores.read_graphs(spark, graphs)
    assert same(stored.nodes.drop("window_idx"), b.nodes) and same(stored.graphs, b.graphs)
    before = stored.nodes.count()
    jobs.graphs_job(spark, flow_path, graphs, V.WINDOWS, V.GRAPHS, skip_existing=True)
    assert stores.read_graphs(spark, graphs).nodes.count() == before
    jobs.sequences_job(spark, flow_path, graphs, seqs, V.WINDOWS, SequenceConfig(8))
    assert spark.read.parquet(seqs).groupBy("scenario", "window_start", "ip").count().agg(F.max("count")).first()[0] <= 8
    spec = SplitSpec(train_scenarios=("sc-a",), holdout_test_scenarios=("sc-b",))
    nodes, edges = jobs.scaled_split(spark, graphs, spec, "train")
    assert abs(nodes.agg(F.avg("fan_in")).first()[0]) < 1e-9 and edges.count() > 0


def test_overwrite_replaces_only_the_written_scenario(spark, sf, tmp_path):
    p, flows = str(tmp_path / "f"), V.flows(spark, sf)
    stores.write_flows(flows, p)
    stores.write_flows(flows.where("scenario = 'sc-a' AND flow_id < 10"), p)
    n = {x["scenario"]: x["count"] for x in stores.read_flows(spark, p).groupBy("scenario").count().collect()}
    assert n == {"sc-a": 5, "sc-b": 500}


def test_result_files(spark, tmp_path):
    doc = {"model": "m", "fit_seconds": 1.5, "test": {"n": 4, "n_pos": 2, "f1": 0.5, "tp": 1, "fp": 1, "fn": 1, "tn": 1},
           "test_per_scenario": {"a-1": {"n": 4, "n_pos": 2, "f1": 0.5, "pr_auc": None}}}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    from flowloom.operators import reports

    runs = stores.read_results(spark, str(tmp_path))
    listed = stores.listing(spark, [("One", "logs/one.json", "c"), ("Two", "two.json", "c")])
    table = {x["label"]: x for x in reports.result_table(listed, runs, ["a-1"]).collect()}
    assert table["One"]["f1"] == 0.5 and table["One"]["a_1_f1"] == 0.5 and not table["One"]["missing"]
    assert table["Two"]["missing"] and table["Two"]["f1"] is None
    cat = reports.by_category(reports.result_table(listed, runs)).first()
    assert (cat["runs"], cat["missing"], cat["best_f1"]) == (2, 1, 0.5)
    values = reports.unpivot_metrics(runs.withColumn("tag", F.col("model")), ["f1", "recall"])
    side = {x["metric"]: x for x in reports.side_by_side(values, ["m"]).collect()}
    assert side["f1"]["m"] == 0.5 and side["f1"]["std"] == 0 and side["recall"]["mean"] is None


def test_result_document_round_trip(spark, sf, tmp_path):
    s = V.scored(spark, sf)
    e = M.evaluate(s)
    stores.write_metrics(stores.result_document("m", e, e, M.evaluate_per_scenario(s), 2.0), str(tmp_path / "r"))
    back = stores.read_results(spark, str(tmp_path / "r")).first()
    assert back["test"]["n"] == s.count() and set(back["test_per_scenario"]) == {"F", "O"}


def test_stream_equals_batch(spark, sf, tmp_path):
    f = V.flows(spark, sf)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for day in (1, 2, 3):   # three files, three micro-batches
        f.where(F.dayofmonth("start_time") % 3 == day % 3).coalesce(1).write.mode("append").parquet(src)
    end = f.limit(1).withColumns({"start_time": F.lit("2030-01-01").cast("timestamp"), "label": F.lit("benign"), "scenario": F.lit("end")})
    end.coalesce(1).write.mode("append").parquet(src)
    q = stream.run_available(stream.edge_stream(stream.flow_stream(spark, src, 1), V.WINDOWS, "40 days"), out, state)
    q.awaitTermination()
    got = spark.read.parquet(out).where("scenario <> 'end'")
    assert same(got, stream.edge_stream(f, V.WINDOWS)) and got.count() > 0
    # A restart finds nothing new.
    n = spark.read.parquet(out).count()
    stream.run_available(stream.edge_stream(stream.flow_stream(spark, src, 1), V.WINDOWS, "40 days"), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == n


def test_mixing(spark):
    rows = [("s", 0, i, 1 if i < 3 else 0, float(i), [float(i), 1.0]) for i in range(8)]
    rows += [("s", 1, i, 1, float(i), [0.0, 0.0]) for i in range(4)] + [("s", 2, 0, 1, 1.0, [0.0, 0.0]), ("s", 2, 1, 0, 1.0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "scenario string, window_idx int, node_idx int, y int, x double, v array<double>")
    k = ("scenario", "window_idx")
    for beta in (1, 3):
        m = N.mix_positives(df, ["x"], ["v"], beta=beta, keys=k)
        mixed = m.where("mixed").collect()
        assert {(q["window_idx"], q["node_idx"]) for q in mixed} == {(0, 0), (0, 1), (0, 2)}
        assert all(0 <= q["x"] <= 2 and q["v"][0] == pytest.approx(q["x"]) and q["v"][1] == pytest.approx(1) for q in mixed)
    assert m.where("NOT mixed").count() == 11
    assert N.mix_positives(df, ["x"], mix_prob=0.0, keys=k).select("x").exceptAll(df.select("x")).isEmpty()


def test_masks_cover_every_sequence(spark):
    df = spark.range(3000).select((F.col("id") % 500).alias("ip"), F.floor(F.col("id") / 500).cast("int").alias("pos"))
    m = N.mask_positions(df, keys=("ip",))
    assert m.groupBy("ip").agg(F.sum(F.col("masked").cast("int")).alias("n")).where("n = 0").isEmpty()
    assert 0.1 < m.agg(F.avg(F.col("masked").cast("int"))).first()[0] < 0.3


def test_models(spark, sf):
    nodes = build_graphs(V.flows(spark, "/root/testdata/sf0.01"), V.WINDOWS, V.GRAPHS).nodes.persist()
    train, test = models.stratified_split(nodes)
    assert test.count() == sum(round(x["count"] * 0.25) for x in nodes.groupBy("y").count().collect())
    model = models.fit_forest(train, trees=5, depth=5)
    e = M.evaluate(models.score_table(model, test)).first()
    assert 0.4 < e["roc_auc"] <= 1
    imp = models.importances(spark, model).collect()
    assert sum(x["importance"] for x in imp) == pytest.approx(1) and imp[0]["importance"] >= imp[-1]["importance"]
    assert models.sanity_check(nodes.where("y = 0"), trees=2, depth=2) is None
    nodes.unpersist()


@pytest.mark.parametrize("partitions", [1, 13])
def test_results_do_not_depend_on_partitions(spark, sf, partitions):
    f = V.flows(spark, sf)
    a = build_graphs(f, V.WINDOWS, GraphConfig(3, 5))
    b = build_graphs(f.repartition(partitions), V.WINDOWS, GraphConfig(3, 5))
    assert same(a.nodes, b.nodes) and same(a.edges, b.edges)
