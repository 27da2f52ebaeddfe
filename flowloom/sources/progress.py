"""Graph and sequence stores that grow window by window.

A run takes the windows that no finished run has looked at, writes their rows
under its own number, and commits last by listing those windows, with and
without a graph, in a manifest. A run without a complete manifest does not
exist for readers and its rows are deleted by the next one, so a crash between
two tables leaves neither half a window nor a doubled one. Window numbers are
given on reading, dense over all built graphs, whatever run built them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.config import GraphConfig, SequenceConfig, WindowConfig
from flowloom.functions.ordered import small_side
from flowloom.operators.graph import BROADCAST_NODES, GraphBuild, GraphTables, graph_table, with_window_idx
from flowloom.operators.sequences import build_sequences
from flowloom.operators.windows import WIN, assign_windows, drop_background, number_windows
from flowloom.session import cut_lineage, delete, stages
from flowloom.sources import stores

MANIFEST = "scenario string, window_start timestamp, n_flows bigint, built boolean"
FEW_SCENARIOS = 1000


class WindowProgress:
    """The runs of one store. One job at a time writes it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _folders(self, table: str) -> list[str]:
        """Runs that have a folder in ``table``; names only, one per run."""
        if not stores.exists(self.spark, f"{self.root}/{table}"):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("run="))

    def runs(self) -> list[str]:
        """Finished runs: their manifest carries the mark that Spark writes last."""
        return [r for r in self._folders("windows") if stores.exists(self.spark, f"{self.root}/windows/{r}/_SUCCESS")]

    def read(self, table: str) -> DataFrame | None:
        """Rows of the finished runs with their number ``run``; folders of others are not listed."""
        paths = [f"{self.root}/{table}/{r}" for r in self.runs() if stores.exists(self.spark, f"{self.root}/{table}/{r}")]
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths) if paths else None

    def finished(self) -> DataFrame:
        found = self.read("windows")
        return self.spark.createDataFrame([], MANIFEST + ", run int") if found is None else found

    def pending(self, windows: DataFrame) -> DataFrame:
        """Windows (one row each) that no finished run has looked at."""
        return windows.join(small_side(self.finished().select(*WIN)), WIN, "left_anti")

    def open(self, tables: tuple[str, ...]) -> str:
        """The folder name of a new run; rows of runs that broke off are deleted."""
        done = self.runs()
        for table in (*tables, "windows"):
            for run in set(self._folders(table)) - set(done):
                delete(self.spark, f"{self.root}/{table}/{run}")
        return f"run={len(done):06d}"

    def write(self, df: DataFrame, table: str, run: str) -> None:
        df.hint("rebalance", "scenario").write.mode("overwrite").partitionBy("scenario").parquet(f"{self.root}/{table}/{run}")

    def commit(self, windows: DataFrame, run: str) -> None:
        windows.selectExpr("scenario", "window_start", "n_flows", "built").write.parquet(f"{self.root}/windows/{run}")


def _narrowed(flows: DataFrame, pending: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Flows of the folders and times that pending windows touch, as literals for the scan."""
    b = pending.agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi")).first()
    names = [r.scenario for r in pending.select("scenario").distinct().limit(FEW_SCENARIOS + 1).collect()]
    if len(names) <= FEW_SCENARIOS:
        flows = flows.where(F.col("scenario").isin(names))
    if cfg.stride != cfg.window_s:
        return flows  # the first window depends on a scenario's earliest flow
    end = F.lit(b.hi) + F.make_dt_interval(secs=F.lit(cfg.window_s))
    return flows.where((F.col("start_time") >= F.lit(b.lo)) & (F.col("start_time") < end))


def _windows(flows: DataFrame, cfg: WindowConfig, keep_background: bool) -> DataFrame:
    used = flows if keep_background else drop_background(flows)
    return assign_windows(used, cfg).groupBy(*WIN).agg(F.count("*").alias("n_flows"))


def graphs_by_window(spark: SparkSession, flow_path: str, root: str, win_cfg: WindowConfig | None = None,
                     cfg: GraphConfig | None = None, keep_background: bool = False) -> int:
    """Build the graphs of all windows that ``root`` has not finished; returns their number.

    A window counts as finished with the flows it had then: flows that arrive
    for it later do not reopen it. With a stride, windows start from a
    scenario's earliest flow, which must stay the same between runs.
    """
    win_cfg, progress = win_cfg or WindowConfig(), WindowProgress(spark, root)
    flows = stores.read_flows(spark, flow_path)
    with stages(spark):
        # One count per window and task leaves the scan; flows are not shuffled for it.
        pending = cut_lineage(progress.pending(_windows(flows, win_cfg, keep_background)))
        todo = pending.count()
        if not todo:
            return 0
        run = progress.open(("nodes", "edges", "graphs"))
        tables = GraphBuild(_narrowed(flows, pending, win_cfg), win_cfg, cfg, keep_background, share=True,
                            only=small_side(pending.select(*WIN)))
        try:
            progress.write(tables.nodes, "nodes", run)
            progress.write(tables.edges, "edges", run)
            # Sizes and labels are counted from what was just written: aggregating the
            # flows' table to pairs and roles once more would cost as much as either table.
            stored = graph_table(stores.read_parts(spark, f"{root}/nodes/{run}", "scenario string, window_start timestamp, y int"),
                                 stores.read_parts(spark, f"{root}/edges/{run}", "scenario string, window_start timestamp"))
            progress.write(stored.drop("window_idx"), "graphs", run)
        finally:
            tables.release()
        built = stores.read_parts(spark, f"{root}/graphs/{run}", "scenario string, window_start timestamp")
        progress.commit(pending.join(built.withColumn("_b", F.lit(True)), WIN, "left").withColumn("built", F.coalesce("_b", F.lit(False))), run)
    return todo


def read_graphs_by_window(spark: SparkSession, root: str) -> GraphTables:
    """All finished graphs with dense window numbers, and the ``run`` that built each."""
    progress = WindowProgress(spark, root)
    graphs = number_windows(progress.read("graphs"))
    slim = small_side(graphs.select(*WIN, "window_idx"))
    return GraphTables(with_window_idx(progress.read("nodes"), slim), with_window_idx(progress.read("edges"), slim), graphs)


def sequences_by_window(spark: SparkSession, flow_path: str, graph_root: str, root: str, win_cfg: WindowConfig | None = None,
                        cfg: SequenceConfig | None = None, keep_background: bool = False) -> int:
    """Build the sequences of the finished graphs whose windows ``root`` has not finished; returns their number."""
    win_cfg, progress = win_cfg or WindowConfig(), WindowProgress(spark, root)
    source = WindowProgress(spark, graph_root)
    with stages(spark):
        pending = cut_lineage(progress.pending(source.finished().where("built").select(*WIN, "n_flows")))
        todo = pending.count()
        if not todo:
            return 0
        run = progress.open(("sequences",))
        only = small_side(pending.select(*WIN))
        nodes = source.read("nodes").join(only, WIN, "left_semi")
        flows = _narrowed(stores.read_flows(spark, flow_path), pending, win_cfg)
        windowed = assign_windows(flows if keep_background else drop_background(flows), win_cfg).join(only, WIN, "left_semi")
        few = nodes.count() <= BROADCAST_NODES
        progress.write(build_sequences(windowed, nodes, win_cfg, cfg, few_nodes=few), "sequences", run)
        progress.commit(pending.withColumn("built", F.lit(True)), run)
    return todo
