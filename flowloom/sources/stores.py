"""Parquet and JSON stores of the stages, partitioned by scenario."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowloom import fixed
from flowloom.operators.graph import GraphBuild, GraphTables, with_window_idx
from flowloom.operators.sequences import attach
from flowloom.operators.windows import WIN
from flowloom.schema import FLOW_SCHEMA, validate_flow_df

_METRICS = T.StructType([
    T.StructField(n, t) for n, t in [
        ("n", T.LongType()), ("n_pos", T.LongType()),
        *[(m, T.DoubleType()) for m in ("accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc")],
        *[(m, T.LongType()) for m in ("tn", "fp", "fn", "tp")]]])
RESULT_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("fit_seconds", T.DoubleType()),
    T.StructField("params", T.LongType()), T.StructField("val", _METRICS), T.StructField("test", _METRICS),
    T.StructField("test_per_scenario", T.MapType(T.StringType(), T.StructType([
        T.StructField(m, T.DoubleType()) for m in ("n", "n_pos", "f1", "pr_auc")])))])


def _write(df: DataFrame, path: str, mode: str) -> None:
    """Partitioned write; ``overwrite`` replaces only the scenarios in ``df``.

    Rows are rebalanced by scenario first: adaptive execution cuts a large
    scenario into many files and packs small ones together.
    """
    (df.hint("rebalance", "scenario").write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("scenario").parquet(path))


def write_flows(flows: DataFrame, path: str, mode: str = "overwrite", validate: bool = False,
                in_slabs: bool = False) -> None:
    """Store a flow table sorted by start within each scenario.

    Range partitioning by (scenario, start) gives files with narrow time
    ranges, so window filters skip files and row groups; a large scenario is
    many files, a small one shares a task. Rows fresh from id assignment lie in
    such ranges already (``in_slabs``) and are only sorted within their task.
    """
    if validate:
        validate_flow_df(flows)
    order = ["scenario", "start_time", "flow_id"]
    ranged = flows if in_slabs else flows.repartitionByRange(*order)
    (ranged.sortWithinPartitions(*order)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("scenario").parquet(path))


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow table in canonical column order; scenario filters prune folders."""
    return spark.read.schema(FLOW_SCHEMA).parquet(path).select(*fixed.FLOW_COLUMNS)


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Some columns of one stored table; no rows if nothing was written."""
    return spark.read.schema(schema).parquet(path)


def write_graphs(tables: GraphTables | GraphBuild, root: str, mode: str = "overwrite") -> None:
    """Store nodes, edges and graphs. ``graphs`` comes last: a scenario counts
    as complete once its graph rows are there."""
    _write(with_window_idx(tables.nodes, tables.graphs), f"{root}/nodes", mode)
    _write(with_window_idx(tables.edges, tables.graphs), f"{root}/edges", mode)
    _write(tables.graphs, f"{root}/graphs", mode)


def read_graphs(spark: SparkSession, root: str, scenarios: Sequence[str] | None = None) -> GraphTables:
    def table(name):
        df = spark.read.parquet(f"{root}/{name}")
        return df if scenarios is None else df.where(F.col("scenario").isin(list(scenarios)))

    return GraphTables(table("nodes"), table("edges"), table("graphs"))


def write_sequences(sequences: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write(sequences, path, mode)


def attach_sequences(spark: SparkSession, nodes: DataFrame, path: str) -> DataFrame:
    """Stored sequences joined to nodes as arrays; every node must be stored."""
    return attach(nodes, spark.read.parquet(path))


def widen_embeddings(emb: DataFrame, dim: int, column: str = "emb") -> DataFrame:
    """Vector column -> ``dim_000, dim_001, ...``."""
    return emb.select(*[c for c in emb.columns if c != column],
                      *[F.get(F.col(column), F.lit(i)).alias(f"dim_{i:03d}") for i in range(dim)])


def narrow_embeddings(wide: DataFrame, column: str = "emb") -> DataFrame:
    dims = sorted(c for c in wide.columns if c.startswith("dim_"))
    return wide.select(*[c for c in wide.columns if c not in dims], F.array(*dims).alias(column))


def write_embeddings(emb: DataFrame, path: str, dim: int, mode: str = "overwrite") -> None:
    _write(widen_embeddings(emb, dim).withColumnRenamed("ip", "node_ip"), path, mode)


def attach_embeddings(nodes: DataFrame, stored: DataFrame, keys: Sequence[str] = (*WIN, "ip")) -> DataFrame:
    """Nodes with their stored vector; both sides must list the same nodes."""
    if "node_ip" in stored.columns:
        stored = stored.withColumnRenamed("node_ip", "ip")
    if "emb" not in stored.columns:
        stored = narrow_embeddings(stored)
    return attach(nodes, stored.select(*keys, "emb"), list(keys))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def not_yet_written(df: DataFrame, path: str, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Rows whose key is not stored yet; reads only the key columns."""
    if not exists(df.sparkSession, path):
        return df
    done = df.sparkSession.read.parquet(path).select(*keys).distinct()
    return df.join(done, list(keys), "left_anti")


def spot_check(flows: DataFrame, k: int = 20) -> DataFrame:
    """A few bot rows of the last scenario."""
    last = flows.agg(F.max("scenario").alias("s")).first()["s"]
    return (
        flows.where((F.col("scenario") == last) & (F.col("label") == "bot"))
        .select("src_ip", "dst_ip", "dst_port", "protocol", "bytes_fwd", "bytes_bwd", "detailed_label", "flow_id")
        .orderBy("flow_id").limit(k).drop("flow_id"))


# --- run results ----------------------------------------------------------

def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric or threshold rows as JSON lines."""
    metrics.write.mode(mode).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Run-result documents, one JSON object per file, with their file name."""
    docs = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path)
    return docs.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def result_document(model: str, val: DataFrame, test: DataFrame, per_scenario: DataFrame,
                    fit_seconds: float | None = None) -> DataFrame:
    """One result row from metric rows, in the layout :func:`read_results` reads."""
    m = F.map_from_entries(F.collect_list(F.struct("scenario", F.struct(
        *[F.col(c).cast("double").alias(c) for c in ("n", "n_pos", "f1", "pr_auc")]))))
    pack = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _METRICS])
    # One row on each side; scenarios are the captures of one evaluation.
    return (
        val.select(pack.alias("val")).crossJoin(test.select(pack.alias("test")))
        .crossJoin(per_scenario.agg(m.alias("test_per_scenario")))
        .select(F.lit(model).alias("model"), F.lit(fit_seconds).cast("double").alias("fit_seconds"),
                F.lit(None).cast("bigint").alias("params"), "val", "test", "test_per_scenario"))


def listing(spark: SparkSession, runs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The runs a report expects: (label, file, category)."""
    return spark.createDataFrame([(l, os.path.basename(f), c) for l, f, c in runs], "label string, file string, category string")
