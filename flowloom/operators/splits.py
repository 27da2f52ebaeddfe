"""Chronological train / val / test assignment of window graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from flowloom.config import SplitSpec

SPLITS = ["train", "val", "test"]
_ROLES = T.StructType([T.StructField("scenario", T.StringType()), T.StructField("role", T.StringType())])


def role_table(spark: SparkSession, spec: SplitSpec) -> DataFrame:
    """One row per scenario named in the spec."""
    rows = [(s, "train") for s in spec.train_scenarios]
    rows += [(s, "holdout") for s in spec.holdout_test_scenarios]
    rows += [(s, "excluded") for s in spec.excluded]
    return spark.createDataFrame(rows, _ROLES)


def chronological(graphs: DataFrame, train_frac: float, val_frac: float, order: str = "window_start") -> DataFrame:
    """First ``int(n * train_frac)`` graphs of a scenario to train, the next
    ``int(n * val_frac)`` to val, the rest to test.

    ``graphs`` has one row per window, so groups are bounded by the length of
    a capture.
    """
    by_time = Window.partitionBy("scenario").orderBy(order)
    n = F.count("*").over(Window.partitionBy("scenario"))
    n_train, n_val = F.floor(n * F.lit(train_frac)), F.floor(n * F.lit(val_frac))
    k = F.row_number().over(by_time)
    split = F.when(k <= n_train, "train").when(k <= n_train + n_val, "val").otherwise("test")
    return graphs.withColumn("split", split)


def assign_splits(graphs: DataFrame, spec: SplitSpec, order: str = "window_start") -> DataFrame:
    """Add ``split``. Holdout scenarios go to test as a whole; excluded and
    unlisted scenarios are absent."""
    # The role table has one row per scenario named by hand in the spec.
    roles = F.broadcast(role_table(graphs.sparkSession, spec).where("role <> 'excluded'"))
    timed = chronological(graphs.join(roles, "scenario"), spec.train_frac, spec.val_frac, order)
    return timed.withColumn("split", F.when(F.col("role") == "holdout", "test").otherwise(F.col("split"))).drop("role")


def load_split(assigned: DataFrame, name: str, table: DataFrame | None = None,
               keys: tuple[str, ...] = ("scenario", "window_start")) -> DataFrame:
    """Graphs of one split, or the rows of ``table`` that belong to them."""
    part = assigned.where(F.col("split") == name)
    return part if table is None else table.join(part.select(*keys), list(keys), "left_semi")


def split_summary(assigned: DataFrame) -> DataFrame:
    """Graphs, nodes, positives and their share per split; empty splits are 0 rows."""
    nodes, bots = F.sum("n_nodes"), F.sum("n_bot_nodes")
    return assigned.groupBy("split").agg(
        F.count("*").alias("graphs"), nodes.alias("nodes"), bots.alias("bot_nodes"),
        F.sum("graph_y").alias("bot_graphs"),
        F.when(nodes > 0, bots / nodes).otherwise(0.0).alias("bot_node_frac"))


def role_overlaps(spark: SparkSession, spec: SplitSpec) -> DataFrame:
    """Scenarios that have more than one role; must be empty."""
    return role_table(spark, spec).groupBy("scenario").agg(F.count_distinct("role").alias("roles")).where("roles > 1")


def split_overlaps(assigned: DataFrame) -> DataFrame:
    """Graphs that are in more than one split; must be empty."""
    return assigned.groupBy("scenario", "window_start").agg(
        F.count_distinct("split").alias("splits")).where("splits > 1")
