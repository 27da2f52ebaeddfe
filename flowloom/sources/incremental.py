"""A folder of logs as an incremental source.

New files are found by Spark's file stream: its own log lists the files that a
batch took, so a file is parsed once, and a batch that broke off is taken again
with the same files under the same number. What a batch writes depends on
earlier batches only, and replaces whatever a broken attempt left, so flow ids
and rows are the same after any number of restarts.

Layout below ``root``: ``flows`` by scenario and batch; ``ranges``, one row per
scenario and batch with rows, ids and times, written after the flows; and the
stream's ``_progress``. ``ranges`` is what makes a batch visible, carries ids on
without reading flows, and lets a reader skip batches outside a time range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowloom import fixed
from flowloom.functions.ordered import small_side
from flowloom.operators.windows import in_time_range
from flowloom.schema import FLOW_SCHEMA, empty_flow_df
from flowloom.session import stages
from flowloom.sources import logs
from flowloom.sources.stores import exists

RANGES = "scenario string, rows bigint, first_id bigint, last_id bigint, t_min timestamp, t_max timestamp, batch bigint"
_STORED = T.StructType([*FLOW_SCHEMA.fields, T.StructField("batch", T.LongType())])


def stream_binetflow(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of binetflow files below ``path`` as they appear.

    Every file's own header is compared with the expected one while it is
    scanned; all columns are read for that, so none escapes the comparison.
    """
    reader = spark.readStream.options(header=True, enforceSchema=False, columnPruning=False,
                                      recursiveFileLookup=True, pathGlobFilter=logs.BINETFLOW_GLOB)
    raw = _bounded(reader, files_per_batch).schema(logs.BINETFLOW_RAW).csv(path)
    return logs.binetflow_rows(raw.withColumn("file_path", F.col("_metadata.file_path")))


def stream_zeek(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of labelled connection logs below ``path`` as they appear."""
    reader = spark.readStream.options(recursiveFileLookup=True, pathGlobFilter=logs.ZEEK_GLOB)
    return logs.zeek_rows(_bounded(reader, files_per_batch).text(path).select("value", F.col("_metadata.file_path").alias("file_path")))


def _bounded(reader, files_per_batch: int | None):
    return reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)


def new_flows(spark: SparkSession, kind: str, path: str, scenario_id: str | None = None,
              files_per_batch: int | None = None, ambiguous: str = "null") -> DataFrame:
    """Canonical flows of the files that appear below ``path``, without ids."""
    scenario = None if scenario_id is None else F.lit(scenario_id)
    if kind == "ctu13":
        return logs.binetflow_to_flows(stream_binetflow(spark, path, files_per_batch), scenario, ambiguous)
    if kind == "iot23":
        return logs.zeek_to_flows(stream_zeek(spark, path, files_per_batch), scenario)
    raise ValueError(f"unknown kind of log: {kind}")


def ingest(spark: SparkSession, kind: str, path: str, root: str, scenario_id: str | None = None,
           files_per_batch: int | None = None, ambiguous: str = "null") -> int:
    """Parse the files below ``path`` that ``root`` does not hold yet; returns the number of batches.

    Ends when no new file is left. ``files_per_batch`` bounds what one batch
    sorts; without it all new files are one batch. A file with a wrong header
    stops its batch before anything becomes visible. One job at a time writes a root.
    """
    query = (
        new_flows(spark, kind, path, scenario_id, files_per_batch, ambiguous)
        .writeStream.foreachBatch(lambda flows, batch: store_batch(flows, batch, root))
        .option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


def store_batch(flows: DataFrame, batch: int, root: str) -> None:
    """Write one batch; doing so again gives the same store."""
    spark = flows.sparkSession
    with stages(spark):
        numbered = logs.assign_flow_ids(flows)
        known = ranges(spark, root).where(F.col("batch") < batch).groupBy("scenario").agg((F.max("last_id") + 1).alias("_from"))
        shifted = numbered.join(small_side(known), "scenario", "left").withColumn("flow_id", F.col("flow_id") + F.coalesce("_from", F.lit(0)))
        (shifted.select(*fixed.FLOW_COLUMNS, F.lit(batch).cast("bigint").alias("batch"))
         .sortWithinPartitions("scenario", "start_time", "flow_id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario", "batch").parquet(f"{root}/flows"))
    if not exists(spark, f"{root}/flows"):
        return
    written = spark.read.schema(_STORED).parquet(f"{root}/flows").where(F.col("batch") == batch)
    (written.groupBy("scenario").agg(
        F.count("*").alias("rows"), F.min("flow_id").alias("first_id"), F.max("flow_id").alias("last_id"),
        F.min("start_time").alias("t_min"), F.max("start_time").alias("t_max"))
     .coalesce(1).write.mode("overwrite").parquet(f"{root}/ranges/batch={batch}"))  # one row per scenario


def ranges(spark: SparkSession, root: str) -> DataFrame:
    """Rows, ids and times of every scenario in every finished batch."""
    if not exists(spark, f"{root}/ranges"):
        return spark.createDataFrame([], RANGES)
    return spark.read.schema(RANGES).parquet(f"{root}/ranges")


def read_store(spark: SparkSession, root: str, start=None, end=None) -> DataFrame:
    """Flows of the finished batches and ``batch``; with ``start`` and ``end``, those in
    ``start <= start_time < end``, from the batches whose times touch that range only."""
    known = ranges(spark, root)
    if not exists(spark, f"{root}/flows") or known.isEmpty():
        return empty_flow_df(spark).withColumn("batch", F.lit(None).cast("bigint"))
    flows = spark.read.schema(_STORED).parquet(f"{root}/flows").select(*fixed.FLOW_COLUMNS, "batch")
    if start is not None and end is not None:
        known = known.where((F.col("t_max") >= F.lit(start)) & (F.col("t_min") < F.lit(end)))
        flows = in_time_range(flows, start, end)
    # Both keys are folders: the counted side prunes them before anything is read.
    return flows.join(small_side(known.select("scenario", "batch")), ["scenario", "batch"], "left_semi").select(*fixed.FLOW_COLUMNS, "batch")
