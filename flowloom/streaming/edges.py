"""Edge table of an unbounded flow stream.

An addition of ours: the batch edge features without the distinct port counts,
as a watermarked windowed aggregate. State per (window, pair) is a few sums; a
window is emitted once and dropped when the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom import fixed
from flowloom.config import WindowConfig
from flowloom.operators.graph import dominant_protocol
from flowloom.functions.scalars import protocol_flags
from flowloom.schema import FLOW_SCHEMA

COLUMNS = ["scenario", "window_start", "src_ip", "dst_ip", *[f for f in fixed.EDGE_FEATURES if "ports" not in f]]


def flow_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(FLOW_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def edge_stream(flows: DataFrame, cfg: WindowConfig | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Works on a stream and, for comparison, on a batch table."""
    cfg = cfg or WindowConfig()
    if cfg.stride != cfg.window_s:
        # Sliding windows of the stream would start before the first flow,
        # which those of the batch job do not.
        raise ValueError("the edge stream has tumbling windows: stride and width must be equal")
    kept = flows.where(F.col("label").isin("bot", "benign"))
    if kept.isStreaming:
        kept = kept.withWatermark("start_time", lateness)
    proto = F.when(F.col("protocol").isin(fixed.PROTOCOLS), F.col("protocol")).otherwise("other")
    counts = []
    for p in fixed.PROTOCOLS:
        counts += [F.count(F.when(proto == p, 1)).alias(f"n_{p}"),
                   F.min(F.when(proto == p, F.col("flow_id"))).alias(f"first_{p}")]
    slide = f"{cfg.stride} seconds"
    agg = kept.groupBy("scenario", F.window("start_time", f"{cfg.window_s} seconds", slide).alias("w"), "src_ip", "dst_ip").agg(
        F.sum(F.col("bytes_fwd") + F.col("bytes_bwd")).cast("double").alias("total_bytes"),
        F.sum(F.col("pkts_fwd") + F.col("pkts_bwd")).cast("double").alias("total_packets"),
        F.avg("duration_s").alias("mean_flow_duration"),
        F.coalesce(F.avg("mean_iat_ms"), F.lit(0.0)).alias("mean_iat_ms"), *counts)
    top = agg.withColumn("top", dominant_protocol())
    return top.withColumns({f"proto_{p}": c for p, c in zip(fixed.PROTOCOLS, protocol_flags(F.col("top")))}).withColumn(
        "window_start", F.col("w.start")).select(*COLUMNS)


def run_available(edges: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, in micro-batches, and stop; restart-safe."""
    return (
        edges.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out))
