"""Flow, packet and score tables derived from the driver's parquet tables.

Every registered query starts from one of these; they are plain projections,
so filters and column pruning reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.config import GraphConfig, WindowConfig
from flowloom.schema import ntz_to_utc
from flowloom.session import tune

# Day-long windows fit the 30-day events table.
WINDOWS = WindowConfig(window_s=86400, min_flows=5, min_nodes=2)
GRAPHS = GraphConfig(min_flows_per_node=3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table read as a canonical flow table."""
    e = table(spark, sf_dir, "events")
    if dict(e.dtypes)["ts"] == "timestamp_ntz":
        e = e.withColumn("ts", ntz_to_utc(F.col("ts")))
    return e.selectExpr(
        "event_id AS flow_id",
        "CASE WHEN event_id % 2 = 0 THEN 'sc-a' ELSE 'sc-b' END AS scenario",
        "concat('u', user_id) AS src_ip",
        "concat('u', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20) AS dst_ip",
        "CAST(1024 + event_id % 500 AS INT) AS src_port",
        "CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 53 WHEN 2 THEN 443 WHEN 3 THEN 6667 ELSE 23 END AS dst_port",
        "CASE event_type WHEN 'click' THEN 'tcp' WHEN 'purchase' THEN 'tcp' WHEN 'view' THEN 'udp' "
        "WHEN 'error' THEN 'icmp' ELSE 'other' END AS protocol",
        "ts AS start_time",
        "timestamp_micros(unix_micros(ts) + CAST(rint(value / 10D * 1000000) AS BIGINT)) AS end_time",
        "value / 10D AS duration_s",
        "CAST(floor(value * 100) AS BIGINT) AS bytes_fwd",
        "CAST(floor(value * 37) AS BIGINT) AS bytes_bwd",
        "1 + event_id % 7 AS pkts_fwd",
        "event_id % 5 AS pkts_bwd",
        "CASE WHEN event_id % 3 = 0 THEN value END AS mean_iat_ms",
        "CAST(NULL AS DOUBLE) AS std_iat_ms",
        "CAST(NULL AS DOUBLE) AS min_pkt_size",
        "CASE WHEN event_id % 4 = 0 THEN 1500D END AS max_pkt_size",
        "CASE WHEN event_type = 'error' AND user_id % 10 < 2 THEN 'bot' WHEN event_type = 'signup' THEN 'background' "
        "ELSE 'benign' END AS label",
        "event_type AS detailed_label",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as single packets; one capture file per scenario.

    Both ends are one of twenty hosts and a host always uses the same port, so
    conversations run in both directions. Times jitter against the capture
    order, so late packets occur.
    """
    f = flows(spark, sf_dir)
    number = (F.when(F.col("protocol") == "tcp", 6).when(F.col("protocol") == "udp", 17)
              .when(F.col("protocol") == "icmp", 1).otherwise(2))
    jitter = F.pmod(F.col("flow_id") * 7919, F.lit(1000)) * 1_000_000
    a = F.pmod(F.substring("src_ip", 2, 20).cast("bigint"), F.lit(20))
    b = F.substring("dst_ip", 2, 20).cast("bigint")

    def host(h):
        return F.concat(F.lit("h"), h.cast("string"))

    return f.select(
        F.when(F.col("scenario") == "sc-a", "caps/mirai_mal_CC_all.pcap").otherwise("caps/torii_leg.pcap").alias("file"),
        F.col("flow_id").alias("packet_no"),
        ((F.unix_micros("start_time") + jitter) / F.lit(1000000.0)).alias("ts"),
        host(a).alias("src"), (F.lit(1000) + a).cast("int").alias("sport"),
        host(b).alias("dst"), (F.lit(1000) + b).cast("int").alias("dport"),
        number.alias("proto"),
        F.pmod(F.col("bytes_fwd"), F.lit(1500)).cast("int").alias("size"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` read as scored nodes: many rows share a score on purpose."""
    li = table(spark, sf_dir, "lineitem")
    proba = (F.col("l_quantity").cast("bigint") * 2 % 100) / F.lit(100.0)
    return li.select(
        F.col("l_linestatus").alias("scenario"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("node_key"),
        F.col("l_linenumber").alias("run"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (proba >= 0.5).cast("int").alias("y_pred"),
        proba.alias("proba"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` read as node vectors of small graphs of 100 nodes."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.lit("emb").alias("scenario"),
        F.floor(F.col("vec_id") / 100).cast("int").alias("window_idx"),
        F.col("vec_id").alias("node_idx"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("ip"),
        F.col("embedding").alias("emb"),
        (F.col("label") == 0).cast("int").alias("y"),
    )
