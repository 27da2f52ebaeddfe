"""Raw connection logs -> canonical flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowloom import fixed
from flowloom.functions.ordered import running
from flowloom.functions.scalars import (
    add_seconds, binetflow_label, binetflow_scenario, epoch_to_timestamp, lenient_double,
    lenient_long, local_to_utc, parse_naive, port_number, protocol_from_name,
    split_by_direction, zeek_label, zeek_scenario,
)
from flowloom.schema import coerce_to_schema

BINETFLOW_GLOB = "*.binetflow"
ZEEK_GLOB = "conn.log.labeled"
PCAP_GLOB = "*.pcap"
_TIES = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "duration_s", "bytes_fwd", "bytes_bwd",
         "pkts_fwd", "pkts_bwd", "label", "detailed_label"]


def find_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files below ``path`` (or ``path`` itself) whose name matches ``glob``.

    Lists names only; no content is read.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).load(path).select("path", "length")
    )
    if found.isEmpty():
        raise FileNotFoundError(f"no {glob} files under {path}")
    return found


def find_binetflow_files(spark: SparkSession, path: str) -> DataFrame:
    return find_files(spark, path, BINETFLOW_GLOB)


def find_zeek_files(spark: SparkSession, path: str) -> DataFrame:
    """Labelled connection logs with the scenario each one belongs to."""
    return find_files(spark, path, ZEEK_GLOB).withColumn("scenario", zeek_scenario(F.col("path")))


def find_captures(spark: SparkSession, path: str, malware_only: bool = False) -> DataFrame:
    found = find_files(spark, path, PCAP_GLOB)
    return found.where(F.col("path").rlike("/malware/[^/]*$")) if malware_only else found


# --- CTU-13 binetflow -----------------------------------------------------

BINETFLOW_RAW = T.StructType([T.StructField(c, T.StringType()) for c in fixed.BINETFLOW_COLUMNS])


def _csv(spark: SparkSession, path: str):
    # Without column pruning the whole header of every file is compared.
    reader = spark.read.options(header=True, recursiveFileLookup=True, columnPruning=False)
    return reader if path.endswith(".binetflow") else reader.option("pathGlobFilter", BINETFLOW_GLOB)


def load_binetflow(spark: SparkSession, path: str) -> DataFrame:
    """Binetflow CSV rows with a checked header and the derived ``class``.

    The header of one file is compared at once, those of all files by the
    reader while it scans. ``StartTime`` is wall-clock time; bad text is NULL.
    """
    header = _csv(spark, path).csv(path).columns
    if header != fixed.BINETFLOW_COLUMNS:
        raise ValueError(f"Unexpected columns in {path}: got {header}, expected {fixed.BINETFLOW_COLUMNS}")
    raw = _csv(spark, path).option("enforceSchema", False).schema(BINETFLOW_RAW).csv(path)
    return binetflow_rows(raw.withColumn("file_path", F.col("_metadata.file_path")))


def binetflow_rows(raw: DataFrame) -> DataFrame:
    """Typed rows and ``class`` from the raw text columns and ``file_path``."""
    doubles = ["Dur", "sTos", "dTos"]
    return raw.select(
        parse_naive(F.col("StartTime")).alias("StartTime"),
        *[(lenient_double(F.col(c)).alias(c) if c in doubles else F.col(c))
          for c in fixed.BINETFLOW_COLUMNS[1:]],
        binetflow_label(F.col("Label")).alias("class"), "file_path",
    )


def binetflow_to_flows(raw: DataFrame, scenario: Column | None = None, ambiguous: str = "null") -> DataFrame:
    """Canonical projection; ``flow_id`` is 0 until ids are assigned."""
    rows = raw.dropna(subset=["StartTime", "SrcAddr", "DstAddr"])
    start = local_to_utc(F.col("StartTime"), fixed.BINETFLOW_ZONE, ambiguous)
    duration = F.coalesce("Dur", F.lit(0.0))
    parts = split_by_direction(*[lenient_long(F.col(c)) for c in ("TotBytes", "SrcBytes", "TotPkts")])
    null = F.lit(None).cast("double")
    out = rows.where(lenient_long(F.col("TotPkts")) >= 1).select(
        F.lit(0).alias("flow_id"),
        (binetflow_scenario(F.col("file_path")) if scenario is None else scenario).alias("scenario"),
        F.col("SrcAddr").alias("src_ip"), F.col("DstAddr").alias("dst_ip"),
        port_number(F.col("Sport")).alias("src_port"), port_number(F.col("Dport")).alias("dst_port"),
        protocol_from_name(F.col("Proto")).alias("protocol"),
        start.alias("start_time"), duration.alias("duration_s"),
        *[c.alias(n) for n, c in parts.items()],
        *[null.alias(c) for c in ("mean_iat_ms", "std_iat_ms", "min_pkt_size", "max_pkt_size")],
        F.col("class").alias("label"), F.col("Label").alias("detailed_label"),
    )
    return coerce_to_schema(out.withColumn("end_time", add_seconds(F.col("start_time"), F.col("duration_s"))))


def parse_binetflow(spark: SparkSession, path: str, scenario_id: str | None = None, ambiguous: str = "null",
                    spread: bool = True) -> DataFrame:
    """All binetflow files below ``path`` as one canonical table with ids."""
    scenario = None if scenario_id is None else F.lit(scenario_id)
    return assign_flow_ids(binetflow_to_flows(load_binetflow(spark, path), scenario, ambiguous), spread=spread)


# --- IoT-23 Zeek conn.log.labeled ----------------------------------------

def load_zeek(spark: SparkSession, path: str) -> DataFrame:
    """Zeek connection rows: 20 tab-separated fields and a blank-separated tail.

    Read as lines, because a ``#`` ends a line anywhere in it and two different
    texts stand for NULL. Input splits take the place of row chunks.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if not path.endswith(ZEEK_GLOB):
        reader = reader.option("pathGlobFilter", ZEEK_GLOB)
    return zeek_rows(reader.text(path).select("value", F.col("_metadata.file_path").alias("file_path")))


def zeek_rows(text: DataFrame) -> DataFrame:
    """Typed rows and ``class`` from lines (``value``) and ``file_path``."""
    names = fixed.ZEEK_COLUMNS
    # The array is its own projection step, so each line is split once.
    lines = text.select(F.split(F.substring_index("value", "#", 1), "\t").alias("f"), "file_path").where(
        (F.size("f") > 1) | (F.get("f", F.lit(0)) != ""))

    def field(i):
        value = F.get("f", F.lit(i))
        return F.when(~value.isin(fixed.ZEEK_NULLS), value)

    raw = lines.select(
        F.get("f", F.lit(0)).alias("ts"), *[field(i).alias(names[i]) for i in range(1, 20)],
        F.split(F.coalesce(field(20), F.lit("-   -   -")), r"\s+", 3).alias("tail"), "file_path")
    parts = [F.coalesce(F.get("tail", F.lit(i)), F.lit("-")) for i in range(3)]
    return raw.select(
        epoch_to_timestamp(lenient_double(F.col("ts"))).alias("ts"), *[f"`{n}`" for n in names[1:20]],
        *[p.alias(n) for p, n in zip(parts, names[20:])],
        zeek_label(parts[1]).alias("class"), "file_path",
    )


def zeek_to_flows(raw: DataFrame, scenario: Column | None = None) -> DataFrame:
    """Canonical projection: originator is the source, responder the destination."""
    rows = raw.dropna(subset=["ts", "`id.orig_h`", "`id.resp_h`"])
    number = {c: lenient_long(F.col(f"`{c}`")) for c in (
        "id.orig_p", "id.resp_p", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")}
    null = F.lit(None).cast("double")
    out = rows.select(
        F.lit(0).alias("flow_id"),
        (zeek_scenario(F.col("file_path")) if scenario is None else scenario).alias("scenario"),
        F.col("`id.orig_h`").alias("src_ip"), F.col("`id.resp_h`").alias("dst_ip"),
        number["id.orig_p"].alias("src_port"), number["id.resp_p"].alias("dst_port"),
        protocol_from_name(F.col("proto")).alias("protocol"),
        F.col("ts").alias("start_time"),
        F.coalesce(lenient_double(F.col("duration")), F.lit(0.0)).alias("duration_s"),
        number["orig_bytes"].alias("bytes_fwd"), number["resp_bytes"].alias("bytes_bwd"),
        number["orig_pkts"].alias("pkts_fwd"), number["resp_pkts"].alias("pkts_bwd"),
        *[null.alias(c) for c in ("mean_iat_ms", "std_iat_ms", "min_pkt_size", "max_pkt_size")],
        F.col("class").alias("label"), F.col("detailed-label").alias("detailed_label"),
    ).where(F.col("pkts_fwd") + F.col("pkts_bwd") >= 1)
    return coerce_to_schema(out.withColumn("end_time", add_seconds(F.col("start_time"), F.col("duration_s"))))


def parse_zeek(spark: SparkSession, path: str, scenario_id: str | None = None,
               spread: bool = True) -> DataFrame:
    scenario = None if scenario_id is None else F.lit(scenario_id)
    return assign_flow_ids(zeek_to_flows(load_zeek(spark, path), scenario), spread=spread)


# --- ids ------------------------------------------------------------------

def assign_flow_ids(flows: DataFrame, spread: bool = True) -> DataFrame:
    """``flow_id`` 0..n-1 by start time within each scenario.

    One capture can hold most of the rows, so ids are not a per-scenario row
    number: rows are range-partitioned by (scenario, time), numbered inside
    their partition, and shifted by the counts of the earlier partitions.
    Rows without a time come last.
    """
    rows = flows.drop("flow_id")
    order = [F.col("start_time").asc_nulls_last(), *[F.col(c) for c in _TIES]]
    out = running(rows, ["scenario"], order, {"_pos": ("position", None)},
                  spread=spread, few_groups=True)
    return out.withColumn("flow_id", (F.col("_pos") - 1).cast("bigint")).select(*fixed.FLOW_COLUMNS)
