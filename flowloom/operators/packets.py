"""Packet tables: bidirectional flow assembly and per-host packet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom import fixed
from flowloom.functions.ordered import running, top_per_group
from flowloom.functions.scalars import (
    capture_family, capture_label, capture_scenario, conversation_key, epoch_to_timestamp,
    file_stem, profile_protocol, protocol_from_number,
)
from flowloom.schema import coerce_to_schema

_KEY = ["file", "lo", "hi", "proto"]


def first_packets(packets: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` packets of each file in capture order."""
    return packets if n is None else packets.where(F.col("packet_no") < n)


def _keyed(packets: DataFrame) -> DataFrame:
    lo, hi = conversation_key(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport"))
    return packets.withColumns({"lo": lo, "hi": hi}).withColumn(
        "from_lo", F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")) == F.col("lo"))


def packet_gaps(packets: DataFrame, compat_first_ts: bool = False, spread: bool = True) -> DataFrame:
    """Packets of each conversation with the gap to the previous one in ms.

    A gap is measured between successive new maxima of the capture-order
    timestamps; a late packet has none. ``compat_first_ts`` compares with the
    first packet only, so a late packet can have a negative gap.
    """
    keyed = _keyed(packets)
    order = [F.col("packet_no")]
    if not compat_first_ts:
        seen = running(keyed, _KEY, order, {"_seen": ("max_before", F.col("ts"))}, spread=spread)
        return seen.withColumn("gap_ms", F.when(F.col("ts") > F.col("_seen"), (F.col("ts") - F.col("_seen")) * 1000)).drop("_seen")
    starts = keyed.groupBy(*_KEY).agg(F.min_by("ts", "packet_no").alias("_t0"), F.min("packet_no").alias("_p0"))
    late = keyed.join(starts, _KEY)
    counted = late.where((F.col("ts") > F.col("_t0")) | (F.col("packet_no") == F.col("_p0")))
    prev = running(counted, _KEY, order, {"_prev": ("previous", F.col("ts"))}, spread=spread)
    gaps = prev.withColumn("gap_ms", (F.col("ts") - F.col("_prev")) * 1000).drop("_prev")
    rest = late.where((F.col("ts") <= F.col("_t0")) & (F.col("packet_no") != F.col("_p0"))).withColumn(
        "gap_ms", F.lit(None).cast("double"))
    return gaps.unionByName(rest).drop("_t0", "_p0")


def assemble_flows(packets: DataFrame, max_packets: int | None = None, compat_first_ts: bool = False,
                   spread: bool = True) -> DataFrame:
    """Packets -> one row per conversation, source = sender of its first packet.

    Everything but the gap is a partial aggregate, combined before the shuffle.
    """
    gaps = packet_gaps(first_packets(packets, max_packets), compat_first_ts, spread)
    lo, hi = F.col("from_lo"), ~F.col("from_lo")
    one = gaps.groupBy(*_KEY).agg(
        F.min_by(F.struct("src", "sport", "dst", "dport", "from_lo", "ts"), "packet_no").alias("first"),
        F.min("packet_no").alias("first_packet"),
        F.min("ts").alias("t_first"), F.max("ts").alias("t_last"),
        F.sum(F.when(lo, F.col("size")).otherwise(0)).alias("bytes_lo"),
        F.sum(F.when(hi, F.col("size")).otherwise(0)).alias("bytes_hi"),
        F.count(F.when(lo, 1)).alias("pkts_lo"), F.count(F.when(hi, 1)).alias("pkts_hi"),
        F.min("size").cast("double").alias("min_pkt_size"), F.max("size").cast("double").alias("max_pkt_size"),
        F.avg("gap_ms").alias("mean_iat_ms"), F.stddev_pop("gap_ms").alias("std_iat_ms"),
    )
    flip = F.col("first.from_lo")
    t_end = F.col("first.ts") if compat_first_ts else F.col("t_last")
    return one.select(
        "file", "first_packet", "t_first", t_end.alias("t_end"),
        F.col("first.src").alias("src_ip"), F.col("first.dst").alias("dst_ip"),
        F.col("first.sport").alias("src_port"), F.col("first.dport").alias("dst_port"), "proto",
        *[F.when(flip, F.col(f"{c}_lo")).otherwise(F.col(f"{c}_hi")).alias(f"{c}_fwd") for c in ("bytes", "pkts")],
        *[F.when(flip, F.col(f"{c}_hi")).otherwise(F.col(f"{c}_lo")).alias(f"{c}_bwd") for c in ("bytes", "pkts")],
        "min_pkt_size", "max_pkt_size", "mean_iat_ms", "std_iat_ms",
    )


def packets_to_flows(packets: DataFrame, max_packets: int | None = None, compat_first_ts: bool = False,
                     scenario_id: str | None = None, spread: bool = True) -> DataFrame:
    """Packets -> canonical flow table; class and family come from the file name."""
    from flowloom.sources.logs import assign_flow_ids

    flows = assemble_flows(packets, max_packets, compat_first_ts, spread)
    path = F.col("file")
    out = flows.select(
        F.lit(0).alias("flow_id"),
        (F.lit(scenario_id) if scenario_id else capture_scenario(path)).alias("scenario"),
        "src_ip", "dst_ip", "src_port", "dst_port",
        protocol_from_number(F.col("proto")).alias("protocol"),
        epoch_to_timestamp(F.col("t_first")).alias("start_time"),
        epoch_to_timestamp(F.col("t_end")).alias("end_time"),
        (F.col("t_end") - F.col("t_first")).alias("duration_s"),
        "bytes_fwd", "bytes_bwd", "pkts_fwd", "pkts_bwd",
        "mean_iat_ms", "std_iat_ms", "min_pkt_size", "max_pkt_size",
        capture_label(path).alias("label"),
        F.concat_ws("-", capture_family(path), file_stem(path)).alias("detailed_label"),
    )
    return assign_flow_ids(coerce_to_schema(out), spread=spread)


def conversations(packets: DataFrame, max_flows: int | None = None, max_packets: int | None = None,
                  spread: bool = True) -> DataFrame:
    """The short form: first and last seen, packets and bytes per conversation.

    ``max_flows`` keeps the conversations that started first in each file.
    """
    one = _keyed(first_packets(packets, max_packets)).groupBy(*_KEY).agg(
        F.min_by(F.struct("src", "dst", "sport", "dport"), "packet_no").alias("first"),
        F.min("packet_no").alias("first_packet"),
        F.min("ts").alias("first_seen_s"), F.max("ts").alias("last_seen_s"),
        F.count("*").alias("packets"), F.sum("size").alias("bytes"))
    if max_flows is not None:
        one = top_per_group(one, ["file"], [F.col("first_packet")], max_flows, spread)
    return one.select(
        "file", "first_packet",
        F.col("first.src").alias("src_ip"), F.col("first.dst").alias("dst_ip"),
        F.col("first.sport").alias("src_port"), F.col("first.dport").alias("dst_port"),
        F.col("proto").alias("protocol"), "first_seen_s", "last_seen_s", "packets", "bytes",
        epoch_to_timestamp(F.col("first_seen_s")).alias("first_seen"),
        epoch_to_timestamp(F.col("last_seen_s")).alias("last_seen"),
        (F.col("last_seen_s") - F.col("first_seen_s")).alias("duration_s"),
        capture_label(F.col("file")).alias("class"), capture_family(F.col("file")).alias("family"),
    )


def host_packets(packets: DataFrame, host: str | None = None, max_packets: int | None = None) -> DataFrame:
    """Packets sent by ``host`` (or by every host), in profile form."""
    p = first_packets(packets, max_packets)
    if host is not None:
        p = p.where(F.col("src") == host)
    known = F.col("proto").isin(6, 17)
    return p.select(
        "src", "file", "packet_no", "ts", F.col("dst").alias("dst_ip"),
        F.when(known, F.col("dport")).otherwise(0).alias("dst_port"),
        profile_protocol(F.col("proto")).alias("protocol"), "size")


def scan_counts(packets: DataFrame, host: str, max_packets: int | None = None) -> DataFrame:
    """How many packets a host scan matched, and why the rest was skipped."""
    reason = F.when(F.col("src").isNull() | F.col("dst").isNull(), "skipped_malformed").when(
        F.col("src") == host, "matched").otherwise("skipped_other_src")
    return first_packets(packets, max_packets).groupBy(reason.alias("outcome")).agg(F.count("*").alias("packets"))
