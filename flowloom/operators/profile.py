"""Dataset and host profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from flowloom import fixed
from flowloom.functions.ordered import exact_quantiles, running
from flowloom.operators.windows import WIN


def overview(df: DataFrame, src: str, dst: str, time: str, group: Sequence[str] = (), end: str | None = None) -> DataFrame:
    """Rows, distinct sources, destinations and addresses, time range.

    Addresses are reduced to one row each before they are counted, so the
    three distinct counts cost a single pass.
    """
    end = end or time
    ends = F.explode(F.array(
        F.struct(F.col(src).alias("ip"), F.lit(1).alias("as_src"), F.lit(0).alias("as_dst")),
        F.struct(F.col(dst).alias("ip"), F.lit(0).alias("as_src"), F.lit(1).alias("as_dst"))))
    seen = df.select(*group, time, *([end] if end != time else []), ends.alias("e")).groupBy(*group, "e.ip").agg(
        F.sum("e.as_src").alias("src_rows"), F.max("e.as_src").alias("as_src"), F.max("e.as_dst").alias("as_dst"),
        F.min(time).alias("t_min"), F.max(end).alias("t_max"))
    one = seen.groupBy(*group).agg(
        F.sum("src_rows").alias("rows"),
        F.count(F.when((F.col("as_src") == 1) & F.col("ip").isNotNull(), 1)).alias("distinct_src"),
        F.count(F.when((F.col("as_dst") == 1) & F.col("ip").isNotNull(), 1)).alias("distinct_dst"),
        F.count("ip").alias("distinct_ips"),
        F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"))
    return one.withColumn("duration_s", (F.unix_micros("t_max") - F.unix_micros("t_min")) / 1_000_000)


def class_counts(df: DataFrame, label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """Rows and percentage of every class, absent classes as 0."""
    wide = df.groupBy(*group).agg(
        F.count("*").alias("_all"), *[F.count(F.when(F.col(label) == c, 1)).alias(c) for c in fixed.LABELS])
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("rows")) for c in fixed.LABELS]))
    return wide.select(*group, "_all", item.alias("i")).select(
        *group, "i.class", "i.rows",
        F.when(F.col("_all") > 0, F.col("i.rows") * 100 / F.col("_all")).otherwise(0.0).alias("percent"))


def label_totals(flows: DataFrame) -> DataFrame:
    """Bot, benign and background rows per scenario."""
    return flows.groupBy("scenario").agg(*[F.count(F.when(F.col("label") == c, 1)).alias(c) for c in fixed.LABELS])


def top_sources(df: DataFrame, src: str = "src_ip", label: str = "label", k: int = 10) -> DataFrame:
    """Busiest sources with their bot flows and dominant class.

    Classes are counted in place; on a tie the class seen first (smallest
    flow id) wins.
    """
    by_class = []
    for c in fixed.LABELS:
        is_c = F.col(label) == c
        by_class += [F.count(F.when(is_c, 1)).alias(f"n_{c}"), F.min(F.when(is_c, F.col("flow_id"))).alias(f"first_{c}")]
    ranked = F.array_max(F.array(*[
        F.struct(F.col(f"n_{c}").alias("n"), (-F.col(f"first_{c}")).alias("first"), F.lit(c).alias("name"))
        for c in fixed.LABELS]))
    return (
        df.groupBy(F.col(src).alias("src_ip")).agg(F.count("*").alias("flows"), *by_class)
        .select("src_ip", "flows", F.col("n_bot").alias("bot_flows"), ranked["name"].alias("dominant_class"))
        .orderBy(F.desc("flows"), F.asc("src_ip")).limit(k)
    )


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; ties in value order."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), F.asc(column)).limit(k))


def bot_sources(df: DataFrame, src: str = "src_ip", label: str = "label") -> DataFrame:
    """Bot flows of every source that has any."""
    return df.where(F.col(label) == "bot").groupBy(F.col(src).alias("src_ip")).agg(F.count("*").alias("bot_flows"))


def detailed_labels(df: DataFrame, k: int = 8, label: str = "label", detail: str = "detailed_label") -> DataFrame:
    return top_values(df.where(F.col(label) == "bot"), detail, k)


def capture_overview(convs: DataFrame) -> DataFrame:
    """Profile of assembled captures: the common overview plus volume."""
    base = overview(convs, "src_ip", "dst_ip", "first_seen", ["file"], end="last_seen")
    volume = convs.groupBy("file").agg(
        F.first("class").alias("class"), F.first("family").alias("family"),
        F.sum("bytes").alias("total_bytes"), F.sum("packets").alias("total_packets"))
    return base.withColumnRenamed("rows", "flows").join(volume, "file")


def top_capture_sources(convs: DataFrame, k: int = 10) -> DataFrame:
    return (
        convs.groupBy("src_ip").agg(
            F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
        .orderBy(F.desc("flows"), F.asc("src_ip")).limit(k))


# --- host traffic ---------------------------------------------------------

def host_gaps(pkts: DataFrame, spread: bool = True) -> DataFrame:
    """Seconds since the host's previous packet in capture order."""
    prev = running(pkts, ["src"], [F.col("file"), F.col("packet_no")], {"_prev": ("previous", F.col("ts"))}, spread=spread)
    return prev.withColumn("gap_s", F.col("ts") - F.col("_prev")).drop("_prev")


def protocol_shares(pkts: DataFrame) -> DataFrame:
    """Packets and percentage of each protocol per host."""
    n = pkts.groupBy("src", "protocol").agg(F.count("*").alias("packets"))
    # One row per protocol number is left, at most 256 per host.
    total = F.sum("packets").over(Window.partitionBy("src"))
    return n.withColumn("percent", F.col("packets") * 100 / total)


def host_profile(pkts: DataFrame, spread: bool = True) -> DataFrame:
    """Rate, sizes, gaps and peers of every sending host, one row each.

    Only positive gaps count. ``rhythm`` is bursty when the coefficient of
    variation of the gaps exceeds 1.
    """
    gaps = host_gaps(pkts, spread).withColumn("gap_s", F.when(F.col("gap_s") > 0, F.col("gap_s")))
    basic = gaps.groupBy("src").agg(
        F.count("*").alias("packets"), (F.max("ts") - F.min("ts")).alias("span_s"),
        F.min("size").cast("double").alias("size_min"), F.max("size").cast("double").alias("size_max"),
        F.avg("size").alias("size_mean"), F.stddev_samp("size").alias("size_std"),
        F.max("gap_s").alias("gap_max_s"), F.avg("gap_s").alias("_gap_mean"), F.stddev_samp("gap_s").alias("_gap_std"))
    peers = pkts.select("src", "dst_ip").distinct().groupBy("src").agg(F.count("dst_ip").alias("distinct_peers"))
    size_names = {f"size_p{int(q * 100)}": ("size", q) for q in fixed.SIZE_QUANTILES}
    gap_names = {f"gap_p{int(q * 100)}_ms": ("gap_s", q) for q in fixed.GAP_QUANTILES}
    quantiles = exact_quantiles(gaps, ["src"], {**size_names, **gap_names}, spread)
    cv = F.when(F.col("_gap_mean") > 0, F.col("_gap_std") / F.col("_gap_mean"))
    return (
        basic.join(peers, "src").join(quantiles, "src")
        .withColumns({n: F.col(n) * 1000 for n in gap_names})
        .withColumns({
            "packets_per_s": F.when(F.col("span_s") > 0, F.col("packets") / F.col("span_s")),
            "gap_mean_ms": F.col("_gap_mean") * 1000,
            "gap_cv": cv,
            "rhythm": F.when(cv > 1, "bursty").when(cv.isNotNull(), "regular"),
        }).drop("_gap_mean", "_gap_std"))


def peer_churn(pkts: DataFrame, spread: bool = True) -> DataFrame:
    """Distinct peers contacted after each quarter of a host's packets.

    A peer counts from its first packet on, so only one position per peer is
    kept; the running set is never built. Packets are read once: the times at
    the quarters are conditional minima of the same aggregate.
    """
    order = [F.col("ts"), F.col("file"), F.col("packet_no")]
    placed = running(pkts.select("src", "dst_ip", "ts", "file", "packet_no"), ["src"], order,
                     {"pos": ("position", None), "n": ("total", F.lit(1))}, spread=spread)
    quarters, step = (1, 2, 3, 4), F.greatest(F.floor(F.col("n") / 4), F.lit(1))
    by_peer = placed.groupBy("src", "dst_ip").agg(
        F.min("pos").alias("first_pos"), F.max("n").alias("n"), F.min("ts").alias("t0"),
        *[F.min(F.when(F.col("pos") == step * q, F.col("ts"))).alias(f"at{q}") for q in quarters])
    by_host = by_peer.groupBy("src").agg(
        F.max("n").alias("n"), F.min("t0").alias("t0"),
        F.array(*[F.struct(F.lit(q).alias("quarter"), F.min(f"at{q}").alias("ts"),
                           F.count(F.when(F.col("first_pos") <= step * q, 1)).alias("peers")) for q in quarters]).alias("quarters"))
    return (
        by_host.select("src", "n", "t0", F.explode("quarters").alias("q")).where(step * F.col("q.quarter") <= F.col("n"))
        .select("src", "q.quarter", (F.col("q.ts") - F.col("t0")).alias("t_rel_s"), "q.peers"))


def histogram(df: DataFrame, value: str, group: Sequence[str] = (), bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram between the smallest and largest value of a group.

    The last bin includes its upper end; a constant column gets a range of
    width 1 around its value. Empty bins are absent.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    counted = rows.groupBy(*group, "_v").agg(F.count("*").alias("_n"))
    span = rows.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(*group, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    both = counted.join(span, list(group)) if group else counted.crossJoin(F.broadcast(span))  # one row
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return both.groupBy(*group, b.alias("bin")).agg(
        F.min(F.col("_lo") + b * width).alias("bin_start"), F.sum("_n").alias("rows"))


def histogram_ticks(df: DataFrame, value: str, group: Sequence[str] = (), bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """:func:`histogram` of integers, with all borders in whole ticks.

    A value lies in bin (value - lowest) x bins div (highest - lowest), the highest
    in the last one; ``bin_start`` is the smallest integer of the bin. A constant
    column fills the middle bin. No step rounds, so every engine agrees on every bin.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("bigint").alias("_v"))
    # Each distinct value once; its bounds come from these counts.
    counted = rows.groupBy(*group, "_v").agg(F.count("*").alias("_n"))
    span = counted.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    both = counted.join(span, list(group)) if group else counted.crossJoin(F.broadcast(span))  # one row
    b = F.expr(f"CASE WHEN _lo = _hi THEN {bins // 2} ELSE least((_v - _lo) * {bins} div (_hi - _lo), {bins - 1}) END")
    start = F.expr(f"CASE WHEN _lo = _hi THEN _lo ELSE _lo + (bin * (_hi - _lo) + {bins - 1}) div {bins} END")
    return (both.withColumn("bin", b.cast("int")).withColumn("bin_start", start)
            .groupBy(*group, "bin", "bin_start").agg(F.sum("_n").alias("rows")))


def log_gap_ticks(gaps: DataFrame) -> DataFrame:
    """log10 of the positive gaps in milliseconds, in millionths."""
    return log_gaps(gaps).withColumn("log10_ms_ticks", F.round(F.col("log10_ms") * 1_000_000).cast("bigint"))


def log_gaps(gaps: DataFrame) -> DataFrame:
    """log10 of the positive gaps in milliseconds."""
    return gaps.where("gap_s > 0").withColumn("log10_ms", F.log10(F.col("gap_s") * 1000 + F.lit(1e-6)))


# --- windows and classes --------------------------------------------------

def representative_window(graphs: DataFrame) -> DataFrame:
    """Per scenario the window with most positive nodes, the earliest on a tie."""
    best = F.struct(F.col("n_bot_nodes"), -F.unix_micros("window_start"))
    return graphs.groupBy("scenario").agg(
        F.max_by(F.struct("window_start", "window_idx", "n_bot_nodes"), best).alias("w")).select("scenario", "w.*")


def first_positive_window(graphs: DataFrame) -> DataFrame:
    """Per scenario the first window with a positive node, else its first window."""
    order = F.struct((F.col("n_bot_nodes") < 1).cast("int"), F.unix_micros("window_start"))
    return graphs.groupBy("scenario").agg(
        F.min_by(F.struct("window_start", "window_idx", "n_bot_nodes"), order).alias("w")).select("scenario", "w.*")


def matched_windows(nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes joined with their sequence length; windows on one side only drop out."""
    return nodes.join(lengths.select(*WIN, "ip", "seq_len"), [*WIN, "ip"])


def window_size_stats(graphs: DataFrame, spread: bool = True) -> DataFrame:
    """Nodes and edges per window: mean, median, smallest, largest."""
    base = graphs.groupBy("scenario").agg(
        F.count("*").alias("windows"), F.sum("n_nodes").alias("n_total"), F.sum("n_bot_nodes").alias("n_pos"),
        F.avg("n_nodes").alias("nodes_mean"), F.min("n_nodes").alias("nodes_min"), F.max("n_nodes").alias("nodes_max"),
        F.avg("n_edges").alias("edges_mean"))
    medians = {"nodes_median": ("n_nodes", 0.5), "edges_median": ("n_edges", 0.5)}
    return base.join(exact_quantiles(graphs, ["scenario"], medians, spread), "scenario")


def flows_per_node_stats(matched: DataFrame, spread: bool = True) -> DataFrame:
    """Sequence lengths by class: mean, median, p10, p90, share up to 1 and 3."""
    key = ["scenario", "y"]
    base = matched.groupBy(*key).agg(
        F.count("*").alias("nodes"), F.avg("seq_len").alias("mean"),
        F.avg((F.col("seq_len") <= 1).cast("double")).alias("share_le1"),
        F.avg((F.col("seq_len") <= 3).cast("double")).alias("share_le3"))
    points = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    q = exact_quantiles(matched, key, {n: ("seq_len", p) for n, p in points.items()}, spread)
    return base.join(q, key)


def class_separation(nodes: DataFrame, features: Sequence[str] = tuple(fixed.NODE_FEATURES)) -> DataFrame:
    """Mean and population std per class and feature, and Cohen's d.

    d needs at least two nodes of each class; ``max_abs_d`` is its largest
    magnitude within the scenario.
    """
    def per_class(y):
        mine = F.when(F.col("y") == y, F.lit(1))
        return [F.count(mine).alias(f"n{y}")] + [
            F.struct(F.avg(F.when(F.col("y") == y, F.col(f))).alias("mean"),
                     F.stddev_pop(F.when(F.col("y") == y, F.col(f))).alias("std")).alias(f"{f}_{y}") for f in features]

    wide = nodes.groupBy("scenario").agg(*per_class(0), *per_class(1))
    item = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_1").alias("bot"), F.col(f"{f}_0").alias("benign")) for f in features]))
    pooled = F.sqrt((F.pow("i.bot.std", F.lit(2.0)) + F.pow("i.benign.std", F.lit(2.0))) / 2 + 1e-9)
    d = F.when((F.col("n0") > 1) & (F.col("n1") > 1), (F.col("i.bot.mean") - F.col("i.benign.mean")) / pooled)
    rows = wide.select("scenario", "n0", "n1", item.alias("i")).select(
        "scenario", "i.feature", F.col("i.bot.mean").alias("bot_mean"), F.col("i.bot.std").alias("bot_std"),
        F.col("i.benign.mean").alias("benign_mean"), F.col("i.benign.std").alias("benign_std"), d.alias("cohen_d"))
    # One row per feature and scenario.
    return rows.withColumn("max_abs_d", F.max(F.abs("cohen_d")).over(Window.partitionBy("scenario")))
