"""Assigning flows to time windows and dropping windows that are too small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowloom.config import WindowConfig
from flowloom.functions.ordered import small_side
from flowloom.functions.scalars import floor_div, floor_to, micros

WIN = ["scenario", "window_start"]


def drop_background(flows: DataFrame) -> DataFrame:
    """Keep flows labelled bot or benign (pushed down to the scan)."""
    return flows.where(F.col("label").isin("bot", "benign"))


def in_time_range(flows: DataFrame, start, end) -> DataFrame:
    """``start <= start_time < end``; both sides reach the parquet reader."""
    return flows.where((F.col("start_time") >= F.lit(start)) & (F.col("start_time") < F.lit(end)))


def assign_windows(flows: DataFrame, cfg: WindowConfig | None = None) -> DataFrame:
    """Add ``window_start``; with a stride other than the width, one row per window.

    Rows without a start time fall in no window. Tumbling assignment is a row
    expression without a shuffle. With a stride, the first window of a scenario
    starts at its earliest flow, floored to the window width.
    """
    cfg = cfg or WindowConfig()
    flows = flows.where(F.col("start_time").isNotNull())
    if cfg.stride == cfg.window_s:
        return flows.withColumn("window_start", floor_to(F.col("start_time"), cfg.window_s))

    width, stride = cfg.window_s * 1_000_000, cfg.stride * 1_000_000
    first = small_side(flows.groupBy("scenario").agg(
        micros(floor_to(F.min("start_time"), cfg.window_s)).alias("_base")))
    offset = micros(F.col("start_time")) - F.col("_base")
    last_window = floor_div(offset, stride)
    first_window = F.greatest(floor_div(offset - width, stride) + 1, F.lit(0).cast("bigint"))
    # With stride > width some flows lie between windows: the picks are empty.
    return (
        flows.join(first, "scenario")
        .withColumns({"_lo": first_window, "_hi": last_window})
        .where("_lo <= _hi")
        .withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("window_start", F.timestamp_micros(F.col("_base") + F.col("_k") * stride))
        .drop("_base", "_lo", "_hi", "_k")
    )


def time_bounds(flows: DataFrame) -> DataFrame:
    """Earliest and latest start and row count per scenario (one partial pass)."""
    return flows.groupBy("scenario").agg(
        F.min("start_time").alias("t_min"), F.max("start_time").alias("t_max"),
        F.count("*").alias("rows"))


def window_starts(bounds: DataFrame, cfg: WindowConfig | None = None) -> DataFrame:
    """All window starts between the bounds, numbered from 0, empty ones included."""
    cfg = cfg or WindowConfig()
    step = cfg.stride * 1_000_000
    base = micros(floor_to(F.col("t_min"), cfg.window_s))
    n = floor_div(micros(F.col("t_max")) - base, step)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("window_no")
    return (
        bounds.where("t_min IS NOT NULL").select("scenario", base.alias("_base"), k)
        .select("scenario", "window_no",
                F.timestamp_micros(F.col("_base") + F.col("window_no") * step).alias("window_start"))
    )


def endpoints(*extra) -> list:
    """Two output rows per input row, one for each endpoint, plus ``extra``."""
    return [*extra, F.explode(F.array("src_ip", "dst_ip")).alias("ip")]


def host_activity(windowed: DataFrame, weight: str | None = None) -> DataFrame:
    """Flows touching each host of a window; a self-flow counts twice.

    Rows are counted, or ``weight`` summed for tables that are already reduced.
    The count is combined before the shuffle, so a busy host sends one row per
    task.
    """
    each = F.count("*") if weight is None else F.sum(weight)
    extra = [] if weight is None else [F.col(weight)]
    return windowed.select(*endpoints(*WIN, *extra)).groupBy(*WIN, "ip").agg(each.alias("activity"))


def window_sizes(activity: DataFrame) -> DataFrame:
    """Flows and distinct hosts of each window."""
    return activity.groupBy(*WIN).agg(
        (F.sum("activity") / 2).cast("bigint").alias("n_flows"), F.count("*").alias("n_hosts"))


def large_enough(sizes: DataFrame, cfg: WindowConfig | None = None) -> DataFrame:
    cfg = cfg or WindowConfig()
    return sizes.where((F.col("n_flows") >= cfg.min_flows) & (F.col("n_hosts") >= cfg.min_nodes))


def keep_large_windows(windowed: DataFrame, cfg: WindowConfig | None = None) -> DataFrame:
    """Flows of the windows with enough flows and enough distinct hosts."""
    sizes = window_sizes(host_activity(windowed))
    return windowed.join(small_side(large_enough(sizes, cfg).select(*WIN)), WIN, "left_semi")


def number_windows(windows: DataFrame) -> DataFrame:
    """Dense ``window_idx`` per scenario in time order.

    ``windows`` has one row per window, so the group size is the number of
    windows in a capture, not the number of flows.
    """
    w = Window.partitionBy("scenario").orderBy("window_start")
    return windows.withColumn("window_idx", (F.row_number().over(w) - 1).cast("int"))
