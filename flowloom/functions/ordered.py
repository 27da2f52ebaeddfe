"""Ordered computations that do not need a whole group in one task.

A plain ``Window.partitionBy(group)`` puts every row of a group on one task. If
one group holds a third of a large table that task never ends. Here the rows
are cut into *slabs* that follow the requested order (range partitioning by
group and order key, so a big group covers many slabs), the computation runs
inside each slab, and one small row per slab and group carries the state of the
earlier slabs over.

This is the way at every size: the number of slabs follows the written size of
the rows. The plain window is an explicit choice (``spread=False``) for groups
the caller knows to be bounded; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.session import cut_lineage, drop_stage

SLAB_BYTES = 64 * 1024 * 1024
LEAST_SLAB_BYTES = 1024 * 1024
BROADCAST_BYTES = 128 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; unknown inputs count as huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


COLUMNAR = ("parquet", "orc")


def reads_files(df: DataFrame) -> bool:
    """Whether ``df`` is projections, filters and explodes over columnar files: it can be
    evaluated twice for the price of a scan, and gives the same rows each time. Text
    is not: its rows would be parsed again."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic():
        return False
    while plan.children().size() == 1:
        if plan.nodeName() not in ("Project", "Filter", "Generate"):
            return False
        plan = plan.children().head()
    if not plan.nodeName().startswith(("LogicalRelation", "Relation")) or not df.inputFiles():
        return False
    return plan.relation().fileFormat().toString().lower() in COLUMNAR


def lay_out(df: DataFrame, group: Sequence[str], order: Sequence[Column], slabs: int | None = None,
            slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """Cut ``df`` into ordered slabs and tag rows with ``_slab`` and ``_row``.

    The slab borders take a pass of their own. Rows that come straight from
    files (:func:`reads_files`) are scanned again for it; others are written
    first. The number of slabs follows the size: about ``slab_bytes`` each, and
    up to the session's shuffle partitions one for every ``LEAST_SLAB_BYTES``.
    The result is written, as a second evaluation could draw other borders.
    """
    keys = [*[F.col(c) for c in group], *order]
    direct = reads_files(df)
    copy = df if direct else cut_lineage(df)
    if slabs is None:
        size, parts = planned_bytes(copy), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slabs = max(1, min(parts, -(-size // LEAST_SLAB_BYTES)), -(-size // slab_bytes))
    numbered = copy.repartitionByRange(slabs, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    laid = cut_lineage(numbered.withColumn("_slab", F.shiftright("_row", 33).cast("int")))
    if not direct:
        drop_stage(copy)
    return laid


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], spec: dict[str, tuple[str, Column | None]],
            spread: bool = True, slabs: int | None = None, few_groups: bool = False) -> DataFrame:
    """Add running values per ``group`` in the total order ``order``.

    ``spec`` maps a new column to ``(kind, column)``:

    ``position``     1-based rank of the row in its group (column unused)
    ``sum``          sum up to and including the row
    ``max_before``   maximum over the earlier rows, NULL for the first
    ``previous``     value of the preceding row, NULL for the first
    ``total``        sum over the whole group

    ``spread=False`` asks for the plain window. With ``few_groups`` the carried
    state (one row per slab and group) is written, counted, and broadcast if it
    is small (:func:`small_side`); rows then stay where they are.
    """
    group = list(group)
    if not spread:
        w = Window.partitionBy(*group).orderBy(*order) if group else Window.partitionBy(F.lit(0)).orderBy(*order)
        return df.withColumns(_local(spec, w))

    laid = lay_out(df, group, order, slabs)
    by_slab = Window.partitionBy(*group, "_slab").orderBy("_row")
    state = laid.groupBy(*group, "_slab").agg(
        F.min("_row").alias("_first_row"), *[_slab_state(n, k, c) for n, (k, c) in spec.items()])
    # One row per slab and group; a group has at most as many rows as there
    # are slabs, however many rows it holds.
    earlier = (
        Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = state.select(*group, "_slab", "_first_row", *[_carry(n, k, earlier) for n, (k, _) in spec.items()])
    joined = _join_null_safe(laid, small_side(carried) if few_groups else carried, [*group, "_slab"])
    # Rows of a slab are numbered consecutively in sort order, so the rank
    # inside the slab is plain arithmetic; other kinds use a per-slab window.
    rank = {n: F.col("_row") - F.col("_first_row") + 1 for n, (k, _) in spec.items() if k == "position"}
    rest = {n: v for n, v in spec.items() if v[0] not in ("position", "total")}
    local = {**rank, **_local(rest, by_slab), "_at": F.col("_row") - F.col("_first_row") + 1}
    return (
        joined.withColumns(local)
        .withColumns({n: _combine(n, k) for n, (k, _) in spec.items()})
        .drop("_slab", "_row", "_first_row", "_at", *[f"_carry_{n}" for n in spec])
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a NULL key meets a NULL key: such rows are a group."""
    renamed = right.withColumnsRenamed({c: f"_key_{c}" for c in keys})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    return left.join(renamed, condition, "left").drop(*[f"_key_{c}" for c in keys])


def _local(spec, w):
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    make = {
        "position": lambda c: F.row_number().over(w),
        "sum": lambda c: F.sum(c).over(upto),
        "max_before": lambda c: F.max(c).over(before),
        "previous": lambda c: F.lag(c).over(w),
        "total": lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }
    return {n: make[k](c) for n, (k, c) in spec.items()}


def _slab_state(name, kind, c):
    agg = {
        "position": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(c),
        "max_before": lambda: F.max(c),
        "previous": lambda: F.max_by(c, F.col("_row")),
        "total": lambda: F.sum(c),
    }[kind]()
    return agg.alias(f"_state_{name}")


def _carry(name, kind, earlier):
    s = F.col(f"_state_{name}")
    if kind == "total":
        return F.sum(s).over(earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_carry_{name}")
    fold = {"position": F.sum, "sum": F.sum, "max_before": F.max, "previous": F.last}[kind]
    return fold(s).over(earlier).alias(f"_carry_{name}")


def _combine(name, kind):
    carry = F.col(f"_carry_{name}")
    if kind == "total":
        return carry
    here = F.col(name)
    if kind in ("position", "sum"):
        # A slab without any non-null value leaves the other part unchanged.
        return F.coalesce(here + carry, here, carry)
    if kind == "max_before":
        return F.greatest(here, carry)
    # 'previous' crosses a slab border only on the group's first row there.
    return F.when(F.col("_at") == 1, carry).otherwise(here)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  spread: bool = True) -> DataFrame:
    """The first ``k`` rows of every group in a total order.

    Up to Spark's group-limit threshold the rank filter is applied per task
    before the shuffle, so a group sends at most ``k`` rows per task. Above it
    ranks come from :func:`running`.
    """
    pruned = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    ranked = running(df, group, order, {"_rank": ("position", None)}, spread=False if k <= pruned else spread)
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def small_side(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A reduced table as join side: broadcast if it has at most ``max_rows``
    and at most ``max_bytes`` as written.

    The table is written out, counted, and only then given the hint; a larger
    one is joined by shuffle, where adaptive execution splits hot keys.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if planned_bytes(kept) <= max_bytes and kept.count() <= max_rows else kept


def exact_quantiles(df: DataFrame, group: Sequence[str], qs: dict[str, tuple[str, float]],
                    spread: bool = True) -> DataFrame:
    """Linear-interpolated quantiles per group, without holding a group.

    ``qs`` maps a result column to ``(value column, quantile)``; NULL values
    are skipped. Equal values are counted first, so the ordered pass runs over
    distinct values, for all value columns at once; each quantile then reads
    the two values around its rank.
    """
    group = list(group)
    columns = list(dict.fromkeys(c for c, _ in qs.values()))
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    counts = (
        df.select(*group, item.alias("_i")).where("_i.v IS NOT NULL")
        .groupBy(*group, F.col("_i.c").alias("_c"), F.col("_i.v").alias("_v")).agg(F.count("*").alias("_n"))
    )
    placed = running(counts, [*group, "_c"], [F.col("_v")],
                     {"_cum": ("sum", F.col("_n")), "_total": ("total", F.col("_n"))}, spread=spread)
    picks, out = [], []
    for name, (column, q) in qs.items():
        mine = F.col("_c") == column
        at = (F.col("_total") - 1) * F.lit(float(q))
        picks += [
            F.min(F.when(mine & (F.col("_cum") > F.floor(at)), F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(mine & (F.col("_cum") > F.ceil(at)), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(F.when(mine, at - F.floor(at))).alias(f"_part_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * F.col(f"_part_{name}")).alias(name))
    return placed.groupBy(*group).agg(*picks).select(*group, *out)


def hash_sample_exact(df: DataFrame, group: Sequence[str], fraction: float, key: Sequence[Column], seed: int,
                      spread: bool = True, by: Column | None = None) -> DataFrame:
    """Mark exactly ``round(fraction * n)`` rows of every group as held out.

    Rows are taken in the order of a seeded hash of their key (or of ``by``),
    so the choice is repeatable. Adds the boolean column ``held_out``.
    """
    group = list(group)
    marked = df.withColumn("_hash", F.xxhash64(*key, F.lit(seed)) if by is None else by)
    ranked = running(marked, group, [F.col("_hash"), *key],
                     {"_rank": ("position", None), "_size": ("total", F.lit(1))}, spread=spread)
    return (
        ranked.withColumn("held_out", F.col("_rank") <= F.rint(F.col("_size") * F.lit(fraction)))
        .drop("_hash", "_rank", "_size")
    )
