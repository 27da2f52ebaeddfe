"""Comparison tables over stored run results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowloom import fixed


def unpivot_metrics(runs: DataFrame, metrics: Sequence[str] = tuple(fixed.SEED_METRICS), prefix: str = "test.") -> DataFrame:
    """One row per run and metric; ``runs`` has ``tag`` and the nested result."""
    items = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(prefix + m).cast("double").alias("value")) for m in metrics])
    return runs.select("tag", F.explode(items).alias("i")).select("tag", "i.*")


def scenario_metrics(runs: DataFrame, metric: str = "f1", column: str = "test_per_scenario") -> DataFrame:
    """One row per run and scenario from the per-scenario map."""
    return runs.select("tag", F.explode(column).alias("scenario", "m")).select(
        "tag", "scenario", F.col(f"m.{metric}").cast("double").alias("value"))


def spread_over_runs(values: DataFrame, by: str = "metric") -> DataFrame:
    """Mean and population std over runs, with smallest and largest value.

    A single run has std 0; missing values are skipped.
    """
    return values.where("value IS NOT NULL").groupBy(by).agg(
        F.count("*").alias("runs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def side_by_side(values: DataFrame, tags: Sequence[str], by: str = "metric") -> DataFrame:
    """One column per run next to the spread."""
    wide = values.groupBy(by).pivot("tag", list(tags)).agg(F.first("value"))
    return wide.join(spread_over_runs(values, by), by, "left")


def result_table(listing: DataFrame, runs: DataFrame, watch: Sequence[str] = ()) -> DataFrame:
    """One row per listed run; a run without a result file is flagged.

    ``listing`` has ``file`` and descriptive columns; ``runs`` the nested
    results with ``file``. ``watch`` adds the F1 of named scenarios.
    """
    joined = listing.join(runs.withColumn("_found", F.lit(True)), "file", "left")
    fields = ["f1", "precision", "recall", "pr_auc", "roc_auc", "fn", "fp", "tp", "tn"]
    watched = [F.try_element_at("test_per_scenario", F.lit(s))["f1"].alias(f"{s.replace('-', '_')}_f1") for s in watch]
    extra = [c for c in ("params", "fit_seconds") if c in runs.columns]
    return joined.select(
        *listing.columns, F.col("_found").isNull().alias("missing"),
        *[F.col(f"test.{f}").alias(f) for f in fields], *watched, *extra)


def by_category(table: DataFrame) -> DataFrame:
    """Runs, missing runs and the best F1 of every category."""
    return table.groupBy("category").agg(
        F.count("*").alias("runs"), F.count(F.when(F.col("missing"), 1)).alias("missing"),
        F.max("f1").alias("best_f1"))
