"""Standardisation fitted on one split, and class weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from flowloom import fixed


@dataclass(frozen=True)
class Scaler:
    """Column means and floored sample standard deviations."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        """Standardise in place; a projection of literals, no join."""
        return df.withColumns({
            c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.mean, self.std)})


def scaler_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form of the fitted values: one row per column."""
    one = train.agg(*[F.struct(F.avg(c).alias("mean"), F.greatest(F.stddev_samp(c), F.lit(fixed.STD_FLOOR)).alias("std")).alias(c)
                      for c in columns])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in columns]))
    return one.select(stacked.alias("s")).select("s.*")


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """One aggregate over the training rows; only two numbers per column reach the driver."""
    rows = {r["feature"]: r for r in scaler_stats(train, columns).collect()}
    return Scaler(tuple(columns), tuple(rows[c]["mean"] for c in columns), tuple(rows[c]["std"] for c in columns))


def fit_feature_scaler(nodes: DataFrame) -> Scaler:
    return fit_scaler(nodes, fixed.NODE_FEATURES)


def fit_edge_scaler(edges: DataFrame) -> Scaler:
    return fit_scaler(edges, fixed.EDGE_FEATURES)


def class_weights(nodes: DataFrame, label: str = "y") -> DataFrame:
    """Inverse-frequency weights and the negative-to-positive ratio.

    A missing class counts as one row, so weights stay finite.
    """
    n = F.count(label)
    pos = F.count(F.when(F.col(label) == 1, 1))
    at_least_one_pos = F.greatest(pos, F.lit(1))
    at_least_one_neg = F.greatest(n - at_least_one_pos, F.lit(1))
    return nodes.agg(
        n.alias("n"), pos.alias("n_pos"),
        (n / (2 * at_least_one_neg)).alias("w_neg"), (n / (2 * at_least_one_pos)).alias("w_pos"),
        ((n - pos) / at_least_one_pos).alias("scale_pos_weight"))


def with_weight(nodes: DataFrame, label: str = "y", column: str = "weight") -> DataFrame:
    """Attach the balanced class weight to every row."""
    w = class_weights(nodes, label).first()
    return nodes.withColumn(column, F.when(F.col(label) == 1, w["w_pos"]).otherwise(w["w_neg"]))
