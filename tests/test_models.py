"""Boosted trees with patience."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import models


@pytest.mark.parametrize("losses,patience,want", [
    ([3, 2, 1, 1, 1], 2, (3, True)), ([3, 2, 1, 1], 2, (3, False)), ([1, 2, 3, 0], 2, (1, True)), ([1, 2, 0, 3], 2, (3, False)), ([1], 5, (1, False))])
def test_best_round(losses, patience, want):
    assert models.best_round(losses, patience) == want


def test_boosting_ends_at_the_best_validated_round(spark):
    rows = spark.range(240).select(F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("double").alias("b"), "id")
    rows = rows.withColumn("y", ((F.col("a") > 50) != (F.col("b") > 50)).cast("int"))
    train, val = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    model = models.fit_boosted(train, val, rounds=6, depth=2, patience=3, features=["a", "b"])
    full = models.fit_boosted(train, val.limit(0), rounds=6, depth=2, features=["a", "b"])
    assert full.getNumTrees == 6
    weighted = models.assemble(val.withColumn("weight", F.lit(1.0)), ["a", "b"])
    losses = full.evaluateEachIteration(weighted)
    # The chosen ensemble is a beginning of the full one.
    assert 1 <= model.getNumTrees <= 6 and model.evaluateEachIteration(weighted) == pytest.approx(losses[:model.getNumTrees])


def test_fits_are_dealt_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    one, many = rows.coalesce(1), rows.repartition(40)
    with models._kept(one, all_cores=True) as a, models._kept(many) as b:
        assert a.rdd.getNumPartitions() == cores and b.rdd.getNumPartitions() == 1
        assert sorted(a.collect()) == sorted(b.collect()) == sorted(rows.collect())
    assert [models.fit_tasks(n, 12) for n in (0, 1, 20_001, 420_000, 24_000_000, 30_000_000)] == [1, 1, 2, 12, 12, 15]
    model = models.fit_forest(one, trees=3, depth=4, features=["a", "b"])
    assert model.getNumTrees == 3 and model.getMaxDepth() == 4 and model.getCacheNodeIds()
    assert models.score_table(model, rows, features=["a", "b"]).where("y_true <> y_pred").count() == 0
