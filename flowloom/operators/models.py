"""Tabular baselines and the hook for user-supplied scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom import fixed
from flowloom.functions.ordered import hash_sample_exact
from flowloom.operators.metrics import confusion, rates
from flowloom.operators.scaling import class_weights, with_weight
from flowloom.session import checkpoint_dir

FEW_ROWS, MOST_ROWS = 20_000, 2_000_000  # training rows a task
PASS_MB = 512  # statistics of the nodes that one task of a forest's pass holds
SCORED = "scenario string, window_idx int, node_idx int, y_true int, y_pred int, proba double"


def assemble(nodes: DataFrame, features: Sequence[str] = tuple(fixed.NODE_FEATURES)) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(nodes)


def fit_tasks(rows: int, cores: int, least: int = 1) -> int:
    """Tasks of every job of a fit: no more than there are cores, ``least`` at least,
    and more only where one would hold over MOST_ROWS."""
    return max(least, min(cores, -(-rows // FEW_ROWS)), -(-rows // MOST_ROWS))


@contextmanager
def _kept(rows: DataFrame, all_cores: bool = False) -> Iterator[DataFrame]:
    """Keep training rows in executor storage while a fit passes over them.

    They are dealt evenly over :func:`fit_tasks` partitions, whatever files they came from:
    a fit runs up to thousands of short jobs, and every task of each reports to the driver.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    found = rows.persist(StorageLevel.MEMORY_AND_DISK)
    kept = None
    try:
        kept = found.repartition(fit_tasks(found.count(), cores, cores if all_cores else 1)).persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        found.unpersist()
        yield kept
    finally:
        found.unpersist()
        if kept is not None:
            kept.unpersist()


def fit_forest(train: DataFrame, trees: int = 500, depth: int = 30, seed: int = fixed.SEED, label: str = "y",
               features: Sequence[str] = tuple(fixed.NODE_FEATURES)) -> Model:
    """Random forest with balanced class weights. Spark limits depth to 30.

    Splits are searched for on all cores, many nodes in one pass, and each row's node in
    every tree is kept, so that a pass does not walk deep trees from their roots. These
    settings change the passes, not the model's parameters.
    """
    checkpoint_dir(train.sparkSession)  # the kept node numbers cut their lineage there
    rf = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed,
                                cacheNodeIds=True, maxMemoryInMB=PASS_MB)
    with _kept(train.select(label, *features), all_cores=True) as rows:
        return rf.fit(assemble(with_weight(rows, label), features))


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The number of rounds with the smallest loss before ``patience`` rounds without
    a smaller one, and whether that many have passed."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_boosted(train: DataFrame, val: DataFrame, rounds: int = 500, depth: int = 6, step: float = 0.1, patience: int = 20,
                seed: int = fixed.SEED, label: str = "y", features: Sequence[str] = tuple(fixed.NODE_FEATURES)) -> Model:
    """Boosted trees up to the round with the smallest validation loss, looked for until
    ``patience`` rounds bring no smaller one; positives are weighted by the
    negative-to-positive ratio.

    Spark's own rule stops at the first small gain. Here the losses of all
    prefixes of an ensemble come from one pass over the validation rows, and the
    ensemble is grown (twice as long each time, the same first trees) until the
    rule is met. Without validation rows all rounds stay.
    """
    checkpoint_dir(train.sparkSession)  # the rounds cut their lineage there
    columns = [label, *features]
    with _kept(train.select(*columns)) as rows, _kept(val.select(*columns)) as held_out:
        ratio = F.lit(class_weights(rows, label).first()["scale_pos_weight"])
        weight = F.when(F.col(label) == 1, ratio).otherwise(1.0)
        fitted, judged = (assemble(x.withColumn("weight", weight), features) for x in (rows, held_out))

        def fit(n: int) -> Model:
            return GBTClassifier(labelCol=label, weightCol="weight", maxIter=n, maxDepth=depth, stepSize=step, seed=seed).fit(fitted)

        if held_out.isEmpty():
            return fit(rounds)
        n = min(rounds, 2 * patience)
        while True:
            model = fit(n)
            best, done = best_round(model.evaluateEachIteration(judged), patience)
            if done or n == rounds:
                return model if best == n else fit(best)
            n = min(rounds, 2 * n)


def score_table(model: Model, nodes: DataFrame, label: str = "y",
                features: Sequence[str] = tuple(fixed.NODE_FEATURES)) -> DataFrame:
    """Scored nodes in the form the metrics operators take."""
    out = model.transform(assemble(nodes, features))
    keep = [c for c in nodes.columns if c not in features]
    return out.select(*keep, F.col(label).alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                      vector_to_array("probability")[1].alias("proba"))


def importances(spark: SparkSession, model: Model, features: Sequence[str] = tuple(fixed.NODE_FEATURES)) -> DataFrame:
    """Features by falling importance (one row per feature)."""
    values = [float(x) for x in model.featureImportances.toArray()]
    pairs = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    return pairs.orderBy(F.desc("importance"), F.asc("feature"))


def stratified_split(nodes: DataFrame, test_frac: float = 0.25, seed: int = fixed.SEED, label: str = "y",
                     key: Sequence[str] = ("scenario", "window_start", "ip"),
                     by: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact share of every class held out, chosen by a seeded hash."""
    marked = hash_sample_exact(nodes, [label], test_frac, [F.col(c) for c in key], seed, by=by)
    return marked.where("NOT held_out").drop("held_out"), marked.where("held_out").drop("held_out")


def sanity_check(nodes: DataFrame, trees: int = 500, depth: int = 30, gate: float = fixed.SANITY_F1,
                 test_frac: float = 0.25, seed: int = fixed.SEED) -> DataFrame | None:
    """Fit on three quarters of the nodes and report F1 against the gate.

    None when only one class is present.
    """
    have = nodes.agg(F.min("y"), F.max("y")).first()
    if have[0] == have[1]:
        return None
    train, test = stratified_split(nodes, test_frac, seed)
    model = fit_forest(train, trees, depth, seed)
    return rates(confusion(score_table(model, test))).withColumn("passed", F.col("f1") >= gate)


def score_graphs(nodes: DataFrame, edges: DataFrame,
                 fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str = SCORED,
                 keys: Sequence[str] = ("scenario", "window_idx")) -> DataFrame:
    """Apply a user model to each graph.

    ``fn(nodes, edges)`` gets one graph as two pandas frames, at most
    ``max_nodes`` nodes and their edges, and returns scored rows.
    """
    # Fresh column identities: both tables may stem from the same flows.
    edges = edges.select(*[F.col(c).alias(c) for c in edges.columns])
    return nodes.groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(fn, schema)
