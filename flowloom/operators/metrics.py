"""Binary classification metrics, ranking curves and threshold calibration.

Scored tables have ``scenario, y_true, y_pred, proba``. Rows are reduced to
counts per score before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from flowloom import fixed
from flowloom.functions.ordered import running, small_side
from flowloom.functions.scalars import at_threshold

METRICS = ["n", "n_pos", "accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc", "tn", "fp", "fn", "tp"]


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where the denominator is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    def cell(t, p):
        return F.count(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), 1))

    return scored.groupBy(*group).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("y_true") == 1, 1)).alias("n_pos"),
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "accuracy": ratio(tp + F.col("tn"), F.col("n")),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def score_counts(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score. Missing scores (NULL or NaN)
    are one step, behind all others."""
    return scored.withColumn("proba", F.when(~F.isnan("proba"), F.col("proba"))).groupBy(*group, "proba").agg(
        F.count(F.when(F.col("y_true") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("y_true") != 1, 1)).alias("neg"))


def ranking_curve(scored: DataFrame, group: Sequence[str] = (), spread: bool = True) -> DataFrame:
    """Cumulative true and false positives by falling score, ties as one step.

    If scores are nearly all distinct, the running sums go through ordered
    slabs instead of one task per group.
    """
    return running(score_counts(scored, group), group, [F.desc("proba")],
                   {"tp_cum": ("sum", F.col("pos")), "fp_cum": ("sum", F.col("neg"))}, spread=spread)


def ranking_areas(scored: DataFrame, group: Sequence[str] = (), spread: bool = True) -> DataFrame:
    """Average precision (step sum) and ROC area (ties count half).

    The ROC area is NULL with a single class; average precision is NULL
    without positives.
    """
    curve = ranking_curve(scored, group, spread)
    tp, pos, neg = F.col("tp_cum"), F.col("pos"), F.col("neg")
    p, n = F.sum("pos"), F.sum("neg")
    ap = F.sum(pos * tp / (tp + F.col("fp_cum")))
    roc = F.sum(neg * (tp - pos / 2))
    return curve.groupBy(*group).agg(
        F.when(p > 0, ap / p).alias("pr_auc"),
        F.when((p > 0) & (n > 0), roc / (p.cast("double") * n)).alias("roc_auc"))


def _with_scores(scored: DataFrame) -> DataFrame:
    return scored if "proba" in scored.columns else scored.withColumn("proba", F.col("y_pred").cast("double"))


def evaluate(scored: DataFrame, group: Sequence[str] = (), spread: bool = True) -> DataFrame:
    """The full metric row, overall or per ``group``."""
    scored = _with_scores(scored)
    base = rates(confusion(scored, group))
    areas = ranking_areas(scored, group, spread)
    if group:
        both = base.join(areas, list(group))
    else:
        both = base.crossJoin(F.broadcast(areas))  # one row on each side
        both = both.withColumn("pr_auc", F.coalesce("pr_auc", F.lit(0.0)))
    return both.select(*group, *METRICS)


def evaluate_per_scenario(scored: DataFrame, spread: bool = True) -> DataFrame:
    """n, positives, F1 and average precision of each scenario."""
    return evaluate(scored, ["scenario"], spread).select("scenario", "n", "n_pos", "f1", "pr_auc")


def as_row(metrics: DataFrame) -> dict:
    """The single metric row as a plain dict, in reporting order."""
    r = metrics.first()
    return {m: r[m] for m in METRICS}


def pretty(row: dict, per_scenario: list[dict] = (), title: str = "results") -> str:
    """Short text rendering of a metric row."""
    def num(v):
        return "nan" if v is None else f"{v:.4f}"

    lines = [f"=== {title} ===", f"  n {row['n']:,}   n_pos {row['n_pos']:,}"]
    lines += [f"  {m:<10s}{num(row[m])}" for m in ("accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc")]
    lines.append("  tn={tn} fp={fp} fn={fn} tp={tp}".format(**row))
    for s in sorted(per_scenario, key=lambda s: s["scenario"]):
        lines.append(f"  {s['scenario']:<32s} n={s['n']:,} pos={s['n_pos']:,} F1={num(s['f1'])} PR-AUC={num(s['pr_auc'])}")
    return "\n".join(lines)


# --- thresholds -----------------------------------------------------------

def threshold_grid() -> list[float]:
    return [float(t) for t in np.linspace(fixed.THRESHOLD_FIRST, fixed.THRESHOLD_LAST, fixed.THRESHOLD_COUNT)]


def _thresholds_passed(proba: Column, grid: list[float]) -> Column:
    """How many grid points are <= the score.

    The arithmetic guess is at most one off because of rounding; the two
    neighbours in the grid settle it. A missing score (NULL or NaN) passes none.
    """
    points = F.array(*[F.lit(t) for t in grid])
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    guess = F.greatest(F.least(F.floor((proba - grid[0]) / step) + 1, F.lit(len(grid))), F.lit(0)).cast("int")
    above = F.coalesce(F.get(points, guess) <= proba, F.lit(False))
    below = F.coalesce(F.get(points, guess - 1) > proba, F.lit(False))
    return F.when(proba.isNull() | F.isnan(proba), 0).when(above, guess + 1).when(below, guess - 1).otherwise(guess)


def threshold_scores(scored: DataFrame, group: Sequence[str] = (), grid: list[float] | None = None) -> DataFrame:
    """F1 at every usable grid threshold per group.

    Rows are binned by the number of thresholds they pass, so at most one row
    per bin is repeated over the thresholds.
    """
    grid = grid or threshold_grid()
    bins = scored.groupBy(*group, _thresholds_passed(F.col("proba"), grid).alias("bin")).agg(
        F.count(F.when(F.col("y_true") == 1, 1)).alias("pos"), F.count(F.when(F.col("y_true") != 1, 1)).alias("neg"))
    totals = bins.groupBy(*group).agg(F.sum("pos").alias("n_pos"))
    at = bins.where("bin > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("bin") - 1)))
    sums = at.groupBy(*group, "k").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp")).where("tp > 0")
    both = sums.join(totals, list(group)) if group else sums.crossJoin(F.broadcast(totals))  # one row
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("n_pos")
    points = F.array(*[F.lit(t) for t in grid])
    return both.select(
        *group, "k", F.get(points, F.col("k")).alias("threshold"),
        (2 * precision * recall / (precision + recall)).alias("f1"))


def best_threshold(scored: DataFrame, group: Sequence[str] = (), grid: list[float] | None = None) -> DataFrame:
    """Threshold with the highest F1, the lowest one on a tie.

    Without positives: (0.5, 0). With positives none of which passes any
    threshold: (0.5, -1).
    """
    best = threshold_scores(scored, group, grid).groupBy(*group).agg(
        F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("k"))).alias("best"))
    pos = scored.groupBy(*group).agg(F.count(F.when(F.col("y_true") == 1, 1)).alias("n_pos"))
    joined = pos.join(best, list(group), "left") if group else pos.crossJoin(F.broadcast(best))  # one row each
    empty = F.when(F.col("n_pos") == 0, 0.0).otherwise(-1.0)
    return joined.select(
        *group, "n_pos", F.coalesce("best.threshold", F.lit(fixed.FALLBACK_THRESHOLD)).alias("threshold"),
        F.coalesce("best.f1", empty).alias("f1"))


def apply_thresholds(scored: DataFrame, thresholds: DataFrame, fallback: float) -> DataFrame:
    """Predict with the scenario's own threshold, else with ``fallback``."""
    own = small_side(thresholds.select("scenario", F.col("threshold").alias("_t")))
    return (
        scored.join(own, "scenario", "left")
        .withColumn("y_pred", at_threshold(F.col("proba"), F.coalesce("_t", F.lit(fallback)))).drop("_t"))


def scenario_thresholds(val: DataFrame, global_threshold: float) -> DataFrame:
    """Per-scenario thresholds; scenarios without positives get the global one."""
    t = best_threshold(val, ["scenario"])
    return t.withColumn("threshold", F.when(F.col("n_pos") > 0, F.col("threshold")).otherwise(global_threshold))


def calibrate(val: DataFrame, test: DataFrame) -> DataFrame:
    """Test metrics of three strategies: fixed 0.5, one tuned threshold, and
    one per scenario with the tuned threshold as fallback."""
    tuned = best_threshold(val).first()["threshold"]
    per = scenario_thresholds(val, tuned)
    named = {
        "fixed": test.withColumn("y_pred", at_threshold(F.col("proba"), fixed.FALLBACK_THRESHOLD)),
        "global": test.withColumn("y_pred", at_threshold(F.col("proba"), tuned)),
        "per_scenario": apply_thresholds(test, per, tuned),
    }
    parts = [rates(confusion(df)).select(F.lit(name).alias("strategy"), "n", "n_pos", "precision", "recall", "f1")
             for name, df in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def compare_scenarios(before: DataFrame, after: DataFrame) -> DataFrame:
    """F1 per scenario before and after, and the change; one-sided scenarios stay."""
    a = before.select("scenario", F.col("f1").alias("f1_before"))
    b = after.select("scenario", F.col("f1").alias("f1_after"))
    return a.join(b, "scenario", "full").withColumn("delta", F.col("f1_after") - F.col("f1_before"))


def sweep(scored_at: Callable[[DataFrame], DataFrame], inputs: DataFrame, key: str) -> DataFrame:
    """Metrics of every value of ``key`` and the F1 change to its smallest value."""
    return add_baseline(rates(confusion(scored_at(inputs), [key])), key)


def add_baseline(rows: DataFrame, key: str) -> DataFrame:
    """``delta_f1``: the difference to the F1 of the smallest value of ``key``."""
    base = rows.agg(F.min_by("f1", key).alias("_base"))
    return rows.crossJoin(F.broadcast(base)).withColumn(  # one row
        "delta_f1", F.col("f1") - F.col("_base")).drop("_base")
