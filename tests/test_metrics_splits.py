import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.config import SplitSpec
from flowloom.operators import metrics as M, scaling, splits

SCORED = "scenario string, y_true int, y_pred int, proba double"


def scored(spark, y, p, proba=None, scenario="s"):
    proba = [float(x) for x in (proba if proba is not None else p)]
    sc = [scenario] * len(y) if isinstance(scenario, str) else scenario
    return spark.createDataFrame(list(zip(sc, y, p, proba)), SCORED)


def test_perfect(spark):
    y = [0, 0, 1, 1, 1, 0, 1]
    r = M.as_row(M.evaluate(scored(spark, y, y)))
    assert [r[m] for m in ("accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc")] == [1] * 6
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (3, 0, 0, 4)
    assert "F1" in M.pretty(r, [dict(scenario="s", n=7, n_pos=4, f1=1.0, pr_auc=None)])


def test_all_negative_and_single_class(spark):
    r = M.as_row(M.evaluate(scored(spark, [0, 0, 1, 1], [0, 0, 0, 0])))
    assert (r["precision"], r["recall"], r["f1"], r["tn"], r["fn"]) == (0, 0, 0, 2, 2)
    one = M.as_row(M.evaluate(scored(spark, [0, 0], [0, 0], [0.1, 0.2])))
    assert one["roc_auc"] is None and one["pr_auc"] == 0.0
    assert M.evaluate_per_scenario(scored(spark, [0, 0], [0, 0])).first()["pr_auc"] is None


def test_predictions_stand_in_for_missing_scores(spark):
    df = scored(spark, [0, 1, 1], [0, 1, 0]).drop("proba")
    assert M.evaluate(df).first()["pr_auc"] == pytest.approx(2 / 3 * 0 + 0.5 * 1 + 0.5 * 2 / 3)


def test_per_scenario(spark):
    df = scored(spark, [0, 0, 1, 1, 0, 1], [0, 0, 1, 0, 0, 1], scenario=list("AAAABB"))
    f1 = {r["scenario"]: r["f1"] for r in M.evaluate_per_scenario(df).collect()}
    assert f1 == {"A": pytest.approx(2 / 3), "B": 1.0}


def brute(y, p):
    order = sorted(set(p), reverse=True)
    ap, last, n_pos = 0.0, 0.0, sum(y)
    for t in order:
        hit = [a for a, b in zip(y, p) if b >= t]
        rec = sum(hit) / n_pos
        ap += (rec - last) * sum(hit) / len(hit)
        last = rec
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    roc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    return ap, roc


@pytest.mark.parametrize("spread", [False, True])
def test_areas_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    y = [int(x) for x in rng.integers(0, 2, 300)]
    p = [round(float(x), 2) for x in rng.random(300)]
    r = M.evaluate(scored(spark, y, [0] * 300, p), spread=spread).first()
    ap, roc = brute(y, p)
    assert r["pr_auc"] == pytest.approx(ap) and r["roc_auc"] == pytest.approx(roc)


def brute_threshold(y, p):
    if sum(y) == 0:
        return 0.5, 0.0
    best = (0.5, -1.0)
    for t in np.linspace(0.05, 0.95, 91):
        tp = sum(1 for a, b in zip(y, p) if b >= t and a)
        fp = sum(1 for a, b in zip(y, p) if b >= t and not a)
        if tp:
            pr, rc = tp / (tp + fp), tp / sum(y)
            f = 2 * pr * rc / (pr + rc)
            if f > best[1]:
                best = (float(t), f)
    return best


@pytest.mark.parametrize("y, p", [
    ([0, 1, 1, 0, 1], [0.2, 0.58, 0.9, 0.58, 0.3]), ([0, 0], [0.2, 0.3]), ([1, 0], [0.01, 0.5]), ([1, 1], [0.95, 1.0]),
    ([0, 1] * 91, [t for t in np.linspace(0.05, 0.95, 91) for _ in (0, 1)])])
def test_best_threshold(spark, y, p):
    r = M.best_threshold(scored(spark, y, [0] * len(y), p)).first()
    t, f = brute_threshold(y, p)
    assert (r["threshold"], r["f1"]) == (pytest.approx(t), pytest.approx(f))


def test_calibration_falls_back(spark):
    val = scored(spark, [0, 1, 1, 0], [0] * 4, [0.1, 0.3, 0.4, 0.35], scenario=list("AAAB"))
    test = scored(spark, [1, 1, 1], [0] * 3, [0.29, 0.3, 0.3], scenario=list("ABC"))
    per = {r["scenario"]: r["threshold"] for r in M.scenario_thresholds(val, 0.25).collect()}
    assert per["B"] == 0.25
    out = {r["strategy"]: r["recall"] for r in M.calibrate(val, test).collect()}
    assert out["fixed"] == 0 and out["global"] == 1


@pytest.mark.parametrize("n, want", [(100, (60, 20, 20)), (7, (4, 1, 2)), (1, (0, 0, 1))])
def test_chronological(spark, n, want):
    g = spark.range(n).select(F.lit("a").alias("scenario"), F.timestamp_seconds("id").alias("window_start"))
    rows = splits.chronological(g, 0.6, 0.2).orderBy("window_start").collect()
    got = [r["split"] for r in rows]
    assert got == ["train"] * want[0] + ["val"] * want[1] + ["test"] * want[2]


def test_roles(spark, tmp_path):
    path = tmp_path / "split.yaml"
    path.write_text("split_version: 1\nseed: 42\ntrain_frac: 0.6\nval_frac: 0.2\ntrain:\n  - a\nholdout_test:\n  - b\nexcluded:\n  - c\n")
    spec = SplitSpec.load(str(path))
    assert spec.scenarios == ["a", "b"] and spec.test_frac == pytest.approx(0.2)
    g = spark.range(10).crossJoin(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "scenario string")).select(
        "scenario", F.timestamp_seconds("id").alias("window_start"), F.lit(3).alias("n_nodes"), F.lit(1).alias("n_bot_nodes"), F.lit(1).alias("graph_y"))
    a = splits.assign_splits(g, spec)
    counts = {(r["scenario"], r["split"]): r["count"] for r in a.groupBy("scenario", "split").count().collect()}
    assert counts == {("a", "train"): 6, ("a", "val"): 2, ("a", "test"): 2, ("b", "test"): 10}
    assert splits.split_overlaps(a).isEmpty() and splits.role_overlaps(spark, spec).isEmpty()
    assert not splits.role_overlaps(spark, SplitSpec(train_scenarios=("x",), excluded=("x",))).isEmpty()


def test_scaler(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "a double, b double")
    s = scaling.fit_scaler(df, ["a", "b"])
    assert s.mean == (4.5, 5.0) and s.std[1] == 1e-6 and s.std[0] == pytest.approx(np.std(range(10), ddof=1))
    r = s.apply(df).agg(F.avg("a"), F.stddev_samp("a"), F.max("b")).first()
    assert (r[0], r[1], r[2]) == (pytest.approx(0, abs=1e-12), pytest.approx(1), 0)


def test_class_weights(spark):
    w = scaling.class_weights(spark.createDataFrame([(0,)] * 9 + [(1,)], "y int")).first()
    assert (w["w_neg"], w["w_pos"]) == (pytest.approx(10 / 18), 5)
    none = scaling.class_weights(spark.createDataFrame([(0,)] * 5, "y int")).first()
    assert math.isfinite(none["w_pos"]) and none["w_pos"] > none["w_neg"]


def test_missing_scores_pass_no_threshold(spark):
    from flowloom.functions.scalars import at_threshold
    from flowloom.operators.metrics import best_threshold
    from pyspark.sql import functions as F

    rows = [(1, None), (1, float("nan")), (0, None), (1, 0.6), (0, 0.2)]
    scored = spark.createDataFrame(rows, "y_true int, proba double")
    assert [r.p for r in scored.select(at_threshold(F.col("proba"), 0.5).alias("p")).collect()] == [0, 0, 0, 1, 0]
    best = best_threshold(scored).collect()[0]
    assert best.f1 == pytest.approx(0.5) and best.threshold == pytest.approx(0.21)
    lost = best_threshold(spark.createDataFrame(rows[:3], "y_true int, proba double")).collect()[0]
    assert (lost.threshold, lost.f1) == (0.5, -1.0)
