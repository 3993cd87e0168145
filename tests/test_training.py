"""Joint fits against one fit at a time, folds, alarm thresholds against a loop over them, leads."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boresight.operators import evaluate, training

NAMES = ["a", "b"]
ROWS = "`group` long, segment long, t double, a double, b double, y_LC int, y_SP int, y_TQ int"


def made(n: int = 600) -> list[tuple]:
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2)) * [2.0, 30.0] + [1.0, 1e5]
    lc = (x[:, 0] + rng.normal(size=n) > 2.5).astype(int)
    sp = ((x[:, 1] - 1e5) / 30 - x[:, 0] + rng.normal(size=n) > 1).astype(int)
    return [(int(i % 23), int(i % 46), float(i), float(x[i, 0]), float(x[i, 1]), int(lc[i]), int(sp[i]), int(i < 5)) for i in range(n)]


def alone(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One regression by plain Newton steps on all its rows."""
    z = np.hstack([(x - x.mean(0)) / (x.std(0) + 1e-6), np.ones((len(x), 1))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    own, w = np.diag([1.0, 1.0, 0.0]), np.zeros(3)
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(0.5 * (z.T * (weight * q * (1 - q))) @ z + own, 0.5 * z.T @ (weight * (q - y)) + own @ w)
    return w


def test_joint_fit_equals_separate_fits(spark):
    dealt = training.group_folds(spark.createDataFrame(made(), ROWS), "group").cache()
    assert dealt.groupBy("group").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert {r.n for r in dealt.groupBy("fold").agg(F.count_distinct("group").alias("n")).collect()} == {4, 5}
    models = training.fit(dealt, NAMES, ["LC", "SP", "TQ"])
    assert models.keys() == {(f, k) for f in ("LC", "SP") for k in range(-1, 5)}  # TQ has five positives
    rows = dealt.collect()
    for (f, k), m in models.items():
        kept = [r for r in rows if r.fold != k]
        wanted = alone(np.array([[r.a, r.b] for r in kept]), np.array([r[f"y_{f}"] for r in kept]))
        assert np.allclose([*m["coef"], m["intercept"]], wanted, atol=1e-6)
    for r in training.out_of_fold(dealt, models, NAMES, ["LC", "TQ"]).collect()[:200]:
        m = models["LC", r.fold]
        z = sum(c * (r[n] - u) / s for c, n, u, s in zip(m["coef"], NAMES, m["mean"], m["std"])) + m["intercept"]
        assert r.p_LC == pytest.approx(1 / (1 + np.exp(-z))) and r.p_TQ is None


def test_rows_without_features(spark):
    """Null and infinite features take no part and have no score; one class or no rows give no model."""
    rows = made(300)
    odd = [(1, 1, 1e4, None, 1.0, 1, 1, 0), (1, 1, 1e4, float("nan"), 1.0, 1, 1, 0), (2, 2, 1e4, float("inf"), 1.0, 1, 1, 0)]
    dealt = spark.createDataFrame([(i % 5, *r) for i, r in enumerate(rows)] + [(0, *r) for r in odd], "fold int, " + ROWS)
    plain = training.fit(dealt.where("t < 1e4"), NAMES, ["LC"])
    found = training.fit(dealt, NAMES, ["LC"])
    assert all(np.allclose(found[k]["coef"], plain[k]["coef"], atol=1e-8) for k in plain) and found.keys() == plain.keys()
    assert training.out_of_fold(dealt, found, NAMES, ["LC"]).where("a IS NULL AND p_LC IS NOT NULL").isEmpty()
    assert training.fit(dealt.where("false"), NAMES, ["LC"]) == {} and training.fit(dealt.withColumn("y_LC", F.lit(1)), NAMES, ["LC"]) == {}


def test_false_alarm_rates_are_those_of_each_threshold(spark):
    rng = np.random.default_rng(8)
    cuts = [0.2, 0.5, 0.5, 0.9]
    rows = [(s, (None, "SP", "LC", "TQ")[s % 4], f, float(t), None if rng.random() < 0.1 else round(float(rng.random()), 1)) for s in range(12) for f in ("SP", "LC") for t in range(30)]
    found = {(r.family, r.threshold): r.false_per_day for r in evaluate.false_alarm_rates(spark.createDataFrame(rows, "segment long, kind string, family string, t double, p double"), cuts).collect()}
    for f in ("SP", "LC"):
        kept = [s for s in range(12) if (None, "SP", "LC", "TQ")[s % 4] not in (f, evaluate.CONFUSABLE.get(f, f))]
        for c in set(cuts):
            n = 0
            for s in kept:
                run = 0
                for *_, p in (r for r in rows if r[0] == s and r[2] == f):
                    run = run + 1 if p is not None and p >= c else 0
                    n += run == 2
            assert found[f, c] == pytest.approx(n / (len(kept) * 30 * 10 / 3600) * 24)
    assert len(found) == 6


def test_event_leads(spark):
    segments = [(1, "LC", 5000.0), (2, "SP", 5000.0), (3, None, None), (4, "LC", None), (5, "OP", 5000.0)]
    alarms = [(1, "LC", 1399.0), (1, "LC", 1400.0), (1, "SP", 1500.0), (2, "SP", 5601.0), (2, "SP", 5600.0), (5, "OP", 6201.0), (3, "LC", 1.0)]
    found = evaluate.event_leads(spark.createDataFrame(alarms, "segment long, family string, alarm_t double"), spark.createDataFrame(segments, "segment long, kind string, t_onset double"))
    assert {(r.segment, r.family): r.lead_min for r in found.collect()} == {(1, "LC"): 70.0, (2, "SP"): -10.0, (5, "OP"): None}


def test_report(spark):
    segments = spark.createDataFrame([(s, ("LC", "SP", None)[s % 3], 100.0) for s in range(46)], "segment long, kind string, t_onset double")
    found = {r.family: r for r in training.report(spark.createDataFrame(made(), ROWS), segments, NAMES, ["LC", "SP", "TQ"]).collect()}
    assert found.keys() == {"LC", "SP"} and all(r.auc > 0.8 and 0.5 <= r.threshold <= 0.99 and r.n_samples == 600 for r in found.values())
    assert training.report(spark.createDataFrame(made(40), ROWS), segments, NAMES, ["TQ"]).count() == 0


def test_backed_families(spark):
    from boresight.operators import features

    names = ["dflow", "pit_slope", "gas_ratio", "tq_z", "overpull", "tq_ssi"]
    rows = [(-0.04, 0.0, 1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.6, 1.6, 0.0, 0.5), (None,) * 6, (-0.03, -0.05, 1.5, 1.5, 8.0, 0.3)]
    made = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(features.backed().alias("x")).collect()
    assert [r.x for r in made] == [["LC", "CM"], ["OP", "SP", "TQ", "CM"], ["CM"], ["CM"]]


def test_alarms_are_not_dealt_by_family(spark):
    """The few thresholds are sent to the scores; scores dealt by family would land in as many tasks as there are families."""
    scored = spark.createDataFrame([(1, "LC", 10.0 * i, 0.9) for i in range(4)] + [(2, f, 10.0 * i, 0.1) for f in ("LC", "SP") for i in range(4)], "segment long, family string, t double, p double")
    segments = spark.createDataFrame([(1, "LC", 20.0), (2, None, None)], "segment long, kind string, t_onset double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = training.alarm_report(scored, segments)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[family#\d+\], \[family#\d+\], Inner", plan)
        assert {r.family: (r.n_events, r.event_recall) for r in found.collect()}["LC"] == (1, 1.0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
