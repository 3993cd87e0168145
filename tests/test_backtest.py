"""The backtest against a loop over bores, similar profiles against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from boresight.operators import backtest, profiles


def test_lookahead(spark):
    rng = random.Random(6)
    families = ["LC", "SP"]
    bores = [(b, rng.uniform(0, 9000), rng.uniform(0, 9000), None if b == 9 else 1990 + b % 7) for b in range(24)]
    events = [(b, rng.choice(families), round(rng.uniform(900, 1400), 1)) for b in range(24) for _ in range(rng.randrange(4))] + [(3, "LC", 1200.0)] * 2
    offsets = backtest.earlier_offsets(spark.createDataFrame(bores, "bore long, x double, y double, year int"), 4000.0)
    truth = spark.createDataFrame(events, "bore long, family string, md double")
    found = {r.method: r for r in backtest.lookahead({"baseline": backtest.baseline_kernels(offsets, truth), "none": backtest.baseline_kernels(offsets, truth.where("false"))}, offsets, truth, families, 1000.0, 1400.0, 5.0, 0.4).collect()}
    n = hits = flagged = points = 0
    for b, x, y, year in bores:
        near = sorted((math.hypot(x - u, y - v), o) for o, u, v, other in bores if year and other and other < year and math.hypot(x - u, y - v) <= 4000)[:5]
        own = [(f, md) for o, f, md in events if o == b and md > 1000]
        if not near or not own:
            continue
        grid = [5.0 * i for i in range(201, 281)]
        high = {f: {z for z in grid if round(1 - math.prod(1 - 0.85 * math.exp(-d / 6000) * math.exp(-0.5 * ((z - md) / 10) ** 2) for d, o in near for p, g, md in events if p == o and g == f), 3) >= 0.4} for f in families}
        flagged += len(set().union(*high.values()))
        points += len(grid)
        n += len(own)
        hits += sum(any(abs(z - md) <= 15 for z in high[f]) for f, md in own)
    assert 0 < hits < n
    r = found["baseline"]
    assert (r.events, r.hits) == (n, hits) and r.recall == pytest.approx(hits / n) and r.flagged == pytest.approx(flagged / points)
    assert (found["none"].events, found["none"].hits, found["none"].flagged) == (n, 0, 0.0)
    assert not {t.target for t in offsets.collect()} & {9} and not {t.bore for t in offsets.collect()} & {9}


def test_aligned_kernels(spark):
    """Two fifths down a layer here is two fifths down there; layers of little relevance and unknown layers don't count."""
    offsets = spark.createDataFrame([(1, 2, 10.0)], "target long, bore long, distance double")
    relevant = spark.createDataFrame([(1, 2, "A", 0.8), (1, 2, "B", 0.49)], "target long, bore long, layer string, s double")
    events = spark.createDataFrame([(2, f, "LC", 0.4, 50.0, 5, 1.0, 0.5, "auto") for f in ("A", "B", "C", None)], "bore long, layer string, family string, f_pos double, md double, severity int, confidence double, weight double, status string")
    tops = spark.createDataFrame([(1, "A", 100.0, 200.0, "actual"), (1, "B", 200.0, 300.0, "actual"), (2, "A", 10.0, 20.0, "actual")], "bore long, layer string, md_top double, md_base double, kind string")
    assert [(r.target, r.family, r.mu, r.sigma, r.amp) for r in backtest.aligned_kernels(offsets, relevant, events, tops).collect()] == [(1, "LC", 140.0, 6.0, pytest.approx(0.4))]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.6, 0.8, 1.0])
def test_alike_profiles(spark, least):
    rng = random.Random(11)
    sets = {e: {rng.randrange(14) for _ in range(rng.randrange(1, 9))} for e in range(90)} | {200 + i: {1, 2, 3} for i in range(20)}
    rows = [(e, i) for e, s in sets.items() for i in s] * 2 + [(None, 3), (5, None), (999, None)]
    members = profiles.profiles(spark.createDataFrame(rows, "who long, what long"), "who", "what")
    classes: dict = {}
    for e in sorted(sets):
        classes.setdefault(frozenset(sets[e]), e)
    assert {(r.entity, r.profile) for r in members.collect()} == {(e, classes[frozenset(s)]) for e, s in sets.items()}
    wanted = {(a, b, len(s & t)) for s, a in classes.items() for t, b in classes.items() if a < b and len(s & t) / len(s | t) >= least}
    found = profiles.alike(members, least).collect()
    assert {(r.left, r.right, r.common) for r in found} == wanted and len(found) == len(wanted)
    assert profiles.alike(members.where("false"), least).count() == 0
