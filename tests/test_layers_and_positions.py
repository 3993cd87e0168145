"""Positions between and beyond stations, closest points, relevance by layer; boundary values of the fixed rules."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from boresight.functions import lexicon, text
from boresight.functions.numeric import fuse
from boresight.operators import events, extraction, questions, records, relevance, retrieval, risk, trajectory
from boresight.plans import spatial
from boresight.streaming import alerts

rng = random.Random(6)


def survey(spark, rows):
    return trajectory.integrate_survey(spark.createDataFrame(rows, "well_id string, k int, md double, inc double, azi double"))


def positions(spark, surveyed, asked):
    df = spark.createDataFrame(asked, "well_id string, x double")
    return {(r.well_id, r.x): r for r in trajectory.position_at(df, surveyed).collect()}


def test_vertical_and_circular_bores(spark):
    radius = 600.0
    quarter = radius * math.pi / 2
    rows = [("v", 1, 0.0, 0.0, 0.0), ("v", 2, 2000.0, 0.0, 0.0), ("c", 1, 0.0, 0.0, 0.0), ("c", 2, quarter, 90.0, 90.0), ("one", 1, 100.0, 5.0, 0.0)]
    s = survey(spark, rows)
    found = positions(spark, s, [("v", 700.0), ("v", -5.0), ("v", 2500.0), ("c", quarter / 3), ("c", quarter), ("one", 400.0), ("none", 1.0)])
    assert (found["v", 700.0].tvd, found["v", -5.0].tvd, found["v", 2500.0].tvd) == (700.0, 0.0, 2000.0)
    p = found["c", quarter / 3]
    assert p.tvd == pytest.approx(radius * math.sin(math.pi / 6)) and p.east == pytest.approx(radius * (1 - math.cos(math.pi / 6))) and p.inc_at == pytest.approx(30)
    assert found["c", quarter].tvd == pytest.approx(radius) and found["one", 400.0].tvd == 100.0 and ("none", 1.0) not in found
    back = spark.createDataFrame([("c", radius / 2), ("c", 0.0), ("c", -3.0), ("v", 2100.0)], "well_id string, tvd double")
    md = {(r.well_id, r.tvd): r.md for r in trajectory.md_at_tvd(back, s).collect()}
    assert md["c", radius / 2] == pytest.approx(quarter / 3) and md["c", 0.0] == md["c", -3.0] == 0.0 and md["v", 2100.0] == pytest.approx(2100.0)


def test_depths_are_found_again(spark):
    """Arcs of all sizes, the smallest too."""
    rows = []
    for w in range(60):
        md, inc, azi = 0.0, rng.uniform(0, 80), rng.uniform(0, 360)
        for k in range(1, 6):
            rows.append((f"w{w}", k, md, inc, azi))
            md += rng.uniform(1, 200)
            turn = 10.0 ** rng.uniform(-8, 1.2)
            inc, azi = min(85.0, max(0.0, inc + rng.uniform(-turn, turn))), azi + rng.uniform(-turn, turn)
    s = survey(spark, rows)
    last = {r[0]: r[2] for r in rows}
    asked = [(w, rng.uniform(0, end)) for w, end in last.items() for _ in range(20)]
    at = trajectory.position_at(spark.createDataFrame(asked, "well_id string, x double"), s)
    worst = trajectory.md_at_tvd(at.select("well_id", "x", "tvd"), s).select(F.max(F.abs(F.col("x") - F.col("md")) * F.cos(F.radians(F.lit(85.0))))).first()[0]
    assert worst < 1e-4


def test_distance_compares_few_points(spark):
    paths = {i: (rng.uniform(0, 3000), rng.uniform(0, 3000), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(12)}
    points = [("f", i, x + 25 * n * dx, y + 25 * n * dy, 25.0 * n) for i, (x, y, dx, dy) in paths.items() for n in range(120)]
    df = spark.createDataFrame(points, "code string, a int, x double, y double, z double").cache()
    other = df.withColumnRenamed("a", "b")
    wanted = df.alias("p").join(other.alias("q"), "code").where("a < b").groupBy("a", "b").agg(F.min(sum((F.col(f"p.{c}") - F.col(f"q.{c}")) ** 2 for c in "xyz")).alias("d"))
    pairs = df.select("code", "a").distinct().join(other.select("code", "b").distinct(), "code").where("a < b")
    found = {(r.a, r.b): r.distance for r in trajectory.min_distance(df, other, ["code"], ("a", "b"), pairs).collect()}
    assert found.keys() == {(r.a, r.b) for r in wanted.collect()}
    assert all(found[r.a, r.b] == pytest.approx(math.sqrt(r.d)) for r in wanted.collect())
    compared = sum(r.count() for r in trajectory.distance_rounds(df, other, ["code"], ("a", "b"), pairs, 100.0, 8))
    assert compared < 0.1 * 66 * 120 * 120


def test_layers_without_components_say_why(spark, sf):
    f = spatial._field(spark, sf)
    made = relevance.layer_scores(f["pairs"], f["wells"], f["tops"], f["surveyed"], f["sections"]).cache()
    reasons = {r.reason for r in made.select("reason").distinct().collect()}
    assert None in reasons and reasons <= {None, relevance.ABSENT, relevance.BARELY}
    assert made.where("(reason IS NULL) <> (dist IS NOT NULL) OR (reason IS NOT NULL AND score <> 0)").count() == 0
    years = {r.well_id: r.spud_year for r in f["wells"].collect()}
    before = relevance.layer_scores(f["pairs"], f["wells"], f["tops"], f["surveyed"], f["sections"], later=False).select("active", "offset").distinct().collect()
    assert all(years[r.offset] <= years[r.active] for r in before)
    assert {(r.active, r.offset) for r in before} == {(r.active, r.offset) for r in made.select("active", "offset").distinct().collect() if years[r.offset] <= years[r.active]}
    rows = spark.createDataFrame([(1, 2, "L3"), (-1, -1, "x")], "active long, offset long, code string")
    assert {r.active: r.relevance for r in relevance.relevance_lookup(rows, made, ["active", "offset", "code"]).collect()}[-1] == 0.0


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], kind if "," in kind else f"i int, x {kind}")
    return [r.y for r in df.select("i", make(df).alias("y")).orderBy("i").collect()]


def test_severity_classes(spark):
    rows = [(None, 1.0, "resolved"), (None, 3.9, "resolved"), (None, 4.0, None), (None, 11.9, ""), (None, 13.0, ""), (None, 29.9, ""), (None, 35.0, ""), (None, 2.0, "failed"), (None, None, "failed"), ("total", None, ""), ("severe", 1.0, ""), ("partial", 30.0, ""), ("seepage", None, ""), ("poor bond", 5.0, "")]
    made = column(spark, rows, lambda df: events.severity(events.subtype_score(F.col("s")), F.col("h"), F.col("o"), F.lit(False)), "i int, s string, h double, o string")
    assert made == [2, 2, 3, 3, 4, 4, 5, 5, 2, 5, 4, 5, 2, 3]


def test_questions(spark):
    ask = ["3 km long section", "losses within 12.5 km", "what worked well here", "table of kicks", "how was it cured", "how deep is it", "Did drilling go without losses", "which wells lost mud"]
    parts = column(spark, ask, lambda df: F.struct(*[v.alias(k) for k, v in questions.parse(F.col("x")).items()]))
    assert [p.radius_km for p in parts] == [None, 12.5, None, None, None, None, None, None]
    assert [p.intent for p in parts] == ["describe", "describe", "how", "count", "how", "describe", "describe", "count"]
    assert [p.families == ["PR"] for p in parts] == [False, False, True, False, False, False, True, False]
    named = column(spark, ["wells A, B and ZZ near well C", "Well AB & B", "welfare A", "well a"], lambda df: questions.named_wells(F.col("x"), F.array(*map(F.lit, ("A", "B", "C", "AB")))))
    assert named == [["A", "B", "C"], ["AB", "B"], [], []]


def test_search_words(spark):
    assert column(spark, ["The wells near a problem happened to will has when losses"], lambda df: retrieval.tokens(F.col("x")))[0] == ["will", "has", "when", "loss"]


def test_answers_need_whole_numbers(spark):
    rows = [("Loss at 2,951 m [1].", ["951 m after 2 h"]), ("Loss at 2,951 m [1].", ["at 2,951 m"]), ("It took 3.5, then 4. [1][2]", ["3.5 h", "and 4 h"]), ("It took 3 [3].", ["3"]), ("no citation 3", ["3"])]
    df = spark.createDataFrame(rows, "sentence string, cited array<string>")
    assert {(r.sentence, tuple(r.cited)) for r in retrieval.verify_answer(df).collect()} == {(s, tuple(c)) for s, c in rows[1:3]}


def test_spans_follow_the_last_kept_one(spark):
    rows = [("p", 0, 10), ("p", 5, 30), ("p", 12, 20), ("p", 20, 21), ("q", 4, 6)]
    made = records.merge_spans(spark.createDataFrame(rows, "k string, start int, end int"), ["k"]).collect()
    assert sorted(tuple(r) for r in made) == [("p", 0, 10), ("p", 12, 20), ("p", 20, 21), ("q", 4, 6)]


def test_similarity_parts(spark):
    muds = column(spark, [("OBM", "OBM"), ("SBM", "OBM"), ("SBM", "KCL")], lambda df: relevance.mud_similarity(F.col("a"), F.col("b")), "i int, a string, b string")
    years = column(spark, [15.0, 0.0, -9.0], lambda df: F.round(relevance.recency_score(F.col("x")), 6), "double")
    assert muds == [1.0, 0.3, 0.7] and years == [round(math.exp(-1), 6), 1.0, 1.0]


def test_pages(spark):
    pages = [
        "  First line\n goes on.  \n\nNew one\nDAILY REPORT 7\ntail\n5.2 Losses\nmore  text\n5.2\nTop", "a\n06:00 - 08:30 | 2.5 h | DRLG | drilled on\nfurther 08:30 - 09:00 | .5 h | TRIP | out", "", "\n\n", "SHORT\nabc", "x\n123456\ny",
    ]
    made = column(spark, pages, lambda df: text.page_text(F.col("x"), lexicon.TABLE_ROW))
    assert made == ["First line goes on.\nNew one\nDAILY REPORT 7\ntail\n5.2 Losses more text\n5.2 Top", "a\ndrilled on further\nout", "", "", "SHORT abc", "x\n123456\ny"]


def test_depths_are_held(spark):
    rows = [(1, "w", 2005.0, 2040.0, []), (2, "w", 2011.0, None, []), (3, "w", 6000.0, None, ["depth_unit_inferred"]), (4, "w", 6000.0, None, []), (5, "w", None, None, []), (6, "w", 1500.04, 1400.0, [])]
    df = spark.createDataFrame(rows, "event_id int, well_id string, md_top double, md_base double, flags array<string>")
    made = {r.event_id: (r.md_top, r.md_base, r.flags) for r in extraction.hold_depths(df, spark.createDataFrame([("w", 2000.0)], "well_id string, td double")).collect()}
    assert made == {1: (2000.0, 2000.0, []), 3: (1828.8, None, ["depth_unit_inferred", "converted_from_ft"]), 6: (1500.0, 1500.0, [])}


def test_wide_kernels_reach_all_their_points(spark):
    kernels = [("k", rng.uniform(0, 3000), s, 0.3) for s in (5.0, 10.0, 25.0, 60.0, 200.0) for _ in range(6)]
    grid = [("k", float(m), 0.02) for m in range(0, 3000, 10)]
    made = {r.md: r.risk for r in risk.noisy_or(spark.createDataFrame(grid, "key string, md double, floor double"), spark.createDataFrame(kernels, "key string, mu double, sigma double, amp double"), ["key"]).collect()}
    for _, md, floor in grid:
        miss = 1 - floor
        for _, mu, sigma, amp in kernels:
            z = (md - mu) / max(sigma, 10.0)
            miss *= 1 - amp * math.exp(-0.5 * z * z) * (abs(z) <= 8)
        assert made[md] == pytest.approx(1 - miss)


def test_contributors_of_zones(spark):
    zones = [("k", 100.0 * i, 100.0 * i + rng.choice((0.0, 10.0, 260.0))) for i in range(20)]
    rows = [("k", rng.uniform(-50, 2300), rng.choice((1.0, 30.0, 400.0)), rng.random(), i) for i in range(150)]
    made = risk.contributors(spark.createDataFrame(zones, "key string, md_from double, md_to double"), spark.createDataFrame(rows, "key string, mu double, sigma double, amp double, event_id int"), ["key"], 4).collect()
    found = {(r.md_from, r.md_to): (r.event_ids, r.n_events) for r in made}
    for _, low, high in zones:
        near = sorted((-amp, i) for _, mu, s, amp, i in rows if low - 2 * s <= mu <= high + 2 * s)
        assert found.get((low, high), ([], 0)) == ([i for _, i in near[:4]], len(near))


def test_alerts_use_the_curve_at_the_bit(spark):
    zone = alerts.Zone("LC-2800", "LC", 2800.0, 2830.0, 0.9)
    feed = spark.createDataFrame([("s", 0.0, 2700.0, 20.0, [], {"LC": 0.8}), ("s", 1.0, 2811.0, 20.0, [], {"LC": 0.8})], "session string, t double, bit_md double, rop_1h double, fired array<string>, live map<string,double>")
    curve = spark.createDataFrame([("LC", 2.0 * i, 0.5 if i == 1405 or i == 1406 else 0.1) for i in range(1500)], "family string, md double, risk double")
    made = {r.t: r.p_final for r in alerts.zone_rows(alerts.with_prior(feed, curve, 2.0, 1500), [zone]).where("zone = 'LC-2800'").collect()}
    expected = spark.range(1).select(fuse(F.lit(0.5), F.lit(0.8)).alias("p")).first().p
    assert made[0.0] == 0.9 and made[1.0] == pytest.approx(expected)
