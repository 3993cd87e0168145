"""Cases of the third round's findings: each failed, or cost too much, before its change."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from boresight.llm import near_copies, simhash
from boresight.operators import backtest, features, profiles, questions, reading, relevance, risk, trajectory
from boresight.plans import spatial
from boresight.streaming import alerts


def test_question_words_end_at_letters_with_marks(spark):
    asked = spark.createDataFrame([("mentera ñjara",), ("enjarado",), ("ócount é",), ("within\u000b5 km",)], "x string")
    parts = questions.parse(F.col("x"))
    found = asked.select(F.array_join(parts["families"], ",").alias("f"), parts["intent"].alias("i"), parts["radius_km"].alias("r")).collect()
    assert [r.f for r in found] == ["SP", "", "", ""]
    assert [r.i for r in found] == ["describe", "describe", "count", "describe"]
    assert [r.r for r in found] == [None] * 4


def test_runs_are_split_alike_however_many_words_are_held(spark):
    words = spark.createDataFrame([("mud", 9), ("loss", 9), ("pump", 5), ("rate", 5), ("stuck", 1), ("pipe", 1), ("12", 3)], "word string, n long")
    runs = spark.createDataFrame([(r,) for r in ("mudloss", "StuckPipe", "pumprate", "lossstuck", "zzmudzz", "qqqqqq")], "run string")
    split = lambda **how: {r.run: r.split for r in reading.split_runs(runs, words, **how).collect()}
    whole = split()
    assert whole["mudloss"] == "mud loss" and whole["StuckPipe"] == "Stuck Pipe"
    assert split(most=3) == split(most=1) == split(most=1, bits=1 << 16) == whole
    often, rare = reading.common_words(words, 3)
    assert {r.word for r in often.collect()} == {"mud", "loss", "pump"} and {r.word for r in rare.collect()} == {"rate", "stuck", "pipe"}


def test_only_pieces_that_may_be_words_are_joined(spark):
    words = spark.createDataFrame([(f"word{chr(97 + i)}", 2) for i in range(20)], "word string, n long")
    runs = spark.createDataFrame([("abcdefghij" * 300,)], "run string")  # 3,000 letters: 14,980 pieces of five, none a word
    assert reading.split_runs(runs, words, most=5).first().split.replace(" ", "") == "abcdefghij" * 300


def test_rate_has_no_sliding_frame(spark):
    df = spark.range(50).select(F.lit(1).alias("k"), (F.col("id") * 60).cast("timestamp").alias("at"), F.col("id").cast("double").alias("v"))
    made = features.rate_over(df, ["k"], "at", "v", 600)
    assert "RangeFrame" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.v: r.rate for r in made.collect()}[30.0] == 60.0


def test_picks_and_versions_equal_plain_loops_without_meeting_one_by_one(spark):
    rng = random.Random(5)
    records = [(rng.randrange(3), float(rng.randrange(200_000)), rng.choice([None, *range(100, 200)])) for _ in range(300)] + [(None, 5.0, 150)]
    tops = [(rng.randrange(4), i, float(rng.randrange(90, 220)), 100.0) for i in range(40)]
    df = spark.createDataFrame([(s, t, None if m is None else float(m)) for s, t, m in records], "session int, t double, hole_md double")
    picks = reading.first_picks(df, spark.createDataFrame(tops, "session int, code int, md_top double, md_prognosed double"))
    joins = [line for line in picks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any(">=" in line for line in joins)
    want = {}
    for s, code, top, _ in tops:
        times = [t for x, t, m in records if x == s and m is not None and m >= top + 2]
        if times:
            want[s, code] = min(times)
    got = {(r.session, r.code): r.t for r in picks.collect()}
    assert got == want
    made = reading.add_version(df, picks)
    assert "filter(" not in made._jdf.queryExecution().optimizedPlan().toString()
    found = sorted((r.session if r.session is not None else -1, r.t, r.version) for r in made.collect())
    assert found == sorted((s if s is not None else -1, t, sum(x == s and at <= t for (x, _), at in want.items())) for s, t, _ in records)


def test_neighbours_are_dealt_by_cells(spark, sf):
    df = spark.range(400).select("id", (F.col("id") * 7 % 101).cast("double").alias("x"), (F.col("id") * 13 % 97).cast("double").alias("y"))
    found = relevance.radius_neighbors(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", 5.0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    places = [(i, i * 7 % 101, i * 13 % 97) for i in range(400)]
    assert found.count() == sum((x - u) ** 2 + (y - v) ** 2 <= 25 for _, x, y in places for _, u, v in places)


def test_all_distances_shuffle_no_pair(spark):
    rng = random.Random(3)
    rows = [(k, i, *(rng.uniform(0, 90) for _ in range(3))) for k in "ab" for i in range(12) for _ in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "key string, id int, x double, y double, z double")
    sides = df.withColumnRenamed("id", "l"), df.withColumnRenamed("id", "r")
    made = trajectory.min_distance(*sides, ["key"], ("l", "r"))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k, i, *p in rows:
        for m, j, *q in rows:
            if k == m and i != j:
                want[k, i, j] = min(want.get((k, i, j), 1e9), sum((u - v) ** 2 for u, v in zip(p, q)) ** 0.5)
    for found in (made, trajectory.all_distances(*sides, ["key"], ("l", "r"), block=5)):
        got = {(r.key, r.l, r.r): r.distance for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_alike_pairs_are_made_once_where_they_meet(spark):
    rng = random.Random(4)
    held = {i: frozenset(rng.sample("abcdefghijkl", rng.randrange(1, 9))) for i in range(90)}
    members = profiles.profiles(spark.createDataFrame([(i, x) for i, s in held.items() for x in s], "e int, i string"), "e", "i")
    found = profiles.alike(members, 0.6)
    last = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Join" in line for line in last) == 1 and not any("Aggregate" in line for line in last)
    heads = {min(i for i in held if held[i] == s): s for s in held.values()}
    want = {(a, b): len(s & t) / len(s | t) for a, s in heads.items() for b, t in heads.items() if a < b and len(s & t) >= 0.6 * len(s | t)}
    got = {(r.left, r.right): r.jaccard for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want) and found.count() == len(want)


def test_layers_of_pairs_are_scored_where_both_wells_are(spark, sf):
    f = spatial._field(spark, sf)
    made = relevance.layer_scores(f["pairs"], f["wells"], f["tops"], f["surveyed"], f["sections"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Join" not in after and "Aggregate" not in after and "Window" not in after  # each of these shuffled rows of pairs
    last = spark.createDataFrame([(1, 2), (2, 1), (1, None), (77, 1)], "active long, offset long")
    few = relevance.layer_scores(last, f["wells"].where("well_id < 3"), f["tops"].where("well_id <> 2"), f["surveyed"], f["sections"]).collect()
    assert {(r.active, r.offset) for r in few} == {(1, 2)} and {r.reason for r in few} == {relevance.ABSENT} and all(r.score == 0 for r in few)


def test_nearest_points_of_several_paths():
    rng = np.random.default_rng(2)
    points, path = rng.uniform(0, 9, (60, 3)), rng.uniform(0, 9, (7, 3))
    points[5] = np.nan
    start, many = np.array([50, 0, 5, 10]), np.array([10, 5, 1, 30])
    want = [min((((p - q) ** 2).sum() ** 0.5 for p in path for q in points[s : s + n] if not np.isnan(q).any()), default=np.nan) for s, n in zip(start, many)]
    for cells in (1, 50, 1 << 15):
        assert np.allclose(relevance.nearest(path, points, start, many, cells), want, equal_nan=True)


def test_near_copies_begin_with_fingerprints(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(r"text rlike '[a-z]'")
    texts = docs.select(F.xxhash64("text").alias("node"), "text")
    root = {r.node: r.node for r in texts.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    asked, pairs = [], near_copies.fingerprint_pairs
    for r in pairs(texts).collect():
        a, b = find(r.a), find(r.b)
        root[max(a, b)] = min(a, b)
    assert {n: find(n) for n in root} == {r.doc_id: r.component_id for r in simhash.near_groups(texts.withColumnRenamed("node", "doc_id")).collect()}
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda t: asked.append(1) or pairs(t))
    corpus_pipeline.near_dedup(spark, docs, sf)
    assert asked


def test_lookahead_shuffles_no_grid(spark):
    offsets = spark.createDataFrame([(t, t + 100, 10.0) for t in range(3)], "target long, bore long, distance double")
    truth = spark.createDataFrame([(t, "LC", 1010.0) for t in range(3)] + [(100, "LC", 1012.0), (101, "SP", 1012.0)], "bore long, family string, md double")
    kernels = {"one": backtest.baseline_kernels(offsets, truth).unionByName(spark.createDataFrame([(0, "LC", None, 1.0, 0.9), (None, "LC", 1010.0, 1.0, 0.9)], "target long, family string, mu double, sigma double, amp double"))}
    made = backtest.lookahead(kernels, offsets, truth, ["LC", "SP"], 1000.0, 3000.0, 5.0, 0.4)
    assert "sequence(" not in made._jdf.queryExecution().optimizedPlan().toString()  # grid points were rows
    assert [(r.events, r.hits) for r in made.collect()] == [(3, 1)]


def test_curves_of_a_group_equal_the_joined_ones_without_pairs(spark):
    rng = random.Random(9)
    points = spark.createDataFrame([(b, f, 2.0 * i, 0.1 * b, None if i % 5 else "A") for b in range(3) for f in ("x", "y") for i in range(200)] + [(None, "x", 4.0, 0.5, "A")], "bore long, family string, md double, floor double, layer string")
    made = [(rng.randrange(4), rng.choice("xyz"), rng.uniform(-100, 500), rng.choice([4.0, 12.0, 40.0]), rng.random()) for _ in range(300)] + [(0, "x", 100.0, 10.0, None), (0, "y", None, 10.0, 0.5)]
    kernels = spark.createDataFrame(made, "bore long, family string, mu double, sigma double, amp double")
    found = risk.noisy_or_by(points, kernels, ["bore"], ["bore", "family"], carried=["layer"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.bore, r.family, r.md): (r.risk, r.layer) for r in risk.noisy_or(points.where("bore IS NOT NULL"), kernels.where("mu IS NOT NULL"), ["bore", "family"], carried=["layer"]).collect()}
    got = {(r.bore, r.family, r.md): (r.risk, r.layer) for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_numbered_alerts_fold_records_once(spark):
    feed = spark.createDataFrame([("a", 10.0 * i, 2700.0 + i, 20.0, ["LC"], {"LC": 0.9}) for i in range(30)], "session string, t double, bit_md double, rop_1h double, fired array<string>, live map<string,double>")
    made = alerts.numbered(alerts.timeline(feed, [alerts.Zone("LC-2710", "LC", 2710.0, 2720.0, 0.9)]))
    assert "MapInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()  # twice, before
    assert {r.alert_id for r in made.collect()} == {"AL-001"}
