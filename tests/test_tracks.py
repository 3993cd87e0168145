"""Tops and zones by version, alerts that follow a re-aligned track in any cut of the stream, snapshots against all changes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from boresight.functions.numeric import fuse
from boresight.operators import tracks
from boresight.streaming import alerts
from tests.test_alerts_and_merging import FEED, levels, made

TOPS = "session string, layer string, md_top double, md_prognosed double"
ZONES = "session string, version int, id string, family string, md_from double, md_to double, peak double"
# The session's second pick moves the loss zone by 20 m and ends the stuck pipe one; the third brings a new one.
MOVED = [("s3", 0, "LC-1000", "LC", 1000.0, 1030.0, 0.9), ("s3", 0, "SP-1100", "SP", 1100.0, 1110.0, 0.6), ("s3", 1, "LC-1020", "LC", 1020.0, 1050.0, 0.8), ("s3", 1, "SP-1100", "SP", 1100.0, 1110.0, 0.6),
         ("s3", 2, "LC-1020", "LC", 1020.0, 1050.0, 0.8), ("s3", 3, "OP-1200", "OP", 1200.0, 1210.0, 0.5)]
PICKS = [("s3", "A", 905.0, 900.0), ("s3", "B", 990.0, 999.0), ("s3", "C", 1085.0, 1085.0), ("other", "A", 10.0, 10.0)]


def test_tops_by_version(spark):
    tops = [("a", "A", 100.0, 90.0), ("a", "B", 150.0, 155.0), ("a", "C", None, 160.0), ("b", "A", None, 50.0), ("c", "A", 900.0, 900.0)]
    found = tracks.tops_by_version(spark.createDataFrame(tops, TOPS), F.lit(200.0))
    assert sorted((r.session, r.version, r.layer, r.md_top, r.md_base, r.kind) for r in found.collect()) == [
        ("a", 0, "A", 90.0, 155.0, "prognosed"), ("a", 0, "B", 155.0, 160.0, "prognosed"), ("a", 0, "C", 160.0, 200.0, "prognosed"),
        ("a", 1, "A", 100.0, 165.0, "actual"), ("a", 1, "B", 165.0, 170.0, "prognosed"), ("a", 1, "C", 170.0, 200.0, "prognosed"),
        ("a", 2, "A", 100.0, 150.0, "actual"), ("a", 2, "B", 150.0, 155.0, "actual"), ("a", 2, "C", 155.0, 200.0, "prognosed"),
        ("b", 0, "A", 50.0, 200.0, "prognosed"),
    ]
    near = spark.createDataFrame([("a", "A", 100.0, 60.0), ("a", "B", 110.0, 70.0), ("a", "C", None, 40.0)], TOPS)
    assert {r.layer: (r.md_top, r.kind) for r in tracks.tops_by_version(near, F.lit(200.0)).where("version = 2").collect()} == {"A": (100.0, "actual"), "B": (110.0, "actual"), "C": (110.0, "prognosed")}
    assert tracks.tops_by_version(spark.createDataFrame([], TOPS), F.lit(1.0)).count() == 0


def test_version_at(spark):
    records = spark.createDataFrame([("a", 101.9), ("a", 102.0), ("a", 400.0), ("a", None), ("x", 400.0), (None, 1.0)], "session string, hole_md double")
    found = tracks.version_at(records, spark.createDataFrame([("a", "A", 100.0, 90.0), ("a", "B", 150.0, 155.0), ("a", "C", None, 160.0)], TOPS))
    assert sorted((r.session or "", r.hole_md or 0, r.version) for r in found.collect()) == [("", 1.0, 0), ("a", 0, 0), ("a", 101.9, 0), ("a", 102.0, 1), ("a", 400.0, 2), ("x", 400.0, 0)]


def test_curves_and_zones(spark):
    """One kernel on one layer, against the closed form; a pick moves it by the shift of the top."""
    tops = tracks.tops_by_version(spark.createDataFrame([("a", "A", 100.0, 90.0), ("a", "B", None, 290.0)], TOPS), F.lit(400.0))
    events = spark.createDataFrame([("a", "A", "LC", 1, 0.5, 7.0, "auto", 0.6), ("a", "Z", "SP", 2, 0.5, 350.0, "auto", 0.1)], "session string, layer string, family string, event_id long, f_pos double, md double, status string, amp double")
    kernels = tracks.projected(events, tops)
    assert {(r.version, r.event_id): (r.mu, r.sigma, r.method) for r in kernels.collect()} == {
        (0, 1): (190.0, 11.0, "formation_relative"), (1, 1): (200.0, 6.0, "formation_relative"), (0, 2): (350.0, 25.0, "tvdss_fallback"), (1, 2): (350.0, 25.0, "tvdss_fallback")}
    curves = tracks.risk_curves(tops, kernels, spark.createDataFrame([("A", "LC", 0.2)], "layer string, family string, posterior double"), ["LC", "SP"], F.lit(400.0)).cache()
    rows = {(r.version, r.family, r.md): (r.layer, r.risk) for r in curves.collect()}
    assert len(rows) == curves.count() == 2 * 2 * 200
    assert rows[0, "LC", 190.0] == ("A", pytest.approx(1 - 0.9 * 0.4)) and rows[1, "LC", 200.0] == ("A", pytest.approx(1 - 0.9 * 0.4))
    assert rows[0, "LC", 88.0] == (None, 0.0) and rows[0, "LC", 90.0][0] == "A" and rows[1, "LC", 98.0] == (None, 0.0) and rows[0, "SP", 350.0] == ("B", pytest.approx(0.1))
    zones = {r.version: r for r in tracks.risk_zones(curves, kernels).collect()}
    assert zones.keys() == {0, 1} and all(r.family == "LC" and r.event_ids == [1] and r.n_events == 1 and r.peak_layer == "A" for r in zones.values())
    assert (zones[0].peak_at, zones[1].peak_at) == (190.0, 200.0)


def plain(rows: list[tuple]) -> list[tuple]:
    """Changes of the one session of ``MOVED``, with zones looked up afresh at each record."""
    names = {"LC-1000": "LC", "SP-1100": "SP", "OP-1200": "OP"} | {f"{f}-live": f for f in alerts.FAMILIES}
    track = {v: {("LC-1000" if i == "LC-1020" else i): (lo, hi) for _, w, i, _, lo, hi, _ in MOVED if w == v} for v in range(4)}
    level, asked, rules, signs, out = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0), dict.fromkeys(names, 0), []
    for _, t, bit, rop, fired, live, backed in rows:
        zones = track[sum(top + 2 <= bit for s, _, top, _ in PICKS if s == "s3")]
        for key, family in names.items():
            rules[key] = rules[key] + 1 if family in fired else 0
            signs[key] = signs[key] + 1 if family in fired or (live.get(family, 0) >= 0.7 and family in backed) else 0
            want, over = 0, False
            if key.endswith("-live"):
                want = 2 if rules[key] >= 3 and not any(names[k] == family and lo - 20 <= bit <= hi + 20 for k, (lo, hi) in zones.items()) else 0
            elif key in zones:
                lo, hi = zones[key]
                over = bit > hi + 10
                want = 0 if over else (3 if rules[key] >= 3 or signs[key] >= 6 else 2) if lo - 20 <= bit <= hi + 5 else 1 if 0 < lo - bit <= max(100, rop * 3) else 0
            before = level[key]
            if want and want >= before:
                level[key], asked[key] = want, t
            elif want < before and (t - asked[key] >= 300 or over):
                level[key] = want
            if level[key] != before:
                out.append((key, t, level[key], before))
    return sorted(out)


def test_realigned_alerts_in_any_cut(spark, tmp_path):
    rows, rng, at, folder = made(3), random.Random(5), 0, tmp_path / "feed"
    zones = alerts.same_zones(spark.createDataFrame(MOVED, ZONES), ["session"])
    assert {(r.version, r.id): r.zone for r in zones.where("family = 'LC'").collect()} == {(0, "LC-1000"): "LC-1000", (1, "LC-1020"): "LC-1000", (2, "LC-1020"): "LC-1000"}
    zones = spark.createDataFrame(zones.collect(), zones.schema)
    tops = spark.createDataFrame(PICKS, TOPS)
    aligned = lambda feed: tracks.version_at(feed.withColumn("hole_md", F.col("bit_md")), tops)
    wanted = plain(rows)
    assert any(k == "LC-1000" for k, *_ in wanted) and any(k == "SP-1100" for k, *_ in wanted)
    assert levels(alerts.timeline(aligned(spark.createDataFrame(rows, FEED)), zones)) == wanted
    while at < len(rows):
        n = rng.randrange(1, 90)
        spark.createDataFrame(rows[at : at + n], FEED).coalesce(1).write.mode("append").parquet(str(folder))
        at += n
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = alerts.stream(aligned(feed), zones).writeStream.format("memory").queryName("realigned").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert levels(spark.table("realigned")) == wanted


def test_zones_of_one_version_never_share_a_name(spark):
    zones = [("a", 0, "LC-100", "LC", 100.0, 110.0, 0.5), ("a", 1, "LC-90", "LC", 90.0, 95.0, 0.5), ("a", 1, "LC-100", "LC", 100.0, 104.0, 0.5), ("a", 2, "LC-94", "LC", 94.0, 95.0, 0.5), ("b", 1, "LC-105", "LC", 105.0, 110.0, 0.5)]
    found = alerts.same_zones(spark.createDataFrame(zones, ZONES), ["session"])
    assert {(r.session, r.version, r.id): r.zone for r in found.collect()} == {("a", 0, "LC-100"): "LC-100", ("a", 1, "LC-90"): "LC-90", ("a", 1, "LC-100"): "LC-100", ("a", 2, "LC-94"): "LC-90", ("b", 1, "LC-105"): "LC-105"}


def test_snapshots(spark):
    changes = alerts.timeline(spark.createDataFrame(made(1) + made(2), FEED), [alerts.Zone("LC-1000", "LC", 1000.0, 1030.0, 0.9), alerts.Zone("SP-1100", "SP", 1100.0, 1110.0, 0.6)]).cache()
    rows = changes.collect()
    times = [(s, float(t)) for s in ("s1", "s2", "none") for t in [*range(-20, 5400, 37), *sorted({r.t for r in rows})[:9]]]
    found = alerts.snapshots(changes, spark.createDataFrame(times + times[:5], "session string, at double"))
    wanted = set()
    for s, at in times:
        for zone in {r.zone for r in rows if r.session == s}:
            past = [r for r in rows if r.session == s and r.zone == zone and r.t <= at]
            if past and all(r.tier for r in past):
                last = max(past, key=lambda r: r.t)
                wanted.add((s, at, zone, last.tier, last.t))
    assert wanted and sorted((r.session, r.at, r.zone, r.tier, r.since) for r in found.collect()) == sorted(wanted)
    assert alerts.snapshots(changes.where("false"), spark.createDataFrame(times, "session string, at double")).count() == 0


def test_missing_evidence_leaves_the_prior(spark):
    r = spark.sql("SELECT 0.6D p, CAST(NULL AS DOUBLE) live").select(fuse(F.col("p"), F.col("live")).alias("x")).first()
    assert r.x == 0.6
