"""The alert ladder against a plain version, streams cut at random, and the merging fold against one over dictionaries."""

from __future__ import annotations

import random


from boresight.operators.events import merge_events
from boresight.streaming import alerts

FEED = "session string, t double, bit_md double, rop_1h double, fired array<string>, live map<string,double>, backed array<string>"
ZONES = [alerts.Zone("LC-1000", "LC", 1000.0, 1030.0, 0.9), alerts.Zone("SP-1100", "SP", 1100.0, 1110.0, 0.6)]


def made(seed: int, n: int = 260) -> list[tuple]:
    rng = random.Random(seed)
    bit, rows = 860.0, []
    for i in range(n):
        bit += rng.choice((0.0, 0.4, 1.5, 3.0))
        rows.append((f"s{seed}", i * 20.0, bit, rng.choice((5.0, 60.0)), rng.choices(([], ["LC"], ["SP", "TQ"]), (5, 3, 2))[0], {"LC": rng.random()}, rng.choice((["LC"], []))))
    return rows


def plain(rows: list[tuple]) -> list[tuple]:
    """Changes of one session, from the description of the tiers."""
    out, keys = [], {z.id: z for z in ZONES} | {f"{f}-live": None for f in alerts.FAMILIES}
    level, asked, rules, signs = dict.fromkeys(keys, 0), dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0), dict.fromkeys(keys, 0)
    for _, t, bit, rop, fired, live, backed in rows:
        for key, z in keys.items():
            family = z.family if z else key[:2]
            rules[key] = rules[key] + 1 if family in fired else 0
            signs[key] = signs[key] + 1 if family in fired or (live.get(family, 0) >= 0.7 and family in backed) else 0
            if z is None:
                near = any(x.family == family and x.md_from - 20 <= bit <= x.md_to + 20 for x in ZONES)
                want = 2 if rules[key] >= 3 and not near else 0
            elif bit > z.md_to + 10:
                want = 0
            elif z.md_from - 20 <= bit <= z.md_to + 5:
                want = 3 if rules[key] >= 3 or signs[key] >= 6 else 2
            else:
                want = 1 if 0 < z.md_from - bit <= max(100, rop * 3) else 0
            before = level[key]
            if want and want >= before:
                level[key], asked[key] = want, t
            elif want < before and (t - asked[key] >= 300 or (z and bit > z.md_to + 10)):
                level[key] = want
            if level[key] != before:
                out.append((key, t, level[key], before))
    return sorted(out)


def levels(df) -> list[tuple]:
    place = {None: 0} | {n: i + 1 for i, n in enumerate(alerts.TIERS)}
    return sorted((r.zone, r.t, place[r.tier], place[r.previous]) for r in df.collect())


def test_timeline(spark):
    for seed in (1, 2):
        changes = alerts.timeline(spark.createDataFrame(made(seed), FEED), ZONES).cache()
        assert levels(changes) == plain(made(seed))
    both = alerts.numbered(alerts.timeline(spark.createDataFrame(made(1) + made(2), FEED), ZONES))
    assert {r.alert_id for r in both.where("session = 's1'").collect()} == {f"AL-{i + 1:03d}" for i in range(len({k for k, *_ in plain(made(1))}))}
    assert alerts.toasts(both).where("tier IS NULL").isEmpty()
    assert alerts.active(both).where("tier IS NULL").isEmpty()


def test_stream_in_any_cut_equals_the_batch(spark, tmp_path):
    rows, rng = made(3), random.Random(9)
    at, folder = 0, tmp_path / "feed"
    while at < len(rows):
        n = rng.randrange(1, 90)
        spark.createDataFrame(rows[at : at + n], FEED).coalesce(1).write.mode("append").parquet(str(folder))
        at += n
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))
    query = alerts.stream(feed, ZONES).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert levels(spark.table("changes")) == plain(rows)


def test_zones_keep_their_names(spark):
    zones = [(0, "LC-1000", "LC", 1000.0, 1030.0), (0, "SP-1100", "SP", 1100.0, 1110.0), (1, "LC-1050", "LC", 1050.0, 1080.0), (1, "LC-1400", "LC", 1400.0, 1410.0), (2, "LC-1105", "LC", 1105.0, 1120.0)]
    found = alerts.same_zones(spark.createDataFrame(zones, "version int, id string, family string, md_from double, md_to double"))
    assert {r.id: r.zone for r in found.collect()} == {"LC-1000": "LC-1000", "SP-1100": "SP-1100", "LC-1050": "LC-1000", "LC-1400": "LC-1400", "LC-1105": "LC-1000"}


def test_merging(spark):
    rng = random.Random(4)
    rows = [("w", float(i * rng.choice((2, 9)) + rng.random()), rng.choice((0.5, 0.7, 0.75, 0.9)), "auto", [f"d{i}"], [rng.choice("xyz")], [], rng.choice((None, float(i))), rng.choice(("unknown", "resolved", "failed"))) for i in range(60)]
    schema = "well string, md double, confidence double, status string, sources array<string>, actions array<string>, flags array<string>, npt_h double, outcome string"
    found = {r.sources[0]: r for r in merge_events(spark.createDataFrame(rows, schema).repartition(5), ["well"]).collect()}
    clusters: list[dict] = []
    for _, md, c, status, sources, actions, _, npt, outcome in sorted(rows, key=lambda r: (r[1], r[2], r[4])):
        new = {"md": md, "c": c, "sources": sources, "actions": actions, "npt": npt, "outcome": outcome, "n": 1, "status": status}
        if not clusters or abs(md - clusters[-1]["md"]) > 15:
            clusters.append(new)
            continue
        old = clusters[-1]
        a, b = (new, old) if c > old["c"] else (old, new)
        clusters[-1] = {"md": a["md"], "c": min(1.0, max(a["c"], b["c"]) + 0.05), "sources": old["sources"] + sources, "actions": list(dict.fromkeys(a["actions"] + b["actions"])), "npt": b["npt"] if a["npt"] is None else a["npt"], "outcome": b["outcome"] if a["outcome"] == "unknown" else a["outcome"], "n": old["n"] + 1}
        clusters[-1]["status"] = "auto" if round(clusters[-1]["c"], 3) >= 0.8 else "needs_review"
    assert len(found) == len(clusters) < len(rows)
    for w in clusters:
        r = found[w["sources"][0]]
        assert (r.md, r.sources, r.actions, r.npt_h, r.outcome, r.status) == (w["md"], w["sources"], w["actions"], w["npt"], w["outcome"], w["status"])
        assert abs(r.confidence - w["c"]) < 1e-6 and r.flags == (["multi_source"] if w["n"] > 1 else [])
    assert merge_events(spark.createDataFrame([], schema), ["well"]).count() == 0

