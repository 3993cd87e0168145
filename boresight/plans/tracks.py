"""Queries of re-aligned risk tracks and of alert states over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boresight.operators import risk, tracks
from boresight.plans import sequences
from boresight.sources.tables import settled, table
from boresight.streaming import alerts

FAMILY = {"click": "LC", "view": "SP", "purchase": "OP", "signup": "TQ", "error": "CM"}
END = 3060.0


def _family():
    return F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[F.col("event_type")]


def _bores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(records, tops): eight users' events are a bore's records, five suppliers its tops."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - 1704067200
    made = table(spark, d, "events").select(F.floor(F.col("user_id") / 8).cast("long").alias("session"), "event_id", _family().alias("family"), t.alias("t"), (2700 + t / 2592000 * 350).alias("hole_md"), "value")
    k = F.col("s_suppkey")
    top = 2700.0 + (k % 5) * 60 + k * 37 % 40
    return made, table(spark, d, "supplier").select(F.floor(k / 5).cast("long").alias("session"), F.concat(F.lit("F"), k % 5).alias("layer"), top.alias("md_top"), (top + k % 17 - 8).alias("md_prognosed"))


def _track(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, tops, curves, kernels)."""
    made, tops = _bores(spark, d)
    i = F.col("event_id")
    amp = risk.amplitude(F.least(F.col("value"), F.lit(100.0)) / 800, F.when(i % 7 > 0, i % 7 - 1), F.lit(0.8), (i % 4) / 4)
    share = F.when(i % 11 > 0, (i % 10) / 10)
    status = F.when(i % 3 == 0, "needs_review").otherwise("auto")
    happened = made.select("session", F.concat(F.lit("F"), i % 5).alias("layer"), "family", "event_id", share.alias("f_pos"), F.col("hole_md").alias("md"), status.alias("status"), amp.alias("amp"))
    atlas = made.groupBy(F.concat(F.lit("F"), i % 5).alias("layer"), "family").agg((F.avg("value") / 200).alias("posterior"))
    versions = tracks.tops_by_version(tops, F.lit(END))
    kernels = tracks.projected(happened, versions)
    curves = tracks.risk_curves(versions, kernels, atlas, list(FAMILY.values()), F.lit(END), start=2600.0)
    return made, tops, curves, kernels


def realigned_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zones of every bore after each pick: ends, peak, its layer, the strongest events."""
    _, _, curves, kernels = _track(spark, d)
    zones = tracks.risk_zones(curves, kernels)
    return zones.select("session", "version", "id", "family", "md_from", "md_to", "points", "peak", "peak_at", "peak_layer", "n_events", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("event_ids"))


REALIGNED_ZONES = f"""WITH r AS (SELECT user_id // 8 AS session, event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY.items())} END family, 2700 + (epoch_us(ts) / 1e6::DOUBLE - 1704067200) / 2592000 * 350 hole_md, value FROM events),
s AS (SELECT s_suppkey // 5 AS session, 'F' || s_suppkey % 5 layer, 2700::DOUBLE + s_suppkey % 5 * 60 + s_suppkey * 37 % 40 md_top, 2700::DOUBLE + s_suppkey % 5 * 60 + s_suppkey * 37 % 40 + s_suppkey % 17 - 8 md_prognosed FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY md_top, md_prognosed, layer) place FROM s),
v AS (SELECT session, unnest(range(0, count(*) + 1)) AS version FROM k GROUP BY session),
a AS (SELECT k.*, v.version, place <= v.version found, max(CASE WHEN place <= v.version THEN md_top END) OVER w last_top, last_value(CASE WHEN place <= v.version THEN md_top - md_prognosed END IGNORE NULLS) OVER (w ORDER BY place) shift FROM k JOIN v USING (session) WINDOW w AS (PARTITION BY session, v.version)),
b AS (SELECT session, version, layer, place, found, CASE WHEN found THEN md_top ELSE greatest(md_prognosed + coalesce(shift, 0), last_top) END top, CASE WHEN found THEN md_top ELSE md_prognosed + coalesce(shift, 0) END raw FROM a),
t AS (SELECT session, version, layer, found, top, coalesce(lead(top) OVER (PARTITION BY session, version ORDER BY top, place), {END}::DOUBLE) base FROM b WHERE raw < {END}),
e AS (SELECT session, 'F' || event_id % 5 layer, family, event_id, CASE WHEN event_id % 11 > 0 THEN (event_id % 10) / 10::DOUBLE END f_pos, hole_md, event_id % 3 = 0 review,
  least(value, 100) / 800 * [0.4::DOUBLE, 0.55::DOUBLE, 0.7::DOUBLE, 0.85::DOUBLE, 0.95::DOUBLE, 1.0::DOUBLE][coalesce(CASE WHEN event_id % 7 > 0 THEN event_id % 7 - 1 END, 0) + 1] * 0.8::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * CASE WHEN event_id % 4 = 0 THEN 0.7::DOUBLE ELSE (event_id % 4) / 4::DOUBLE END) amp FROM r),
p AS (SELECT e.session, x.version, family, event_id, amp, CASE WHEN t.top IS NULL OR f_pos IS NULL THEN hole_md ELSE t.top + f_pos * (t.base - t.top) END mu,
  CASE WHEN t.top IS NULL OR f_pos IS NULL THEN 25 ELSE 6 + CASE WHEN t.found THEN 0 ELSE 5 END + CASE WHEN review THEN 4 ELSE 0 END END sigma
  FROM e JOIN (SELECT DISTINCT session, version FROM t) x ON x.session = e.session LEFT JOIN t ON t.session = e.session AND t.version = x.version AND t.layer = e.layer),
m AS (SELECT 'F' || event_id % 5 layer, family, avg(value) / 200 posterior FROM r GROUP BY 1, 2),
g AS (SELECT v.session, v.version, 2.0::DOUBLE * i md, f.family, t.layer FROM (SELECT DISTINCT session, version FROM t) v CROSS JOIN range(1300, {int(END / 2)}) x(i) CROSS JOIN (SELECT unnest({list(FAMILY.values())}) family) f
  LEFT JOIN t ON t.session = v.session AND t.version = v.version AND 2 * i >= t.top AND 2 * i < t.base),
c AS (SELECT g.session, g.version, g.family, g.md, g.layer, round(1 - (1 - 0.5 * coalesce(any_value(m.posterior), 0)) * coalesce(product(1 - amp * exp(-0.5 * ((g.md - mu) / greatest(sigma, 10)) ** 2)), 1), 3) risk FROM g LEFT JOIN m ON m.layer = g.layer AND m.family = g.family
  LEFT JOIN p ON p.session = g.session AND p.version = g.version AND p.family = g.family AND abs(g.md - mu) <= 8 * greatest(sigma, 10) GROUP BY ALL),
h AS (SELECT *, md / 2 - row_number() OVER (PARTITION BY session, version, family ORDER BY md) island FROM c WHERE risk >= 0.4),
z AS (SELECT session, version, family, min(md) md_from, max(md) md_to, count(*) points, max(risk) peak, arg_min(struct_pack(md := md, layer := layer), struct_pack(r := -risk, md := md)) best FROM h GROUP BY session, version, family, island),
w AS (SELECT z.session, z.version, z.family, z.md_from, count(*) n_events, array_to_string(list_slice(list(event_id ORDER BY amp DESC, event_id), 1, 8), ',') event_ids FROM z JOIN p ON p.session = z.session AND p.version = z.version AND p.family = z.family AND mu + 2 * sigma >= md_from AND mu - 2 * sigma <= md_to GROUP BY ALL)
SELECT z.session, z.version::INT AS version, z.family || '-' || floor(z.md_from)::BIGINT id, z.family, z.md_from, z.md_to, points, peak, best.md peak_at, best.layer peak_layer, coalesce(n_events, 0) n_events, coalesce(event_ids, '') event_ids FROM z LEFT JOIN w USING (session, version, family, md_from)"""


def realigned_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alert changes of every bore against the zones of the picks made by then; zones keep their names when a pick moves them."""
    made, tops, curves, _ = _track(spark, d)
    zones = tracks.named_zones(curves).select("session", "version", "id", "family", "md_from", "md_to", "peak")
    named = settled(alerts.same_zones(zones, ["session"]))  # read twice
    feed = made.select("session", "t", "hole_md", F.col("hole_md").alias("bit_md"), F.lit(20.0).alias("rop_1h"), F.when(F.col("value") > 60, F.array("family")).otherwise(F.array().cast("array<string>")).alias("fired"),
                       F.map_from_arrays(F.array("family"), F.array(F.least(F.col("value") / 100, F.lit(1.0)))).alias("live"))
    return alerts.numbered(alerts.timeline(tracks.version_at(feed, tops), named))


def alerts_at(spark: SparkSession, d: str) -> DataFrame:
    """The alerts of each feed of ``alert_timeline`` that are open at noon of each day with records."""
    e = table(spark, d, "events")
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - 1704067200) / 86400)
    times = e.select(F.col("event_type").alias("session"), (day * 86400 + 43200).cast("double").alias("at")).distinct()
    changes = alerts.timeline(*sequences.alert_feed(spark, d))
    return alerts.snapshots(changes, times).select("session", "at", "zone", "tier", F.round("since", 3).alias("since"), "p_final")


ALERTS_AT = f"""{sequences.CHANGES}, asked AS (SELECT DISTINCT event_type AS session, floor((epoch_us(ts) / 1e6::DOUBLE - 1704067200) / 86400) * 86400 + 43200 AS "at" FROM events),
y AS (SELECT *, lead(t) OVER (PARTITION BY session, zone ORDER BY n) til, max((tier IS NULL)::INT) OVER (PARTITION BY session, zone ORDER BY n) shut FROM changes)
SELECT asked.session, asked."at", zone, tier, round(t, 3) since, round(p_final, 3) p_final FROM asked JOIN y ON y.session = asked.session AND t <= asked."at" AND (til IS NULL OR til > asked."at") WHERE shut = 0"""

FUNCTIONS = (realigned_zones, realigned_alerts, alerts_at)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
