"""Queries of rolling features, rules, scores, episodes and alerts over the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boresight.functions import numeric
from boresight.operators import events as event_ops
from boresight.operators import features
from boresight.sources.tables import table
from boresight.streaming import alerts

NAMES = ["dflow", "pit_slope", "spp_dev", "tq_z", "tq_ssi", "rop_ratio", "dxc_ratio", "gas_level", "gas_ratio"]
# Fixed coefficients of the demonstration score.
MODEL = {"coef": [-8.0, 1.5, 0.7], "intercept": -0.5, "mean": [0.0, 1.0, 1.0], "std": [1.0, 0.5, 0.5]}
SCORED = ["dflow", "gas_ratio", "rop_ratio"]


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The events as drilling records, by event type."""
    e = table(spark, d, "events")
    u, v = F.col("user_id").cast("double"), F.col("value")
    return e.select(
        "event_id", "event_type", (480 + v % 60).alias("flow_in"), (480 + v % 60 + u % 7 - 3).alias("flow_out"), (v % 40).alias("pit"), (150 + u % 30).alias("spp"), (10 + v % 9).alias("torque"),
        (5 + u % 13).alias("rop"), (1 + v % 5).alias("gas"), F.when(F.col("event_id") % 11 != 0, 1.0 + (u % 9) / 10).alias("dxc"), (F.col("event_id") % 5 != 0).cast("int").alias("on_bottom"), (80 + v % 50).alias("hookload"),
    )


def _features(spark: SparkSession, d: str) -> DataFrame:
    records = features.run_overpull(_records(spark, d), ["event_type"], "event_id", F.col("on_bottom") == 0, "hookload", width=1 << 20)
    fields = ["flow_in", "flow_out", "pit", "spp", "torque", "rop", "gas", "dxc", "on_bottom"]
    framed = features.buffered(records, ["event_type"], "event_id", fields, width=1 << 20)
    made = features.add_features(framed.select("event_id", "event_type", "flow_in", "overpull", "buffer"))
    return made.select("event_id", "event_type", "flow_in", *[F.round(n, 4).alias(n) for n in [*NAMES, "overpull"]])


def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("event_id", *NAMES)


_RECORDS = """r AS (SELECT event_id, event_type, 480 + value % 60 flow_in, 480 + value % 60 + user_id % 7 - 3 flow_out, value % 40 pit, 150.0::DOUBLE + user_id % 30 spp, 10 + value % 9 torque,
  5.0::DOUBLE + user_id % 13 rop, 1 + value % 5 gas, CASE WHEN event_id % 11 <> 0 THEN 1.0::DOUBLE + (user_id % 9) / 10.0::DOUBLE END dxc, (event_id % 5 <> 0)::INT on_bottom, 80 + value % 50 hookload FROM events)"""
_TAIL = lambda a, n: f"list_slice({a}, greatest(len({a}) - {n - 1}, 1), len({a}))"
_FEATURES = f"""{_RECORDS},
b AS (SELECT event_id, event_type, flow_in, list({{'fi': flow_in, 'fo': flow_out, 'pit': pit, 'spp': spp, 'tq': torque, 'rop': rop, 'gas': gas, 'dxc': dxc, 'ob': on_bottom}}) OVER (PARTITION BY event_type ORDER BY event_id ROWS 179 PRECEDING) b FROM r),
p AS (SELECT *, list_filter(b, lambda x: x.fi > 500) p FROM b), q AS (SELECT *, list_filter(p, lambda x: x.ob > 0) q FROM p),
a AS (SELECT event_id, event_type, flow_in, len(b) nb, len(p) np, len(q) nd, list_transform({_TAIL('p', 12)}, lambda x: (x.fo - x.fi) / x.fi) gap, list_transform({_TAIL('p', 30)}, lambda x: x.pit) pit, list_transform(p, lambda x: x.spp) spp,
  list_transform(q, lambda x: x.tq) tq, list_transform(q, lambda x: x.rop) rop, list_filter(list_transform(q, lambda x: x.dxc), lambda x: x IS NOT NULL) dxc, list_transform(b, lambda x: x.gas) gas FROM q),
f AS (SELECT event_id, event_type, flow_in, round(CASE WHEN np >= 6 THEN list_avg(gap) ELSE 0 END, 4) dflow,
  round(CASE WHEN np >= 6 THEN list_sum(list_transform(pit, lambda y, i: ((i - 1) / 6.0::DOUBLE - (len(pit) - 1) / 12.0::DOUBLE) * (y - list_avg(pit)))) / greatest(list_sum(list_transform(pit, lambda y, i: ((i - 1) / 6.0::DOUBLE - (len(pit) - 1) / 12.0::DOUBLE) ** 2)), 1e-9) ELSE 0 END, 4) pit_slope,
  round(CASE WHEN np >= 6 THEN (list_avg({_TAIL('spp', 6)}) - list_median(spp)) / greatest(list_median(spp), 1.0) ELSE 0 END, 4) spp_dev,
  round(CASE WHEN nd >= 12 THEN (list_avg({_TAIL('tq', 12)}) - list_avg(tq)) / greatest(list_stddev_pop(tq), 0.3) ELSE 0 END, 4) tq_z,
  round(CASE WHEN nd >= 12 THEN (list_max({_TAIL('tq', 12)}) - list_min({_TAIL('tq', 12)})) / greatest(list_avg({_TAIL('tq', 12)}), 0.5) ELSE 0 END, 4) tq_ssi,
  round(CASE WHEN nd >= 12 THEN list_avg({_TAIL('rop', 12)}) / greatest(list_median(rop), 0.5) ELSE 1 END, 4) rop_ratio,
  round(CASE WHEN nd >= 12 AND len(dxc) >= 12 THEN list_avg({_TAIL('dxc', 12)}) / greatest(list_median(dxc), 1e-3) ELSE 1 END, 4) dxc_ratio,
  round(CASE WHEN nb >= 6 THEN list_avg({_TAIL('gas', 12)}) ELSE 0 END, 4) gas_level, round(CASE WHEN nb >= 6 THEN list_avg({_TAIL('gas', 12)}) / greatest(list_median(gas), 0.2) ELSE 1 END, 4) gas_ratio FROM a)"""
ROLLING_FEATURES = f"WITH {_FEATURES} SELECT event_id, {', '.join(NAMES)} FROM f"


def run_overpull(spark: SparkSession, d: str) -> DataFrame:
    found = features.run_overpull(_records(spark, d), ["event_type"], "event_id", F.col("on_bottom") == 0, "hookload", width=1 << 20)
    return found.select("event_id", F.round("overpull", 4).alias("overpull"))


_OVERPULL = """n AS (SELECT *, CASE WHEN lag(on_bottom) OVER w IS DISTINCT FROM on_bottom THEN 1 ELSE 0 END new FROM r WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
u AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY event_id) run FROM n),
top AS (SELECT event_type, run, max(hookload) top FROM u WHERE on_bottom = 0 GROUP BY 1, 2),
jump AS (SELECT event_type, run + 1 run, CASE WHEN count(*) OVER w >= 2 THEN greatest(0, top - median(top) OVER w) END jump FROM top WINDOW w AS (PARTITION BY event_type ORDER BY run ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
o AS (SELECT u.event_id, round(coalesce(last_value(jump IGNORE NULLS) OVER (PARTITION BY u.event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 4) overpull FROM u LEFT JOIN jump USING (event_type, run))"""
RUN_OVERPULL = f"WITH {_RECORDS}, {_OVERPULL} SELECT * FROM o"


def rules_fired(spark: SparkSession, d: str) -> DataFrame:
    fired = _features(spark, d).withColumn("fired", features.rules_fired(pumping=F.col("flow_in") > 500))
    return fired.groupBy("event_type").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col("fired")[f]), F.lit(0)).cast("long").alias(f.lower()) for f in features.RULES])


RULES_FIRED = f"""WITH {_FEATURES}, {_OVERPULL}, g AS (SELECT f.*, overpull, flow_in > 500 p FROM f JOIN o USING (event_id))
SELECT event_type, count(*) n, sum((p AND dflow < -0.07)::INT + (p AND pit_slope < -0.12 AND dflow < -0.03)::INT)::BIGINT lc,
  sum((p AND dflow > 0.05 AND pit_slope > 0.08)::INT + (gas_ratio > 3 AND gas_level > 4)::INT + (rop_ratio > 2 AND gas_ratio > 1.8)::INT)::BIGINT op,
  sum((overpull > 15)::INT + (tq_z > 3)::INT + (tq_ssi > 0.6 AND rop_ratio < 0.7)::INT)::BIGINT sp, sum((tq_ssi > 0.8)::INT)::BIGINT tq FROM g GROUP BY 1"""


def backed_families(spark: SparkSession, d: str) -> DataFrame:
    """How often the features of each event type back a score of each family."""
    held = _features(spark, d).select("event_type", F.explode(features.backed()).alias("family"))
    return held.groupBy("event_type", "family").agg(F.count("*").alias("n"))


BACKED_FAMILIES = f"""WITH {_FEATURES}, {_OVERPULL}, g AS (SELECT f.*, overpull FROM f JOIN o USING (event_id))
SELECT event_type, family, count(*) n FROM (SELECT event_type, unnest([CASE WHEN dflow < -0.03 OR pit_slope < -0.05 THEN 'LC' END, CASE WHEN gas_ratio > 1.5 OR dflow > 0.02 OR pit_slope > 0.05 THEN 'OP' END,
  CASE WHEN tq_z > 1.5 OR overpull > 8 OR tq_ssi > 0.3 THEN 'SP' END, CASE WHEN tq_ssi > 0.4 OR tq_z > 2 THEN 'TQ' END, 'CM']) family FROM g) WHERE family IS NOT NULL GROUP BY 1, 2"""


def logit_score(spark: SparkSession, d: str) -> DataFrame:
    p, top = features.score_family(MODEL, SCORED)
    made = _features(spark, d)
    return made.select("event_id", F.round(p, 4).alias("p"), F.array_join(top, ",").alias("reasons"), F.round(numeric.fuse(F.lit(0.3), p), 4).alias("fused"))


LOGIT_SCORE = f"""WITH {_FEATURES}, z AS (SELECT event_id, -8.0 * (dflow - 0.0) / 1.0 a, 1.5 * (gas_ratio - 1.0) / 0.5 b, 0.7 * (rop_ratio - 1.0) / 0.5 c FROM f),
s AS (SELECT *, 1 / (1 + exp(-least(greatest(a + b + c - 0.5, -30), 30))) p FROM z),
t AS (SELECT event_id, string_agg(n, ',' ORDER BY v DESC, n) reasons FROM (SELECT event_id, unnest(['dflow', 'gas_ratio', 'rop_ratio']) n, unnest([a, b, c]) v FROM z) WHERE v > 0.2 GROUP BY 1)
SELECT event_id, round(p, 4) p, coalesce(reasons, '') reasons, round(1 / (1 + exp(-(ln(0.3 / 0.7) + 0.8 * ln(least(greatest(p, 0.02), 0.98) / (1 - least(greatest(p, 0.02), 0.98)))))), 4) fused FROM s LEFT JOIN t USING (event_id)"""


def _flag() -> Column:
    return F.col("value") > 40


def alarm_episodes(spark: SparkSession, d: str) -> DataFrame:
    return features.episodes(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", _flag()).select("event_id", "user_id")


_STREAK = """s AS (SELECT *, coalesce(value > 40, false) f, sum((NOT coalesce(value > 40, false))::INT) OVER (PARTITION BY user_id ORDER BY event_id) island FROM events),
k AS (SELECT event_id, user_id, (sum(f::INT) OVER (PARTITION BY user_id, island ORDER BY event_id))::BIGINT streak FROM s)"""
ALARM_EPISODES = f"WITH {_STREAK}, g AS (SELECT k.*, lag(streak) OVER (PARTITION BY user_id ORDER BY event_id) before FROM k) SELECT event_id, user_id FROM g WHERE streak = 2 AND before = 1"


def persistence(spark: SparkSession, d: str) -> DataFrame:
    return features.streaks(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", _flag()).select("event_id", "streak")


PERSISTENCE = f"WITH {_STREAK} SELECT event_id, streak FROM k"


def rate_1h(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return features.rate_over(e, ["event_type"], "ts", "value", 3600, instant=F.lit(0.0)).select("event_id", F.round("rate", 3).alias("rate"))


RATE_1H = """WITH s AS (SELECT *, epoch_us(ts) / 1e6 s FROM events), o AS (SELECT event_id, value, s, min(s) OVER w t0, arg_min(value, s) OVER w v0 FROM s WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN (s - t0) / 3600 > 0.05 THEN (value - v0) / ((s - t0) / 3600) ELSE 0 END, 3) rate FROM o"""


def alert_feed(spark: SparkSession, d: str) -> tuple[DataFrame, list[alerts.Zone]]:
    """Each event type's feed and fixed zones: depth is a day's share, rules fire on large values."""
    e = table(spark, d, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000)).cast("double") - 1704067200
    feed = e.select(F.col("event_type").alias("session"), seconds.alias("t"), (2700 + seconds / 2592000 * 300).alias("bit_md"), F.lit(20.0).alias("rop_1h"),
                    F.when(F.col("value") > 60, F.array(F.lit("LC"))).otherwise(F.array().cast("array<string>")).alias("fired"),
                    F.map_from_arrays(F.array(F.lit("LC")), F.array(F.least(F.col("value") / 100, F.lit(1.0)))).alias("live"))
    return feed, [alerts.Zone("LC-2800", "LC", 2800.0, 2830.0, 0.9), alerts.Zone("SP-2900", "SP", 2900.0, 2910.0, 0.6)]


def alert_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Alert changes of each event type's feed against fixed zones."""
    return alerts.numbered(alerts.timeline(*alert_feed(spark, d))).withColumn("t", F.round("t", 3)).withColumn("bit_md", F.round("bit_md", 4)).drop("md_from", "md_to")


# What a record asks of a key comes from windows; the tier held is a recursion over each key's records. Keys: LC-2800, SP-2900 and one for evidence alone (the other families never have any).
_FUSED = "1 / (1 + exp(-(ln(0.9::DOUBLE / (1 - 0.9::DOUBLE)) + 0.8::DOUBLE * ln(least(greatest(live, 0.02), 0.98) / (1 - least(greatest(live, 0.02), 0.98))))))"
CHANGES = f"""WITH RECURSIVE f AS (SELECT event_type AS session, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 t, 2700 + (epoch_us(ts) / 1000000.0::DOUBLE - 1704067200) / 2592000 * 300 bit_md, value > 60 fired, least(value / 100, 1) live FROM events),
o AS (SELECT *, row_number() OVER w n, row_number() OVER (w) - max(CASE WHEN NOT fired THEN i ELSE 0 END) OVER w rules, row_number() OVER (w) - max(CASE WHEN NOT (fired OR live >= 0.7) THEN i ELSE 0 END) OVER w signs
  FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, bit_md) i FROM f) WINDOW w AS (PARTITION BY session ORDER BY t, bit_md)),
k AS (SELECT 'LC-2800' AS zone, 'LC' family, 2800.0::DOUBLE md_from, 2830.0::DOUBLE md_to, 0.9::DOUBLE peak UNION ALL SELECT 'SP-2900', 'SP', 2900, 2910, 0.6 UNION ALL SELECT 'LC-live', 'LC', NULL, NULL, NULL),
a AS (SELECT session, zone, family, n, t, bit_md, md_from - bit_md ahead, bit_md > md_to + 10 passed, bit_md BETWEEN md_from - 20 AND md_to + 5 inside, rules, signs, live, peak, md_from, md_to FROM o CROSS JOIN k),
q AS MATERIALIZED (SELECT session, zone, family, n, t, bit_md, ahead, coalesce(passed, false) passed, md_from, md_to,
  CASE WHEN md_from IS NULL THEN CASE WHEN rules >= 3 AND NOT bit_md BETWEEN 2780 AND 2850 THEN 2 ELSE 0 END WHEN passed THEN 0 WHEN inside THEN CASE WHEN family = 'LC' AND (rules >= 3 OR signs >= 6) THEN 3 ELSE 2 END WHEN ahead > 0 AND ahead <= 100 THEN 1 ELSE 0 END wanted,
  CASE WHEN md_from IS NULL THEN live WHEN inside AND family = 'LC' THEN {_FUSED} ELSE peak END p_final FROM a),
held AS (SELECT session, zone, 0::BIGINT n, 0 tier, 0 before, 0.0::DOUBLE asked FROM (SELECT DISTINCT session, zone FROM q) UNION ALL
  SELECT h.session, h.zone, q.n, CASE WHEN wanted >= h.tier OR q.t - h.asked >= 300 OR passed THEN wanted ELSE h.tier END, h.tier, CASE WHEN wanted >= h.tier AND wanted > 0 THEN q.t ELSE h.asked END FROM held h JOIN q ON q.session = h.session AND q.zone = h.zone AND q.n = h.n + 1),
changes AS (SELECT q.session, q.zone, q.family, q.n, q.t, q.bit_md, [NULL, 'ADVISORY', 'CAUTION', 'WARNING'][h.tier + 1] tier, [NULL, 'ADVISORY', 'CAUTION', 'WARNING'][h.before + 1] previous, ahead, p_final, md_from, md_to FROM held h JOIN q USING (session, zone, n) WHERE h.tier <> h.before)"""
ALERT_TIMELINE = f"""{CHANGES}, b AS (SELECT session, zone, 'AL-' || lpad((row_number() OVER (PARTITION BY session ORDER BY min(t), zone))::VARCHAR, 3, '0') alert_id FROM changes GROUP BY session, zone),
x AS (SELECT *, CASE family WHEN 'LC' THEN 'Mud loss' ELSE 'Stuck pipe' END label, CASE zone WHEN 'LC-2800' THEN '2,800-2,830 m' ELSE '2,900-2,910 m' END span FROM changes)
SELECT session, zone, family, round(t, 3) t, round(bit_md, 4) bit_md, tier, previous, round(ahead, 1) ahead, round(p_final, 3) p_final, alert_id,
  CASE WHEN tier IS NULL THEN label || ': cleared' WHEN md_from IS NULL THEN label || ': live signs where no offset had trouble' WHEN tier = 'ADVISORY' THEN label || ' zone ' || span || ' is ' || round_even(ahead, 0)::INT || ' m ahead'
  WHEN tier = 'CAUTION' THEN label || ' zone ' || span || ': inside, live data normal' ELSE label || ' zone ' || span || ': live signs agree' END message FROM x JOIN b USING (session, zone)"""


def merge_mentions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9
    rows = e.select("user_id", "event_type", hours.alias("md"), (0.5 + F.col("event_id") % 5 / 10).cast("double").alias("confidence"), F.lit("auto").alias("status"), F.array("event_id").alias("sources"), F.array(F.col("event_type")).alias("actions"), F.array().cast("array<string>").alias("flags"), F.when(F.col("value") > 50, F.col("value")).alias("npt_h"))
    merged = event_ops.merge_events(rows, ["user_id", "event_type"], 15.0)
    return merged.select("user_id", "event_type", F.round("md", 4).alias("md"), "confidence", "status", F.size("sources").alias("n_sources"), F.array_min("sources").alias("first_id"), "npt_h")


# One row at a time of each key, in depth order: where the cluster stands, how sure it is, what it holds.
MERGE_MENTIONS = """WITH RECURSIVE r AS MATERIALIZED (SELECT user_id, event_type, event_id, depth, sure, CASE WHEN value > 50 THEN value END npt, row_number() OVER (PARTITION BY user_id, event_type ORDER BY depth, sure, event_id) n
  FROM (SELECT *, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE depth, 0.5::DOUBLE + event_id % 5 / 10::DOUBLE sure FROM events)),
c AS (SELECT user_id, event_type, n, 1 AS cluster, depth md, sure, npt, 1 AS members, event_id first_id FROM r WHERE n = 1 UNION ALL
  SELECT r.user_id, r.event_type, r.n, c.cluster + apart::INT, CASE WHEN apart OR r.sure > c.sure THEN r.depth ELSE c.md END, CASE WHEN apart THEN r.sure ELSE least(1, greatest(r.sure, c.sure) + 0.05::DOUBLE) END,
    CASE WHEN apart THEN r.npt WHEN r.sure > c.sure THEN coalesce(r.npt, c.npt) ELSE coalesce(c.npt, r.npt) END, CASE WHEN apart THEN 1 ELSE c.members + 1 END, CASE WHEN apart THEN r.event_id ELSE least(c.first_id, r.event_id) END
  FROM c JOIN r ON r.user_id = c.user_id AND r.event_type = c.event_type AND r.n = c.n + 1 CROSS JOIN LATERAL (SELECT abs(r.depth - c.md) > 15 apart))
SELECT user_id, event_type, round(md, 4) md, round(sure, 3) confidence, CASE WHEN members = 1 OR round(sure, 3) >= 0.8 THEN 'auto' ELSE 'needs_review' END status, members n_sources, first_id, npt npt_h
FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type, cluster ORDER BY n DESC) = 1"""

FUNCTIONS = (rolling_features, run_overpull, rules_fired, backed_families, logit_score, alarm_episodes, persistence, rate_1h, alert_timeline, merge_mentions)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
