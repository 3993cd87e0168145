"""Queries of the look-ahead backtest and of alike profiles: users as bores, their large events as trouble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boresight.operators import backtest, profiles
from boresight.plans.tracks import FAMILY
from boresight.sources.tables import table

LOW, HIGH, STEP, LEVEL, RADIUS, TROUBLE = 1000.0, 3000.0, 5.0, 0.4, 12000.0, 100


def bore_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Recall and share of the hole flagged, of aligned events and of the baseline, over all bores."""
    e = table(spark, d, "events")
    u = F.col("user_id")
    bores = e.select(u.alias("bore")).distinct().select("bore", (F.col("bore") * 37 % 100 * 300.0 + F.floor(F.col("bore") / 100) * 20000.0).alias("x"), (F.col("bore") * 53 % 97 * 300.0).alias("y"), (1980 + F.col("bore") % 40).alias("year"))
    layer = F.explode(F.sequence(F.lit(0), F.lit(4)))
    top = lambda i: 900.0 + i * 420 + (F.col("bore") * 7 + i * 11) % 50
    tops = bores.select("bore", layer.alias("i")).select("bore", F.concat(F.lit("F"), F.col("i")).alias("layer"), top(F.col("i")).alias("md_top"), F.when(F.col("i") == 4, F.lit(HIGH)).otherwise(top(F.col("i") + 1)).alias("md_base"), F.lit("actual").alias("kind"))
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9
    trouble = e.where(F.col("value") > TROUBLE).select(u.alias("bore"), "event_id", F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[F.col("event_type")].alias("family"), (800 + 3 * hours).alias("md"))
    i = F.col("event_id")
    events = trouble.join(tops, "bore").where("md >= md_top AND md < md_base").select("bore", "layer", "family", ((F.col("md") - F.col("md_top")) / (F.col("md_base") - F.col("md_top"))).alias("f_pos"), "md", (i % 6).alias("severity"), ((i % 4) / 4).alias("confidence"), F.lit(0.8).alias("weight"), F.lit("auto").alias("status"))
    offsets = backtest.earlier_offsets(bores, RADIUS)
    relevant = offsets.join(tops.select("bore", "layer"), "bore").select("target", "bore", "layer", F.exp(-F.col("distance") / 6000).alias("s"))
    kernels = {"ours": backtest.aligned_kernels(offsets, relevant, events, tops), "baseline": backtest.baseline_kernels(offsets, trouble)}
    found = backtest.lookahead(kernels, offsets, trouble, list(FAMILY.values()), LOW, HIGH, STEP, LEVEL)
    return found.withColumns({"recall": F.round("recall", 4), "flagged": F.round("flagged", 4)})


BORE_BACKTEST = f"""WITH b AS (SELECT DISTINCT user_id bore, user_id * 37 % 100 * 300.0::DOUBLE + user_id // 100 * 20000 x, user_id * 53 % 97 * 300.0::DOUBLE y, user_id % 40 born FROM events),
l AS (SELECT bore, i, 900.0::DOUBLE + i * 420 + (bore * 7 + i * 11) % 50 top, CASE WHEN i = 4 THEN {HIGH} ELSE 900.0::DOUBLE + (i + 1) * 420 + (bore * 7 + (i + 1) * 11) % 50 END base FROM b CROSS JOIN range(0, 5) g(i)),
e AS (SELECT user_id bore, event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY.items())} END family, 800 + 3 * ((epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE) md FROM events WHERE value > {TROUBLE}),
o AS (SELECT t.bore target, p.bore, sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2) distance FROM b t JOIN b p ON p.born < t.born AND sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2) <= {RADIUS}),
n AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY target ORDER BY distance, bore) <= 5),
k AS (SELECT 'baseline' AS method, target, family, md mu, 0.85::DOUBLE * exp(-distance / 6000) amp FROM n JOIN e USING (bore) UNION ALL
  SELECT 'ours', o.target, family, t.top + (md - l.top) / (l.base - l.top) * (t.base - t.top), exp(-distance / 6000) * [0.4::DOUBLE, 0.55::DOUBLE, 0.7::DOUBLE, 0.85::DOUBLE, 0.95::DOUBLE, 1.0::DOUBLE][event_id % 6 + 1] * 0.8::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * CASE WHEN event_id % 4 = 0 THEN 0.7::DOUBLE ELSE (event_id % 4) / 4::DOUBLE END)
  FROM o JOIN e USING (bore) JOIN l ON l.bore = e.bore AND md >= l.top AND md < l.base JOIN l t ON t.bore = o.target AND t.i = l.i WHERE exp(-distance / 6000) >= 0.5),
v AS (SELECT * FROM e WHERE md > {LOW} AND bore IN (SELECT target FROM o)), m AS (SELECT unnest(['ours', 'baseline']) AS method),
g AS (SELECT method, target, family, 5.0::DOUBLE * i md FROM m CROSS JOIN (SELECT DISTINCT bore target FROM v) CROSS JOIN (SELECT unnest({list(FAMILY.values())}) family) CROSS JOIN range({int(LOW / STEP) + 1}, {int(HIGH / STEP) + 1}) r(i)),
c AS (SELECT g.method, g.target, g.family, g.md, round(1 - coalesce(product(1 - amp * exp(-0.5 * ((g.md - mu) / 10) ** 2)), 1), 3) >= {LEVEL} up FROM g LEFT JOIN k ON k.method = g.method AND k.target = g.target AND k.family = g.family AND abs(g.md - mu) <= 80 GROUP BY ALL),
s AS (SELECT method, avg(up::INT) flagged FROM (SELECT method, target, md, bool_or(up) up FROM c GROUP BY ALL) GROUP BY method),
h AS (SELECT m.method, v.event_id, bool_or(coalesce(c.up, false)) hit FROM v CROSS JOIN m LEFT JOIN c ON c.method = m.method AND c.target = v.bore AND c.family = v.family AND abs(c.md - v.md) <= 15 GROUP BY m.method, v.event_id)
SELECT method, count(*) events, count(*) FILTER (hit) hits, round(count(*) FILTER (hit) / count(*), 4) recall, round(any_value(flagged), 4) flagged FROM h JOIN s USING (method) GROUP BY method"""

def profile_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Users whose sets of event type and size differ little: pairs of classes with how many users each has."""
    e = table(spark, d, "events").select("user_id", F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 30).cast("string")).alias("item"))
    members = profiles.profiles(e, "user_id", "item")
    sizes = members.groupBy("profile").agg(F.count("*").alias("n"))
    found = profiles.alike_with(members.join(sizes, "profile"), 0.7, ["n"])
    return found.select("left", "right", "n_left", "n_right", "common", F.round("jaccard", 6).alias("jaccard"))


PROFILE_PAIRS = """WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type || ':' || floor(value / 30)::BIGINT)) x FROM events GROUP BY user_id), c AS (SELECT min(user_id) id, count(*) n, x FROM s GROUP BY x),
p AS (SELECT a.id l, b.id r, a.n nl, b.n nr, len(list_intersect(a.x, b.x)) common, len(a.x) + len(b.x) total FROM c a JOIN c b ON a.id < b.id)
SELECT l AS "left", r AS "right", nl n_left, nr n_right, common::INT common, round(common / (total - common), 6) jaccard FROM p WHERE common / (total - common) >= 0.7"""

FUNCTIONS = (bore_backtest, profile_pairs)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
