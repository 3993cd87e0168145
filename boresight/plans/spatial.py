"""Queries of the risk atlas, neighbours, relevance, geometry and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boresight.functions import numeric
from boresight.operators import intervals, relevance, risk, trajectory
from boresight.sources.tables import table


def _risk_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    weight = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.6).otherwise(0.5)
    events = lines.where("l_discount >= 0.05").select(F.col("l_suppkey").alias("entity"), F.col("p_type").alias("layer"), F.col("l_returnflag").alias("family"), weight.alias("weight"), F.col("l_quantity").alias("cost"))
    pairs = lines.select(F.col("l_suppkey").alias("entity"), F.col("p_type").alias("layer")).distinct().withColumn("s", F.lit(1.0))
    return pairs, events


def eb_risk_atlas(spark: SparkSession, d: str) -> DataFrame:
    cells = risk.risk_atlas(*_risk_inputs(spark, d), ["A", "N", "R"])
    return cells.select("layer", "family", F.round("n_eff", 2).alias("n_eff"), F.round("k_eff", 2).alias("k_eff"), "entities_hit", F.round("posterior", 4).alias("posterior"), F.round("mean_cost", 3).alias("mean_cost"), F.col("likelihood").cast("int"), F.col("consequence").cast("int"))


EB_RISK_ATLAS = """
WITH l AS (SELECT l_suppkey entity, p_type layer, l_returnflag family, l_quantity cost, l_discount, CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.6 ELSE 0.5 END::DOUBLE w FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT DISTINCT entity, layer FROM l), e AS (SELECT * FROM l WHERE l_discount >= 0.05),
prior AS (SELECT family, greatest(count(*)::DOUBLE / (SELECT count(*) FROM pairs), 0.01) rate FROM (SELECT DISTINCT entity, layer, family FROM e) GROUP BY 1),
hit AS (SELECT entity, layer, family, max(w) w, sum(cost) cost, count(*) c FROM e GROUP BY 1, 2, 3),
k AS (SELECT layer, family, sum(w) k, sum(cost) / sum(c) mean_cost, count(*) hits FROM hit GROUP BY 1, 2),
n AS (SELECT layer, count(*)::DOUBLE n FROM pairs GROUP BY 1),
cell AS (SELECT n.layer, f.family, n.n, coalesce(k.k, 0) k, coalesce(k.hits, 0) hits, k.mean_cost, coalesce(p.rate, 0.01) rate FROM n, (VALUES ('A'), ('N'), ('R')) f(family)
  LEFT JOIN k ON k.layer = n.layer AND k.family = f.family LEFT JOIN prior p ON p.family = f.family),
post AS (SELECT *, (4 * rate + k) / (4 * rate + k + 4 * (1 - rate) + greatest(n - k, 0)) p FROM cell)
SELECT layer, family, round(n, 2) n_eff, round(k, 2) k_eff, hits::BIGINT entities_hit, round(p, 4) posterior, round(mean_cost, 3) mean_cost,
  (1 + (p >= 0.05)::INT + (p >= 0.15)::INT + (p >= 0.3)::INT + (p >= 0.5)::INT)::INT likelihood,
  (1 + (coalesce(mean_cost, 0) >= 2)::INT + (coalesce(mean_cost, 0) >= 8)::INT + (coalesce(mean_cost, 0) >= 16)::INT + (coalesce(mean_cost, 0) >= 30)::INT)::INT consequence FROM post
"""


def eb_risk_ci(spark: SparkSession, d: str) -> DataFrame:
    cells = risk.risk_atlas(*_risk_inputs(spark, d), ["A", "N", "R"])
    q = lambda p: F.round(numeric.beta_quantile(F.lit(p), "a1", "b1"), 3)
    return cells.select("layer", "family", q(0.05).alias("ci_low"), q(0.95).alias("ci_high"))


def _places(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, ((F.col(key) * 7919) % 10007).cast("double").alias("x"), ((F.col(key) * 104729) % 10009).cast("double").alias("y"))


def radius_neighbors(spark: SparkSession, d: str) -> DataFrame:
    found = relevance.radius_neighbors(_places(table(spark, d, "customer"), "c_custkey"), _places(table(spark, d, "supplier"), "s_suppkey"), "c_custkey", "s_suppkey", 300.0)
    return found.withColumn("distance", F.round("distance", 3))


RADIUS_NEIGHBORS = """
WITH c AS (SELECT c_custkey, ((c_custkey * 7919) % 10007)::DOUBLE x, ((c_custkey * 104729) % 10009)::DOUBLE y FROM customer),
s AS (SELECT s_suppkey, ((s_suppkey * 7919) % 10007)::DOUBLE x, ((s_suppkey * 104729) % 10009)::DOUBLE y FROM supplier)
SELECT c_custkey, s_suppkey, round(sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2), 3) distance FROM c JOIN s ON sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2) <= 300
"""


def weighted_jaccard(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    mix = lines.groupBy(F.col("o_custkey").alias("entity"), F.col("p_brand").alias("code")).agg(F.sum("l_quantity").alias("amount"))
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return relevance.weighted_jaccard(mix, pairs, "entity", "code", "amount", "a", "b").withColumn("jaccard", F.round("jaccard", 4))


WEIGHTED_JACCARD = """
WITH mix AS (SELECT o_custkey e, p_brand code, sum(l_quantity) amount FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
pairs AS (SELECT c_custkey a, c_custkey + 1 b FROM customer),
side AS (SELECT a, b, code, amount x, 0 y FROM pairs JOIN mix ON e = a UNION ALL SELECT a, b, code, 0, amount FROM pairs JOIN mix ON e = b),
by_code AS (SELECT a, b, code, sum(x) x, sum(y) y FROM side GROUP BY 1, 2, 3),
j AS (SELECT a, b, sum(least(x, y)) lo, sum(greatest(x, y)) hi FROM by_code GROUP BY 1, 2)
SELECT pairs.a, pairs.b, round(CASE WHEN hi > 0 THEN lo / hi ELSE 0 END, 4) jaccard FROM pairs LEFT JOIN j ON j.a = pairs.a AND j.b = pairs.b
"""


def relevance_rank(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    scores = lines.groupBy("s_nationkey", "s_suppkey", (F.col("p_size") % 7).alias("layer")).agg(F.round(F.exp(-F.avg("l_discount") * 10), 3).alias("score")).withColumn("layer_ord", F.col("layer"))
    return relevance.rank_overall(scores, "s_nationkey", "s_suppkey", "layer")


RELEVANCE_RANK = """
WITH s AS (SELECT s_nationkey, s_suppkey, p_size % 7 layer, round(exp(-avg(l_discount) * 10), 3) score FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
o AS (SELECT s_nationkey, s_suppkey, round(sum(round(score * 1000)) / count(*)) / 1000 overall, arg_max(layer, score * 1000 - layer * 0.001) best_layer FROM s GROUP BY 1, 2)
SELECT *, (row_number() OVER (PARTITION BY s_nationkey ORDER BY overall DESC, s_suppkey))::INT place FROM o
"""


def _stations(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("well_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "well_id")  # the name that later windows deal by, so that rows are dealt once
    md = F.sum(F.col("l_quantity") * 10).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("well_id", F.row_number().over(w).alias("k"), md.alias("md"), (F.col("l_discount") * 300).alias("inc"), (F.col("l_tax") * 1000).alias("azi"))


def survey_integration(spark: SparkSession, d: str) -> DataFrame:
    surveyed = trajectory.integrate_survey(_stations(spark, d))
    last = F.max_by(F.struct("md", "tvd", "north", "east"), "k")
    out = surveyed.groupBy("well_id").agg(last.alias("end"), F.round(F.max("dls"), 3).alias("max_dls"))
    return out.select("well_id", F.round("end.md", 1).alias("md"), *[F.round(f"end.{c}", 2).alias(c) for c in ("tvd", "north", "east")], "max_dls")


SURVEY_INTEGRATION = """
WITH s AS (SELECT l_orderkey well_id, row_number() OVER w k, sum(l_quantity * 10) OVER w md, radians(l_discount * 300) i, radians(l_tax * 1000) a FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, lag(md) OVER (PARTITION BY well_id ORDER BY k) md0, lag(i) OVER (PARTITION BY well_id ORDER BY k) i0, lag(a) OVER (PARTITION BY well_id ORDER BY k) a0 FROM s),
b AS (SELECT *, acos(least(greatest(cos(i - i0) - sin(i0) * sin(i) * (1 - cos(a - a0)), -1.0), 1.0)) beta FROM p),
h AS (SELECT *, (md - md0) / 2 * CASE WHEN beta < 1e-9 THEN 1 ELSE 2 / beta * tan(beta / 2) END half FROM b)
SELECT well_id, round(max(md), 1) md, round(min(md) + coalesce(sum(half * (cos(i0) + cos(i))), 0), 2) tvd, round(coalesce(sum(half * (sin(i0) * cos(a0) + sin(i) * cos(a))), 0), 2) north,
  round(coalesce(sum(half * (sin(i0) * sin(a0) + sin(i) * sin(a))), 0), 2) east, round(coalesce(max(degrees(beta) * 30 / (md - md0)) FILTER (md0 IS NOT NULL), 0), 3) max_dls FROM h GROUP BY 1
"""


def interval_lookup(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    band = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, a, b in (("small", 1, 15), ("medium", 15, 35), ("large", 35, 36))]))
    bands = parts.select("p_type").distinct().select("p_type", band.alias("b")).select("p_type", "b.*")
    placed = intervals.interval_join(parts, bands, ["p_type"], "p_size", "low", "high", open_end=F.col("i.band") == "large")
    return placed.groupBy("p_type", "band").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("avg_price"))


INTERVAL_LOOKUP = """
SELECT p_type, CASE WHEN p_size >= 35 THEN 'large' WHEN p_size >= 15 THEN 'medium' WHEN p_size >= 1 THEN 'small' END band, count(*) n, round(avg(p_retailprice), 2) avg_price FROM part GROUP BY 1, 2
"""


def section_first_match(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    section = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("section"), F.lit(a).alias("low"), F.lit(b).alias("high")) for o, n, a, b in ((1, "upper", 0.0, 10.0), (2, "middle", 10.0, 25.0), (3, "lower", 25.0, 40.0))]))
    sections = lines.select("l_returnflag").distinct().select("l_returnflag", section.alias("s")).select("l_returnflag", "s.*")
    placed = intervals.first_match(lines, sections, ["l_returnflag"], ["l_orderkey", "l_linenumber"], "l_quantity", "low", "high", "ord")
    return placed.groupBy("l_returnflag", "section").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


SECTION_FIRST_MATCH = """
SELECT l_returnflag, CASE WHEN l_quantity <= 10 + 1e-6 AND l_quantity >= 0 THEN 'upper' WHEN l_quantity >= 10 AND l_quantity <= 25 + 1e-6 THEN 'middle' ELSE 'lower' END section, count(*) n, sum(l_quantity) quantity FROM lineitem GROUP BY 1, 2
"""


def asof_station(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    found = intervals.asof_join(bought, clicks, ["user_id"], "ts", "click_ts", "click_id", ["click_id", "click_value"])
    return found.select("event_id", "user_id", "click_id", "click_value")


ASOF_STATION = """
SELECT p.event_id, p.user_id, c.event_id click_id, c.value click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
"""


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return intervals.carry_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase").select("event_id", "last_purchase")


CARRY_FORWARD = """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) last_purchase FROM events
"""


def md_at_value_bisect(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_acctbal >= 0")
    root = trajectory.bisect(lambda x: x * x + x - F.col("s_acctbal"), F.lit(0.0), F.lit(1000.0), 60)
    return s.select("s_suppkey", F.round(root, 3).alias("root"))


MD_AT_VALUE_BISECT = "SELECT s_suppkey, round((-1 + sqrt(1 + 4 * s_acctbal)) / 2, 3) root FROM supplier WHERE s_acctbal >= 0"


def _curve(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9
    kernels = e.select("event_type", hours.alias("mu"), F.lit(10.0).alias("sigma"), (0.01 * F.col("value") / 100).alias("amp"), "event_id")
    grid = e.select("event_type").distinct().withColumn("md", F.explode(F.sequence(F.lit(0), F.lit(718), F.lit(2)))).withColumn("md", F.col("md").cast("double")).withColumn("floor", F.lit(0.02))
    return risk.noisy_or(grid, kernels, ["event_type"], reach=8.0).withColumn("risk", F.round("risk", 3))


def noisy_or_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d)


_CURVE = """k AS (SELECT event_type, (epoch_us(ts) - 1704067200000000) / 3.6e9 mu, 0.01 * value / 100 amp FROM events),
g AS (SELECT event_type, (h * 2)::DOUBLE md FROM (SELECT DISTINCT event_type FROM events), range(0, 360) t(h)),
m AS (SELECT g.event_type, g.md, coalesce(product(1 - amp * exp(-0.5 * ((md - mu) / 10) ** 2)), 1) miss FROM g LEFT JOIN k ON k.event_type = g.event_type AND abs(md - mu) <= 80 GROUP BY 1, 2),
curve AS (SELECT event_type, md, round(1 - 0.98 * miss, 3) risk FROM m)"""
NOISY_OR_CURVE = f"WITH {_CURVE} SELECT * FROM curve"
LEVEL = 0.40


def risk_zones(spark: SparkSession, d: str) -> DataFrame:
    return risk.zones(_curve(spark, d), ["event_type"], "md", "risk", LEVEL)


RISK_ZONES = f"""WITH {_CURVE}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md) n FROM curve),
z AS (SELECT *, n - row_number() OVER (PARTITION BY event_type ORDER BY md) run FROM r WHERE risk >= {LEVEL})
SELECT event_type, min(md) md_from, max(md) md_to, max(risk) peak, arg_min(md, -risk * 1e6 + md / 1e6) peak_at, count(*) points FROM z GROUP BY event_type, run"""


def latlon_projection(spark: SparkSession, d: str) -> DataFrame:
    c = _places(table(spark, d, "customer"), "c_custkey")
    return c.select("c_custkey", F.round(numeric.xy_to_lat(F.col("y"), 27.0), 5).alias("lat"), F.round(numeric.xy_to_lon(F.col("x"), 27.0, 95.0), 5).alias("lon"))


LATLON_PROJECTION = """
SELECT c_custkey, round(27.0 + degrees(((c_custkey * 104729) % 10009)::DOUBLE / 6371000.0), 5) lat, round(95.0 + degrees(((c_custkey * 7919) % 10007)::DOUBLE / (6371000.0 * cos(radians(27.0)))), 5) lon FROM customer
"""


def unit_normalise(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    unit = F.when(F.col("p_partkey") % 3 == 0, "ft").when(F.col("p_partkey") % 3 == 1, "m").otherwise("")
    depth = numeric.normalise_depth(F.col("p_retailprice") * 2, unit, F.lit(1500.0))
    mud = numeric.normalise_mud_weight(F.col("p_size") / 4, F.when(F.col("p_partkey") % 2 == 0, "ppg").otherwise(""))
    return p.select("p_partkey", F.round(depth["md"], 3).alias("md"), depth["inferred"].alias("inferred"), F.round(mud, 4).alias("sg"))


UNIT_NORMALISE = """
WITH p AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'ft' WHEN 1 THEN 'm' ELSE '' END u, p_retailprice * 2 v, p_size / 4.0 w FROM part)
SELECT p_partkey, round(CASE WHEN u = 'ft' OR (u = '' AND v > 1650.0000000000002 AND v * 0.3048 <= 1650.0000000000002) THEN v * 0.3048 ELSE v END, 3) md, u = '' inferred,
  round(CASE WHEN p_partkey % 2 = 0 THEN w * 0.119826427 WHEN w BETWEEN 0.8 AND 2.6 THEN w WHEN w BETWEEN 6.5 AND 22 THEN w * 0.119826427 END, 4) sg FROM p
"""

def _field(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A field of straight bores out of the suppliers: places, six layers of which a third of the bores miss one, sections, surveys."""
    k = F.col("s_suppkey")
    wells = table(spark, d, "supplier").select(
        k.alias("well_id"), (k % 3).alias("compartment"), (1990 + k % 31).alias("spud_year"), ((k * 7919) % 10007).cast("double").alias("x0"), ((k * 104729) % 10009).cast("double").alias("y0"), (k % 20).cast("double").alias("rkb"),
        (k % 5).alias("n_docs"), (k % 2 == 0).alias("has_report"), (k % 4).alias("n_events"),
    )
    k = F.col("well_id")
    inc = (k % 4) * 10.0
    surveyed = trajectory.integrate_survey(wells.select("well_id", F.posexplode(F.array(*map(F.lit, (0.0, 900.0, 2500.0, 4000.0)))).alias("k", "md"), inc.alias("inc"), ((k % 12) * 30.0).alias("azi")))
    i = F.col("i")
    base = (500.0 * i + (k * (i + 3) % 7) * 20.0).alias("md_top")
    tops = wells.select("well_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i")).select("well_id", "i", base)
    tops = tops.withColumn("md_base", F.coalesce(F.lead("md_top").over(Window.partitionBy("well_id").orderBy("i")), F.col("md_top") + 5.0 * (k % 40)))
    tops = tops.where((k % 9 != i)).select("well_id", F.concat(F.lit("L"), i).alias("code"), i.alias("ord"), "md_top", "md_base", *[(F.col(f"md_{e}") * F.cos(F.radians(inc))).alias(f"tvd_{e}") for e in ("top", "base")], (i == 6).alias("td_in_formation"))
    parts = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("md_from"), F.lit(b).alias("md_to"), F.lit(h).alias("hole_in")) for o, a, b, h in ((1, 0.0, 1200.0, 17.5), (2, 1200.0, 2600.0, 12.25), (3, 2600.0, 3000.0, 8.5))])
    sections = wells.select("well_id", F.explode(parts).alias("s")).select("well_id", "s.ord", "s.md_from", "s.md_to", F.when(k % 8 == 0, 6.0).otherwise(F.col("s.hole_in")).alias("hole_in"), F.element_at(F.array(*map(F.lit, ("OBM", "SBM", "KCL"))), ((k + F.col("s.ord")) % 3 + 1).cast("int")).alias("mud_system"), (1.0 + ((k + F.col("s.ord")) % 6) / 25.0).alias("mw_sg"))
    near = relevance.radius_neighbors(wells.select(k.alias("active"), F.col("x0").alias("x"), F.col("y0").alias("y")), wells.select(k.alias("offset"), F.col("x0").alias("x"), F.col("y0").alias("y")), "active", "offset", 2500.0)
    return {"pairs": near.where("active <> offset").select("active", "offset"), "wells": wells, "tops": tops, "surveyed": surveyed, "sections": sections}


def relevance_layers(spark: SparkSession, d: str) -> DataFrame:
    """Each bore's neighbours within 2.5 km: relevance by layer with components, or the reason why there are none."""
    f = _field(spark, d)
    made = relevance.layer_scores(f["pairs"], f["wells"], f["tops"], f["surveyed"], f["sections"], {"dist": 0.4}, skipped=("L1",))
    return made.drop("md_base")


_FIELD = """w AS (SELECT s_suppkey k, s_suppkey % 3 comp, 1990 + s_suppkey % 31 yr, ((s_suppkey * 7919) % 10007)::DOUBLE x0, ((s_suppkey * 104729) % 10009)::DOUBLE y0, (s_suppkey % 20)::DOUBLE rkb,
  radians((s_suppkey % 4) * 10.0) inc, radians((s_suppkey % 12) * 30.0) azi FROM supplier),
t0 AS (SELECT k, i, 500.0 * i + (k * (i + 3) % 7) * 20.0 md_top FROM w, range(1, 7) r(i)),
t1 AS (SELECT *, coalesce(lead(md_top) OVER (PARTITION BY k ORDER BY i), md_top + 5.0 * (k % 40)) md_base FROM t0),
t AS (SELECT k, i, md_top::DOUBLE md_top, md_base::DOUBLE md_base, ((md_base - md_top) * cos(inc))::DOUBLE thick, (md_top + md_base)::DOUBLE / 2 mid FROM t1 JOIN w USING (k) WHERE k % 9 <> i),
c AS (SELECT t.*, o, CASE WHEN k % 8 = 0 THEN 6.0 ELSE [17.5, 12.25, 8.5][o] END hole, ['OBM', 'SBM', 'KCL'][(k + o) % 3 + 1] mud, 1.0 + ((k + o) % 6) / 25.0::DOUBLE mw FROM (SELECT *, CASE WHEN mid <= 1200 + 1e-6 THEN 1 WHEN mid <= 2600 + 1e-6 THEN 2 ELSE 3 END o FROM t) t),
pr AS (SELECT a.k a, b.k b FROM w a JOIN w b ON a.k <> b.k AND sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) <= 2500),
wj AS (SELECT a, b, coalesce(sum(least(x.thick, coalesce(y.thick, 0))), 0) lo FROM pr LEFT JOIN t x ON x.k = a AND x.i < 6 LEFT JOIN t y ON y.k = b AND y.i = x.i GROUP BY 1, 2),
tot AS (SELECT k, sum(thick) s FROM t WHERE i < 6 GROUP BY 1),
j AS (SELECT a, b, lo / (x.s + y.s - lo) jac FROM wj JOIN tot x ON x.k = a JOIN tot y ON y.k = b),
pt AS (SELECT k, i, x0 + m * sin(inc) * sin(azi) x, y0 + m * sin(inc) * cos(azi) y, m * cos(inc) - rkb z FROM (SELECT k, i, unnest(list_distinct(list_append([md_top + 25 * n FOR n IN range(0, floor((md_base - md_top) / 25)::BIGINT + 1)], md_base))) m FROM t) JOIN w USING (k)),
m AS (SELECT pr.a, pr.b, x.i, x.thick th1, y.thick th2, y.k IS NULL absent, CASE WHEN x.i = 6 THEN least(greatest(greatest(y.thick, 0) / greatest(x.thick, 1), 0), 1) ELSE 1 END cover, x.hole h1, y.hole h2, x.mud m1, y.mud m2, x.mw w1, y.mw w2
  FROM pr JOIN c x ON x.k = pr.a AND x.i <> 1 LEFT JOIN c y ON y.k = pr.b AND y.i = x.i),
dd AS (SELECT m.a, m.b, m.i, sqrt(min((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) d FROM m JOIN pt p ON p.k = m.a AND p.i = m.i JOIN pt q ON q.k = m.b AND q.i = m.i WHERE NOT absent AND cover >= 0.05 GROUP BY 1, 2, 3),
v AS (SELECT m.*, d, CASE WHEN absent THEN 'Formation not penetrated / absent in offset' WHEN cover < 0.05 THEN 'Offset drilled <5% of this interval' END reason, exp(-d / 6000) dist,
  0.5 * jac + 0.5 * CASE WHEN m.i = 6 THEN 1 ELSE least(greatest(th1, 1), greatest(th2, 0)) / greatest(greatest(th1, 1), greatest(th2, 0)) END strat, 1 - least(abs(degrees(p.inc) - degrees(q.inc)) / 60, 1) traj,
  0.3 * CASE WHEN h1 = h2 THEN 1 ELSE 0.4 END + 0.4 * CASE WHEN m1 = m2 THEN 1 WHEN (m1 = 'OBM') <> (m2 = 'OBM') THEN 0.3 ELSE 0.7 END + 0.3 * greatest(0, 1 - abs(w1 - w2) / 0.15) ops,
  least(1, 0.4 + 0.25 * (m.b % 2 = 0)::INT + 0.1 * least(m.b % 5, 3) + 0.05 * least(m.b % 4, 1)) qual, exp(-greatest(p.yr - q.yr, 0) / 15) "time", CASE WHEN p.comp = q.comp THEN 1 ELSE 0.55 END struct
  FROM m JOIN j ON j.a = m.a AND j.b = m.b JOIN w p ON p.k = m.a JOIN w q ON q.k = m.b LEFT JOIN dd ON dd.a = m.a AND dd.b = m.b AND dd.i = m.i)"""
_SHOWN = ", ".join(f"CASE WHEN reason IS NULL THEN round(({n})::DOUBLE, 3) END {n}" for n in ("dist", "strat", "traj", "ops", "qual", '"time"', "struct", "cover"))
_SCORED = f"""WITH {_FIELD}, z AS (SELECT a active, b "offset", 'L' || i code, i::INT ord, CASE WHEN reason IS NULL THEN round((struct * cover * (0.4 * dist + 0.25 * strat + 0.1 * traj + 0.15 * ops + 0.1 * qual + 0.1 * "time") / 1.1)::DOUBLE, 3) ELSE 0 END::DOUBLE score, reason, CASE WHEN reason IS NULL THEN round_even(d, 0) END distance_3d, {_SHOWN} FROM v)"""
RELEVANCE_LAYERS = f"{_SCORED} SELECT * FROM z"


def offsets_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Each bore's neighbours by their mean relevance over the layers whose base lies below 1,500 m, with the best layer and words for it."""
    f = _field(spark, d)
    made = relevance.layer_scores(f["pairs"], f["wells"], f["tops"], f["surveyed"], f["sections"], {"dist": 0.4}, skipped=("L1",)).where("md_base >= 1500")
    words = relevance.explain(*[F.col(c) for c in ("struct", "distance_3d", "strat", "ops", "traj", "reason")])
    ranked = relevance.rank_overall(made.select("active", "offset", "code", "score", F.col("ord").alias("layer_ord"), words.alias("words")), "active", "offset", "code", carried=("words",))
    return ranked.select("active", "offset", "overall", "best_layer", "place", "words")


OFFSETS_RANKED = f"""{_SCORED}, g AS (SELECT z.* FROM z JOIN t ON t.k = active AND t.i = ord WHERE md_base >= 1500),
o AS (SELECT active, "offset", round(sum(round(score * 1000)) / count(*)) / 1000 overall, arg_max(code, score * 1000 - ord * 0.001) best_layer FROM g GROUP BY 1, 2),
p AS (SELECT *, (row_number() OVER (PARTITION BY active ORDER BY overall DESC, "offset"))::INT place FROM o)
SELECT p.*, CASE WHEN reason IS NOT NULL THEN reason ELSE concat_ws('; ', CASE WHEN struct >= 1 THEN 'same fault compartment' ELSE 'across a fault (different compartment)' END, printf('%.1f km apart in-formation', floor(distance_3d / 100 + 0.5) / 10),
  CASE WHEN strat >= 0.85 THEN 'very similar stratigraphy' WHEN strat < 0.7 THEN 'different stratigraphy/thickness' END, CASE WHEN ops >= 0.85 THEN 'similar hole & mud' END, CASE WHEN traj < 0.7 THEN 'different inclination' END) END words
FROM p JOIN g ON g.active = p.active AND g."offset" = p."offset" AND g.code = p.best_layer"""


FUNCTIONS = (relevance_layers, offsets_ranked, eb_risk_atlas, eb_risk_ci, radius_neighbors, weighted_jaccard, relevance_rank, survey_integration, interval_lookup, section_first_match, asof_station, carry_forward, md_at_value_bisect, noisy_or_curve, risk_zones, latlon_projection, unit_normalise)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
