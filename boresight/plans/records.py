"""Queries of event views, reviews, provenance, positions along a bore, questions, labels and the look-ahead backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boresight.functions import text
from boresight.operators import evaluate, events, features, intervals, questions, records, relevance, risk, trajectory
from boresight.plans.spatial import _CURVE, LEVEL, _curve, _stations
from boresight.sources.tables import table

_HOURS = "(epoch_us(ts) - 1704067200000000) / 3.6e9"


def _hours():
    return (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9


def review_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Users as records, the purchases as their review log: the last review of each wins."""
    e = table(spark, d, "events")
    base = e.groupBy("user_id").agg(F.min("value").alias("md_top"), F.lit("auto").alias("status"), F.min_by("event_type", "event_id").alias("type"), F.lit("LC").alias("family"))
    log = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("seq"), F.when(F.col("value") > 50, "confirmed").otherwise("rejected").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("md_top"), F.when(F.col("event_id") % 2 == 0, "KICK").alias("type"), F.when(F.col("event_id") % 2 == 0, "OP").alias("family"), F.lit("u").alias("user"))
    return events.overlay_reviews(base, log, "user_id").select("user_id", "status", F.round("md_top", 4).alias("md_top"), "type", "family", "curated_by")


REVIEW_OVERLAY = """WITH b AS (SELECT user_id, min(value) m, arg_min(event_type, event_id) t FROM events GROUP BY 1),
r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events WHERE event_type = 'purchase')
SELECT user_id, CASE WHEN r.user_id IS NULL THEN 'auto' WHEN value > 50 THEN 'confirmed' ELSE 'rejected' END status, round(CASE WHEN event_id % 3 = 0 THEN value ELSE m END, 4) md_top, CASE WHEN event_id % 2 = 0 THEN 'KICK' ELSE t END AS type,
  CASE WHEN event_id % 2 = 0 THEN 'OP' ELSE 'LC' END family, CASE WHEN r.user_id IS NOT NULL THEN 'u' END curated_by FROM b LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (user_id)"""


def event_brief(spark: SparkSession, d: str) -> DataFrame:
    """Documents as events with one or two sources, those of the languages without a family under PR."""
    docs = table(spark, d, "documents")
    source = lambda page: F.struct(F.col("doc_id").alias("doc_id"), F.lit(page).alias("page"), F.coalesce("text", F.lit("")).alias("quote"))
    made = docs.select("doc_id", F.col("lang").alias("well_id"), F.when(F.col("doc_id") % 4 != 0, F.when(F.col("doc_id") % 4 == 1, "LC").otherwise("SP")).alias("family"), F.when(F.col("doc_id") % 5 == 0, F.array(source(1))).otherwise(F.array(source(2), source(3))).alias("provenance"))
    found = records.brief(records.filter_events(made, family="PR"), ["well_id", "family"])
    return found.select("well_id", "family", "doc_id", "page", F.sha2("summary", 256).alias("summary_sha256"), "n_sources")


EVENT_BRIEF = "SELECT lang well_id, 'PR' family, doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END page, sha256(left(coalesce(text, ''), 220)) summary_sha256, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END n_sources FROM documents WHERE doc_id % 4 = 0"


def quote_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark passage word for word: they meet on the passage's longest inner word, then all of it decides."""
    cut = lambda c: F.split(c, r"\s")
    inner = F.slice(cut("text"), F.lit(2), F.greatest(F.size(cut("text")) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), longest.alias("word")).where("word IS NOT NULL")
    met = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(cut("text"))).alias("word")).join(asked, "word")
    both = met.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return both.where(F.contains("text", "quote")).select("item_id", "doc_id", (F.instr("text", F.col("quote")) - 1).alias("start"))


QUOTE_PROVENANCE = "SELECT item_id, doc_id, (instr(d.text, b.text) - 1)::INT AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def _asked_depths(surveyed: DataFrame) -> DataFrame:
    """Depths at, between and beyond the stations of each bore: three a station, in its leg or, at the last one, below the survey; one above the first."""
    w = Window.partitionBy("well_id").orderBy("k")
    step = F.coalesce(F.lead("md").over(w) - F.col("md"), F.lit(80.0))
    asked = surveyed.select("well_id", "k", "md", step.alias("step")).select("*", F.posexplode(F.array(*map(F.lit, (0.0, 0.3, 0.75)))).alias("part", "f"))
    above = surveyed.where("k = 1").select("well_id", "k", (F.col("md") - 7.5).alias("x"), F.lit(-1).alias("part"))
    return asked.select("well_id", "k", (F.col("md") + F.col("f") * F.col("step")).alias("x"), "part").unionByName(above)


def survey_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions on the arcs at, between and beyond the stations."""
    surveyed = trajectory.integrate_survey(_stations(spark, d))
    made = trajectory.position_at(_asked_depths(surveyed), surveyed)
    return made.select("well_id", "k", "part", *[(F.round(c, 2) + 0.0).alias(c) for c in ("tvd", "north", "east")], F.round("inc_at", 4).alias("inc_at"))


_SURVEY = """s AS (SELECT l_orderkey well_id, row_number() OVER w k, sum(l_quantity * 10) OVER w md, radians(l_discount * 300) i, radians(l_tax * 1000) a FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, lag(md) OVER v md0, lag(i) OVER v i0, lag(a) OVER v a0, count(*) OVER (PARTITION BY well_id) n FROM s WINDOW v AS (PARTITION BY well_id ORDER BY k)),
b AS (SELECT *, acos(least(greatest(cos(i - i0) - sin(i0) * sin(i) * (1 - cos(a - a0)), -1.0), 1.0)) beta FROM p),
h AS (SELECT *, (md - md0) / 2 * CASE WHEN beta < 1e-9 THEN 1 ELSE 2 / beta * tan(beta / 2) END half FROM b),
t AS (SELECT well_id, k, n, md, first_value(md) OVER u + coalesce(sum(half * (cos(i0) + cos(i))) OVER u, 0) tvd, coalesce(sum(half * (sin(i0) * cos(a0) + sin(i) * cos(a))) OVER u, 0) north,
  coalesce(sum(half * (sin(i0) * sin(a0) + sin(i) * sin(a))) OVER u, 0) east FROM h WINDOW u AS (PARTITION BY well_id ORDER BY k ROWS UNBOUNDED PRECEDING))"""
_ASKED_SQL = f"""{_SURVEY}, e AS (SELECT t.*, degrees(s.i) inc, s.i i0, s.a a0, lead(s.i) OVER u i1, lead(s.a) OVER u a1, lead(t.md) OVER u - t.md step FROM t JOIN s USING (well_id, k) WINDOW u AS (PARTITION BY well_id ORDER BY k)),
q AS (SELECT e.*, part, f, md + f * coalesce(step, 80.0) x FROM e, (VALUES (0, 0.0::DOUBLE), (1, 0.3), (2, 0.75)) v(part, f) UNION ALL SELECT e.*, -1, 0.0, md - 7.5 FROM e WHERE k = 1)"""
#: The arc by its chord integrals: of unit tangents t0 and t1, R / sin b * (t0 * (cos(b - t) - cos b) + t1 * (1 - cos t)).
_WALK = lambda t0, t1: f"CASE WHEN step IS NULL OR f = 0 THEN 0 WHEN bend < 1e-6 THEN f * step * ({t0} + {t1}) / 2 ELSE step / bend / sin(bend) * (({t0}) * (cos((1 - f) * bend) - cos(bend)) + ({t1}) * (1 - cos(f * bend))) END"
SURVEY_POSITIONS = f"""WITH {_ASKED_SQL}, z AS (SELECT *, acos(least(greatest(cos(i1 - i0) - sin(i0) * sin(i1) * (1 - cos(a1 - a0)), -1.0), 1.0)) bend FROM q)
SELECT well_id, k::INT k, part, round(tvd + {_WALK("cos(i0)", "cos(i1)")}, 2) + 0.0 tvd, round(north + {_WALK("sin(i0) * cos(a0)", "sin(i1) * cos(a1)")}, 2) + 0.0 north,
  round(east + {_WALK("sin(i0) * sin(a0)", "sin(i1) * sin(a1)")}, 2) + 0.0 east, round(inc + CASE WHEN step IS NULL THEN 0 ELSE f * degrees(i1 - i0) END, 4) inc_at FROM z"""


def survey_md_at_tvd(spark: SparkSession, d: str) -> DataFrame:
    """Measured depths found again from the vertical depths of points on the arcs, and of points above and below the survey."""
    surveyed = trajectory.integrate_survey(_stations(spark, d))
    on = trajectory.position_at(_asked_depths(surveyed), surveyed).select("well_id", "k", "part", "tvd")
    last = surveyed.groupBy("well_id").agg(F.max_by(F.struct("k", "tvd"), "k").alias("s")).select("well_id", "s.k", F.lit(9).alias("part"), (F.col("s.tvd") + 50).alias("tvd"))
    return trajectory.md_at_tvd(on.unionByName(last), surveyed).select("well_id", "k", "part", F.round("md", 2).alias("md"))


SURVEY_MD_AT_TVD = f"""WITH {_ASKED_SQL} SELECT well_id, k::INT k, part, round(CASE WHEN part = -1 OR step IS NULL THEN md ELSE x END, 2) md FROM q
UNION ALL SELECT well_id, k::INT, 9, round(md + 50 / greatest(cos(i0), 1e-3), 2) FROM e WHERE step IS NULL"""


def path_distance(spark: SparkSession, d: str) -> DataFrame:
    """Least distance of the sampled paths of suppliers of a nation whose keys are neighbours."""
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 7919) % 997).cast("double").alias("x"), ((F.col("s_suppkey") * 104729) % 991).cast("double").alias("y"))
    path = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("s_nationkey", "id", (F.col("x") + F.col("k") * (F.col("id") % 7)).alias("x"), "y", (F.col("k") * 25.0).alias("z"))
    near = trajectory.min_distance(path.withColumnRenamed("id", "a"), path.withColumnRenamed("id", "b"), ["s_nationkey"], ("a", "b"), rising=True)
    return near.withColumn("distance", F.round("distance", 3))


PATH_DISTANCE = """WITH p AS (SELECT s_nationkey, s_suppkey id, ((s_suppkey * 7919) % 997)::DOUBLE + k * (s_suppkey % 7) x, ((s_suppkey * 104729) % 991)::DOUBLE y, k * 25.0 z FROM supplier, range(0, 6) t(k))
SELECT l.s_nationkey, l.id a, r.id b, round(sqrt(min((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2)), 3) distance FROM p l JOIN p r ON l.s_nationkey = r.s_nationkey AND l.id < r.id GROUP BY 1, 2, 3"""


def first_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Where the value of a user's events first reaches 90, between the event before and that one."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").cast("double").alias("x"), (F.col("value") - 90).alias("diff"))
    return trajectory.first_crossing(e, ["user_id"], "x", "diff").withColumn("crossing", F.round("crossing", 3))


FIRST_CROSSING = """WITH s AS (SELECT user_id, event_id::DOUBLE x, value - 90 d, lag(event_id::DOUBLE) OVER w px, lag(value - 90) OVER w pd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) n FROM s WHERE d >= 0)
SELECT user_id, round(coalesce(px + (-pd) / greatest(d - pd, 1e-9) * (x - px), x), 3) crossing FROM f WHERE n = 1"""


def label_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of users whose first purchase is an incident, labelled by time around it."""
    e = table(spark, d, "events").withColumn("t", _hours() * 3600)
    onset = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("segment")).agg(F.min("t").alias("t_onset")).select("segment", F.when(F.col("segment") % 2 == 0, "LC").otherwise("SP").alias("kind"), "t_onset", F.lit(50.0).alias("md_onset"), F.lit(20.0).alias("precursor_m"))
    rows = e.select("event_id", F.col("user_id").alias("segment"), "t", F.col("value").alias("md"))
    both = [features.label_windows(rows, onset, f).select("event_id", F.lit(f).alias("family"), "label") for f in ("LC", "SP")]
    return both[0].unionByName(both[1]).groupBy("family").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positive"))


LABEL_WINDOWS = f"""WITH e AS (SELECT user_id, value, {_HOURS} * 3600 t, event_type FROM events), o AS (SELECT user_id, min(t) o FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT 'LC' family, count(*) n, count(*) FILTER (user_id % 2 = 0 AND t BETWEEN o AND o + 1800) positive FROM e LEFT JOIN o USING (user_id)
UNION ALL SELECT 'SP', count(*), count(*) FILTER (user_id % 2 = 1 AND value >= 30 AND t <= o + 600) FROM e LEFT JOIN o USING (user_id)"""


def alarm_recall(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the first alarm (a large value) of their user from an hour before to ten minutes after."""
    e = table(spark, d, "events").withColumn("t", _hours() * 3600)
    alarms = e.where("value > 80").select("user_id", F.col("t").alias("alarm_t"))
    bought = e.where("event_type = 'purchase'").select("user_id", "t", "event_id")
    return evaluate.event_recall(alarms, bought, ["user_id"]).select("event_id", F.round("lead_min", 3).alias("lead_min"))


ALARM_RECALL = f"""WITH e AS (SELECT *, {_HOURS} * 3600 t FROM events), a AS (SELECT user_id, t FROM e WHERE value > 80), b AS (SELECT user_id, t, event_id FROM e WHERE event_type = 'purchase'),
f AS (SELECT b.user_id, b.t, min(a.t) f FROM b JOIN a ON a.user_id = b.user_id AND a.t BETWEEN b.t - 3600 AND b.t + 600 GROUP BY 1, 2) SELECT event_id, round((b.t - f) / 60, 3) lead_min FROM b LEFT JOIN f ON f.user_id = b.user_id AND f.t = b.t"""


def lookahead_backtest(spark: SparkSession, d: str) -> DataFrame:
    """The first 15 days' events predict the later ones: share of later events within 4 h of a flagged hour, and share of hours flagged."""
    e = table(spark, d, "events").select("event_id", "event_type", _hours().alias("h"), "value")
    kernels = e.where("h < 360").select("event_type", (F.col("h") + 360).alias("mu"), F.lit(10.0).alias("sigma"), (0.01 * F.col("value") / 100).alias("amp"))
    grid = e.select("event_type").distinct().withColumn("md", F.explode(F.sequence(F.lit(360), F.lit(720), F.lit(4)))).withColumn("md", F.col("md").cast("double")).withColumn("floor", F.lit(0.02))
    curve = risk.noisy_or(grid, kernels, ["event_type"])
    flagged = curve.withColumn("flag", F.round("risk", 3) >= LEVEL)
    later = e.where("h >= 360").select("event_id", "event_type", "h")
    hits = intervals.bucketed_range_join(later, flagged.where("flag").select("event_type", "md"), ["event_type"], "h", "md", 4.0).select("event_id").distinct().withColumn("hit", F.lit(1))
    caught = later.join(hits, "event_id", "left").groupBy("event_type").agg(F.count("*").alias("n_events"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_hit"))
    shares = flagged.groupBy("event_type").agg(F.round(F.avg(F.col("flag").cast("int")), 4).alias("flagged"))
    return caught.join(shares, "event_type")


LOOKAHEAD_BACKTEST = f"""WITH e AS (SELECT event_id, event_type, {_HOURS} h, value FROM events), k AS (SELECT event_type, h + 360 mu, 0.01 * value / 100 amp FROM e WHERE h < 360),
g AS (SELECT event_type, (360 + 4 * i)::DOUBLE md FROM (SELECT DISTINCT event_type FROM events), range(0, 91) t(i)),
c AS (SELECT g.event_type, g.md, round(1 - 0.98 * coalesce(product(1 - amp * exp(-0.5 * ((md - mu) / 10) ** 2)), 1), 3) >= {LEVEL} flag FROM g LEFT JOIN k ON k.event_type = g.event_type AND abs(md - mu) <= 80 GROUP BY 1, 2),
l AS (SELECT * FROM e WHERE h >= 360), n AS (SELECT event_type, count(*) n_events, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE flag AND c.event_type = l.event_type AND abs(c.md - l.h) <= 4)) n_hit FROM l GROUP BY 1)
SELECT n.*, s.flagged FROM n JOIN (SELECT event_type, round(avg(flag::INT), 4) flagged FROM c GROUP BY 1) s USING (event_type)"""


ZONE_LEVEL = 1.15  # times the mean risk of an event type, so that tables of any size have zones


def zone_contributors(spark: SparkSession, d: str) -> DataFrame:
    """The strongest events within two sigma of each zone."""
    e = table(spark, d, "events").select("event_type", _hours().alias("mu"), F.lit(1.0).alias("sigma"), F.col("value").alias("amp"), "event_id")
    curve = _curve(spark, d).withColumn("raised", F.round(F.col("risk") / F.avg("risk").over(Window.partitionBy("event_type")), 4))
    zones = risk.zones(curve, ["event_type"], "md", "raised", ZONE_LEVEL).select("event_type", "md_from", "md_to")
    return risk.contributors(zones, e, ["event_type"], 3).select("event_type", "md_from", "md_to", F.array_join("event_ids", ",").alias("event_ids"), "n_events")


ZONE_CONTRIBUTORS = f"""WITH {_CURVE}, r AS (SELECT *, round(risk / avg(risk) OVER (PARTITION BY event_type), 4) raised, row_number() OVER (PARTITION BY event_type ORDER BY md) n FROM curve), z AS (SELECT *, n - row_number() OVER (PARTITION BY event_type ORDER BY md) run FROM r WHERE raised >= {ZONE_LEVEL}),
zz AS (SELECT event_type, min(md) md_from, max(md) md_to FROM z GROUP BY event_type, run), x AS (SELECT zz.*, event_id, row_number() OVER (PARTITION BY zz.event_type, md_from ORDER BY value DESC, event_id) p FROM zz JOIN (SELECT *, {_HOURS} h FROM events) e ON e.event_type = zz.event_type AND h BETWEEN md_from - 2 AND md_to + 2)
SELECT event_type, md_from, md_to, string_agg(event_id, ',' ORDER BY p) FILTER (p <= 3) event_ids, count(*) n_events FROM x GROUP BY 1, 2, 3"""


def risk_at(spark: SparkSession, d: str) -> DataFrame:
    """The curve at each event's hour, by the nearest grid point."""
    e = table(spark, d, "events").select("event_id", "event_type", intervals.nearest_grid(_hours(), F.lit(0.0), F.lit(2.0), F.lit(359.0)).alias("i"))
    curve = _curve(spark, d).select("event_type", (F.col("md") / 2).cast("int").alias("i"), "risk")
    return e.join(curve, ["event_type", "i"]).select("event_id", "risk")


RISK_AT = f"WITH {_CURVE} SELECT e.event_id, risk FROM (SELECT event_id, event_type, greatest(least(round_even({_HOURS} / 2, 0), 359), 0) * 2 md FROM events) e JOIN curve USING (event_type, md)"


def relevance_components(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one nation against its first: components, weights overridden and set to sum to one, and what passes 0.5."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", ((F.col("s_suppkey") * 7919) % 10007).cast("double").alias("x"), F.col("s_acctbal").alias("bal"))
    first = s.groupBy("s_nationkey").agg(F.min_by(F.struct("s_suppkey", "x", "bal"), "s_suppkey").alias("a"))
    p = s.join(first, "s_nationkey").where("s_suppkey <> a.s_suppkey")
    k = F.col("s_suppkey")
    parts = {
        "dist": relevance.distance_score(F.abs(F.col("x") - F.col("a.x"))), "strat": F.least(F.abs(F.col("bal")), F.abs(F.col("a.bal"))) / F.greatest(F.abs(F.col("bal")), F.abs(F.col("a.bal")), F.lit(1.0)),
        "traj": 1 - F.least(F.lit(1.0), (k % 90) / 60.0), "ops": relevance.operations_score(k % 2 == 0, F.when(k % 3 == 0, 1.0).otherwise(0.3), (k % 5) / 20.0),
        "qual": relevance.quality_score(k % 2 == 1, k % 5, k % 3), "time": relevance.recency_score((k % 30).cast("double")),
    }
    score = relevance.relevance_score(parts, F.when(k % 11 == 0, 0.04).otherwise(1.0), F.when(k % 7 == 0, 0.55).otherwise(1.0), {"dist": 0.6})
    return p.select("s_nationkey", "s_suppkey", score.alias("score")).withColumn("relevant", F.col("score") >= 0.5)


RELEVANCE_COMPONENTS = """WITH s AS (SELECT s_nationkey n, s_suppkey k, ((s_suppkey * 7919) % 10007)::DOUBLE x, s_acctbal b FROM supplier), f AS (SELECT n, min(k) k, arg_min(x, k) x, arg_min(b, k) b FROM s GROUP BY 1),
c AS (SELECT s.n, s.k, exp(-abs(s.x - f.x) / 6000) d, least(abs(s.b), abs(f.b)) / greatest(abs(s.b), abs(f.b), 1.0) t, 1 - least(1.0, (s.k % 90) / 60.0) j,
  0.3 * (CASE WHEN s.k % 2 = 0 THEN 1 ELSE 0.4 END) + 0.4 * (CASE WHEN s.k % 3 = 0 THEN 1 ELSE 0.3 END) + 0.3 * greatest(0, 1 - abs((s.k % 5) / 20.0) / 0.15) o,
  least(1.0, 0.4 + 0.25 * (s.k % 2 = 1)::INT + 0.1 * least(s.k % 5, 3) + 0.05 * least(s.k % 3, 1)) q, exp(-(s.k % 30) / 15.0) y FROM s JOIN f USING (n) WHERE s.k <> f.k),
r AS (SELECT n, k, CASE WHEN k % 11 = 0 THEN 0.0 ELSE round((CASE WHEN k % 7 = 0 THEN 0.55 ELSE 1.0 END * (0.6 * d + 0.25 * t + 0.1 * j + 0.15 * o + 0.1 * q + 0.1 * y) / 1.3)::DOUBLE, 3) END::DOUBLE score FROM c)
SELECT n s_nationkey, k s_suppkey, score, score >= 0.5 relevant FROM r"""


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Per brand the 25 most similar lines (returned ones only, where there are three), their actions and what they are worth."""
    from boresight.operators import retrieval

    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sim = F.floor((1 - F.col("l_discount")) * (1 - F.col("l_tax")) * 1000 + 0.0001) / 1000
    cases = lines.select("p_brand", F.col("p_type").alias("action"), sim.alias("sim"), (F.col("l_returnflag") == "R").alias("exact"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 3 == 0, "failed").when(F.col("l_linenumber") % 3 == 1, "resolved").otherwise("unknown").alias("outcome"), F.col("l_quantity").alias("cost"))
    ranked = retrieval.rank_actions(questions.choose_cases(cases, ["p_brand"], "sim", "exact", "id"), ["p_brand"], 4)
    return ranked.withColumn("verdict", questions.verdict(F.col("score"), F.col("success")))


RECOMMENDATIONS = """WITH c AS (SELECT p_brand, p_type AS action, floor((1 - l_discount) * (1 - l_tax) * 1000 + 0.0001) / 1000 sim, l_returnflag = 'R' exact, l_orderkey * 10 + l_linenumber id, l_linenumber % 3 o, l_quantity cost FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT *, count(*) FILTER (exact) OVER (PARTITION BY p_brand) x FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sim DESC, id) n FROM m WHERE exact OR x < 3),
a AS (SELECT p_brand, action, round(sum(sim * CASE o WHEN 0 THEN -0.5 WHEN 1 THEN 1.0 ELSE 0.2 END), 4) score, count(*) n, count(*) FILTER (o = 1) resolved, 0::BIGINT partial, count(*) FILTER (o = 0) failed, round(median(cost) FILTER (cost > 0), 4) median_cost FROM k WHERE n <= 25 GROUP BY 1, 2),
r AS (SELECT *, round(resolved / n, 4) success, (row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, action))::INT place FROM a)
SELECT *, CASE WHEN success < 0.5 THEN 'not_effective' WHEN score > 0 THEN 'effective' ELSE 'open' END verdict FROM r WHERE place <= 4"""


def question_intents(spark: SparkSession, d: str) -> DataFrame:
    """What the turns of users ask for."""
    asked = table(spark, d, "conversations").where("role = 'user'")
    parts = questions.parse(F.coalesce("text", F.lit("")))
    return asked.select("conv_id", "turn", parts["intent"].alias("intent"), F.array_join(parts["families"], ",").alias("families"), parts["nearby"].alias("nearby"), parts["radius_km"].alias("radius_km"))


_ASKED = lambda p: f"regexp_matches(t, '{p}')"
QUESTION_INTENTS = f"""WITH q AS (SELECT conv_id, turn, coalesce(text, '') t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN {_ASKED(questions.COUNT)} THEN 'count' WHEN {_ASKED(questions.HOW)} THEN 'how' ELSE 'describe' END intent, CASE WHEN {_ASKED(questions.PRACTICE)} THEN 'PR' ELSE concat_ws(',', {', '.join(f"CASE WHEN {_ASKED(p)} THEN '{n}' END" for n, p in questions.TRIGGERS.items())}) END families,
  {_ASKED(questions.NEARBY)} nearby, TRY_CAST(nullif(regexp_extract(t, '{questions.RADIUS}', 1), '') AS DOUBLE) radius_km FROM q"""


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """How often each lower-cased word of letters stands in the documents."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


VOCABULARY = "SELECT word, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) word FROM documents) GROUP BY 1"


def family_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "view", F.upper("event_type")).alias("family"))
    return records.family_counts(e, "user_id", ["CLICK", "PURCHASE", "PR"])


FAMILY_COUNTS = "SELECT user_id, count(*) n_events, count(*) FILTER (event_type = 'click') n_click, count(*) FILTER (event_type = 'purchase') n_purchase, count(*) FILTER (event_type = 'view') n_pr FROM events GROUP BY 1"


def adjacent_lines(spark: SparkSession, d: str) -> DataFrame:
    """Part types that consecutive lines of an order share."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tops = lines.groupBy("l_orderkey", "l_linenumber", "p_type").agg(F.max("l_quantity").alias("q"))
    return records.adjacent(tops, "l_orderkey", "l_linenumber", "p_type", "q")


ADJACENT_LINES = """WITH t AS (SELECT l_orderkey, l_linenumber, p_type, max(l_quantity) q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
SELECT a.l_orderkey, a.l_linenumber, a.p_type, a.q value_from, b.q value_to FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.p_type = b.p_type AND b.l_linenumber = a.l_linenumber + 1"""


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """Where a quote stands in its document, and its key against repeats."""
    docs = table(spark, d, "documents").where(F.length("text") >= 60).select("doc_id", "text", F.substring("text", 11, 45).alias("quote"))
    return docs.select("doc_id", text.spans_of(F.col("text"), F.col("quote"))["start"].alias("start"), F.sha2(text.dedupe_key(F.col("quote")), 256).alias("key_sha256"))


HIGHLIGHTS = r"SELECT doc_id, (instr(text, substr(text, 11, 45)) - 1)::INT AS start, sha256(left(lower(regexp_replace(substr(text, 11, 45), '[^\pL\pN_]+', '', 'g')), 80)) key_sha256 FROM documents WHERE length(text) >= 60"


def page_stories(spark: SparkSession, d: str) -> DataFrame:
    """The extraction chain over whole documents, with everyday words in the place of troubles."""
    from boresight.operators import extraction

    docs = table(spark, d, "documents").select("doc_id", "text")
    words = {"STUCK_PIPE": r"\b(the|que)\b", "TIGHT_HOLE": r"\b(die|le)\b", "TORQUE_SPIKE": r"\b[0-9]{3}\b"}
    sentences = extraction.read_sentences(docs, ["doc_id"], events=words)
    stories = extraction.group_stories(sentences, ["doc_id"])
    return stories.groupBy("doc_id", "story", "type").agg(F.count("*").alias("n_sentences"), F.min("sent_no").alias("first_sentence"))


FUNCTIONS = (review_overlay, event_brief, quote_provenance, survey_positions, survey_md_at_tvd, path_distance, first_crossing, label_windows, alarm_recall, lookahead_backtest, zone_contributors, risk_at, relevance_components,
             recommendations, question_intents, vocabulary, family_counts, adjacent_lines, highlights, page_stories)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
