"""Queries of training and alarm thresholds: users as drilling segments, their events as records 10 seconds apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boresight.operators import features, training
from boresight.plans import sequences
from boresight.sources.tables import table

KINDS = ("LC", "SP", "OP", "TQ", None)


def _samples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(records, segments): every fifth user has no event, the others have one of their kind in the middle."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("segment"), "value")
    t = (10 * F.row_number().over(Window.partitionBy("segment").orderBy("event_id"))).cast("double")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("segment") % 5 + 1).cast("int"))
    segments = e.groupBy("segment").agg((10.0 * F.floor(F.count("*") / 2)).alias("t_onset")).select("segment", kind.alias("kind"), F.when(kind.isNotNull(), F.col("t_onset")).alias("t_onset"), F.col("t_onset").alias("md_onset"), F.lit(50.0).alias("precursor_m"))
    return e.withColumn("t", t).withColumn("md", F.col("t")), segments


def alarm_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of each family with at most two false alarms a day, what it catches and how early; scores are values."""
    rows, segments = _samples(spark, d)
    scored = rows.select("segment", "t", F.explode(F.array(*map(F.lit, training.FAMILIES))).alias("family"), (F.col("value") / 300).alias("p"))
    found = training.alarm_report(scored, segments, most=250.0)
    return found.select("family", "threshold", F.round("false_per_day", 3).alias("false_per_day"), "n_events", F.round("event_recall", 4).alias("event_recall"), F.round("median_lead_min", 3).alias("median_lead_min"))


ALARM_THRESHOLDS = """WITH r AS (SELECT user_id seg, value / 300 p, 10.0::DOUBLE * row_number() OVER (PARTITION BY user_id ORDER BY event_id) t FROM events),
s AS (SELECT seg, ['LC', 'SP', 'OP', 'TQ', NULL][seg % 5 + 1] kind, 10.0::DOUBLE * (count(*) // 2) onset FROM r GROUP BY seg),
x AS (SELECT r.*, kind, family, i / 100.0::DOUBLE threshold FROM r JOIN s USING (seg) CROSS JOIN (SELECT unnest(['LC', 'SP', 'OP', 'TQ']) family) CROSS JOIN range(50, 100) g(i)),
b AS (SELECT *, sum((p < threshold)::INT) OVER (PARTITION BY seg, family, threshold ORDER BY t) island FROM x),
k AS (SELECT *, p >= threshold AND sum((p >= threshold)::INT) OVER (PARTITION BY seg, family, threshold, island ORDER BY t) = 2 alarm FROM b),
f AS (SELECT family, threshold, count(*) FILTER (alarm) / (count(*) * 10 / 3600.0::DOUBLE) * 24 rate FROM k WHERE kind IS NULL OR (kind <> family AND NOT (kind IN ('SP', 'TQ') AND family IN ('SP', 'TQ'))) GROUP BY ALL),
c AS (SELECT family, coalesce(min(threshold) FILTER (rate <= 250), arg_min(threshold, struct_pack(r := rate, t := threshold))) threshold FROM f GROUP BY family),
a AS (SELECT seg, family, t FROM k JOIN c USING (family, threshold) WHERE alarm),
l AS (SELECT s.seg, s.kind family, (onset + CASE WHEN s.kind = 'SP' THEN 0 ELSE 600 END - min(a.t)) / 60 lead_min FROM s LEFT JOIN a ON a.seg = s.seg AND a.family = s.kind AND a.t BETWEEN onset - 3600 AND onset + CASE WHEN s.kind = 'SP' THEN 600 ELSE 1200 END WHERE s.kind IS NOT NULL GROUP BY s.seg, s.kind, onset)
SELECT c.family, c.threshold, round(rate, 3) false_per_day, coalesce(n_events, 0) n_events, round(coalesce(event_recall, 0), 4) event_recall, round(median_lead_min, 3) median_lead_min FROM c JOIN f USING (family, threshold)
LEFT JOIN (SELECT family, count(*) n_events, count(lead_min) / count(*) event_recall, median(lead_min) median_lead_min FROM l GROUP BY family) USING (family)"""


def training_report(spark: SparkSession, d: str) -> DataFrame:
    """Models of four families on the rolling features, validated on users that they never saw (groups of three users)."""
    rows, segments = _samples(spark, d)
    for f in training.FAMILIES:
        rows = features.label_windows(rows, segments, f).withColumnRenamed("label", f"y_{f}").select(*rows.columns, f"y_{f}")
    made = rows.join(sequences.rolling_features(spark, d), "event_id").withColumn("group", F.floor(F.col("segment") / 3))
    found = training.report(made, segments, sequences.NAMES)
    return found.select("family", "n_samples", "n_positive", F.round("auc", 3).alias("auc"), "threshold", F.round("false_per_day", 2).alias("false_per_day"), "n_events", F.round("event_recall", 3).alias("event_recall"), F.round("median_lead_min", 1).alias("median_lead_min"))


FUNCTIONS = (alarm_thresholds, training_report)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
