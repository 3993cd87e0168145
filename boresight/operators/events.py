"""The event base: validation, severity, confidence, merging, review overlay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores of subtypes, and the lost hours from which the next class begins.
SUBTYPE_SEVERITY = {"total": 5, "severe": 4, "partial": 3, "seepage": 1}
HOURS_SEVERITY = ((30, 5), (12, 4), (4, 3))


def subtype_score(subtype: Column) -> Column:
    """Score of a subtype; null for one that has none."""
    out = F.lit(None).cast("int")
    for name, score in SUBTYPE_SEVERITY.items():
        out = F.when(subtype == name, score).otherwise(out)
    return out


def severity(subtype_score: Column, npt: Column, outcome: Column, practice: Column) -> Column:
    """0 for practices; the greater of the subtype's score and the class of lost hours, 5 on failure; 2 without lost hours."""
    hours = F.coalesce(npt, F.lit(0.0))
    by_npt = F.when(hours == 0, 2).when(outcome == "failed", 5)
    for least, score in HOURS_SEVERITY:
        by_npt = by_npt.when(hours >= least, score)
    by_npt = by_npt.otherwise(2)
    return F.when(practice, 0).otherwise(F.greatest(F.coalesce(subtype_score, F.lit(0)), by_npt)).cast("int")


def confidence(reported: Column, consistent: Column, dated: Column, answered: Column, inferred: Column, scanned: Column, off_date: Column) -> Column:
    """Sum of evidence for and against a record, held in [0, 1]; ``consistent`` may be null."""
    score = 0.55 + 0.20 * reported.cast("int") + F.when(consistent.isNull(), 0.0).when(consistent, 0.10).otherwise(-0.15) + 0.05 * dated.cast("int") + 0.05 * answered.cast("int")
    score = score - 0.10 * inferred.cast("int") - 0.10 * scanned.cast("int") - 0.10 * off_date.cast("int")
    return F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2)


def review_status(score: Column, cut: float = 0.8) -> Column:
    return F.when(score >= cut, "auto").otherwise("needs_review")


def split_valid(events: DataFrame, depth: str, total: str, slack: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with a reason): no depth, or deeper than the bore."""
    reason = F.when(F.col(depth).isNull(), "no depth").when(F.col(depth) > F.col(total) + slack, "deeper than total depth")
    marked = events.withColumn("reject_reason", reason)
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def merge_events(events: DataFrame, key: list[str], reach: float = 15.0, order: list[str] | None = None, cut: float = 0.8) -> DataFrame:
    """Cross-document merging of one key's events: neighbours in depth that lie within ``reach`` of a cluster's depth are one event.

    A cluster stands where its surest member stands (the earlier one on ties) and every merge raises its certainty by 0.05,
    so whether a row joins depends on the rows before: no gaps-and-islands. That much is a fold over rows in depth order with
    four numbers of memory, however large a key is. It gives each row its cluster and its precedence: a surer row goes before
    all others of the cluster, another one behind them. All else is one aggregate: the first known value by precedence of
    the other columns ('unknown' outcomes count as not known), pooled ``sources``, ``actions`` in order of precedence,
    ``flags`` with multi_source. ``events`` has key columns, md, confidence, status, sources, actions, flags and others.
    """
    order = order or ["md", "confidence", "sources"]
    placed = "__cluster long, __place int, __sure double"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cluster, md, sure, front, back = None, 0, 0.0, 0.0, 0, 0
        for pdf in batches:
            out = []
            for *here, depth, certainty in zip(*(pdf[k] for k in key), pdf["__md"], pdf["__confidence"]):
                if here != at or abs(depth - md) > reach:
                    at, cluster, md, sure, front, back, place = here, cluster + 1, depth, certainty, 0, 0, 0
                elif certainty > sure:
                    md, sure, front = depth, min(1.0, certainty + 0.05), front - 1
                    place = front
                else:
                    sure, back = min(1.0, sure + 0.05), back + 1
                    place = back
                out.append((cluster, place, sure))
            made = pd.DataFrame(out, columns=["__cluster", "__place", "__sure"], index=pdf.index)
            yield pd.concat([pdf[[*key, "__id"]], made], axis=1)

    # The fold sees four columns; the rows themselves meet its answer in the aggregate, by their place in the key.
    w = Window.partitionBy(*key).orderBy(*order)
    ranked = events.withColumn("__id", F.row_number().over(w))
    slim = ranked.select(*key, "__id", F.col("md").cast("double").alias("__md"), F.col("confidence").cast("double").alias("__confidence"))
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in key)
    folded = slim.repartition(*key).sortWithinPartitions(*key, "__id").mapInPandas(fold, f"{kinds}, __id int, {placed}")
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("__place")))
    made: dict[str, Column] = {"md": first(F.col("md"))}
    by_place = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("__place", F.col(c).alias("x")))), lambda s: s["x"])
    by_depth = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("__id", F.col(c).alias("x")))), lambda s: s["x"])
    for c in (c for c in events.columns if c not in key):
        made[c] = first(F.nullif(F.col(c), F.lit("unknown"))) if c == "outcome" else first(F.col(c))
    made |= {"sources": F.flatten(by_depth("sources")), "actions": F.array_distinct(F.flatten(by_place("actions")))}
    extra = F.when(F.count("*") > 1, F.array(F.lit("multi_source"))).otherwise(F.array().cast("array<string>"))
    made["flags"] = F.array_sort(F.array_union(F.array_distinct(F.flatten(F.collect_list("flags"))), extra))
    made["confidence"] = F.round(F.max_by("__sure", "__id"), 3)
    made["status"] = F.when(F.count("*") == 1, F.first("status")).when(F.round(F.max_by("__sure", "__id"), 3) >= cut, "auto").otherwise("needs_review")
    if "outcome" in made:
        made["outcome"] = F.coalesce(made["outcome"], F.lit("unknown"))
    both = ranked.join(folded, [*key, "__id"])
    return both.groupBy(*key, "__cluster").agg(*[x.alias(c) for c, x in made.items()]).select(*events.columns)


def overlay_reviews(events: DataFrame, reviews: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Events as the last review of each leaves them; ``reviews(event_id, ts, seq, status, md_top, type, family, user)``.

    The log is append-only; the last entry of an event is a combinable aggregate. Derived columns stay as they were.
    """
    last = reviews.groupBy(event_id).agg(F.max_by(F.struct("status", "md_top", "type", "family", "user", "ts"), F.struct("ts", "seq")).alias("r"))
    joined = events.join(last, event_id, "left")
    new = {"status": F.coalesce("r.status", "status"), "md_top": F.coalesce("r.md_top", "md_top"), "type": F.coalesce("r.type", "type"), "family": F.when(F.col("r.type").isNotNull(), F.col("r.family")).otherwise(F.col("family"))}
    kept = [new[c].alias(c) if c in new else F.col(c) for c in events.columns]
    return joined.select(*kept, F.col("r.user").alias("curated_by"), F.col("r.ts").alias("curated_at"))


def log_tail(log: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` entries of an append-only log, newest first."""
    return log.orderBy(F.desc(order)).limit(n)
