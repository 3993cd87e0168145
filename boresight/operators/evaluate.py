"""Evaluation: ranking gain, ROC-AUC, alarm thresholds, greedy matching, backtests."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boresight.operators import features

CONFUSABLE = {"SP": "TQ", "TQ": "SP"}  # fixed values: families whose signs overlap
AT_ONCE = "SP"  # fixed value: the family that a crew notices at its onset


def ndcg(ranked: DataFrame, group: str, gain: str, score: list[Column], k: int = 5) -> DataFrame:
    """NDCG at ``k`` of each group; groups without gain have 0."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(gain)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*score))
    both = ranked.withColumn("__place", place).withColumn("__best", best).where(f"__place <= {k} OR __best <= {k}")
    part = lambda p: F.sum(F.when(F.col(p) <= k, F.col(gain) / F.log2(F.col(p) + 1)).otherwise(0.0))
    sums = both.groupBy(group).agg(part("__place").alias("dcg"), part("__best").alias("ideal"))
    return sums.select(group, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def auc(scored: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """Rank-sum ROC-AUC with average ranks on ties.

    Scores are first counted by value, so the running count goes over different values rather than rows.
    """
    by_value = scored.groupBy(*group, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by_value.withColumn("w", F.col("p") * (below + F.col("n") / 2))
    total = wins.groupBy(*group).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*group, "p", "n", (F.col("w") / F.when(F.col("p") * F.col("n") > 0, F.col("p") * F.col("n"))).alias("auc"))


def threshold_sweep(scored: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Alarms, hits, precision and recall at each threshold, from one aggregate by threshold step."""
    step = sum(((F.col(score) >= t).cast("int") for t in thresholds), F.lit(0))
    by_step = scored.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.sum(label).alias("hits"))
    spread = by_step.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("s")))).where("i > 0").groupBy("i").agg(F.sum("n").alias("alarms"), F.sum("hits").alias("hits"))
    value = F.element_at(F.array(*map(F.lit, thresholds)), F.col("i"))
    return spread.select(value.alias("threshold"), "alarms", "hits")


def choose_threshold(rates: DataFrame, most: float = 2.0) -> DataFrame:
    """By family the lowest threshold with at most ``most`` false alarms a day, else the one with fewest; ``rates(family, threshold, false_per_day)``."""
    good = F.min(F.when(F.col("false_per_day") <= most, F.col("threshold")))
    return rates.groupBy("family").agg(F.coalesce(good, F.min_by("threshold", F.struct("false_per_day", "threshold"))).alias("threshold"))


def false_alarm_rates(scored: DataFrame, thresholds: list[float], every_s: float = 10.0) -> DataFrame:
    """``family, threshold, false_per_day`` over segments that are neither of the family nor of one that looks like it.

    ``scored(segment, kind, family, t, p)`` has a row each ``every_s`` seconds; an alarm is the second row in a row at the
    threshold. A segment without a kind counts for all families. Each segment is ordered alone. A row is an alarm at just the
    thresholds that it and the row before reach and the one before them doesn't, so rows aren't multiplied by thresholds: each
    says between which of them it is one, and the family's few thresholds are summed up at the end. A null ``p`` reaches none.
    """
    cuts = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    alike = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFUSABLE.items() for x in kv]), F.col("family")), F.lit(""))
    kept = scored.where(F.col("kind").isNull() | ((F.col("kind") != F.col("family")) & (F.col("kind") != alike)))
    w = Window.partitionBy("segment", "family").orderBy("t")
    reached = F.coalesce(F.size(F.filter(cuts, lambda t: t <= F.col("p"))), F.lit(0))
    steps = kept.withColumn("__own", F.when(F.col("p").isNull(), 0).otherwise(reached))
    steps = steps.select("family", F.least("__own", F.lag("__own", 1, 0).over(w)).alias("high"), F.lag("__own", 2, 0).over(w).alias("low"))
    turn = F.when(F.col("high") > F.col("low"), F.array(F.struct((F.col("low") + 1).alias("i"), F.lit(1).alias("x")), F.struct((F.col("high") + 1).alias("i"), F.lit(-1).alias("x"))))
    turns = steps.select("family", F.explode(turn).alias("e")).groupBy("family", "e.i").agg(F.sum("e.x").alias("x"))
    rows = steps.groupBy("family").agg(F.count("*").alias("n")).select("family", "n", F.posexplode(cuts).alias("i", "threshold")).withColumn("i", F.col("i") + 1)
    summed = F.coalesce(F.sum("x").over(Window.partitionBy("family").orderBy("i")), F.lit(0))  # a row a threshold
    return rows.join(turns, ["family", "i"], "left").select("family", "threshold", (summed / F.greatest(F.col("n") * every_s / 3600, F.lit(1e-6)) * 24).alias("false_per_day"))


def event_leads(alarms: DataFrame, segments: DataFrame, before_s: int = 3600, declared_s: int = 600, after_s: int = 600) -> DataFrame:
    """``segment, family, lead_min`` of every event of ``segments(segment, kind, t_onset)``: minutes from its first alarm to when it was declared.

    An event is declared ``declared_s`` after its onset, a stuck pipe at once; alarms of its own family count from ``before_s``
    before the onset to ``after_s`` after it was declared. Events without such an alarm have null. ``alarms(segment, family, alarm_t)``.
    """
    declared = F.col("t_onset") + F.when(F.col("family") == AT_ONCE, 0).otherwise(declared_s)
    events = segments.where(F.col("kind").isNotNull() & F.col("t_onset").isNotNull()).select("segment", F.col("kind").alias("family"), "t_onset")
    in_time = F.col("alarm_t").between(F.col("t_onset") - before_s, declared + after_s)
    first = events.join(alarms, ["segment", "family"], "left").groupBy("segment", "family", "t_onset").agg(F.min(F.when(in_time, F.col("alarm_t"))).alias("first"))
    return first.select("segment", "family", ((declared - F.col("first")) / 60).alias("lead_min"))


def _follow(links: list[int], i: int) -> int:
    """Where the links from ``i`` end; the path is shortened on the way."""
    while links[i] != i:
        links[i] = links[links[i]]
        i = links[i]
    return i


def greedy_match(truth: DataFrame, found: DataFrame, key: list[str], reach: float) -> DataFrame:
    """One-to-one matches within ``reach``: truths in ``ord`` order, each takes its nearest unused find (least id on ties).

    Finds farther apart than ``reach`` from every other row never compete, so each key's axis is cut at such gaps and each
    stretch is matched alone, in time n log n. A stretch is held by one task: a key with rows closer than ``reach`` all along
    is one stretch. ``truth(key, ord, at)``, ``found(key, id, at)``.
    """
    t = truth.select(*key, F.lit(0).alias("side"), F.col("ord").cast("long").alias("n"), F.col("at").cast("double"))
    f = found.select(*key, F.lit(1).alias("side"), F.col("id").cast("long").alias("n"), F.col("at").cast("double"))
    w = Window.partitionBy(*key).orderBy("at", "side", "n")
    cut = t.unionByName(f).withColumn("stretch", F.sum(F.coalesce((F.col("at") - F.lag("at").over(w) > reach).cast("int"), F.lit(0))).over(w))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None

        def solve() -> list[tuple]:
            places = sorted({x for s, _, x in held if s == 1})
            free = [[] for _ in places]  # the unused finds at a place, least id last
            for n, x in sorted(((n, x) for s, n, x in held if s == 1), reverse=True):
                free[bisect_left(places, x)].append(n)
            # Beside each place the nearest one, itself included, that may have unused finds; one more on either side stands for none.
            after, before = list(range(len(places) + 1)), list(range(len(places) + 1))
            out = []
            for _, n, x in sorted((r for r in held if r[0] == 0), key=lambda r: r[1]):
                k = bisect_left(places, x)
                near = []
                if (right := _follow(after, k)) < len(places):
                    near.append((abs(places[right] - x), free[right][-1], right))
                if (left := _follow(before, k)) > 0:  # shifted by one
                    near.append((abs(places[left - 1] - x), free[left - 1][-1], left - 1))
                if near and (best := min(near))[0] <= reach:
                    d, fn, i = best
                    free[i].pop()
                    if not free[i]:
                        after[i], before[i + 1] = i + 1, i
                    out.append((*at[:-1], n, fn, d))
            return out

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                here = (*r[: len(key)], r.stretch)
                if here != at:
                    rows += solve() if held else []
                    held, at = [], here
                held.append((r.side, r.n, r.at))
            if rows:
                yield pd.DataFrame(rows, columns=[*key, "ord", "id", "distance"])
        if held and (rows := solve()):
            yield pd.DataFrame(rows, columns=[*key, "ord", "id", "distance"])

    schema = ", ".join([*(f"{k} {truth.schema[k].dataType.simpleString()}" for k in key), "ord long", "id long", "distance double"])
    return cut.repartition(*key, "stretch").sortWithinPartitions(*key, "stretch").mapInPandas(match, schema)


def precision_recall(n_truth: Column, n_found: Column, n_matched: Column) -> list[Column]:
    p = n_matched / F.greatest(n_found, F.lit(1))
    r = n_matched / F.greatest(n_truth, F.lit(1))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def event_recall(alarms: DataFrame, events: DataFrame, key: list[str], before_s: int = 3600, after_s: int = 600) -> DataFrame:
    """Each event with its first alarm in the window and the lead in minutes."""
    hit = F.col("alarm_t").between(F.col("t") - before_s, F.col("t") + after_s)
    first = events.join(alarms, key).where(hit).groupBy(*key, "t").agg(F.min("alarm_t").alias("first_alarm"))
    return events.join(first, [*key, "t"], "left").withColumn("lead_min", (F.col("t") - F.col("first_alarm")) / 60)
