"""Look-ahead backtest: every bore in turn plays the one under way, seen from earlier bores alone, against a plain baseline.

All bores are tested in one job: the bore under test is a key of the kernels and curves, so nothing is computed bore by bore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boresight.operators import relevance, risk

# Bores of the baseline, their weight's scale in metres, width and height of its kernels; the least relevance; how far a hit may be off.
NEAREST, SCALE_M, WIDTH_M, HEIGHT, LEAST_RELEVANCE, REACH_M = 5, 6000.0, 10.0, 0.85, 0.50, 15.0
LEAST_WIDTH_M, REACH_WIDTHS = 10.0, 8.0  # fixed values: as in risk.noisy_or


def earlier_offsets(bores: DataFrame, radius: float) -> DataFrame:
    """``target, bore, distance``: bores within ``radius`` that were begun in an earlier year; ``bores(bore, x, y, year)``. A bore without a year has and is none."""
    a = bores.select(F.col("bore").alias("target"), "x", "y")
    near = relevance.radius_neighbors(a, bores.select("bore", "x", "y"), "target", "bore", radius)
    years = bores.select("bore", "year")
    both = near.join(years, "bore").join(years.select(F.col("bore").alias("target"), F.col("year").alias("__own")), "target")
    return both.where("year < __own").select("target", "bore", "distance")


def baseline_kernels(offsets: DataFrame, events: DataFrame) -> DataFrame:
    """``target, family, mu, sigma, amp`` of the nearest bores' events at their own depths; ``events(bore, family, md)``."""
    place = F.row_number().over(Window.partitionBy("target").orderBy("distance", "bore"))
    near = offsets.withColumn("__place", place).where(F.col("__place") <= NEAREST)
    return near.join(events, "bore").select("target", "family", F.col("md").alias("mu"), F.lit(WIDTH_M).alias("sigma"), (HEIGHT * F.exp(-F.col("distance") / SCALE_M)).alias("amp"))


def aligned_kernels(offsets: DataFrame, relevant: DataFrame, events: DataFrame, tops: DataFrame) -> DataFrame:
    """The same of all relevant bores' events, at their share of the layer in the bore under test.

    ``relevant(target, bore, layer, s)``, ``events(bore, layer, family, f_pos, md, severity, confidence, weight, status)``,
    ``tops(bore, layer, md_top, md_base, kind)``. Events of layers below ``LEAST_RELEVANCE``, or of no layer, don't count.
    """
    met = offsets.select("target", "bore").join(relevant.where(F.col("s") >= LEAST_RELEVANCE), ["target", "bore"]).join(events, ["bore", "layer"])
    own = tops.select(F.col("bore").alias("target"), "layer", F.col("md_top").alias("tvd_top"), F.col("md_base").alias("tvd_base"), "kind")
    amp = risk.amplitude(F.col("s"), F.col("severity"), F.col("weight"), F.col("confidence"))
    return risk.project(met.withColumn("amp", amp), own, ["target"]).select("target", "family", F.coalesce("at_tvd", "md").alias("mu"), "sigma", "amp")


def lookahead(kernels: dict[str, DataFrame], offsets: DataFrame, truth: DataFrame, families: list[str], low: float, high: float, step: float, level: float) -> DataFrame:
    """``method, events, hits, recall, flagged`` of each method's kernels, on the depths above ``low`` up to ``high``.

    A hit is an event of ``truth(bore, family, md)`` with its family's risk at ``level`` or over within ``REACH_M``; ``flagged`` is the share
    of grid points at which any family is. Bores without such events, or without earlier offsets, are not tested.
    """
    tested = truth.where((F.col("md") > low) & F.col("family").isin(list(families))).withColumnRenamed("bore", "target").join(offsets.select("target").distinct(), "target")
    tested = tested.groupBy("target", "family", "md").agg(F.count("*").alias("__n"))
    place = (F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1).cast("int").alias("family")
    rows = tested.select("target", F.lit(-1).alias("method"), place, F.col("md").cast("double").alias("mu"), F.lit(0.0).alias("bw"), F.col("__n").cast("double").alias("amp"))
    for i, k in enumerate(kernels.values()):
        one = k.where(F.col("target").isNotNull() & F.col("family").isin(list(families)))
        rows = rows.unionByName(one.select("target", F.lit(i).alias("method"), place, "mu", F.greatest("sigma", F.lit(LEAST_WIDTH_M)).alias("bw"), "amp"))
    parts = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "target").sortWithinPartitions("target", "method", "family")  # a number, as the rows are few in bytes and adaptive execution would put many in a task
    seen = dealt.mapInPandas(_seen(len(kernels), len(families), np.arange(int(low // step) + 1, int(high // step) + 1) * float(step), level), "method int, events long, hits long, high long, points long")
    summed = seen.groupBy("method").agg(*[F.sum(c).alias(c) for c in ("events", "hits", "high", "points")])
    named = F.element_at(F.array(*map(F.lit, kernels)), F.col("method") + 1).alias("method")
    return summed.select(named, "events", "hits", (F.col("hits") / F.col("events")).alias("recall"), (F.col("high") / F.col("points")).alias("flagged"))


def _seen(methods: int, families: int, grid: np.ndarray, level: float):
    """Rows in order of target: its events (method -1, ``amp`` times), then kernels; each method's sums for each target with events.

    The curves of one target are in memory at a time, so neither grid points nor their kernels are shuffled.
    """

    def told(events: list[np.ndarray], miss: np.ndarray) -> list[tuple]:
        up = np.floor((1 - miss) * 1000 + 0.5) / 1000 >= level
        any_up = up.any(axis=1).sum(axis=1)
        family, md, n = np.concatenate(events, axis=1)
        near = np.abs(grid - md[:, None]) <= REACH_M
        return [(i, int(n.sum()), int(n[(up[i, family.astype(int)] & near).any(axis=1)].sum()), int(any_up[i]), len(grid)) for i in range(methods)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, events, miss = None, [], None
        for pdf in batches:
            out = []
            target, method = pdf["target"].to_numpy(), pdf["method"].to_numpy()
            family, mu, bw, amp = (pdf[c].to_numpy(float) for c in ("family", "mu", "bw", "amp"))
            turns = np.flatnonzero(np.r_[len(pdf) > 0, target[1:] != target[:-1]])
            for s, e in zip(turns, [*turns[1:], len(pdf)]):
                if target[s] != at:
                    out += told(events, miss) if events else []
                    at, events, miss = target[s], [], np.ones((methods, families, len(grid)))
                first = s + int((method[s:e] < 0).sum())
                if first > s:
                    events.append(np.stack([family[s:first], mu[s:first], amp[s:first]]))
                if first == e or not events:
                    continue
                for low in range(first, e, 1024):  # kernels at once
                    k = slice(low, min(low + 1024, e))
                    z = (grid - mu[k, None]) / bw[k, None]
                    part = np.where(np.abs(z) <= REACH_WIDTHS, 1 - amp[k, None] * np.exp(-0.5 * z * z), 1.0)
                    part[np.isnan(part)] = 1.0
                    group = method[k] * families + family[k].astype(int)
                    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                    miss.reshape(methods * families, -1)[group[starts]] *= np.multiply.reduceat(part, starts, axis=0)
            if out:
                yield pd.DataFrame(out, columns=["method", "events", "hits", "high", "points"])
        if events:
            yield pd.DataFrame(told(events, miss), columns=["method", "events", "hits", "high", "points"])

    return run
