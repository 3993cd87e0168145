"""Empirical-Bayes risk atlas, projection along an axis, noisy-OR curves and zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from boresight.functions.numeric import band

PRIOR_STRENGTH, LEAST_RATE = 4.0, 0.01
LIKELIHOOD, CONSEQUENCE = [0.05, 0.15, 0.3, 0.5], [2.0, 8.0, 16.0, 30.0]
# Amplitude by severity 0 to 5.
SEVERITY = [0.4, 0.55, 0.7, 0.85, 0.95, 1.0]


def risk_atlas(pairs: DataFrame, events: DataFrame, families: list[str]) -> DataFrame:
    """Posterior risk of every (layer, family).

    ``pairs(entity, layer, s)`` are the layers that entities met, with their relevance; ``events(entity, layer, family,
    weight, cost)`` what happened there. Two combinable aggregates; cells without events come from exploding the families.
    """
    prior = events.groupBy("family").agg(F.count_distinct("entity", "layer").alias("hits"))
    n_pairs = pairs.agg(F.count("*").alias("n_pairs"))
    hit = events.groupBy("entity", "layer", "family").agg(F.max("weight").alias("weight"), F.sum(F.when(F.col("cost") > 0, F.col("cost"))).alias("cost"), F.count_if(F.col("cost") > 0).alias("costs"))
    k = hit.join(pairs, ["entity", "layer"]).groupBy("layer", "family").agg(F.sum(F.col("s") * F.col("weight")).alias("k"), F.sum("cost").alias("cost"), F.sum("costs").alias("costs"), F.count("*").alias("entities_hit"))
    layers = pairs.groupBy("layer").agg(F.sum("s").alias("n"), F.count("*").alias("entities"))
    cells = layers.withColumn("family", F.explode(F.array(*map(F.lit, families)))).join(k, ["layer", "family"], "left").join(F.broadcast(prior), "family", "left").join(F.broadcast(n_pairs))
    rate = F.greatest(F.coalesce("hits", F.lit(0)) / F.greatest("n_pairs", F.lit(1)), F.lit(LEAST_RATE))
    found = F.coalesce("k", F.lit(0.0))
    a1 = PRIOR_STRENGTH * rate + found
    b1 = PRIOR_STRENGTH * (1 - rate) + F.greatest(F.col("n") - found, F.lit(0.0))
    mean_cost = F.col("cost") / F.when(F.col("costs") > 0, F.col("costs"))
    return cells.select("layer", "family", F.col("n").alias("n_eff"), found.alias("k_eff"), "entities", F.coalesce("entities_hit", F.lit(0)).alias("entities_hit"), a1.alias("a1"), b1.alias("b1"),
                        (a1 / (a1 + b1)).alias("posterior"), mean_cost.alias("mean_cost"), band(a1 / (a1 + b1), LIKELIHOOD).alias("likelihood"), band(F.coalesce(mean_cost, F.lit(0.0)), CONSEQUENCE).alias("consequence"))


def thirds(position: Column, s: Column) -> list[Column]:
    """Sums of relevance in the upper, middle and lower third."""
    third = F.least(F.floor(position * 3), F.lit(2))
    return [F.sum(F.when(third == i, s).otherwise(0.0)).alias(f"third_{i + 1}") for i in range(3)]


def amplitude(s: Column, severity: Column, family_weight: Column, confidence: Column) -> Column:
    by_level = F.element_at(F.array(*map(F.lit, SEVERITY)), F.coalesce(severity, F.lit(0)).cast("int") + 1)
    trust = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.7).otherwise(confidence)
    return s * by_level * family_weight * (0.6 + 0.4 * trust)


def project(events: DataFrame, tops: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Place events of other entities on the active one: by position within the layer, else by absolute depth.

    ``events(layer, f_pos, tvdss, status)``, ``tops(layer, tvd_top, tvd_base, kind)``, of each ``key`` if given; adds ``at_tvd``
    (null: use the event's own depth) and ``sigma``.
    """
    key = [*(key or []), "layer"]
    t = tops.select(*key, F.col("tvd_top").alias("__top"), F.col("tvd_base").alias("__base"), F.col("kind").alias("__kind"))
    placed = F.col("__top").isNotNull() & F.col("f_pos").isNotNull()
    sigma = 6.0 + F.when(F.col("__kind") == "prognosed", 5.0).otherwise(0.0) + F.when(F.col("status") == "needs_review", 4.0).otherwise(0.0)
    at = F.when(placed, F.col("__top") + F.col("f_pos") * (F.col("__base") - F.col("__top")))
    method = F.when(placed, "formation_relative").otherwise("tvdss_fallback")
    return events.join(t, key, "left").select(*events.columns, at.alias("at_tvd"), F.when(placed, sigma).otherwise(25.0).alias("sigma"), method.alias("method"))


def noisy_or(grid: DataFrame, kernels: DataFrame, key: list[str], reach: float = 8.0, least_width: float = 10.0, carried: list[str] | None = None) -> DataFrame:
    """1 - (1 - floor) * prod(1 - amp * gauss) at every grid point ``(key, md, floor)`` over ``kernels(key, mu, sigma, amp)``.

    Kernels beyond ``reach`` widths are nothing, so grid and kernels meet on buckets rather than all by all. A kernel stands in
    each bucket that it reaches, however wide it is, and a grid point in its own. Columns ``carried`` of the grid are kept.
    """
    size = reach * least_width
    bucket = lambda x: F.floor(x / size)
    g = grid.withColumn("__bucket", bucket(F.col("md")))
    k = kernels.withColumn("bw", F.greatest("sigma", F.lit(least_width)))
    k = k.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("mu") - reach * F.col("bw")), bucket(F.col("mu") + reach * F.col("bw")))))
    z = (F.col("md") - F.col("mu")) / F.col("bw")
    near = g.join(k.select(*key, "__bucket", "mu", "bw", "amp"), [*key, "__bucket"], "left").withColumn("miss", F.when(F.abs(z) <= reach, 1 - F.col("amp") * F.exp(-0.5 * z * z)).otherwise(1.0))
    return near.groupBy(*key, "md").agg((1 - (1 - F.first("floor")) * F.product("miss")).alias("risk"), *[F.first(c).alias(c) for c in carried or []])


def noisy_or_by(grid: DataFrame, kernels: DataFrame, group: list[str], key: list[str], reach: float = 8.0, least_width: float = 10.0, carried: list[str] | None = None) -> DataFrame:
    """The same, where a task can hold the grid and the kernels of one ``group``, columns of the key such as the bore.

    Points and kernels are shuffled once; no row of a point and a kernel is made. Points with a null in the key have no curve.
    """
    kept, rest = [*key, "md", "floor", *(carried or [])], [c for c in key if c not in group]
    schema = StructType([*[grid.schema[c] for c in key], grid.schema["md"], StructField("risk", DoubleType()), *[grid.schema[c] for c in carried or []]])

    def curve(g: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        md, miss = g["md"].to_numpy(float), np.ones(len(g))
        k = k[k[["mu", "bw", "amp"]].notna().all(axis=1)]
        mu, bw, amp = (k[c].to_numpy(float) for c in ("mu", "bw", "amp"))
        own = k.groupby([f"__k_{c}" for c in rest], sort=False).indices
        for name, at in g.groupby(rest, sort=False).indices.items():
            mine, here = own.get(name, ()), md[at]
            for low in range(0, len(mine), 512):  # kernels at once
                i = mine[low : low + 512, None]
                z = (here - mu[i]) / bw[i]
                z *= z
                part = np.exp(-0.5 * z)
                part *= -amp[i]
                part += 1
                part[z > reach * reach] = 1.0
                miss[at] *= np.multiply.reduce(part, axis=0)
        return g.assign(risk=1 - (1 - g["floor"].to_numpy(float)) * miss)[schema.names]

    # A number of parts, as rows are few in bytes for the work on them, and adaptive execution would put many groups in a task.
    parts = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
    wide = known(kernels).select(*[F.col(c).alias(f"__k_{c}") for c in key], "mu", F.greatest("sigma", F.lit(least_width)).alias("bw"), "amp")  # other names, as both may stem from one frame
    # The hash is one more column, as Spark drops a repartitioning by columns that rows are dealt by already.
    deal = lambda df, by: df.withColumn("__deal", F.hash(*by)).repartition(parts, "__deal", *by).groupBy("__deal", *by)
    dealt = deal(known(grid).select(*kept), group), deal(wide, [f"__k_{c}" for c in group])
    return dealt[0].cogroup(dealt[1]).applyInPandas(curve, schema)


def zones(curve: DataFrame, key: list[str], at: str, risk: str, threshold: float = 0.40, carried: list[str] | None = None) -> DataFrame:
    """Maximal runs of grid points with risk at or over the threshold: ends, size, peak and where it first is, with the ``carried`` columns there as ``peak_<name>``."""
    w = Window.partitionBy(*key).orderBy(at)
    high = F.col(risk) >= threshold
    runs = curve.withColumn("__all", F.row_number().over(w)).where(high).withColumn("__run", F.col("__all") - F.row_number().over(w))
    return runs.groupBy(*key, "__run").agg(F.min(at).alias("md_from"), F.max(at).alias("md_to"), F.max(risk).alias("peak"), F.min_by(at, F.struct(-F.col(risk), F.col(at))).alias("peak_at"), F.count("*").alias("points"), *[F.min_by(c, F.struct(-F.col(risk), F.col(at))).alias(f"peak_{c}") for c in carried or []]).drop("__run")


def contributors(found: DataFrame, events: DataFrame, key: list[str], top: int = 8, bucket: float = 50.0) -> DataFrame:
    """The events within two sigma of each zone, strongest first.

    Zones and events (as stretches of two sigma to either side) stand in each bucket that they touch; a pair is taken in the
    first bucket that both have, so it counts once and no key is joined all by all.
    """
    at = lambda x: F.floor(x / bucket)
    low, high = F.col("mu") - 2 * F.col("sigma"), F.col("mu") + 2 * F.col("sigma")
    z = found.withColumn("__first", at(F.col("md_from"))).withColumn("__bucket", F.explode(F.sequence(at(F.col("md_from")), at(F.col("md_to"))))).alias("z")
    e = events.withColumns({"__low": low, "__high": high}).withColumn("__first", at(F.col("__low"))).withColumn("__bucket", F.explode(F.sequence(at(F.col("__low")), at(F.col("__high"))))).alias("e")
    on = (F.col("z.__bucket") == F.col("e.__bucket")) & (F.col("z.__bucket") == F.greatest("z.__first", "e.__first")) & (F.col("e.__low") <= F.col("z.md_to")) & (F.col("e.__high") >= F.col("z.md_from"))
    for k in key:
        on = on & (F.col(f"z.{k}") == F.col(f"e.{k}"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("e.amp")).alias("a"), F.col("e.event_id").alias("id"))))
    return z.join(e, on).groupBy(*[F.col(f"z.{c}") for c in found.columns]).agg(F.transform(F.slice(ranked, 1, top), lambda s: s["id"]).alias("event_ids"), F.count("*").alias("n_events"))


def max_ahead(curve: DataFrame, key: list[str], at: str, risk: str, low: Column, high: Column) -> DataFrame:
    """Greatest risk over (low, high] and where it first is."""
    return curve.where((F.col(at) > low) & (F.col(at) <= high)).groupBy(*key).agg(F.max(risk).alias("peak"), F.min_by(at, F.struct(-F.col(risk), F.col(at))).alias("peak_at"))
