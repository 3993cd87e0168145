"""Risk tracks of bores under way: a version for each number of picked tops, so that a pick re-aligns all that lies below.

A track depends on the picks alone, and how many tops a bore has passed depends on its depth alone. So the versions are a
static table, computed once for all bores, and a live record finds its own by the depth of the hole: a stream needs no state
and no recomputation to be re-aligned. A bore has a few dozen tops, so versions times tops stay small beside the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boresight.operators import intervals, risk
from boresight.sources.tables import settled

SLACK_M = 2.0  # fixed value: how far the hole must be below a top to pick it
FLOOR_SHARE, RISKY = 0.5, 0.40  # fixed values: the share of the atlas that stands under a curve, the risk from which a zone is one


def tops_by_version(tops: DataFrame, end: Column, session: str = "session") -> DataFrame:
    """``session, version, layer, md_top, md_base, kind``: in version n the first n tops are where they were found, the others prognosed.

    ``tops(session, layer, md_top, md_prognosed)`` and what ``end``, the depth of the bore, reads. Prognosed tops move by the
    shift of the last pick; one that would come to lie above the pick stands at it. Tops without a found depth are never
    picked. Ties go by layer; sessions without tops have no version.
    """
    known = tops.withColumn("__end", end).withColumn("__place", F.row_number().over(Window.partitionBy(session).orderBy(F.col("md_top").asc_nulls_last(), "md_prognosed", "layer")))
    n = known.groupBy(session).agg(F.count("md_top").cast("int").alias("__n")).withColumn("version", F.explode(F.sequence(F.lit(0), F.col("__n")))).drop("__n")
    each = known.join(n, session).withColumn("__actual", F.when(F.col("__place") <= F.col("version"), F.col("md_top")))
    last = F.max("__actual").over(Window.partitionBy(session, "version"))
    each = each.select(session, "version", "layer", "__place", "__end", "__actual", "md_prognosed", last.alias("__last"))
    placed = intervals.carry_tops(each, [session, "version"], "__place", "md_prognosed", "__actual", F.col("__end"))
    top = F.when(F.col("kind") == "actual", F.col("md_top")).otherwise(F.greatest("md_top", "__last"))
    base = F.coalesce(F.lead(top).over(Window.partitionBy(session, "version").orderBy(top, "__place")), F.col("__end"))
    return placed.select(session, "version", "layer", top.alias("md_top"), base.alias("md_base"), "kind")


def version_at(records: DataFrame, tops: DataFrame, session: str = "session", depth: str = "hole_md") -> DataFrame:
    """Adds ``version``, how many tops of its bore lie ``SLACK_M`` above a record's hole depth (0 without tops or depth).

    The depth of the hole never falls, so neither does the version. Needs no memory: ``records`` may be a stream.
    """
    found = tops.where(F.col("md_top").isNotNull()).groupBy(session).agg(F.collect_list(F.col("md_top") + SLACK_M).alias("__tops"))
    n = F.coalesce(F.size(F.filter("__tops", lambda x: x <= F.col(depth))), F.lit(0))
    return records.join(found, session, "left").withColumn("version", F.greatest(n, F.lit(0))).drop("__tops")


def projected(events: DataFrame, tops: DataFrame, session: str = "session") -> DataFrame:
    """Kernels ``session, version, family, event_id, mu, sigma, amp, method`` of ``events`` in every version of ``tops``.

    ``events(session, layer, family, event_id, f_pos, md, status, amp)``, ``tops`` as of ``tops_by_version``. An event stands at its share of
    the layer, or at its own depth where the layer or the share is unknown.
    """
    versions = tops.select(session, "version").distinct()
    layers = tops.select(session, "version", "layer", F.col("md_top").alias("tvd_top"), F.col("md_base").alias("tvd_base"), "kind")
    placed = risk.project(events.join(versions, session), layers, [session, "version"])
    return placed.select(session, "version", "family", "event_id", F.coalesce("at_tvd", "md").alias("mu"), "sigma", "amp", "method")


def risk_curves(tops: DataFrame, kernels: DataFrame, atlas: DataFrame, families: list[str], end: Column, step: float = 2.0, session: str = "session", start: float = 0.0) -> DataFrame:
    """``session, version, family, md, layer, risk`` at every ``step`` metres from ``start`` to ``end``.

    Grid points are spread from the layers themselves, so none is looked up; above the first top there is no layer and no
    floor. ``atlas(layer, family, posterior)``.
    """
    at = lambda x: F.ceil(x / step)
    rows = lambda low, high: F.when(high > low, F.sequence(low, high - 1))
    inside = tops.withColumn("__i", F.explode(rows(at(F.col("md_top")), at(F.col("md_base"))))).select(session, "version", "layer", "__i")
    above = tops.groupBy(session, "version").agg(F.min("md_top").alias("md_top")).withColumn("__i", F.explode(rows(F.lit(0).cast("long"), at(F.col("md_top"))))).select(session, "version", F.lit(None).cast(tops.schema["layer"].dataType).alias("layer"), "__i")
    points = inside.unionByName(above).withColumn("md", F.col("__i") * F.lit(float(step))).where((F.col("md") >= start) & (F.col("md") < end))
    grid = points.withColumn("family", F.explode(F.array(*map(F.lit, families)))).join(atlas, ["layer", "family"], "left")
    grid = grid.select(session, "version", "family", "md", "layer", (FLOOR_SHARE * F.coalesce("posterior", F.lit(0.0))).alias("floor"))
    key = [session, "version", "family"]
    curve = risk.noisy_or_by(grid, kernels, [session], key, carried=["layer"])
    return curve.withColumn("risk", F.round("risk", 3))


def named_zones(curves: DataFrame, session: str = "session") -> DataFrame:
    """The zones of every version, named by family and depth, with the layer at the peak."""
    found = risk.zones(curves, [session, "version", "family"], "md", "risk", RISKY, carried=["layer"])
    # Kept, as zones are few and the curves under them are not made twice.
    return settled(found.withColumn("id", F.concat(F.col("family"), F.lit("-"), F.floor("md_from").cast("string"))))


def risk_zones(curves: DataFrame, kernels: DataFrame, session: str = "session", top: int = 8) -> DataFrame:
    """``named_zones`` with the ``top`` strongest events within two sigma."""
    key, named = [session, "version", "family"], named_zones(curves, session)
    met = risk.contributors(named, kernels, key, top).select(*key, "id", "event_ids", "n_events")
    return named.join(met, [*key, "id"], "left").withColumns({"event_ids": F.coalesce("event_ids", F.array().cast(kernels.select(F.array("event_id").alias("x")).schema["x"].dataType)), "n_events": F.coalesce("n_events", F.lit(0))})
