"""Rolling features of a drilling record stream, rules, scores, episodes.

The features are projections of an array of the last records, so batch (a window frame) and streaming (a state buffer)
share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUFFER = 180
RATIOS = ("rop_ratio", "dxc_ratio", "gas_ratio")
# The rules, by family; each is a condition on the features.
RULES: dict[str, list[tuple[str, bool]]] = {
    "LC": [("dflow < -0.07", True), ("pit_slope < -0.12 AND dflow < -0.03", True)],
    "OP": [("dflow > 0.05 AND pit_slope > 0.08", True), ("gas_ratio > 3 AND gas_level > 4", False), ("rop_ratio > 2 AND gas_ratio > 1.8", False)],
    "SP": [("overpull > 15", False), ("tq_z > 3", False), ("tq_ssi > 0.6 AND rop_ratio < 0.7", False)],
    "TQ": [("tq_ssi > 0.8", False)],
}
UNGATED = ("CM",)  # fixed value: the family whose scores need no corroboration
# The features that must agree with a model's score.
GATES = {
    "LC": "dflow < -0.03 OR pit_slope < -0.05", "OP": "gas_ratio > 1.5 OR dflow > 0.02 OR pit_slope > 0.05",
    "SP": "tq_z > 1.5 OR overpull > 8 OR tq_ssi > 0.3", "TQ": "tq_ssi > 0.4 OR tq_z > 2",
}


def tail(a: Column, n: int) -> Column:
    """The last ``n`` elements, or all."""
    return F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), n)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))


def median(a: Column) -> Column:
    """Of the known values; null without any."""
    s = F.sort_array(F.array_compact(a))
    n = F.size(s)
    low, high = F.try_element_at(s, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")), F.try_element_at(s, F.greatest(F.floor(n / 2 + 1), F.lit(1)).cast("int"))
    return (low + high) / 2


def deviation(a: Column) -> Column:
    """Population standard deviation; the mean travels in the accumulator, so it is not computed again for each element."""
    start = F.struct(mean(a).alias("m"), F.lit(0.0).alias("v"))
    squares = F.aggregate(a, start, lambda s, x: F.struct(s["m"].alias("m"), (s["v"] + (x - s["m"]) * (x - s["m"])).alias("v")), lambda s: s["v"])
    return F.sqrt(squares / F.greatest(F.size(a), F.lit(1)))


def slope(a: Column, dt: float, least: int = 6) -> Column:
    """Least-squares slope against index * dt; 0 under ``least`` points.

    In one pass: with centred indexes the mean of the values drops out, and the indexes' squares sum to n (n^2 - 1) / 12.
    """
    n = F.size(a)
    start = F.struct((-(n - 1) / 2).alias("i"), F.lit(0.0).alias("v"))
    product = F.aggregate(a, start, lambda s, y: F.struct((s["i"] + 1).alias("i"), (s["v"] + s["i"] * y).alias("v")), lambda s: s["v"])
    squares = n * (n * n - 1) / 12 * (dt * dt)
    return F.when(n < least, 0.0).otherwise(product * dt / F.greatest(squares, F.lit(1e-9)))


def drilling_exponent(rop: Column, rpm: Column, wob: Column, ecd: Column) -> Column:
    """Corrected d-exponent; null outside the logarithms' domain."""
    up = (F.greatest(rop, F.lit(0.1)) / 0.3048) / (60 * F.greatest(rpm, F.lit(1.0)))
    down = 12 * F.greatest(wob, F.lit(0.5)) * 2204.6 / (1e6 * 8.5)
    return F.when((up > 0) & (down > 0) & (down != 1), F.log10(up) / F.log10(down) * 1.03 / F.greatest(ecd, F.lit(0.9)))


def beside(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the further columns of the row of ``other`` whose ``on`` columns are the same, null like null; null without one."""
    renamed = other.select(*[F.col(c).alias(f"__o_{c}" if c in on else c) for c in other.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in on]
    return rows.join(renamed, same, "left").drop(*[f"__o_{c}" for c in on])


def numbered(records: DataFrame, key: list[str], order: str, width: int | None = None) -> DataFrame:
    """Adds ``__n``, the row's place in its key by ``order``.

    With ``width``, for a whole-number ``order``: rows are counted by ranges of that width first, so that a key with a large
    share of all rows is ranked in as many tasks as it has ranges.
    """
    if width is None:
        return records.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    ranged = records.withColumn("__range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(*key, "__range").count()
    before = counts.withColumn("__before", F.sum("count").over(Window.partitionBy(*key).orderBy("__range")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy(*key, "__range").orderBy(order)) + F.col("__before")
    return beside(ranged, before, [*key, "__range"]).withColumn("__n", place).drop("__range", "__before")


def buffered(records: DataFrame, key: list[str], order: str, fields: list[str], size: int = BUFFER, block: int = 4096, width: int | None = None) -> DataFrame:
    """Each record with its last ``size`` records of the key as the array ``buffer``.

    A key's rows are cut into blocks of ``block`` rows, each with the ``size - 1`` rows before it, so a hot key fills many tasks.
    """
    placed = numbered(records, key, order, width).withColumn("__own", F.floor((F.col("__n") - 1) / block))
    last = F.floor((F.col("__n") + size - 2) / block)  # the last block whose first rows look back to this one
    spread = placed.withColumn("__block", F.explode(F.sequence("__own", last)))
    w = Window.partitionBy(*key, "__block").orderBy("__n").rowsBetween(-(size - 1), 0)
    framed = spread.withColumn("buffer", F.collect_list(F.struct(*fields)).over(w))
    return framed.where(F.col("__own") == F.col("__block")).drop("__n", "__own", "__block")


def add_features(framed: DataFrame, buffer: str = "buffer", overpull: str = "overpull") -> DataFrame:
    """Replaces a buffer of records (flow_in, flow_out, pit, spp, torque, rop, gas, dxc, on_bottom) by its ten features.

    In steps, so that each filtered or sorted array is made once and read by all features on it; projections only, so it
    serves batch and streaming frames alike.
    """
    kept = [c for c in framed.columns if c not in (buffer, overpull)]
    pick = lambda a, f: F.transform(a, lambda r: r[f])
    lift = lambda df, **new: df.select(*df.columns, *[x.alias(f"__{n}") for n, x in new.items()])
    c = lambda n: F.col(f"__{n}")
    df = lift(framed, pumped=F.filter(buffer, lambda r: r["flow_in"] > 500), gas=pick(F.col(buffer), "gas"), filled=F.size(buffer) >= 6)
    df = lift(df, drilled=F.filter(c("pumped"), lambda r: r["on_bottom"] > 0), spp=pick(c("pumped"), "spp"), p6=F.size(c("pumped")) >= 6)
    df = lift(df, torque=pick(c("drilled"), "torque"), rop=pick(c("drilled"), "rop"), dxc=F.array_compact(pick(c("drilled"), "dxc")), d12=F.size(c("drilled")) >= 12)
    df = lift(df, t12=tail(c("torque"), 12), tmean=mean(tail(c("torque"), 12)), gmean=mean(tail(c("gas"), 12)), mspp=median(c("spp")), mrop=median(c("rop")), mdxc=median(c("dxc")), mgas=median(c("gas")))
    gap = F.transform(tail(c("pumped"), 12), lambda r: (r["flow_out"] - r["flow_in"]) / r["flow_in"])
    made = {
        "dflow": F.when(c("p6"), mean(gap)).otherwise(0.0),
        "pit_slope": F.when(c("p6"), slope(pick(tail(c("pumped"), 30), "pit"), 1 / 6)).otherwise(0.0),
        "spp_dev": F.when(c("p6"), (mean(tail(c("spp"), 6)) - c("mspp")) / F.greatest(c("mspp"), F.lit(1.0))).otherwise(0.0),
        "tq_z": F.when(c("d12"), (c("tmean") - mean(c("torque"))) / F.greatest(deviation(c("torque")), F.lit(0.3))).otherwise(0.0),
        "tq_ssi": F.when(c("d12"), (F.array_max(c("t12")) - F.array_min(c("t12"))) / F.greatest(c("tmean"), F.lit(0.5))).otherwise(0.0),
        "rop_ratio": F.when(c("d12"), mean(tail(c("rop"), 12)) / F.greatest(c("mrop"), F.lit(0.5))).otherwise(1.0),
        "dxc_ratio": F.when(c("d12") & (F.size(c("dxc")) >= 12), mean(tail(c("dxc"), 12)) / F.greatest(c("mdxc"), F.lit(1e-3))).otherwise(1.0),
        "gas_level": F.when(c("filled"), c("gmean")).otherwise(0.0),
        "gas_ratio": F.when(c("filled"), c("gmean") / F.greatest(c("mgas"), F.lit(0.2))).otherwise(1.0),
        "overpull": F.coalesce(overpull, F.lit(0.0)),
    }
    return df.select(*kept, *[x.alias(n) for n, x in made.items()])


def run_overpull(records: DataFrame, key: list[str], order: str, off: Column, value: str, width: int | None = None, block: int = 4096) -> DataFrame:
    """Adds ``overpull``: when a run of off-bottom records ends, its greatest value over the median of up to four runs before.

    Known from the record after the run, held until the next run ends; needs two runs before. ``order`` is distinct in a key.
    Runs are counted by ranges of ``order`` of that ``width`` and the counts are added up, and the runs are compared by blocks
    of ``block`` runs, so a hot key fills many tasks; without a width each key's records are ordered in one task.
    """
    cut = F.floor(F.col(order) / width) if width is not None else F.lit(0)
    within = Window.partitionBy(*key, "__range").orderBy(order)
    seen = records.withColumn("__off", F.coalesce(off, F.lit(False))).withColumn("__range", cut)
    seen = seen.withColumn("__at", F.row_number().over(within)).withColumn("__begins", (F.col("__off") & ~F.coalesce(F.lag("__off").over(within), F.lit(False))).cast("long"))
    ranges = seen.groupBy(*key, "__range").agg(F.sum("__begins").alias("__begun"), F.bool_or(F.col("__off") & (F.col("__at") == 1)).alias("__head"), F.max_by("__off", "__at").alias("__tail"))
    across = Window.partitionBy(*key).orderBy("__range")
    goes_on = (F.col("__head") & F.coalesce(F.lag("__tail").over(across), F.lit(False))).cast("long")
    base = ranges.withColumn("__fresh", F.col("__begun") - goes_on).select(*key, "__range", (F.sum("__fresh").over(across) - F.col("__begun")).alias("__base"))
    runs = beside(seen, base, [*key, "__range"]).withColumn("__run", F.sum("__begins").over(within) + F.col("__base"))

    top = runs.where("__off").groupBy(*key, "__run").agg(F.max(value).alias("__top")).withColumn("__own", F.floor((F.col("__run") - 1) / block))
    spread = top.withColumn("__block", F.explode(F.sequence("__own", F.floor((F.col("__run") + 3) / block))))
    past = F.collect_list("__top").over(Window.partitionBy(*key, "__block").orderBy("__run").rowsBetween(-4, -1))
    compared = spread.withColumn("__past", past).where(F.col("__own") == F.col("__block"))
    jumps = compared.withColumn("__jump", F.when(F.size("__past") >= 2, F.greatest(F.lit(0.0), F.col("__top") - median(F.col("__past")))))
    ends = jumps.groupBy(*key, "__own").agg(F.max_by("__jump", F.when(F.col("__jump").isNotNull(), F.col("__run"))).alias("__left"))
    carried = ends.select(*key, "__own", F.last("__left", ignorenulls=True).over(Window.partitionBy(*key).orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    local = F.last("__jump", ignorenulls=True).over(Window.partitionBy(*key, "__own").orderBy("__run"))
    held = beside(jumps, carried, [*key, "__own"]).select(*key, F.col("__run").alias("__done"), F.coalesce(local, "__carried").alias("__held"))
    known = beside(runs.withColumn("__done", F.col("__run") - F.col("__off").cast("long")), held, [*key, "__done"])
    return known.select(*records.columns, F.coalesce("__held", F.lit(0.0)).alias("overpull"))


def rules_fired(rules: dict[str, list[tuple[str, bool]]] = RULES, pumping: Column | None = None) -> Column:
    """Map family -> number of its rules that hold; families without one are left out."""
    pumping = pumping if pumping is not None else F.lit(True)
    entries = []
    for family, conditions in rules.items():
        hits = sum(((F.expr(c) & (pumping if needs else F.lit(True))).cast("int") for c, needs in conditions), F.lit(0))
        entries.append(F.struct(F.lit(family).alias("k"), hits.alias("v")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"] > 0))


def backed(gates: dict[str, str] = GATES) -> Column:
    """The families whose features corroborate a model's score, for ``alerts.zone_rows``: a score alone raises no alert.

    A null feature backs nothing; families without a gate are backed always.
    """
    held = [F.when(F.coalesce(F.expr(gate), F.lit(False)), F.lit(family)) for family, gate in gates.items()]
    return F.array_compact(F.array(*held, *[F.lit(f) for f in UNGATED]))


def score_family(params: dict, names: list[str]) -> tuple[Column, Column]:
    """(probability, top three reasons) of a logistic model ``{coef, intercept, mean, std}`` over features."""
    parts = [F.lit(float(c)) * (F.col(n) - m) / s for n, c, m, s in zip(names, params["coef"], params["mean"], params["std"])]
    z = sum(parts, F.lit(float(params["intercept"])))
    p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    ranked = F.array_sort(F.array(*[F.struct((-x).alias("minus"), F.lit(n).alias("name")) for n, x in zip(names, parts)]))
    top = F.filter(F.slice(ranked, 1, 3), lambda r: -r["minus"] > 0.2)
    return p, F.transform(top, lambda r: r["name"])


def streaks(rows: DataFrame, key: list[str], order: str, flag: Column, name: str = "streak") -> DataFrame:
    """Adds how many rows in a row, up to this one, the flag has held."""
    w = Window.partitionBy(*key).orderBy(order)
    breaks = rows.withColumn("__flag", F.coalesce(flag, F.lit(False))).withColumn("__island", F.sum((~F.col("__flag")).cast("int")).over(w))
    inside = Window.partitionBy(*key, "__island").orderBy(order)
    return breaks.withColumn(name, F.sum(F.col("__flag").cast("int")).over(inside)).drop("__flag", "__island")


def episodes(rows: DataFrame, key: list[str], order: str, flag: Column, at: int = 2) -> DataFrame:
    """The rows at which a flag has held ``at`` times in a row: one for each alarm."""
    return streaks(rows, key, order, flag, "__streak").where(F.col("__streak") == at).drop("__streak")


def rate_over(rows: DataFrame, key: list[str], at: str, value: str, span_s: int, least_h: float = 0.05, instant: Column | None = None, spans: int = 16) -> DataFrame:
    """Adds ``rate``: change of ``value`` an hour since the oldest row within ``span_s`` seconds; ``instant`` on shorter spans.

    A key's time is cut into blocks of ``spans`` spans; a row within a span of the next block is seen there too, so a hot key
    fills many tasks. The oldest row is found in one pass over a block, however many rows a span has; of rows of one time the value
    is any one's. Rows without a time have ``instant``.
    """
    timed = rows.withColumn("__s", F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6))
    seconds, wide = F.col("__s"), span_s * spans
    blocks = F.coalesce(F.sequence("__own", F.floor((seconds + span_s) / wide)), F.array(F.lit(None).cast("long")))
    spread = timed.withColumn("__own", F.floor(seconds / wide)).withColumn("__block", F.explode(blocks))
    # Walked from the latest row down, each row's question for the first one at or after ``span_s`` before it is met by the last row passed: linear.
    marks = F.array(F.struct(seconds.alias("__at"), F.lit(False).alias("__asks")), F.struct((seconds - span_s).alias("__at"), F.lit(True).alias("__asks")))
    asked = spread.withColumn("__m", F.explode(marks)).where(~F.col("__m.__asks") | F.col("__own").eqNullSafe(F.col("__block")))
    down = Window.partitionBy(*key, "__block").orderBy(F.desc("__m.__at"), F.col("__m.__asks")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(~F.col("__m.__asks"), F.struct(seconds.alias("t"), F.col(value).alias("v"))), ignorenulls=True).over(down)
    old = asked.withColumn("__old", seen).where("__m.__asks").withColumns({"__t0": F.col("__old.t"), "__v0": F.col("__old.v")}).drop("__m", "__old")
    hours = (seconds - F.col("__t0")) / 3600
    rate = F.when(hours > least_h, (F.col(value) - F.col("__v0")) / F.greatest(hours, F.lit(1e-9)))
    return old.withColumn("rate", F.coalesce(rate, instant) if instant is not None else rate).drop("__s", "__t0", "__v0", "__own", "__block")


def label_windows(rows: DataFrame, segments: DataFrame, family: str) -> DataFrame:
    """Adds ``label``: whether a row lies in the precursor window of its segment's event."""
    s = segments.select("segment", "kind", "t_onset", "md_onset", "precursor_m")
    by_depth = (F.col("md") >= F.col("md_onset") - F.col("precursor_m")) & (F.col("t") <= F.col("t_onset") + 600)
    by_time = F.col("t").between(F.col("t_onset"), F.col("t_onset") + 1800)
    label = (F.col("kind") == family) & F.col("t_onset").isNotNull() & (by_depth if family == "SP" else by_time)
    return rows.join(s, "segment", "left").withColumn("label", F.coalesce(label, F.lit(False)).cast("int")).drop("kind", "t_onset", "md_onset", "precursor_m")
