"""What is computed in blocks equals what is computed over the whole key."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import Window
from pyspark.sql import functions as F

from boresight.operators import evaluate, features


def test_blocks_see_the_rows_before_them(spark):
    rows = spark.range(60).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, "cold").alias("k"), F.col("id").alias("at"))
    w = Window.partitionBy("k").orderBy("at").rowsBetween(-3, 0)
    wanted = {r["at"]: r["b"] for r in rows.withColumn("b", F.collect_list("at").over(w)).collect()}
    for width in (None, 7):
        made = features.buffered(rows, ["k"], "at", ["at"], size=4, block=5, width=width).collect()
        assert len(made) == len(wanted)
        assert {r["at"]: [x["at"] for x in r["buffer"]] for r in made} == wanted


def _overpulls(rows: list[tuple]) -> dict[int, float]:
    """By the definition: each run's jump over the up to four runs before, known from the record after the run."""
    out = {}
    for k in {r[0] for r in rows}:
        tops, inside, held = [], False, 0.0
        for _, at, off, value in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if inside and not off:
                past = [x for x in tops[-5:-1] if x is not None]
                if len(past) >= 2:
                    held = max(0.0, tops[-1] - statistics.median(past)) if tops[-1] is not None else 0.0
            if off:
                tops = tops if inside else [*tops, None]
                tops[-1] = max((x for x in (tops[-1], value) if x is not None), default=None)
            inside, out[at] = bool(off), held
    return out


def test_overpull_in_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", None]), at, rng.choice([True, False, False, None]), None if rng.random() < 0.3 else rng.uniform(80, 130)) for at in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, off boolean, load double")
    wanted = _overpulls(rows)
    for width, block in ((None, 4096), (7, 3), (1, 1), (40, 5)):
        made = {r["at"]: r["overpull"] for r in features.run_overpull(df, ["k"], "at", F.col("off"), "load", width, block).collect()}
        assert made.keys() == wanted.keys()
        assert all(abs(made[at] - x) < 1e-9 for at, x in wanted.items())


def test_rate_in_blocks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", None]), i, None if i % 17 == 0 else s, float(rng.randrange(100))) for i, s in enumerate(rng.sample(range(40_000), 250))]
    df = spark.createDataFrame(rows, "k string, id long, s long, v double").withColumn("at", F.timestamp_seconds("s"))
    wanted = {}
    for k, i, s, v in rows:
        s0, v0 = min((x, y) for q, _, x, y in rows if q == k and x is not None and s - 600 <= x <= s) if s is not None else (None, None)
        wanted[i] = (v - v0) / ((s - s0) / 3600) if s is not None and s - s0 > 180 else -1.0
    for spans in (1, 3, 1000):
        made = {r["id"]: r["rate"] for r in features.rate_over(df, ["k"], "at", "v", 600, instant=F.lit(-1.0), spans=spans).collect()}
        assert made.keys() == wanted.keys()
        assert all(abs(made[i] - x) < 1e-9 for i, x in wanted.items())


def test_greedy_match_is_the_serial_choice(spark):
    rng = random.Random(7)
    truth = [("hot", i, rng.randrange(300) / 4) for i in range(80)]
    found = [("hot", i, rng.randrange(300) / 4) for i in range(90)]
    used, wanted = set(), {}
    for _, n, x in truth:
        near = [(abs(y - x), i) for _, i, y in found if i not in used and abs(y - x) <= 1.0]
        if near:
            d, i = min(near)
            used.add(i)
            wanted[n] = (i, d)
    made = evaluate.greedy_match(spark.createDataFrame(truth, "k string, ord long, at double"), spark.createDataFrame(found, "k string, id long, at double"), ["k"], 1.0)
    assert {r["ord"]: (r["id"], r["distance"]) for r in made.collect()} == wanted
    assert len(wanted) > 40
