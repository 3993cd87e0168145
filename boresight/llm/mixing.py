"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a share of all words by its weight, held at ``most`` times the source's size (water filling). Each
document starts with the fractional copy count ``target / source_size``. Its whole part is certain. The fractions are
rounded in pairs: mass moves from one document to the other, in words, until one of the two is whole, so a source's words
stay at its target throughout and only the last, single residual is rounded alone, to the nearer whole number: a source
ends within half of that one document of its target. Long documents go first: the residual
of a pair is the longer one, and the shorter ones that follow make it whole, so what is left at the end is short. Each source
has a reduction tree of its own, with as many hashed leaves as its documents need and fan-in ``FAN_IN``: a leaf leaves at most
one residual, which climbs a level a stage. So a hot source is spread over all tasks, a million small ones end at their
leaves, and no task holds more than one residual in memory. Draws are hashes of the two ids: reruns agree, whatever the
partitioning.

Cases: null text counts 0 words; a null source is a source of its own, last in order; null ids take part; empty documents
get 0; rows that repeat a doc_id are rounded one by one; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boresight.llm.common import WORD, cut, parts_for

FAN_IN = 64
LEAF_ROWS = 5_000
STATE = "doc_id long, source string, size long, source_size long, target double, nodes long, node long, part double, copies long, settled boolean"


def draw(seed: int, *ids: object) -> float:
    """A uniform number in [0, 1) fixed by the seed and the ids."""
    return xxhash.xxh64_intdigest(repr(ids).encode(), seed) / 2.0**64


def pivot(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """Move mass between fractions p and q of documents of a and b words; a*p + b*q stays, one of the two becomes 0 or 1."""
    up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
    if u * (up + down) < down:
        return (1.0, q - (1 - p) * a / b) if 1 - p <= q * b / a else (p + q * b / a, 0.0)
    return (0.0, q + p * a / b) if p <= (1 - q) * b / a else (p - (1 - q) * b / a, 1.0)


def _settle(seed: int):
    """Rows sorted by source and node: pairs them one after the other; leaves at most one unsettled row a node, none at a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None

        def done(row: dict, whole: float) -> dict:
            return row | {"part": 0.0, "copies": row["copies"] + int(whole), "settled": True}

        def left(row: dict) -> dict:
            return done(row, round(row["part"])) if row["nodes"] == 1 else row

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (at := (row["source"], row["node"])) != key:
                    if held is not None:
                        out.append(left(held))
                    held, key = None, at
                if not 1e-9 < row["part"] < 1 - 1e-9:
                    out.append(done(row, round(row["part"])))
                elif held is None:
                    held = row
                else:
                    p, q = pivot(held["part"], held["size"], row["part"], row["size"], draw(seed, held["doc_id"], row["doc_id"]))
                    rest = None
                    for r, x in ((held, p), (row, q)):
                        if 1e-9 < x < 1 - 1e-9:
                            rest = r | {"part": x}
                        else:
                            out.append(done(r, round(x)))
                    held = rest
            schema = batch.schema
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([left(held)], schema=schema)

    return run


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, source_rows, target`` from ``source, size``: weights repeat over the sources in code-point order, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ordered = cut(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    first, counts = 0, {}
    for part, n in sorted(map(tuple, ordered.groupBy(F.shiftright("at", 33).alias("p")).count().collect())):  # a row a partition
        counts[part], first = first, first + n
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    if counts:
        place = place + F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.shiftright("at", 33)]
    weighed = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    full, held = F.col("source_size") * most, -1
    level, total = None, 0.0
    while True:
        over = F.lit(False) if level is None else full <= F.lit(level) * F.col("weight")
        n, words, capped, open_weight = weighed.agg(F.count_if(over), F.sum("source_size"), F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("weight")))).first()
        total = (words or 0) * share
        if n == held or not open_weight:
            break
        held, level = n, (total - (capped or 0.0)) / open_weight
    target = F.least(full, F.lit(level or 0.0) * F.col("weight"))
    return weighed.select("source", "source_size", "source_rows", target.cast("double").alias("target"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every document."""
    sized = cut(docs.select(F.col("doc_id").cast("long"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    targets = source_targets(sized, weights, share, most).withColumnRenamed("source", "of")
    most_nodes, rows = (x or 1 for x in targets.agg(F.max(F.ceil(F.col("source_rows") / leaf_rows)), F.sum("source_rows")).first())
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = sized.join(targets, sized["source"].eqNullSafe(targets["of"])).withColumn("nodes", F.ceil(F.col("source_rows") / leaf_rows)).select(
        "doc_id", "source", "size", "source_size", "target", "nodes", F.pmod(F.xxhash64("doc_id", "size"), F.col("nodes")).alias("node"),
        F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0).alias("part"), F.floor(ratio).cast("long").alias("copies"), F.lit(False).alias("settled"),
    )
    settled = []
    while True:
        spread = state.repartition(min(parts_for(rows, leaf_rows), 4096), "source", "node").sortWithinPartitions("source", "node", F.desc("size"), "doc_id")
        level = cut(spread.mapInArrow(_settle(seed), STATE))
        settled.append(level.where("settled"))
        if most_nodes == 1:
            break
        most_nodes, rows = parts_for(most_nodes, FAN_IN), parts_for(rows, leaf_rows / FAN_IN)
        state = level.where("not settled").withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).withColumn("nodes", F.ceil(F.col("nodes") / FAN_IN).cast("long"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
