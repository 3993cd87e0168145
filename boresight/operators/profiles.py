"""Entities with alike profiles: a set-similarity join with a prefix filter, or by bits where there are few items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from boresight.sources.tables import settled


def profiles(items: DataFrame, entity: str, item: str) -> DataFrame:
    """``profile, entity``: each entity with its class, named by the least entity of the same set of items.

    Null items and entities don't count; repeated rows count once. Entities without an item have no row.
    """
    sets = items.where(F.col(entity).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.array_sort(F.collect_set(item)).alias("__set"))
    classes = sets.groupBy("__set").agg(F.min("entity").alias("profile"))
    return sets.join(classes, "__set").select("profile", "entity", F.col("__set").alias("items"))


def alike(members: DataFrame, least: float, blocks: int = 4) -> DataFrame:
    """``left, right, common, jaccard`` of all pairs of different profiles with a Jaccard similarity of at least ``least``; ``members`` by ``profiles``.

    Equal profiles are one class, so copies make no pairs; which entities a class has is said by ``members``. Sets of sizes
    a <= b can reach the similarity only when a >= least * b, and then they share one of the first size - ceil(least * size) + 1
    items of each, in any one order; the order is from the rarest item on, so that the join meets on few. Nothing is
    dropped: the filter is complete, and pairs are verified by their sets where they meet.
    """
    sets = members.where(F.col("entity") == F.col("profile")).select("profile", "items")
    each = sets.select("profile", F.explode("items").alias("item"))
    counts = settled(each.groupBy("item").agg(F.count("*").alias("__count")).withColumn("__id", F.monotonically_increasing_id()))
    bit = F.pmod(F.xxhash64("__id"), F.lit(256))
    parity = [F.bit_xor(F.when(F.floor(bit / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(4)]
    ranked = each.join(counts, "item").groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("__count", "__id"))).alias("__ranked"), *parity)  # a profile is small
    ranked = ranked.select("profile", F.transform("__ranked", lambda x: x["__id"]).alias("set"), *(f"w{k}" for k in range(4))).withColumn("n", F.size("set"))
    # A little is taken off, so that a product just above a whole number by rounding drops no pair; pairs are verified after.
    prefix = F.slice("set", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int"))
    first = settled(ranked.withColumn("prefix", prefix)).select("*", F.posexplode("prefix").alias("at", "item"))
    # The profiles of an item are dealt into blocks, each of which meets all others of the item, so a hot item fills many tasks.
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("profile", "set", "n", "prefix", "at", "w0", "w1", "w2", "w3")]
    a = first.select("item", F.pmod(F.hash("profile"), F.lit(blocks)).alias("block"), *spread("a")).repartition(parts, "item", "block")
    b = first.select("item", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *spread("b")).repartition(parts, "item", "block")
    low, high = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    room = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))  # this item and those behind it
    need = F.lit(least / (1 + least)) * (F.col("a_n") + F.col("b_n")) - 1e-9
    # Sets differ in no fewer items than the parities of their items' bits do, which rules most pairs out before sets are compared.
    apart = sum((F.bit_count(F.col(f"a_w{k}").bitwiseXOR(F.col(f"b_w{k}"))) for k in range(4)), F.lit(0))
    close = apart <= F.lit(1 - 2 * least / (1 + least)) * (F.col("a_n") + F.col("b_n")) + 1e-9
    met = a.join(b, ["item", "block"]).where((F.col("a_profile") < F.col("b_profile")) & (low >= F.lit(least) * high - 1e-9) & (room >= need) & close)
    # A pair is taken at the first item that both prefixes hold, so once, and no pair is shuffled.
    met = met.where(F.get(F.array_intersect("a_prefix", "b_prefix"), F.lit(0)) == F.col("item")).withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    found = met.withColumn("jaccard", F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common")))
    return found.where(F.col("jaccard") >= least).select(F.col("a_profile").alias("left"), F.col("b_profile").alias("right"), "common", "jaccard")


def alike_with(members: DataFrame, least: float, carried: list[str], most: int = 1024, block: int = 2048) -> DataFrame:
    """``alike`` with the ``carried`` columns of both profiles, as they are where entity and profile are one, under their names with ``_left`` and ``_right``.

    Where there are ``most`` items at most, a profile is a row of bits. Profiles are dealt by hash into blocks of about ``block``, and a
    task compares all rows of one block with those of another by counting bits: over few items a prefix rules little out. Profiles are
    shuffled once for each block, pairs not at all, and each pair is compared once. More items go by the prefix filter.
    """
    sets = settled(members.where(F.col("entity") == F.col("profile")).select("profile", "items", *carried))
    each = sets.select("profile", F.explode("items").alias("item"))
    items = [r[0] for r in each.select("item").distinct().limit(most + 1).collect()]
    if len(items) > most:
        found = alike(members, least)
        for side in ("left", "right"):
            found = found.join(sets.select(F.col("profile").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in carried]), side)
        return found.select("left", "right", "common", "jaccard", *[f"{c}_{side}" for side in ("left", "right") for c in carried])
    place = {x: i for i, x in enumerate(sorted(items))}
    words, kind = -(-max(len(items), 1) // 64), sets.schema["profile"].dataType

    def bits(batches):
        for batch in batches:
            lists = batch.column("items")
            drawn = np.zeros((len(batch), words * 64), bool)
            drawn[np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy()), [place[x] for x in lists.flatten().to_pylist()]] = True
            body = np.packbits(drawn, axis=1, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("profile"), pa.array([body[i : i + words * 8] for i in range(0, len(body), words * 8)], pa.binary()), *[batch.column(c) for c in carried]], names=["profile", "bits", *carried])

    kept = [StructField(c, sets.schema[c].dataType) for c in carried]
    schema = StructType([StructField("profile", kind), sets.select(F.lit(b"").alias("bits")).schema["bits"], *kept])
    drawn = settled(sets.mapInArrow(bits, schema))
    blocks, parts = max(1, -(-drawn.count() // block)), int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, every = F.pmod(F.hash("profile"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    again = drawn.select(*[F.col(c).alias(c) for c in drawn.columns])  # its own columns: the two sides must not share any
    dealt = drawn.withColumn("__a", own).withColumn("__b", every), again.withColumn("__a", every).withColumn("__b", own)
    dealt = [x.select("__a", "__b", *drawn.columns).repartition(parts, "__a", "__b") for x in dealt]
    out = StructType([StructField("left", kind), StructField("right", kind), StructField("common", IntegerType()), StructField("jaccard", DoubleType()), *[StructField(f"{f.name}_{side}", f.dataType) for side in ("left", "right") for f in kept]])

    nothing = members.sparkSession.createDataFrame([], out).toArrow()

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):  # a block without rows
            return nothing
        right = right.sort_by("profile")
        (mine, x), (other, y) = ((t.column("profile").to_numpy(), np.frombuffer(b"".join(t.column("bits").to_pylist()), "<u8").reshape(-1, words)) for t in (left, right))
        m, n = (np.bitwise_count(v).sum(axis=1, dtype=np.int32) for v in (x, y))
        y = np.ascontiguousarray(y.T)
        of, to, shared, near = [], [], [], []
        for i, first in enumerate(np.searchsorted(other, mine, "right").tolist()):
            common = np.zeros(len(other) - first, np.int32)
            for k in range(words):
                common += np.bitwise_count(y[k, first:] & x[i, k])
            jaccard = common / (m[i] + n[first:] - common)
            good = np.flatnonzero(jaccard >= least)
            of.append(np.full(len(good), i))
            to.append(good + first)
            shared.append(common[good])
            near.append(jaccard[good])
        of, to, shared, near = (np.concatenate([np.empty(0, t), *v]) for t, v in ((np.int64, of), (np.int64, to), (np.int32, shared), (float, near)))
        left, right = left.take(pa.array(of)), right.take(pa.array(to))
        return pa.table({"left": left.column("profile"), "right": right.column("profile"), "common": shared, "jaccard": near} | {f"{c}_{side}": t.column(c) for side, t in (("left", left), ("right", right)) for c in carried})

    return dealt[0].groupBy("__a", "__b").cogroup(dealt[1].groupBy("__a", "__b")).applyInArrow(met, out)
