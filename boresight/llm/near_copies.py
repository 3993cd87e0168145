"""Near copies by the Jaccard similarity of word shingles, complete: no pair at or over the wanted similarity is missed.

The search begins with op4's fingerprints: texts of one fingerprint and those that its covering tables link are compared, and the
similar ones are connected. A SimHash distance does not bound a Jaccard similarity, so a complete search for what the fingerprints
leave apart follows. Put the shingles of every text into one order that is the same for all texts: two sets of similarity t or more
then share one of the first n - ceil(t n) + 1 shingles of each (prefix filter). The order puts shingles that a sample of the documents shows to
be common last, so that common lines rarely key anything; a poor sample costs time and no pair. Only the chosen shingles are
shuffled, packed; of keys that the same texts share one is kept.

A large group of near copies must not cost all its pairs. So rounds come next: each key names a lead, the texts of the key
that are not connected to it are compared with it, and what is similar is connected; other leads in the next round. When a
round connects little, all pairs of a key that are still unconnected follow, which makes the result complete. A key gives a
pair only if sizes, and what stands behind the key in both orders, leave room for the similarity: the first shingle that a
similar pair shares always does. A pair is first bounded by parity bitmaps: each shingle flips one bit of its text's bitmap, so two bitmaps
differ in no more bits than the sets do in shingles, and a pair whose bitmaps differ more than the similarity allows is out.
The rest is verified by the exact similarity of the two sets. Shingles and texts are told apart by 64-bit hashes.

Cases: texts without words (nulls too) are copies of each other; texts of fewer words than a shingle are one shingle; A-Z are
lower-cased and blanks do not count; rows that repeat join their group; null ids take part, last in order; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boresight.llm import simhash
from boresight.llm.common import WORD, cut, few, parts_for, text_bytes
from boresight.llm.components import components
from boresight.llm.hashing import in_turn, windows, words_of, xxh64

#: Bytes of text whose keys a bucket is meant to hold, rows of a key that one bucket takes, and rounds of leads.
BUCKET_BYTES, KEY_ROWS, ROUNDS = 16 << 20, 1_000_000, 8
#: Pairs whose nodes are sent to all executors, so that only the texts of these nodes are shuffled.
FEW_PAIRS = 200_000
_PACKED = np.dtype([("key", "<i8"), ("node", "<i8"), ("n", "<i4"), ("before", "<u2")])  # before: shingles that come first, at most what fits
_MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = ("w0", "w1", "w2", "w3")


def shingle_sets(texts: list[bytes], words: int = 5, seed: int = 42) -> list[np.ndarray]:
    """The sorted different hashes of the word shingles of each UTF-8 text; a shingle's hash is mixed from the XXH64 of its words, in order."""
    found = []
    for some in in_turn(texts):
        body, starts, sizes, many = words_of(some)
        first, last, each = windows(many, words)
        hashes = np.append(xxh64(body, starts, sizes, seed), np.uint64(0))  # the last one stands for words that a short text lacks
        mixed = hashes[first]
        for k in range(1, words):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + hashes[np.where(first + k <= last, first + k, -1)]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
        for part in np.split(mixed, np.cumsum(each)[:-1]):
            part.sort()
            new = np.r_[True, part[1:] != part[:-1]] if len(part) else np.empty(0, bool)
            found.append(part if new.all() else part[new])
    return found


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in batch.column("text")]


def prefix(sorted_set: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a text shares one with each text of that similarity; ``common`` is sorted, ``counts`` go with it."""
    n = len(sorted_set)
    size = n - math.ceil(similarity * n - 1e-9) + 1
    if not len(common):
        return sorted_set[:size]
    at = np.minimum(np.searchsorted(common, sorted_set), len(common) - 1)
    rare = np.flatnonzero(common[at] != sorted_set)
    if len(rare) >= size:
        return sorted_set[rare[:size]]
    often = np.where(common[at] == sorted_set, counts[at], 0)
    return sorted_set[np.argsort(often, kind="stable")[:size]]


def bitmap(sorted_set: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of at least twice as many bits, a power of two from 512."""
    bits = max(512, 1 << (2 * max(len(sorted_set), 1) - 1).bit_length())
    place = ((sorted_set.view(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(bool), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap folded to ``size`` bytes; its parities stay parities."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the shingles in which two sets differ."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def _map(fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(fn(batch), schema=schema)

    return run


def _sampled(words: int, seed: int):
    def keys(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.concatenate([np.empty(0, np.int64), *shingle_sets(_texts(batch), words, seed)]))]

    return _map(keys, pa.schema([("key", pa.int64())]))


def _packed(words: int, seed: int, similarity: float, common: np.ndarray, counts: np.ndarray, parts: np.ndarray, buckets: int):
    """The prefixes of a batch of texts, packed by bucket; a key that the sample shows to be very common goes to several."""
    schema = pa.schema([("bucket", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch), words, seed)
            chosen = [prefix(s, similarity, common, counts) for s in sets]
            many = [len(c) for c in chosen]
            rows = np.empty(sum(many), _PACKED)
            if not len(rows):
                continue
            rows["key"], rows["node"] = np.concatenate(chosen), np.repeat(batch.column("node").to_numpy(), many)
            rows["n"] = np.repeat([len(s) for s in sets], many)
            rows["before"] = np.minimum(np.arange(len(rows)) - np.repeat(np.cumsum([0, *many[:-1]]), many), 65535)
            slot = (rows["key"].view("u8") * _MIX) >> np.uint64(32)
            if len(common):
                at = np.minimum(np.searchsorted(common, rows["key"]), len(common) - 1)
                hot = np.flatnonzero((common[at] == rows["key"]) & (parts[at] > 1))
                slot[hot] += (rows["node"][hot].view("u8") >> np.uint64(7)) % parts[at[hot]].astype("u8")
            bucket = (slot % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            turns = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            bodies = [rows[order[s:e]].tobytes() for s, e in zip(turns[:-1], turns[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[turns[:-1]]]), pa.array(bodies, pa.binary())], schema=schema)

    return run


def fits(similarity: float, m, n, i, j, least=np.minimum):
    """Whether sets of m and n shingles can be similar if the first one that they share has i and j before it; numbers or columns."""
    need = similarity / (1 + similarity) * (m + n) - 1e-6
    return (n >= similarity * m - 1e-6) & (m >= similarity * n - 1e-6) & (least(m - i, n - j) >= need)


def _shared(similarity: float, split: np.ndarray):
    """Rows sorted by bucket: the texts of each key that several have, under the mark of that set of texts.

    The keys ``split`` over several buckets keep all rows and have their own mark.
    """
    schema = pa.schema([("mark", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("before", pa.int32())])

    def groups(bodies: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(bodies), _PACKED)
        rows = rows[np.lexsort((rows["node"], rows["key"]))]
        rows = rows[np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])]]
        starts = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
        sizes = np.diff(np.r_[starts, len(rows)])
        apart = np.isin(rows["key"][starts], split)
        good = (sizes > 1) | apart
        two = np.flatnonzero((sizes == 2) & ~apart)
        n, before = rows["n"].astype(np.int64), rows["before"].astype(np.int64)
        good[two] = fits(similarity, n[starts[two]], n[starts[two] + 1], before[starts[two]], before[starts[two] + 1])
        with np.errstate(over="ignore"):
            mixed = (rows["node"].view("u8") ^ (rows["node"].view("u8") >> np.uint64(31))) * _MIX
            mixed ^= mixed >> np.uint64(29)
            marks = np.add.reduceat(mixed * _MIX, starts).view("<i8")
        marks = np.where(apart, rows["key"][starts], marks)
        first = np.lexsort((before[starts], marks))  # of the keys of one set of texts the one that comes first in the order
        good[first[np.r_[False, marks[first][1:] == marks[first][:-1]]]] = False
        kept = np.repeat(good, sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(marks, sizes)[kept]), pa.array(rows["node"][kept]), pa.array(rows["n"][kept]), pa.array(before[kept].astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist()))
        for _, mine in groupby(rows, key=lambda r: r[0]):
            yield groups([body for _, body in mine])

    return run


def _sketched(words: int, seed: int):
    """``node, n``, the bitmap, its fold to four longs, and the compressed text of each text."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("packed", pa.binary()), *((w, pa.int64()) for w in FOLD)])

    def sketch(batch: pa.RecordBatch) -> list[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        texts = _texts(batch)
        sets = shingle_sets(texts, words, seed)
        bits = [bitmap(s) for s in sets]
        longs = np.stack([folded(b, 32) for b in bits]).view("<i8")
        return [batch.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([squeeze(t) for t in texts], pa.binary()), *map(pa.array, np.ascontiguousarray(longs.T))]

    return _map(sketch, schema)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bounded(similarity: float):
    """Pairs that their bitmaps don't rule out."""

    def good(batch: pa.RecordBatch) -> list[pa.Array]:
        total = batch.column("m").to_numpy() + batch.column("n").to_numpy()
        room = total - 2 * np.ceil(similarity / (1 + similarity) * total - 1e-9)
        bits = lambda c: (np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c))
        kept = batch.filter(pa.array([least_difference(x, y) <= r for x, y, r in zip(bits("x"), bits("y"), room)], pa.bool_()))
        return [kept.column("a"), kept.column("b")]

    return _map(good, PAIR)


def _similar(words: int, seed: int, similarity: float):
    """Pairs whose sets are similar."""

    def good(batch: pa.RecordBatch) -> list[pa.Array]:
        held: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress

        def of(node: int, packed: pa.Scalar) -> np.ndarray:
            if node not in held:
                if len(held) >= 64:
                    held.clear()
                held[node] = shingle_sets([unpack(packed.as_py())], words, seed)[0]
            return held[node]

        found = []
        for a, b, s, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("s"), batch.column("t")):
            x, y = of(a, s), of(b, t)
            both = np.intersect1d(x, y, assume_unique=True).size
            found.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        kept = batch.filter(pa.array(found, pa.bool_()))
        return [kept.column("a"), kept.column("b")]

    return _map(good, PAIR)


def _joined(pairs: DataFrame, mine: DataFrame, of_a: list[Column], of_b: list[Column]) -> DataFrame:
    """What ``mine`` has of both nodes of the stored ``pairs``."""
    n = pairs.count()
    pairs = few(pairs, n, 20_000)
    if n <= FEW_PAIRS:
        named = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
        mine = mine.join(F.broadcast(named), mine["node"] == named["of"], "left_semi")
    half = few(pairs.join(mine.select(F.col("node").alias("a"), *of_a), "a"), n, 2_000)
    return few(half.join(mine.select(F.col("node").alias("b"), *of_b), "b"), n, 2_000)


def fingerprint_pairs(texts: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``a < b`` of the nodes of ``texts(node, text)`` by their fingerprints: each with the first of its own, and the firsts of those linked within the radius."""
    marked = cut(simhash.fingerprints(texts.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "fp"))
    firsts = cut(marked.groupBy("fp").agg(F.min("node").alias("first")))
    rows, many = marked.count(), firsts.count()
    own = few(marked.join(firsts, "fp"), rows).select(F.col("first").alias("a"), F.col("node").alias("b"))
    named = lambda side: firsts.select(F.col("fp").alias(side), F.col("first").alias(f"__{side}"))
    linked = few(few(simhash.near_links(firsts.select("fp"), radius), many, 10_000).distinct(), many)
    linked = few(few(linked.join(named("a"), "a"), many).join(named("b"), "b"), many)
    pairs = own.unionByName(linked.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")))
    return cut(few(few(pairs.where("a <> b"), rows + many).distinct(), rows + many))


def similar_links(texts: DataFrame, words: int = 5, seed: int = 42, similarity: float = 0.8, share: int = 16, most: int = 1_000_000, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links ``a, b`` that connect the nodes of ``texts(node, text)`` wherever a chain of similar pairs does.

    One document in ``share`` is sampled to find the common shingles, of which the order knows the ``most`` commonest.
    """
    guessed = fingerprint_pairs(texts)
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).mapInArrow(_sampled(words, seed), "key long")
    often = sample.groupBy("key").agg(F.count("*").alias("many")).where("many > 2").orderBy(F.desc("many"), "key").limit(most).toArrow()
    common, counts = (often.column(c).to_numpy() for c in ("key", "many"))
    order = np.argsort(common)
    common, counts = common[order], counts[order]
    parts = -(-counts * share // key_rows)
    buckets = parts_for(text_bytes(texts), BUCKET_BYTES)
    packed = texts.mapInArrow(_packed(words, seed, similarity, common, counts, parts, buckets), "bucket long, body binary")
    shared = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(similarity, common[parts > 1]), "mark long, node long, n int, before int")
    met = cut(shared.groupBy("mark", "node", "n").agg(F.min("before").alias("before")))
    wanted = met.select(F.col("node").alias("of")).distinct()
    sketched = texts.mapInArrow(_sketched(words, seed), f"node long, n int, bits binary, packed binary, {', '.join(f'{w} long' for w in FOLD)}")
    mine = cut(sketched.join(wanted.hint("merge"), sketched["node"] == wanted["of"], "left_semi").dropDuplicates(["node"]))
    many = met.count()
    can = lambda: fits(F.lit(similarity), F.col("m"), F.col("n"), F.col("i"), F.col("before"), F.least)

    def verified(pairs: DataFrame) -> DataFrame:  # stored and different pairs
        named = _joined(pairs, mine, [F.col("bits").alias("x"), F.col("n").alias("m")], [F.col("bits").alias("y"), F.col("n")])
        close = cut(named.select("a", "b", "m", "n", "x", "y").mapInArrow(_bounded(similarity), "a long, b long"))
        named = _joined(close, mine, [F.col("packed").alias("s")], [F.col("packed").alias("t")])
        return cut(named.select("a", "b", "s", "t").mapInArrow(_similar(words, seed, similarity), "a long, b long"))

    def connected(links: DataFrame) -> DataFrame:
        roots = components(links, rows=links.count()).withColumnRenamed("node", "of")
        return cut(few(met.join(roots, met["node"] == roots["of"], "left").select("mark", "node", "n", "before", F.coalesce("root", "node").alias("root")), many))

    links = verified(guessed)
    placed, new, most_new, turn = connected(links), 1, 0, 0
    while True:
        lead = F.min_by(F.struct("node", "n", "before", "root"), F.xxhash64("node", F.lit(turn)))
        open_ = placed.groupBy("mark").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many"), lead.alias("lead")).where("low < high")
        open_ = cut(few(open_.select("mark", "many", F.col("lead.node").alias("a"), F.col("lead.n").alias("m"), F.col("lead.before").alias("i"), F.col("lead.root").alias("top")), many))
        if turn == ROUNDS or 10 * new < most_new or open_.isEmpty():
            break
        led = placed.join(open_, "mark").where((F.col("root") != F.col("top")) & can())
        fresh = verified(cut(few(led.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), many)))
        new = fresh.count()
        most_new = max(most_new, new, 1)
        links = links.unionByName(fresh)
        if new:
            placed = connected(links)
        turn += 1
    left = placed.join(open_.select("mark"), "mark").join(mine.select("node", *FOLD), "node")
    other = left.select("mark", F.col("node").alias("b"), F.col("n").alias("m"), F.col("before").alias("i"), F.col("root").alias("top"), *[F.col(w).alias(f"{w}_") for w in FOLD])
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_"))) for w in FOLD), F.lit(0))
    room = (F.col("m") + F.col("n")) * (1 - 2 * similarity / (1 + similarity)) + 1e-6
    every = left.join(other, "mark").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("top")) & can() & (apart <= room))
    last = verified(cut(every.select(F.col("node").alias("a"), "b").distinct()))
    return links.unionByName(last)


def near_copies(docs: DataFrame, words: int = 5, seed: int = 42, similarity: float = 0.8, **how: int) -> DataFrame:
    """``doc_id, component_id`` for every document; component_id is the smallest doc_id of its group of near copies.

    ``how`` goes to ``similar_links``.
    """
    text = F.col("text").cast("binary")
    node = F.when(F.col("text").cast("string").rlike(WORD), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    named = docs.select(F.col("doc_id").cast("long"), text.alias("text"), node.alias("node"))
    links = similar_links(named.where("node <> 0").select("node", "text"), words, seed, similarity, **how)
    roots = components(links, rows=links.count()).withColumnRenamed("node", "of")
    marked = named.select("doc_id", "node")
    rooted = cut(marked.join(roots, marked["node"] == roots["of"], "left").select("doc_id", F.coalesce("root", "node").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(heads, "root").select("doc_id", "component_id")
