"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. For a radius r, every bit position i gets a
non-zero vector f(i) of r + 1 bits; the mask of a non-zero vector v keeps the positions with an odd inner product <f(i), v>.
Any r positions leave some v orthogonal to all of them, so two fingerprints that differ in at most r bits agree under the
mask of that v: the 2^(r+1) - 1 tables miss no pair, by structure rather than by chance.

Only different fingerprints enter the tables, so copies cost one row. A bucket of more than ``hot`` fingerprints is covered
again over the bits that its mask leaves free: the second tables are as complete, and with both masks held few bits are
free, which bounds a bucket by a power of two whatever the data. Within a bucket a frontier search takes from the unvisited
fingerprints all that lie within the radius, and emits one link a fingerprint, never all pairs. Links are closed by
``components`` on the executors.

Cases: null and empty texts have fingerprint zero and are linked like any other; texts of fewer words than a shingle are one
shingle; rows that repeat join their group; null ids take part, last in order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boresight.llm.common import cut, map_batches
from boresight.llm.components import components
from boresight.llm.hashing import in_turn, windows, words_of, xxh64

BITS = 64


def majority(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each text, of which ``many`` hashes follow each other, the bits that over half of them have, as signed longs.

    A byte of a long counts one bit of at most 255 hashes, eight bits in a pass.
    """
    runs = -(-many // 255)
    begin = np.repeat(np.cumsum(many) - many, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    counts, some = np.zeros((len(many), BITS), np.int64), many > 0
    for k in range(8 if len(hashes) else 0):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), begin)
        counts[some, 7 - k :: 8] = np.add.reduceat(lanes.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64), (np.cumsum(runs) - runs)[some], axis=0)
    return np.packbits(2 * counts > many[:, None], axis=1).view(">i8")[:, 0].astype(np.int64)


def fingerprints_of(texts: list[bytes], words: int = 3, seed: int = 42) -> np.ndarray:
    """Majorities of the XXH64 of the word shingles of UTF-8 texts, A-Z lower-cased, as signed 64-bit numbers."""
    found = [np.empty(0, np.int64)]
    for some in in_turn(texts):
        body, starts, sizes, many = words_of(some)
        first, last, each = windows(many, words)
        found.append(majority(xxh64(body, starts[first], starts[last] + sizes[last] - starts[first], seed), each))
    return np.concatenate(found)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprints_of([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")], words, seed)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks over these bit positions that cover every pair within the radius."""
    top = 1 << (radius + 1)
    return [sum(1 << p for i, p in enumerate(positions) if ((1 + i % (top - 1)) & v).bit_count() % 2) for v in range(1, top)]


def stars(values: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (member, centre) that join what is connected within the radius among different sorted values of one bucket."""
    members, centres = [], []
    todo = values
    while todo.size > 1:
        root, todo = todo[0], todo[1:]
        frontier = [root]
        while frontier and todo.size:
            near = np.bitwise_count(todo ^ frontier.pop()) <= radius
            if near.any():
                hit, todo = todo[near], todo[~near]
                members.append(hit)
                centres.append(np.full(hit.size, root))
                frontier.extend(hit)
    return members, centres


def _bucket_links(radius: int):
    """Rows sorted by bucket: links within each bucket."""
    names = ("t", "key", "t2", "key2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(rows)])
            fps = rows[:, 4].astype(np.uint64, copy=False) if rows.dtype == np.uint64 else np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            members, centres = [fps[two + 1]], [fps[two]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                m, c = stars(np.unique(fps[s : s + n]), radius)
                members += m
                centres += c
            a, b = np.concatenate(members).view(np.int64), np.concatenate(centres).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*names, "fp")], axis=1)])
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            split = last[-1] + 1 if len(last) else 0
            held = rows[split:]
            if (out := links(rows[:split])) is not None:
                yield out
        if (out := links(held)) is not None:
            yield out

    return run


def near_links(fps: DataFrame, radius: int = 3, hot: int = 2048) -> DataFrame:
    """Links ``a, b`` that connect the different fingerprints ``fp`` wherever a chain of steps within the radius does."""
    first = covering_masks(list(range(BITS)), radius)
    second = [covering_masks([p for p in range(BITS) if not m >> p & 1], radius) for m in first]
    longs = lambda ms: F.array(*[F.lit(signed(m)) for m in ms])
    keyed = fps.select("fp", F.posexplode(longs(first)).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, ["t", "key"])
    plain = met.where(F.col("n") <= hot).select("t", "key", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2"), "fp")
    again = met.where(F.col("n") > hot).select("t", "key", "fp", F.posexplode(F.element_at(F.array(*map(longs, second)), F.col("t") + 1)).alias("t2", "mask"))
    again = again.select("t", "key", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("key2"), "fp")
    rows = plain.unionByName(again).repartition("t", "key", "t2", "key2").sortWithinPartitions("t", "key", "t2", "key2")
    return rows.mapInArrow(_bucket_links(radius), "a long, b long")


def near_groups(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document; component_id is the smallest doc_id of its group."""
    marked = cut(fingerprints(docs, words, seed))
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(firsts.select("fp"), radius)).withColumnRenamed("node", "of")
    rooted = cut(firsts.join(roots, firsts["fp"] == roots["of"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(heads, "root").select(F.col("fp").alias("of"), "component_id")
    return marked.join(named, marked["fp"] == named["of"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
