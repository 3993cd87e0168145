"""Benchmark decontamination by CGK random-walk embedding.

The embedding walks along a sequence of words and, at each step, emits the current word and moves on or stays, by a random
bit of (walk, step, word). Two sequences within a small edit distance soon walk in step again, so edits become few Hamming
differences. Bit-sampling tables key a walk by the words emitted at a few random steps; windows of documents and of items
that share a key in any table are candidates. As a walk of M steps sees at most M words, each item is indexed at every
offset, document windows start every few words, and an item-sized region around a candidate is verified: its exact word
edit distance to the item (free ends) must be at most ``rate`` of the item's words. The number of walks follows from the wanted
recall, for each length that items have: all walks run over the same ``TRIES`` edited copies of items of that length, with
edits at random, spread evenly and at either end, and each kind of edit must miss at most a tenth of what the recall allows, so
that chance does not pass a length. The lengths are tried by Spark tasks, one each. Where ``WALKS`` walks don't do, items of
the length take an exact path instead: an item of n words and k allowed edits is cut into k + 1 pieces, one of which is left
whole by any k edits, so the first floor(n / (k + 1)) words of the pieces find every match.

Items come in blocks of at most about ``block`` rows; a block's tables have that bound, go to the workers as one closure,
and each block takes one pass over all documents, without a shuffle of texts. Words are compared without ASCII case and
punctuation.

Cases: null or empty items and texts match nothing; items of few words allow no edit and match exactly; rows that repeat
count once a doc_id and item; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boresight.llm.common import map_batches, parts_for

RATE, RECALL, BLOCK, SEED = 0.2, 0.99, 2000, 11
STEPS = (12, 4, 1)  # of the walks, for items of at least so many words
CLASSES = (1, 5, 10, 15, 20, 30, 50, 100, 200)  # least words of the item lengths that get their own walks
TABLES, SAMPLED = 4, 8  # tables a walk, steps a table
TRIES, WALKS, TRIED_ITEMS = 1000, 3, 256  # copies of each kind for a length, most walks, items of a length that give the copies
FOUND = "doc_id long, item_id long, distance int, item_words int, start_word int, end_word int"

_LOWER = bytes(range(256)).lower()
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes) -> list[bytes]:
    """Words without ASCII case and punctuation."""
    return text.translate(_LOWER, _MARKS).split()


class Hashes(dict):
    """63-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def edit_end(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text`` and where the first such stretch ends (bit-parallel)."""
    n = len(item)
    eq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        eq[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text):
        m = eq.get(w, 0)
        d = (((m & pv) + pv) ^ pv) | m | mv
        ph, mh = mv | ~(d | pv) & full, pv & d
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(d | ph) & full, ph & d
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Tables:
    """Walks of one length over the items that have at least so many words."""

    steps: int
    stride: int
    walks: int
    seed: int
    items: list[tuple[int, list[int]]] = field(default_factory=list)  # place of the item, its word hashes
    keys: np.ndarray | None = None  # sorted
    owners: np.ndarray | None = None  # (item, offset) by key
    probe: np.ndarray | None = None
    rate: float = RATE

    def samples(self, walk: int) -> list[list[int]]:
        rng = random.Random(self.seed * 1000 + walk)
        size = min(SAMPLED, self.steps)
        return [sorted(rng.sample(range(self.steps), size)) for _ in range(TABLES if self.steps > size else 1)]

    def embed(self, hashes: np.ndarray, at: np.ndarray, walk: int) -> list[np.ndarray]:
        """Keys of all tables of one walk, for the windows that start at ``at``."""
        with np.errstate(over="ignore"):
            bits = (hashes ^ np.uint64(xxhash.xxh64_intdigest(f"{self.seed}/{self.steps}/{walk}"))) * _MIX
            bits ^= bits >> np.uint64(29)
            bits *= _MUL
            tables = self.samples(walk)
            keys = [np.full(len(at), 7919 * walk + t + 1, np.uint64) for t in range(len(tables))]
            at = at.copy()
            last = max(map(max, tables))
            for step in range(last + 1):
                now = None
                for key, taken in zip(keys, tables):
                    if step in taken:
                        now = hashes[at] if now is None else now
                        key *= _MUL
                        key += now
                if step < last:
                    at += ((bits[at] >> np.uint64(step + 20)) & np.uint64(1)).view(np.int64)
            return [k ^ (k >> np.uint64(31)) for k in keys]

    def spots(self) -> list[tuple[int, int]]:
        """(item, offset) of all windows to index."""
        return [(k, f) for k, (_, ws) in enumerate(self.items) for f in range(len(ws) - self.steps + 1)]

    def index(self) -> None:
        hashes = np.array([h for _, ws in self.items for h in ws], np.uint64)
        first = np.cumsum([0, *(len(ws) for _, ws in self.items)])
        spots = self.spots()
        at = np.array([first[k] + f for k, f in spots], np.int64)
        keys = [key for w in range(self.walks) for key in self.embed(hashes, at, w)]
        all_keys, owners = np.concatenate(keys), np.tile(np.array(spots, np.int64), (len(keys), 1))
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.owners = all_keys[order], owners[order]
        self.probe = np.zeros(1 << 22, bool)
        self.probe[(self.keys >> np.uint64(20)).astype(np.int64) & ((1 << 22) - 1)] = True

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window's place in ``at``, item, offset) for each shared key."""
        mask = np.uint64((1 << 22) - 1)
        for walk in range(self.walks):
            for keys in self.embed(hashes, at, walk):
                hit = np.flatnonzero(self.probe[((keys >> np.uint64(20)) & mask).view(np.int64)])
                low, high = np.searchsorted(self.keys, keys[hit]), np.searchsorted(self.keys, keys[hit], "right")
                for h, a, b in zip(hit[low < high], low[low < high], high[low < high]):
                    for k, f in self.owners[a:b]:
                        yield int(h), int(k), int(f)


def allowed(n: int, rate: float) -> int:
    return math.floor(rate * n + 1e-9)


def edits_of(ws: list[int], kind: str, rng: random.Random, k: int) -> list[int]:
    """A copy with ``k`` word edits: random ones, or replaced words spread evenly or at an end."""
    copy, n = list(ws), len(ws)
    fresh = lambda: rng.getrandbits(62)
    if kind == "random":
        for _ in range(k):
            i, what = rng.randrange(len(copy)), rng.randrange(3)
            copy[i : i + 1] = [[fresh()], [], [fresh(), copy[i]]][what]
    else:
        for j in range(k):
            copy[{"even": (j + 1) * n // (k + 1), "head": j, "tail": n - 1 - j}[kind]] = fresh()
    return copy


def class_of(n: int, rate: float) -> tuple[int, int, int]:
    """Least length of the class of an item of ``n`` words, steps of its walks, words from one window to the next."""
    low = max(c for c in CLASSES if c <= n)
    steps = next(x for x in STEPS if low >= x)
    return low, steps, max(1, min(3, (low - allowed(low, rate) - steps) // 8))


def walks_for(words: list[list[int]], rate: float, recall: float, seed: int, tries: int = TRIES, most: int = WALKS) -> int:
    """Walks that find copies of items of one length with as many edits as the rate allows, for each way to place the edits.

    All walks run over the same copies, so what fails in all of them together counts as missed. 0: ``most`` don't do.
    """
    _, steps, stride = class_of(len(words[0]), rate)
    tables, rng, needed = Tables(steps, stride, 1, seed), random.Random(5), 1
    for kind in ("even", "random", "head", "tail"):
        left, right, a, b, first, second = [], [], [], [], 0, 0
        for t in range(tries):
            ws = words[rng.randrange(len(words))]
            copy = edits_of(ws, kind, rng, allowed(len(ws), rate))
            whole = [rng.getrandbits(62) for _ in range(rng.randrange(5) + 5)] + copy + [rng.getrandbits(62) for _ in range(steps)]
            a += [(t, first + f) for f in range(len(ws) - steps + 1)]
            b += [(t, second + f) for f in range(0, len(whole) - steps + 1, stride)]
            left.extend(ws)
            right.extend(whole)
            first, second = first + len(ws), second + len(whole)
        one, two = np.array(left, np.uint64), np.array(right, np.uint64)
        (t1, at1), (t2, at2) = np.array(a, np.int64).T, np.array(b, np.int64).T
        found = np.zeros(tries, bool)
        for walk in range(most):
            for x, y in zip(tables.embed(one, at1, walk), tables.embed(two, at2, walk)):
                found[t2[np.isin(y * _MIX + t2.astype(np.uint64), x * _MIX + t1.astype(np.uint64))]] = True
            if 1 - found.mean() <= (1 - recall) / 10:
                needed = max(needed, walk + 1)
                break
        else:
            return 0
    return needed


def choose_walks(items: DataFrame, rate: float, recall: float, seed: int) -> dict[int, int]:
    """Walks for each number of words that items have; a row a length comes to the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t or b"") for t in batch.column("text").to_pylist()]
            kept = [(len(ws), b" ".join(ws)) for ws in words if ws]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.int32()), pa.array([w for _, w in kept], pa.binary())], names=["n", "words"])

    def choose(table: pa.Table) -> pa.Table:
        seen = Hashes()
        words = [[int(h) for h in seen.of(t.split(b" "))] for t in sorted(table["words"].to_pylist())]
        return pa.table({"n": table["n"][:1], "walks": pa.array([walks_for(words, rate, recall, seed)], pa.int32())})

    measured = items.mapInArrow(measure, "n int, words binary").distinct()
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.xxhash64("words"), "words"))
    tried = measured.withColumn("place", place).where(F.col("place") <= TRIED_ITEMS).drop("place")
    return {r.n: r.walks for r in tried.groupBy("n").applyInArrow(choose, "n int, walks int").collect()}


class Seeds(Tables):
    """Exact path: of k + 1 pieces of an item, k edits leave one whole; ``steps`` words of each piece are its key."""

    def embed(self, hashes: np.ndarray, at: np.ndarray, walk: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            key = np.full(len(at), self.steps, np.uint64)
            for step in range(self.steps):
                key = key * _MUL + hashes[at + step]
            return [key ^ (key >> np.uint64(31))]

    def spots(self) -> list[tuple[int, int]]:
        return [(k, f) for k, (_, ws) in enumerate(self.items) for f in pieces(len(ws), self.rate)[1]]


def pieces(n: int, rate: float) -> tuple[int, list[int]]:
    """Words of a seed and where the pieces of an item start."""
    many = allowed(n, rate) + 1
    return n // many, [i * n // many for i in range(many)]


class Matcher:
    """The tables of one block of items; finds them in batches of documents."""

    def __init__(self, items: list[tuple[int | None, bytes]], rate: float, recall: float, seed: int = SEED, walks: Mapping[int, int] | None = None) -> None:
        self.rate, self.seen = rate, Hashes()
        kept = [(i, words_of(t or b"")) for i, t in items]
        self.ids = [i for i, ws in kept if ws]
        self.words = [[int(h) for h in self.seen.of(ws)] for _, ws in kept if ws]
        self.sets = [frozenset(ws) for ws in self.words]
        by_length, by_class, exact = defaultdict(list), defaultdict(list), defaultdict(list)
        for k, ws in enumerate(self.words):
            by_length[len(ws)].append((k, ws))
        self.walks = {n: walks[n] if walks is not None else walks_for([ws for _, ws in mine[:TRIED_ITEMS]], rate, recall, seed) for n, mine in sorted(by_length.items())}
        for n, mine in sorted(by_length.items()):
            if self.walks[n]:
                by_class[class_of(n, rate)] += mine
            else:
                exact[pieces(n, rate)[0]] += mine
        self.tables = [Tables(steps, stride, max(self.walks[len(ws)] for _, ws in mine), seed, mine) for (_, steps, stride), mine in sorted(by_class.items())]
        self.tables += [Seeds(size, 1, 1, seed, mine, rate=rate) for size, mine in sorted(exact.items())]
        for t in self.tables:
            t.index()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": Hashes()}

    def find(self, doc_ids: list, texts: list[bytes | None]) -> list[tuple]:
        docs = [words_of(t or b"") for t in texts]
        sizes = np.array([len(d) for d in docs])
        first = np.r_[0, np.cumsum(sizes)]
        hashes = np.concatenate([self.seen.of(d) for d in docs]) if docs else np.empty(0, np.uint64)
        found: dict[tuple[int, int], tuple] = {}
        for t in self.tables:
            starts = [np.arange(a, a + n - t.steps + 1, t.stride) for a, n in zip(first, sizes) if n >= t.steps]
            if not starts:
                continue
            at, tried = np.concatenate(starts), set()
            for lo in range(0, len(at), 1 << 15):
                part = at[lo : lo + (1 << 15)]
                base = int(part[0])
                near = hashes[base : int(part[-1]) + t.steps + 1]
                for h, k, f in t.candidates(near, part - base):
                    p = int(part[h])
                    d = int(np.searchsorted(first, p, "right")) - 1
                    place, ws = t.items[k]
                    n = len(ws)
                    if (spot := (d, place, (p - f) // max(1, n // 4))) in tried:
                        continue
                    tried.add(spot)
                    limit = allowed(n, self.rate)
                    a, b = max(int(first[d]), p - f - limit - n // 4), min(int(first[d + 1]), p - f + n + limit + n // 4)
                    near_words = hashes[a:b].tolist()
                    if len(self.sets[place].difference(near_words)) > limit:
                        continue  # each edit loses one word at most
                    distance, end = edit_end(ws, near_words)
                    if distance > limit:
                        continue
                    back, length = edit_end(ws[::-1], near_words[:end][::-1])
                    hit = (distance, a + end - length - int(first[d]), a + end - int(first[d]))
                    if (d, place) not in found or hit < found[d, place]:
                        found[d, place] = hit
        return [(doc_ids[d], self.ids[k], dist, len(self.words[k]), s, e) for (d, k), (dist, s, e) in sorted(found.items())]


def _search(matcher: Matcher):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int32()) for c in ("distance", "item_words", "start_word", "end_word"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if rows := matcher.find(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def matchers(benchmark: DataFrame, rate: float, recall: float, block: int) -> Iterator[Matcher]:
    """A matcher for each block of about ``block`` items."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).distinct()
    blocks, walks = parts_for(items.count(), block), choose_walks(items, rate, recall, SEED)
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Matcher(sorted(map(tuple, mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b"")), rate, recall, walks=walks)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, distance, item_words, start_word, end_word`` of every item found in a document, at its best place."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    out = None
    for matcher in matchers(benchmark, rate, recall, block):
        found = texts.mapInArrow(_search(matcher), FOUND)
        out = found if out is None else out.unionByName(found)
    place = F.struct("distance", "start_word", "end_word", "item_words")
    best = out.groupBy("doc_id", "item_id").agg(F.min(place).alias("best"))
    return best.select("doc_id", "item_id", "best.distance", "best.item_words", "best.start_word", "best.end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The documents, all columns, in which no benchmark item was found; texts stay where they are read."""

    def clean(matcher: Matcher):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = matcher.find(list(range(batch.num_rows)), batch.column("text").cast(pa.binary()).to_pylist())
            mask = np.ones(batch.num_rows, bool)
            mask[[row[0] for row in found]] = False
            return batch.filter(pa.array(mask))

        return run

    for matcher in matchers(benchmark, rate, recall, block):
        docs = map_batches(docs, clean(matcher), docs.schema)
    return docs
