"""Substring dedup by repeated-phrase automata.

1. Confirm: documents lie in chunks by the hash of their id and text. A chunk hashes every window of ``width`` words, merges
   its own copies to one entry (hash, first document), and the entries of all chunks meet in buckets, which answer for each
   window that lies in several documents who its first document is.
2. Compile: the first document of a recurring window owns it. Runs of owned windows are passages; they leave the chunk as
   text, and the passages of one first document are a shard: an Aho-Corasick automaton over the numbers of their words,
   with every window of a passage as a pattern, since a later document may share only part of a passage. A shard of more
   than ``shard_windows`` windows has several automata, of which a worker holds one at a time.
3. Stream: stretches of later documents go as text through the automaton of each first document that they may share a window
   with. Only what an automaton locates, word for word, is removed. A passage that very many chunks share is copied to as
   many shards as it needs, and the stretches are dealt over them.

A hash only says where to look: windows of equal hash and different words are told apart by the automata, and those that no
automaton located meet once more by their whole text, so a clash of hashes neither removes nor loses a word.

Chunks, buckets and partitions are sized from the input, so a worker's memory is flat. One key never holds many rows: a
window that a third of all documents share is one entry a chunk. Texts travel compressed.

Cases: null counts as no words; texts under ``width`` words keep all; a null doc_id is larger than any other; rows that
repeat a doc_id never remove each other's words; repeats within one document are no reason to remove; an empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boresight.llm.common import cut, map_batches, parts_for, text_bytes

WIDTH = 13
#: Bytes of text a chunk and a task are meant to hold, windows a bucket, and chunks that stream through one copy of a shard.
CHUNK_BYTES, TASK_BYTES, BUCKET_WINDOWS, SHARD_CHUNKS = 4 << 20, 32 << 20, 2_000_000, 16
SHARD_WINDOWS = 50_000  # of an automaton
LAST = np.iinfo(np.int64).max  # stands for a null doc_id
_BASE = 0x9E3779B97F4A7C15
_SHORT = np.uint64((1 << 48) - 1)  # bits of a window that travel; the bucket is taken from the upper ones


class WordHashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 13) >> 1
        return value


HASHES = WordHashes()


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` word ids: a polynomial, built by doubling, then mixed."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    with np.errstate(over="ignore"):
        done, out, size, block = 0, None, 1, ids
        while True:
            if width & size:
                tail = block[done:]
                out = tail.copy() if out is None else out[: len(tail)] * power(size) + tail[: len(out)]
                done += size
            if done == width:
                break
            block = block[:-size] * power(size) + block[size:]
            size *= 2
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


class Chunk:
    """The documents of one chunk in their fixed order; windows are numbered through the chunk."""

    def __init__(self, doc_ids: list[int | None], packed: list[bytes], width: int) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(p) if p else b"" for p in packed]
        keys = np.array([LAST if d is None else d for d in doc_ids], np.int64)
        order = sorted(range(len(texts)), key=lambda i: (keys[i], texts[i]))
        self.doc_ids, self.keys, self.width = [doc_ids[i] for i in order], keys[order], width
        self.words = [texts[i].split() for i in order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.counts = np.maximum(self.sizes - width + 1, 0)  # windows of each document
        self.edges, self.word_edges = np.r_[0, np.cumsum(self.counts)], np.r_[0, np.cumsum(self.sizes)]
        self.doc_of = np.repeat(np.arange(len(texts)), self.counts)  # of each window
        self.start = np.arange(len(self.doc_of)) + (self.word_edges[:-1] - self.edges[:-1])[self.doc_of]  # its first word in the chunk

    @cached_property
    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        ids = np.fromiter((HASHES[w] for ws in self.words for w in ws), np.int64, int(self.sizes.sum())).view(np.uint64)
        return window_hashes(ids, self.width)[self.start]

    def parts(self, buckets: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, different short hashes by first place, places of the windows, entry of each place) of each bucket that has some."""
        if not len(self.hashes):
            return
        bucket = ((self.hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        short = self.hashes & np.uint64(_SHORT >> np.uint64(48 - bits))
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)) if buckets < len(order) else None
        turns = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if ends is None else ends[:-1][np.diff(ends) > 0]
        for s, e in zip(turns, np.r_[turns[1:], len(order)]):
            places = order[s:e]
            values, at, entry = np.unique(short[places], return_index=True, return_inverse=True)
            by_place = np.argsort(at)
            rank = np.empty(len(values), np.int64)
            rank[by_place] = np.arange(len(values))
            yield int(bucket[places[0]]), values[by_place], places, rank[entry]

    def text(self, doc: int, low: int, high: int) -> bytes:
        """The words of the windows ``low`` to ``high`` (not included) of a document, numbered through the chunk."""
        first = low - self.edges[doc]
        return b" ".join(self.words[doc][first : first + (high - low) + self.width - 1])


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unzip(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind) if b else np.empty(0, kind)


def _bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _fields(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


SENT = "chunk long, bucket long, hashes binary, docs binary, counts binary, several binary"
BACK = "chunk long, bucket long, shared binary, firsts binary, copies binary"
ROUTED = "first long, copies int, salt int, side int, chunk long, doc long, at long, body binary"
LOCATED = "chunk long, doc long, at long, n int, body binary"
SENT_SCHEMA, BACK_SCHEMA, ROUTED_SCHEMA, LOCATED_SCHEMA = map(_fields, (SENT, BACK, ROUTED, LOCATED))
CLEAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _send(width: int, buckets: int, bits: int):
    """A chunk's different windows by bucket, each with its first document and whether the chunk has another one."""

    def run(table: pa.Table) -> pa.Table:
        chunk, at = Chunk(table["doc_id"].to_pylist(), table["packed"].to_pylist(), width), table["chunk"][0].as_py()
        rows = []
        for bucket, values, places, entry in chunk.parts(buckets, bits):
            docs = chunk.keys[chunk.doc_of[places]]
            first, last = np.full(len(values), LAST), np.full(len(values), -LAST)
            np.minimum.at(first, entry, docs)
            np.maximum.at(last, entry, docs)
            ids, counts = np.unique(first, return_counts=True)  # entries stand in the order of their first documents
            short = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((at, bucket, short.tobytes(), _zip(np.diff(ids, prepend=0)), _zip(counts.astype("<u4")), np.packbits(last > first).tobytes()))
        return _table(rows, SENT_SCHEMA)

    return run


def _meet(shard_chunks: int):
    """Rows sorted by bucket: which entries lie in several documents, their first one, and the copies their shard needs."""

    def answer(rows: list[dict]) -> pa.RecordBatch:
        sizes = [len(r["hashes"]) // 6 for r in rows]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint8).reshape(-1, 6)
        hashes = wide.view("<u8").ravel()
        docs = np.concatenate([np.repeat(np.cumsum(_unzip(r["docs"], "<i8")), _unzip(r["counts"], "<u4")) for r in rows])
        several = np.concatenate([_bits(r["several"], n) for r, n in zip(rows, sizes)])
        order = np.argsort(hashes)
        ranked = hashes[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        many = np.diff(np.r_[starts, len(docs)])
        least = np.minimum.reduceat(docs[order], starts)
        common = (many > 1) | np.maximum.reduceat(several[order], starts)
        copies = 1 << np.ceil(np.log2(np.maximum(many / shard_chunks, 1))).astype(np.int64)
        first, shared, need = np.empty(len(docs), np.int64), np.empty(len(docs), bool), np.empty(len(docs), np.int64)
        for column, values in ((first, least), (shared, common), (need, copies)):
            column[order] = np.repeat(values, many)
        out, at = [], 0
        for r, n in zip(rows, sizes):
            s = shared[at : at + n]
            if s.any():
                out.append((r["chunk"], r["bucket"], np.packbits(s).tobytes(), _zip(first[at : at + n][s]), _zip(need[at : at + n][s])))
            at += n
        return _table(out, BACK_SCHEMA).combine_chunks().to_batches()[0] if out else pa.RecordBatch.from_pylist([], schema=BACK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby((row for batch in batches for row in batch.to_pylist()), key=lambda r: r["bucket"]):
            yield answer(list(rows))

    return run


def _route(width: int, buckets: int, bits: int):
    """Passages that a chunk owns (side 0) and stretches that may repeat others' (side 1), to the shards of the first documents."""

    def run(texts: pa.Table, back: pa.Table) -> pa.Table:
        if not back.num_rows or not texts.num_rows:
            return ROUTED_SCHEMA.empty_table()
        at, chunk = texts["chunk"][0].as_py(), Chunk(texts["doc_id"].to_pylist(), texts["packed"].to_pylist(), width)
        answers = {r["bucket"]: r for r in back.to_pylist()}
        first, copies = np.full(len(chunk.start), -1, np.int64), np.zeros(len(chunk.start), np.int64)
        met = np.zeros(len(chunk.start), bool)
        for bucket, values, places, entry in chunk.parts(buckets, bits):
            if r := answers.get(bucket):
                shared = _bits(r["shared"], len(values))
                known, need = np.full(len(values), -1, np.int64), np.zeros(len(values), np.int64)
                known[shared], need[shared] = _unzip(r["firsts"], "<i8"), _unzip(r["copies"], "<i8")
                first[places], copies[places], met[places] = known[entry], need[entry], shared[entry]
        cuts = np.r_[True, (np.diff(first) != 0) | (np.diff(copies) != 0) | (np.diff(met) != 0) | (np.diff(chunk.doc_of) != 0), True]
        turns, rows = np.flatnonzero(cuts), []
        for s, e in zip(turns[:-1], turns[1:]):
            if met[s]:
                doc = int(chunk.doc_of[s])
                key, f, k, body = int(chunk.keys[doc]), int(first[s]), int(copies[s]), chunk.text(doc, s, e)
                if f == key:
                    rows += [(f, k, salt, 0, at, key, int(s), body) for salt in range(k)]
                elif f < key:
                    rows.append((f, k, at % k, 1, at, key, int(s), body))
        return _table(rows, ROUTED_SCHEMA)

    return run


class Shard:
    """Automata over the passages of one first document; letters are the numbers of their words, patterns their windows.

    An automaton takes at most ``most`` windows. Where there are several, one is compiled at a time, and a stretch runs
    through it only where its windows' hashes are among the automaton's.
    """

    def __init__(self, width: int, most: int) -> None:
        self.width, self.most, self.segments, self.room, self.ready = width, most, [], 0, None

    def add(self, passage: bytes) -> None:
        words, at = passage.split(b" "), 0
        while at <= len(words) - self.width:
            if not self.room:
                self.segments.append([])
                self.room = self.most
            n = min(self.room, len(words) - self.width + 1 - at)
            self.segments[-1].append(b" ".join(words[at : at + n + self.width - 1]))
            self.room -= n
            at += n
        self.ready = None

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return window_hashes(np.fromiter((HASHES[w] for w in words), np.int64, len(words)).view(np.uint64), self.width)

    def compiled(self, segment: list[bytes]) -> tuple[dict[bytes, int], ahocorasick.Automaton]:
        numbers, automaton = {}, ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for passage in segment:
            letters = [numbers.setdefault(w, len(numbers) + 1) for w in passage.split(b" ")]
            for i in range(len(letters) - self.width + 1):
                automaton.add_word(tuple(letters[i : i + self.width]), 1)
        automaton.make_automaton()
        return numbers, automaton

    def locate(self, stretches: list[bytes]) -> list[np.ndarray]:
        """For each window of each stretch whether it is one of the passages'."""
        found = [np.zeros(s.count(b" ") + 2 - self.width, bool) for s in stretches]
        for segment in self.segments:
            alone = len(self.segments) == 1
            numbers, automaton = self.ready or self.compiled(segment)
            if alone:
                self.ready = numbers, automaton
            known = None if alone else np.unique(np.concatenate([self.hashes(p.split(b" ")) for p in segment]))
            for stretch, mine in zip(stretches, found):
                words = stretch.split(b" ")
                runs = [(0, len(mine))]
                if known is not None:
                    turns = np.flatnonzero(np.diff(np.r_[False, np.isin(self.hashes(words), known), False].astype(np.int8)))
                    runs = zip(turns[::2].tolist(), turns[1::2].tolist())
                for s, e in runs:
                    part = words[s : e + self.width - 1]
                    letters = tuple(map(numbers.get, part, [0] * len(part)))
                    mine[[s + end - self.width + 1 for end, _ in automaton.iter(letters)]] = True
        return found


def _locate(width: int, most: int):
    """Rows sorted by shard, passages first: the runs of located windows, and the text of each window not located."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            out = []
            for at_key, rows in groupby(zip(*(batch.column(c).to_pylist() for c in ROUTED_SCHEMA.names)), key=lambda r: r[:3]):
                if at_key != key:
                    key, shard = at_key, Shard(width, most)
                stretches = []
                for *_, side, chunk, doc, at, body in rows:
                    if side == 0:
                        shard.add(body)
                    else:
                        stretches.append((chunk, doc, at, body))
                for (chunk, doc, at, body), found in zip(stretches, shard.locate([s[3] for s in stretches]) if stretches else ()):
                    turns = np.flatnonzero(np.diff(np.r_[False, found, False].astype(np.int8)))
                    out += [(chunk, doc, at + int(s), int(e - s), None) for s, e in zip(turns[::2], turns[1::2])]
                    if not found.all():
                        words = body.split(b" ")
                        out += [(chunk, doc, at + int(i), 1, b" ".join(words[i : i + width])) for i in np.flatnonzero(~found)]
            if out:
                yield from _table(out, LOCATED_SCHEMA).to_batches()

    return run


def _strip(width: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return CLEAN.empty_table()
        chunk = Chunk(texts["doc_id"].to_pylist(), texts["packed"].to_pylist(), width)
        change = np.zeros(chunk.word_edges[-1] + 1, np.int64)
        at, n = found["at"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)
        if len(at):
            np.add.at(change, chunk.start[at], 1)
            np.add.at(change, chunk.start[at] + n + width - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for d, words in enumerate(chunk.words):
            mine = gone[chunk.word_edges[d] : chunk.word_edges[d + 1]]
            turns = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            kept = b" ".join([w for w, g in zip(words, mine.tolist()) if not g]) if len(turns) else b" ".join(words)
            out.append((chunk.doc_ids[d], len(words), int(mine.sum()), [{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2])], kept.decode("utf-8", "replace")))
        return _table(out, CLEAN)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS, shard_chunks: int = SHARD_CHUNKS, bits: int = 48, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept`` for every document: spans of removed words, and the kept text.

    ``bits`` of a window's hash travel beside its bucket; fewer of them cost time and change no row.
    """
    total = text_bytes(docs)
    chunks, buckets = parts_for(total, chunk_bytes), parts_for(total / 6, bucket_windows)
    tasks = parts_for(total, TASK_BYTES, docs.sparkSession.sparkContext.defaultParallelism)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        packed = [squeeze(t) if t else None for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("doc_id"), pa.array(packed, pa.binary())], names=["chunk", "doc_id", "packed"])

    ids = F.col("doc_id").cast("long")
    place = F.pmod(F.xxhash64(ids, "text"), F.lit(chunks)).alias("chunk")
    texts = map_batches(docs.select(place, ids.alias("doc_id"), F.col("text").cast("binary").alias("text")), pack, "chunk long, doc_id long, packed binary").repartition(tasks, "chunk")
    by_chunk = lambda df: texts.groupBy("chunk").cogroup(df.repartition(tasks, "chunk").groupBy("chunk"))
    sent = texts.groupBy("chunk").applyInArrow(_send(width, buckets, bits), SENT)
    back = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(shard_chunks), BACK)
    routed = by_chunk(back).applyInArrow(_route(width, buckets, bits), ROUTED)
    shards = routed.repartition(tasks, "first", "copies", "salt").sortWithinPartitions("first", "copies", "salt", "side", "chunk", "at")
    located = cut(shards.mapInArrow(_locate(width, shard_windows), LOCATED))
    # Windows whose hash is a clash: the whole text decides.
    open_ = located.where("body IS NOT NULL").withColumn("least", F.min("doc").over(Window.partitionBy("body"))).where("least < doc")
    gone = located.where("body IS NULL").unionByName(open_.drop("least")).select("chunk", "at", "n")
    return by_chunk(gone).applyInArrow(_strip(width), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
