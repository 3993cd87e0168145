"""Exact dedup by Patricia-trie owners.

Each map task inserts the full normalised byte strings of its rows into a compressed radix trie whose terminal nodes keep
the best row (most code points, then smallest doc_id) and a count, so a group of copies leaves a task as one row however
large it is. Rows go by length and content hash to owner partitions, whose tries merge the terminals. A trie over its memory budget
writes its largest subtree to an unlinked temporary file of the task, which is read back on its own at the end; a single text
over the budget is held whole, as any row is. Documents
then meet their owner's verdict by digest in a plain equi-join, which adaptive execution splits where one text is hot.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Cases: null counts as
the empty text, and empty texts are copies of each other; ties on length go to the smallest doc_id, null last; rows that
repeat a doc_id stand or fall together; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boresight.llm.common import SPACE, cut, parts_for, text_bytes

BLANKS = b" \t\n\x0b\x0c\r"
OWNED = "n_bytes long, sha binary, body binary, points long, best_id long, members long"
#: Bytes of text that an owner partition is meant to get, and that a trie holds before it drains or spills.
OWNER_BYTES, TRIE_BYTES = 48 << 20, 96 << 20


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def rank(points: int, best_id: int | None) -> tuple:
    """Order of the rows of a group: the least stays."""
    return -points, best_id is None, best_id or 0


class Node:
    """An edge label, the children by first byte, and for a whole key its verdict [points, best_id, members]."""

    __slots__ = ("kids", "label", "spool", "verdict")

    def __init__(self, label: bytes, verdict: list | None = None) -> None:
        self.label, self.verdict, self.kids, self.spool = label, verdict, {}, None


class RadixTrie:
    """Compressed radix trie over byte strings with merging terminals and spill by subtree."""

    def __init__(self, budget: int) -> None:
        self.root, self.held, self.budget, self.spilled = Node(b""), 0, budget, []

    def put(self, key: bytes, points: int, best_id: int | None, members: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                self._hang(node, key[at:], [points, best_id, members])
                return
            if kid.spool is not None:
                pickle.dump((key[at:], points, best_id, members), kid.spool)
                return
            size = len(kid.label)
            if key.startswith(kid.label, at):
                node, at = kid, at + size
                continue
            n = shared_prefix(kid.label, key[at : at + size])
            fork = Node(kid.label[:n])
            kid.label = kid.label[n:]
            fork.kids[kid.label[0]] = kid
            node.kids[fork.label[0]] = fork
            node, at = fork, at + n
        v = node.verdict
        if v is None:
            node.verdict = [points, best_id, members]
        else:
            if rank(points, best_id) < rank(v[0], v[1]):
                v[0], v[1] = points, best_id
            v[2] += members

    def _hang(self, node: Node, label: bytes, verdict: list) -> None:
        node.kids[label[0]] = Node(label, verdict)
        self.held += len(label) + 400
        if self.held > self.budget:
            self._spill()

    def _size(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + 400
            todo += x.kids.values()
        return total

    def _spill(self) -> None:
        """Write the largest subtree below the first fork to a file of its own; a lone key stays, as it has to be held anyway."""
        top, before = self.root, b""
        while True:
            live = [k for k in top.kids.values() if k.spool is None]
            if not live:
                return
            big = max(live, key=self._size)
            if len(live) > 1 or top.verdict is not None and top is not self.root:
                break
            if not big.kids:
                return
            top, before = big, before + big.label
        file = tempfile.TemporaryFile(buffering=1 << 20)
        for key, v in self._walk(big, b""):
            pickle.dump((key, *v), file)
        path, others = before + big.label, []
        for at, inner in self.spilled:  # what was spilled from below it goes to its file, so a key has one file
            if at.startswith(path):
                for key, *v in self._records(inner):
                    pickle.dump((at[len(before) :] + key, *v), file)
            else:
                others.append((at, inner))
        self.spilled = others
        self.held -= self._size(big)
        stub = Node(big.label[:1])
        stub.spool = file
        top.kids[big.label[0]] = stub
        self.spilled.append((before, stub))

    @staticmethod
    def _records(stub: Node) -> Iterator[tuple]:
        """What a spilled subtree's file holds; the file goes."""
        stub.spool.seek(0)
        while True:
            try:
                yield pickle.load(stub.spool)
            except EOFError:
                break
        stub.spool.close()

    def _walk(self, node: Node, before: bytes) -> Iterator[tuple[bytes, list]]:
        todo = [(node, before)]
        while todo:
            x, path = todo.pop()
            if x.spool is not None:
                continue
            path += x.label
            if x.verdict is not None:
                yield path, x.verdict
            todo += [(k, path) for k in x.kids.values()]

    def drain(self) -> Iterator[tuple[bytes, list]]:
        """All keys with their verdicts, memory first, then each spilled subtree by itself; the trie is empty after."""
        yield from self._walk(self.root, b"")
        waiting, self.root, self.held, self.spilled = self.spilled, Node(b""), 0, []
        while waiting:
            before, stub = waiting.pop()
            part = RadixTrie(self.budget)
            for record in self._records(stub):
                part.put(*record)
            for key, v in part._walk(part.root, b""):
                yield before + key, v
            waiting += [(before + path, x) for path, x in part.spilled]


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[0] + 200
        if size >= at_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


LOCAL_SCHEMA = pa.schema([("n_bytes", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("points", pa.int64()), ("best_id", pa.int64()), ("members", pa.int64())])
OWNER_SCHEMA = pa.schema([("n_bytes", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _local(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(1 << 62)

        def emptied() -> Iterator[tuple]:
            for key, (points, best_id, members) in trie.drain():
                yield len(key), hashlib.sha256(key).digest(), key, points, best_id, members

        for batch in batches:
            for doc_id, text, points in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "points"))):
                trie.put(text.translate(None, BLANKS), points, doc_id)
                if trie.held > budget:
                    yield from _batches(emptied(), LOCAL_SCHEMA)
        yield from _batches(emptied(), LOCAL_SCHEMA)

    return run


def _owner(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(budget)
        for batch in batches:
            for body, points, best_id, members in zip(*(batch.column(c).to_pylist() for c in ("body", "points", "best_id", "members"))):
                trie.put(body, points, best_id, members)
        found = ((len(k), hashlib.sha256(k).digest(), v[1], v[2]) for k, v in trie.drain())
        yield from _batches(((n, sha, best, members) for n, sha, best, members in found), OWNER_SCHEMA, 1 << 22)

    return run


def owners(docs: DataFrame, owner_bytes: int = OWNER_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``n_bytes, sha, keep_id, group_size``: a row for each different text."""
    parts = parts_for(text_bytes(docs), owner_bytes, docs.sparkSession.sparkContext.defaultParallelism)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("points"))
    local = rows.mapInArrow(_local(trie_bytes // 2), OWNED)
    return local.repartition(parts, "n_bytes", "sha").mapInArrow(_owner(trie_bytes), "n_bytes long, sha binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every document, dropped ones too."""
    texts = docs.select(F.col("doc_id").cast("long"), F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", ""), 256).alias("text_sha256"))
    verdicts = cut(owners(docs).select(F.lower(F.hex("sha")).alias("sha"), "keep_id", "group_size"))
    return texts.join(verdicts, texts["text_sha256"] == verdicts["sha"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
