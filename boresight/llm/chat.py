"""Chat formatting of reply trees.

Messages name their parent. Root-to-leaf paths are found by iterative self-joins that double their reach: after k joins a
leaf knows its 2^k nearest ancestors, so a chain of any depth takes a logarithm of joins. Branches are ranked by the mean
score of their messages and the chosen ones are formatted, each as one conversation, by streaming over sorted rows.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn. Inside texts a control opening ``<|`` gets a backslash, and one
more where backslashes already stand between the two characters, which can be undone exactly. The loss mask covers the
assistant texts.

Cases: null role or text counts as empty; a message whose parent is missing is a root; rows that repeat are turns of their
own; in a flat conversation equal turn numbers are ordered by role, then text; rows without a tree id are one tree; empty
tables give no rows. Messages on a parent cycle, and those that answer one, belong to no path. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boresight.llm.common import cut, map_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ADD, TAKE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return ADD.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return TAKE.sub(r"<\1|", text)


def header(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        line, _, rest = piece.partition("\n")
        turns.append((role_of(line), unescape(rest[: -len(CLOSE)])))
    return turns


def reply_paths(messages: DataFrame) -> DataFrame:
    """``tree_id, leaf_id, node_id, up`` for every leaf and each message on its way to the root; up 0 is the leaf.

    ``messages(tree_id, node_id, parent_id)``; node ids are unique within a tree. The jump tables come first: what still has
    an ancestor farther away than its tree has messages hangs on a cycle and is left out.
    """
    nodes = messages.select(F.struct("tree_id").alias("tree_id"), "node_id", "parent_id")  # a struct equals another one with a null in it
    present = nodes.select("tree_id", F.col("node_id").alias("parent_id"))
    jump = cut(nodes.join(present, ["tree_id", "parent_id"], "left_semi").select("tree_id", "node_id", F.col("parent_id").alias("to_id")))  # one step up
    parents = jump.select("tree_id", F.col("to_id").alias("node_id"))
    largest = nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    jumps, reach = [], 1
    while reach <= largest and not jump.isEmpty():
        jumps.append((reach, jump))
        onward = jump.select("tree_id", F.col("node_id").alias("to_id"), F.col("to_id").alias("far_id"))
        jump = cut(jump.join(onward, ["tree_id", "to_id"]).select("tree_id", "node_id", F.col("far_id").alias("to_id")))
        reach *= 2
    leaves = nodes.join(parents, ["tree_id", "node_id"], "left_anti").join(jump, ["tree_id", "node_id"], "left_anti")
    found = cut(leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("up")))
    for reach, jump in jumps:
        more = found.join(jump, ["tree_id", "node_id"]).select("tree_id", "leaf_id", F.col("to_id").alias("node_id"), (F.col("up") + reach).alias("up"))
        found = cut(found.unionByName(more))
    return found.select("tree_id.tree_id", "leaf_id", "node_id", "up")


def choose_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """``tree_id, leaf_id, node_id, up, role, text`` of the ``top`` branches of each tree by mean score (None: all)."""
    tree = F.struct("tree_id").alias("tree_id")
    paths = reply_paths(messages).select(tree, "leaf_id", "node_id", "up")
    full = paths.join(messages.select(tree, "node_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree_id", "node_id"])
    plain = lambda df: df.select("tree_id.tree_id", "leaf_id", "node_id", "up", "role", "text")
    if top is None:
        return plain(full)
    ranked = full.groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("mean"))
    order = Window.partitionBy("tree_id").orderBy(F.desc("mean"), "leaf_id")
    best = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("tree_id", "leaf_id")
    return plain(full.join(best, ["tree_id", "leaf_id"], "left_semi"))


FORMATTED = pa.schema([("conv_id", pa.int64()), ("leaf_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, pieces, loss, size = None, [], [], 0
    ready, ready_size = [], 0

    def closed() -> dict:
        return {"conv_id": key[0], "leaf_id": key[1], "formatted": "".join(pieces), "loss": loss}

    for batch in batches:
        for tree, leaf, role, text in zip(*(batch.column(c).to_pylist() for c in ("tree_id", "leaf_id", "role", "text"))):
            if (tree, leaf) != key:
                if key is not None:
                    ready.append(closed())
                    ready_size += size
                key, pieces, loss, size = (tree, leaf), [], [], 0
            if ready_size > 4 << 20:
                yield pa.RecordBatch.from_pylist(ready, schema=FORMATTED)
                ready, ready_size = [], 0
            body = escape(text or "")
            head = f"{OPEN}{header(role or '')}\n"
            if role == "assistant":
                loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
            pieces.append(f"{head}{body}{CLOSE}")
            size += len(pieces[-1])
    if key is not None:
        ready.append(closed())
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=FORMATTED)


def format_paths(paths: DataFrame) -> DataFrame:
    """``conv_id, leaf_id, formatted, loss`` with the loss mask as spans of code points."""
    rows = paths.select(F.col("tree_id").cast("long"), F.col("leaf_id").cast("long"), "role", "text", "up")
    rows = rows.repartition("tree_id", "leaf_id").sortWithinPartitions("tree_id", "leaf_id", F.desc("up"))
    return rows.mapInArrow(_format, "conv_id long, leaf_id long, formatted string, loss array<struct<start:long,end:long>>")


def as_tree(conversations: DataFrame) -> DataFrame:
    """Flat conversations as reply trees of one branch: each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    flat = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    numbered = flat.withColumn("node_id", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turn counts and digests, taken from the formatted texts and their loss masks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            turns = parse(text)
            learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            every = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256(every.encode()).hexdigest(), "loss_chars": len(learnt), "loss_sha256": hashlib.sha256(learnt.encode()).hexdigest(), "formatted_chars": len(text)})
        return pa.RecordBatch.from_pylist(out)

    return map_batches(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
