"""Hard negatives by an orthogonal PCA rotation.

An anchor's inner products with all rows are bounded before they are made. The second moments of all vectors' directions give
an orthogonal rotation whose leading components carry most of a product. A partial product over the leading components, plus
or minus the product of the residual norms and a slack for rounding, encloses the score; a row that can neither reach the
anchor's band nor beat what it has found already is discarded. The next components narrow the interval for those that are left, and the last
survivors get their integer product, which alone decides. So the rotation saves time and changes no row.

The anchors, a stated query set, meet all rows in tiles of at most about ``tile`` rows and ``tile`` anchors; a tile is one
group of a cogroup and is what a worker holds. It returns the first few of each anchor, and a window over the anchor picks
the first of all. Rows of a tile go by id, so of equal scores only the smallest ids are kept and a hot vector is discarded as
soon as its first copies are in. The driver sees a matrix of the moments, whose size is that of the vector alone.

Cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do rows with a null id; of
rows that share an id the one with the smallest (label, vector) counts; a shorter vector counts as if zeros followed; an empty
vector has score 0 with all; an anchor without positives, or a positive below zero, has no rows (its band is empty); scores
beyond a long count as the largest or smallest long. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boresight.llm.common import cut, parts_for

TILE, BLOCK = 1 << 16, 4096
EVERY, POSITIVES, NEGATIVES, STEP = 100, 5, 10, 16
LOW, HIGH = (30, 100), (90, 100)
_LONG = np.iinfo(np.int64)
HIT = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def valid_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding``: the rows that take part, one an id, with the labels that count."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ids, labels = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = vectors.where(ids.isNotNull() & labels.isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", number))
    rows = rows.select(ids.alias("vec_id"), F.when(ids % 7 == 0, (labels + 1) % 10).otherwise(labels).alias("label"), "embedding")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Whole numbers floor(256 x) of the vectors, as doubles; zeros follow a shorter one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not dim:
        return np.zeros((len(column), 0))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        rows = flat.reshape(-1, dim)
    else:
        rows = np.zeros((len(sizes), dim))
        rows[np.arange(dim) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * 256), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def _directions(rows: np.ndarray) -> np.ndarray:
    most = np.abs(rows).max(axis=1, initial=0)
    rows = rows / np.where(most > 0, most, 1)[:, None]
    norms = np.linalg.norm(rows, axis=1)
    return rows / np.where(norms > 0, norms, 1)[:, None]


def rotation(rows: DataFrame, dim: int, slots: int = 32) -> np.ndarray:
    """Orthogonal matrix whose columns go from the largest to the smallest second moment of the vectors' directions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moment, first = np.zeros((dim, dim)), None
        for batch in batches:
            if batch.num_rows:
                first = batch.column("vec_id")[0].as_py() if first is None else first
                unit = _directions(matrix(batch.column("embedding"), dim))
                moment += unit.T @ unit
        if first is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([first % slots], pa.int64()), "moment": pa.array([moment.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table["moment"].to_pylist())
        return pa.table({"slot": table["slot"][:1], "moment": pa.array([total.tobytes()], pa.binary())})

    if not dim:
        return np.zeros((0, 0))
    schema = "slot long, moment binary"
    sums = rows.select("vec_id", "embedding").mapInArrow(partial, schema).groupBy("slot").applyInArrow(add, schema).collect()
    moment = sum((np.frombuffer(r.moment, np.float64).reshape(dim, dim) for r in sums), np.zeros((dim, dim)))
    return np.linalg.eigh(moment)[1][:, ::-1].copy()


class Side:
    """The vectors of one side of a tile: whole numbers, rotated ones, and norms of what follows each step."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, turn: np.ndarray, ends: list[int]) -> None:
        self.ids, self.labels, self.whole = ids, labels, whole
        with np.errstate(over="ignore", invalid="ignore"):
            self.turned = whole @ turn
            self.norms = np.linalg.norm(whole, axis=1)
            self.rest = [np.linalg.norm(self.turned[:, e:], axis=1) for e in ends]

    def part(self, s: slice) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.whole, out.turned, out.norms = self.ids[s], self.labels[s], self.whole[s], self.turned[s], self.norms[s]
        out.rest = [r[s] for r in self.rest]
        return out


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with the rows of ``b``; ``exact``: they fit in a long for sure."""
    if exact:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q)), _LONG.min), _LONG.max) for p, q in zip(a.tolist(), b.tolist())], np.int64)


def open_ended(bounds: np.ndarray, end: float) -> np.ndarray:
    """Bounds one step towards ``end``, as doubles beyond 2**53 are not exact; at the ends of a long there is none, since scores beyond count as that end."""
    return np.where(np.abs(bounds) >= 2.0**63, end, np.nextafter(bounds, end))


@dataclass
class Search:
    """The first ``most`` rows of each anchor and slot with low <= score <= high; higher scores first, then smaller ids."""

    turn: np.ndarray
    same: bool  # rows of the anchor's label, or of all others
    most: int
    compared: int = 0
    verified: int = 0

    def __post_init__(self) -> None:
        dim = len(self.turn)
        self.ends = [*range(STEP, dim, STEP), dim] if dim else [0]
        # ||V'V - I|| by which the rotation fails to be orthogonal, and the rounding of rotated vectors and their products.
        drift = float(np.linalg.norm(self.turn.T @ self.turn - np.eye(dim))) if dim else 0.0
        self.slack = 2 * drift + 16 * (dim + 1) ** 1.5 * np.finfo(np.float64).eps

    def side(self, table: pa.Table) -> Side:
        order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        return Side(table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["embedding"], len(self.turn)), self.turn, self.ends)

    def survivors(self, a: Side, r: Side, need: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``a``, place in ``r``) whose score may lie from ``need`` to ``high`` of the anchor."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._survivors(a, r, need, high)

    def _survivors(self, a: Side, r: Side, need: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slack = self.slack * np.outer(a.norms, r.norms)
        alive = (a.labels[:, None] == r.labels) == self.same
        if self.same:
            alive &= a.ids[:, None] != r.ids
        score, begin, i, j = np.zeros(alive.shape), 0, None, None
        for k, end in enumerate(self.ends):
            if i is None:  # many are left: whole blocks
                score += a.turned[:, begin:end] @ r.turned[:, begin:end].T
                margin = np.outer(a.rest[k], r.rest[k]) + slack
                alive &= ~((score + margin < need[:, None]) | (score - margin > high[:, None]))  # so that a NaN stays
                if alive.mean() < 0.2:
                    i, j = np.nonzero(alive)
                    score, slack = score[i, j], slack[i, j]
            else:
                score = score + np.einsum("ij,ij->i", a.turned[i, begin:end], r.turned[j, begin:end])
                margin = a.rest[k][i] * r.rest[k][j] + slack
                stay = ~((score + margin < need[i]) | (score - margin > high[i]))
                i, j, score, slack = i[stay], j[stay], score[stay], slack[stay]
            begin = end
        return np.nonzero(alive) if i is None else (i, j)

    def run(self, anchors: Side, rows: Side, bands: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
        """(anchor_id, slot, vec_id, score) of what each anchor's bands hold; rows are sorted by id."""
        best = {(i, s): ([], []) for i, b in enumerate(bands) for s in range(len(b))}
        for lo in range(0, len(anchors.ids), 256):
            a, mine = anchors.part(slice(lo, lo + 256)), bands[lo : lo + 256]
            high = np.array([max((h for _, h in b), default=_LONG.min) for b in mine], np.float64)
            need = [[low for low, _ in b] for b in mine]
            for at in range(0, len(rows.ids), BLOCK):
                r = rows.part(slice(at, at + BLOCK))
                least = np.array([min(n, default=_LONG.max) for n in need], np.float64)
                i, j = self.survivors(a, r, open_ended(least, -np.inf), open_ended(high, np.inf))
                self.compared += len(a.ids) * len(r.ids)
                self.verified += len(i)
                if not len(i):
                    continue
                scores = np.concatenate([products(a.whole[i[s : s + BLOCK]], r.whole[j[s : s + BLOCK]], bool(a.norms.max() * r.norms.max() < 2.0**62)) for s in range(0, len(i), BLOCK)])
                edges = np.searchsorted(i, np.arange(len(a.ids) + 1))
                for k in np.unique(i):
                    s, ids = scores[edges[k] : edges[k + 1]], r.ids[j[edges[k] : edges[k + 1]]]
                    for slot, (_, top) in enumerate(mine[k]):
                        fit = (s >= need[k][slot]) & (s <= top)
                        if fit.any():
                            old = best[lo + k, slot]
                            all_s, all_ids = np.concatenate([old[0], s[fit]]).astype(np.int64) if len(old[0]) else s[fit], np.concatenate([old[1], ids[fit]]).astype(np.int64) if len(old[1]) else ids[fit]
                            order = np.lexsort((all_ids, ~all_s))[: self.most]
                            best[lo + k, slot] = all_s[order], all_ids[order]
                            if len(order) == self.most and all_s[order[-1]] < _LONG.max:
                                need[k][slot] = max(need[k][slot], int(all_s[order[-1]]) + 1)  # an equal score comes with a larger id
        return [(int(anchors.ids[i]), s, int(v), int(x)) for (i, s), (xs, vs) in best.items() for x, v in zip(xs, vs)]


def band(positive: int, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH) -> tuple[int, int]:
    """Least and largest whole score from ``low`` to ``high`` of a positive's score."""
    return -((-positive * low[0]) // low[1]), (positive * high[0]) // high[1]


def _tiles(anchors: DataFrame, rows: DataFrame, groups: int, blocks: int, work, bands: bool) -> DataFrame:
    """``work`` on every tile: each group of rows with each block of anchors."""
    place = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own, apart from those of rows
    left = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("tile", place(groups))
    right = rows.withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", place(blocks))

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        if not a.num_rows or not r.num_rows:
            return HIT.empty_table()
        search = work()
        a = a.take(pa.array(np.argsort(a["vec_id"].to_numpy(), kind="stable")))
        mine = [[band(p) for p in ps] for ps in a["positives"].to_pylist()] if bands else [[(_LONG.min, _LONG.max)]] * a.num_rows
        found = search.run(search.side(a), search.side(r), mine)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), HIT)], schema=HIT) if found else HIT.empty_table()

    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(run, "anchor_id long, slot int, vec_id long, score long")


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, tile: int = TILE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors are the ids divisible by ``every``."""
    rows = cut(valid_rows(vectors))
    many, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    turn = rotation(rows, dim)
    groups, blocks = parts_for(many, tile, 2 * rows.sparkSession.sparkContext.defaultParallelism), parts_for(many / every, tile)
    anchors = rows.where(F.col("vec_id") % every == 0)

    def first(df: DataFrame, most: int, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    near = cut(first(_tiles(anchors, rows, groups, blocks, lambda: Search(turn, True, positives), False), positives, "anchor_id"))
    slots = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found"))
    slots = slots.select(F.col("anchor_id").alias("vec_id"), F.col("found.score").alias("positives"))
    far = _tiles(anchors.join(slots.hint("merge"), "vec_id"), rows, groups, blocks, lambda: Search(turn, False, negatives), True)
    far = first(far, negatives, "anchor_id", "slot").select("anchor_id", (F.col("slot") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(near.hint("merge"), ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
