"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs set a document labelled good against one labelled poor; the chance that the first is preferred is the
logistic of the difference of their scores, and a score is linear in features of the whole text, so the fit is a logistic
loss on feature differences. The threshold is a quantile of the scores: the one at the share of poor documents among the
training labels. Published scores are the logistic of the distance to it, shifted so that ``CUT`` falls on the threshold.

The fit takes a sample of at most ``sample`` labelled rows a class (the rows of least hash), a documented bound; all
documents are scored, in one pass without a shuffle. Labels are learnt only from rows whose crc32(doc_id as text) mod 5
is not 0; lang, source and doc_id are no features.

Cases: null and empty texts get the score of an empty text; labels that are null are skipped, repeated ones count once
(the greatest); of documents that repeat a labelled doc_id one is learnt from; without both classes every score is 0.5 and every document is accepted; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boresight.llm.common import map_batches

CUT = 0.3
SAMPLE = 6000
PAIRS_EACH = 4
_ALL = np.arange(256)
#: Byte classes whose shares are features.
CLASSES = {
    "upper": (_ALL >= 65) & (_ALL <= 90), "lower": (_ALL >= 97) & (_ALL <= 122), "digit": (_ALL >= 48) & (_ALL <= 57), "blank": (_ALL == 32) | (_ALL == 9),
    "newline": _ALL == 10, "stop": _ALL == 46, "comma": _ALL == 44, "bang": (_ALL == 33) | (_ALL == 63), "pipe": _ALL == 124, "mark": np.isin(_ALL, list(b"#$%&*@^~=+_<>\\{}[]")),
    "high": _ALL >= 128, "control": (_ALL < 32) & (_ALL != 10) & (_ALL != 9) & (_ALL != 13),
}
_CLASSES = np.stack([c.astype(float) for c in CLASSES.values()], axis=1)
NAMES = (*CLASSES, "log_words", "variety", "top_share", "adjacent", "word_length", "word_spread", "line_repeat", "line_length", "marked_words", "shout_words")


def features(text: bytes) -> np.ndarray:
    """The features of a whole UTF-8 text."""
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / max(1, len(text))
    words = text.split()
    n = len(words)
    if not n:
        return np.r_[shares, np.zeros(len(NAMES) - len(CLASSES))]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, n)
    lines = text.split(b"\n")
    marked = sum(c for w, c in counts.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1] in b".,;:"))
    shout = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return np.r_[
        shares, np.log1p(n), np.log1p(len(counts)) / np.log1p(n), counts.most_common(1)[0][1] / n, sum(map(eq, words, words[1:])) / n, lengths.mean(), lengths.std(),
        1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), marked / n, shout / n,
    ]


@dataclass
class Ranking:
    """A fitted scorer: standardisation, weights of the features and of their squares, and the threshold."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def expand(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -6, 6)
        return np.hstack([z, np.minimum(z * z, 9)])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.expand(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = self.raw(rows) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ranking(rows: np.ndarray, good: np.ndarray, poor_share: float, ridge: float = 1e-3, steps: int = 30) -> Ranking | None:
    """Newton steps on the logistic loss of feature differences; None without both classes."""
    pos, neg = rows[good], rows[~good]
    if not len(pos) or not len(neg):
        return None
    mean, spread = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
    model = Ranking(mean, spread, np.zeros(2 * rows.shape[1]), 0.0)
    a, b = model.expand(pos), model.expand(neg)
    n = max(len(a), len(b))
    each = np.arange(n)
    diff = np.vstack([a[each % len(a)] - b[(each * (k + 1) + k * 7919) % len(b)] for k in range(PAIRS_EACH)])
    w = model.weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        slope = diff.T @ (1 - p) / len(diff) - ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    scores = model.raw(rows)
    weight = np.where(good, (1 - poor_share) / len(pos), poor_share / len(neg))
    order = np.argsort(scores)
    below = np.cumsum(weight[order])
    at = min(int(np.searchsorted(below, poor_share - 1e-9)), len(order) - 2)
    model.threshold = float(scores[order[at : at + 2]].mean())
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([features(t or b"") for t in batch.column("text").to_pylist()])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking | None:
    """Fit on at most ``sample`` rows of each class of the labels that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))
    share = known.agg(F.avg((~F.col("good")).cast("int"))).first()[0]
    if share is None:
        return None
    chosen = [known.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for g in (True, False)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows of 9 bytes
    picked = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(ids, "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "good": batch.column("good"), "x": pa.array([r.astype("<f8").tobytes() for r in _rows(batch)], pa.binary())})

    made = map_batches(picked, run, "doc_id long, good boolean, x binary").groupBy("doc_id").agg(F.first("good").alias("good"), F.min("x").alias("x"))  # a row an id
    found = sorted(map(tuple, made.collect()))  # the bounded sample
    if not found:
        return None
    return fit_ranking(np.stack([np.frombuffer(x, "<f8") for _, _, x in found]), np.array([g for _, g, _ in found]), share)


def score(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.score(_rows(batch)) if model else np.full(batch.num_rows, 0.5)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    scored = map_batches(texts, run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """The documents, all columns, that score ``CUT`` or more; texts stay where they are read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not model:
            return batch
        texts = batch.column("text").cast(pa.binary())
        return batch.filter(pa.array(model.score(_rows(pa.RecordBatch.from_arrays([texts], names=["text"]))) >= CUT))

    return map_batches(docs, run, docs.schema)


def rate(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on ``labels`` and score ``docs``."""
    return score(docs, learn(docs, labels, sample))
