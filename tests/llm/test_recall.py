"""Recall of decontamination by item length and by where the edits lie."""

from __future__ import annotations

import random

import pytest

from boresight.llm import queries
from boresight.llm.decontaminate import Matcher, allowed, choose_walks, words_of


def placed(ws: list[str], kind: str, k: int, rng: random.Random) -> list[str]:
    out, n = list(ws), len(ws)
    for j in range(k):
        if kind == "random":
            i = rng.randrange(len(out))
            out[i : i + 1] = rng.choice(([f"x{j}"], [], [f"x{j}", out[i]]))
        else:
            out[{"even": (j + 1) * n // (k + 1), "head": j, "tail": n - 1 - j}[kind]] = f"x{j}"
    return out


KINDS = ("even", "random", "head", "tail")


def shares(items: list[str], finder: Matcher, kind: str, tries: dict[int, int]) -> dict[int, float]:
    """Share of edited copies found, by item length; ``tries`` a length."""
    rng, texts, wanted = random.Random(9), [], []
    fill = lambda: [f"f{rng.randrange(5000)}" for _ in range(rng.randrange(12))]
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(items):
        by_length.setdefault(len(t.split()), []).append(i)
    for n, mine in by_length.items():
        for _ in range(tries.get(n, 0)):
            i = rng.choice(mine)
            texts.append(" ".join([*fill(), *placed(items[i].split(), kind, allowed(n, 0.2), rng), *fill()]).encode())
            wanted.append((i, n))
    found = {(d, i) for d, i, *_ in finder.find(list(range(len(texts))), texts)}
    hits: dict[int, int] = {}
    for d, (i, n) in enumerate(wanted):
        hits[n] = hits.get(n, 0) + ((d, i) in found)
    return {n: hits[n] / tries[n] for n in hits}


def made(counts: dict[int, int]) -> list[str]:
    rng = random.Random(4)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n, many in counts.items() for _ in range(many)]


@pytest.fixture(scope="module")
def every_length():
    items = made({n: 5 for n in (*range(3, 61), 80, 150, 260)})
    return items, Matcher(list(enumerate(t.encode() for t in items)), 0.2, 0.99)


@pytest.mark.parametrize("kind", KINDS)
def test_recall_at_every_length(every_length, kind):
    items, finder = every_length
    found = shares(items, finder, kind, {n: 200 for n in range(3, 61)} | {80: 100, 150: 100, 260: 100})
    assert {n: x for n, x in found.items() if x < 0.99} == {}


@pytest.mark.parametrize("common,rare", [(29, 20), (9, 5), (49, 30), (19, 15), (99, 50), (14, 10)])
def test_recall_of_rare_lengths(common, rare):
    """40 items of one length beside 4 of another one of its class."""
    items = made({common: 40, rare: 4})
    finder = Matcher(list(enumerate(t.encode() for t in items)), 0.2, 0.99)
    for kind in KINDS:
        assert min(shares(items, finder, kind, {common: 200, rare: 200}).values()) >= 0.99


def test_walks_are_chosen_by_tasks(spark):
    items = made({3: 2, 20: 3, 40: 5})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    made_by = choose_walks(df.selectExpr("item_id", "cast(text as binary) text"), 0.2, 0.99, 11)
    assert made_by.keys() == {3, 20, 40} and made_by == Matcher(list(enumerate(t.encode() for t in items)), 0.2, 0.99).walks | made_by


def edit_distance_in(item: list[str], text: list[str]) -> int:
    """Least edit distance of an item to any stretch of a text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_query_against_all_alignments(spark, sf, tmp_path):
    """The registered query over the smallest table and edited items, against every alignment of every item and text."""
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rng = random.Random(2)
    for k, (_, t) in enumerate(benchmark):
        ws = t.split()
        docs.append((10_000 + k, " ".join([*[f"a{x}" for x in range(9)], *placed(ws, KINDS[k % 4], max(0, allowed(len(ws), 0.2) - k % 2), rng), "tail"])))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.doc_id, r.item_id): r.distance for r in queries.op9_decontaminate(spark, str(tmp_path)).collect()}
    plain = lambda t: [w.decode() for w in words_of((t or "").encode())]
    items = [(i, plain(t)) for i, t in benchmark]
    wanted = {}
    for d, t in docs:
        ws = plain(t)
        have = set(ws)
        for i, item in items:
            if len(set(item) - have) <= allowed(len(item), 0.2) and (x := edit_distance_in(item, ws)) <= allowed(len(item), 0.2):
                wanted[d, i] = x
    assert found.items() <= wanted.items()  # nothing is found that isn't there, and each at its least distance
    assert len(found) >= 0.99 * len(wanted)
