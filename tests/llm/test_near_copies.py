"""The near_dedup stage against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random
from fractions import Fraction

import corpus_pipeline
from boresight.llm.near_copies import near_copies
from tests.llm.brute import WORD


def shingled(text: str | None) -> frozenset:
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def groups(texts: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable by steps of similarity 0.8 or more."""
    sets, root = [(d, shingled(t)) for d, t in texts], {d: d for d, _ in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if not s | t or 5 * len(s & t) >= 4 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in texts}


def made() -> list[tuple[int, str | None]]:
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(2000)]
    line = " ".join(rng.choices(pool, k=25))
    bases = [rng.choices(pool, k=n) for n in (1, 4, 5, 9, 30, 55, 60, 120, 400, 1500) for _ in range(4)]
    texts = []
    for ws in bases:
        for edits in (0, 1, 2, 5, 12, 30):
            copy = list(ws)
            for _ in range(min(edits, len(ws) // 12)):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice(([], ["new"], ["new", copy[i]]))
            texts.append(" ".join(copy) if edits else f"  {' '.join(copy).upper()}\n")
    texts += [f"{line} {' '.join(rng.choices(pool, k=k))}" for k in range(40)]  # one common line
    step = rng.choices(pool, k=100)
    for i in range(0, 60, 2):  # a chain whose ends are not similar
        step[i] = f"s{i}"
        texts.append(" ".join(step))
    return [*enumerate(texts), (9000, None), (9001, ""), (9002, " \n\t")]


def test_no_pair_is_missed(spark):
    texts = made()
    wanted = groups(texts)
    assert len({s for s in wanted.values()}) < len(texts) * 0.8
    a, b = shingled("a b c d e f g h i j k l m n"), shingled("a b c d e f g h i j k l m n o p")
    assert Fraction(len(a & b), len(a | b)) == Fraction(10, 12)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == wanted
    assert {r.doc_id: r.component_id for r in near_copies(docs, share=1, key_rows=4).collect()} == wanted  # common keys lie in several buckets
    assert near_copies(docs.where("false")).count() == 0


def test_stage_takes_out_similar_texts(spark, sf):
    """Word edits that stay at 0.8 of five-word shingles move a three-word SimHash by more than three bits."""
    texts = made()
    docs = spark.createDataFrame([*texts, (0, texts[0][1]), (None, texts[0][1])], "doc_id long, text string")
    wanted = groups(texts)
    found = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted([0, *(d for d in wanted if wanted[d] == d)])
    assert not [r for r in found if r.doc_id is None]


def test_few_links_take_few_tasks(spark):
    """A small search writes no more files than its rows need, whatever the number of shuffle partitions."""
    from boresight.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)], "a long, b long")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(links, rows=60)
        assert found.rdd.getNumPartitions() <= 4
        assert len(found.inputFiles()) <= 2
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(61)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
