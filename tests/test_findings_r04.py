"""Cases of the fourth round's findings: each failed, or cost too much, before its change."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from boresight.llm import hashing, near_copies, simhash
from boresight.operators import intervals, profiles, reading, trajectory
from boresight.plans import records


def test_shingles_of_a_batch_are_hashed_at_once(monkeypatch):
    """One call of a hash a shingle took most of near_dedup's time."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcÑé0", k=rng.choice([1, 3, 7, 8, 9, 30, 33, 70])))
    texts = ["", " \n", "One", "one  TWO", "a b c", *(rng.choice([" ", "\n", "\t \x0b"]).join(word() for _ in range(rng.randrange(60))) for _ in range(80)), "x " * 900]
    bodies = [t.encode() for t in texts]
    fold = [b"".join(c.lower() if c < b"\x80" else c for c in map(lambda i: bytes([i]), b)).split() for b in bodies]
    grams = lambda ws, n: [b" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []
    wanted = []
    for ws in fold:
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams(ws, 3)]
        wanted.append(simhash.signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    calls, one = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a: calls.append(len(a[0])) or one(*a))
    monkeypatch.setattr(xxhash, "xxh64_digest", None)
    assert simhash.fingerprints_of(bodies).tolist() == wanted
    assert all(n >= hashing.LONG for n in calls)
    sets = near_copies.shingle_sets(bodies)
    names = {}
    for found, ws in zip(sets, fold):
        mine = set(grams(ws, 5))
        assert len(found) == len(mine) and (found[1:] > found[:-1]).all()
        for other, vs in zip(sets, fold):
            assert len(np.intersect1d(found, other)) == len(mine & set(grams(vs, 5)))
        for key in found.tolist():
            names[key] = names.get(key, 0) + 1
    assert len(names) == len({g for ws in fold for g in grams(ws, 5)})


def test_pieces_of_all_lengths_have_their_xxh64():
    rng = random.Random(7)
    text = bytes(rng.randrange(256) for _ in range(500))
    at, size = (np.array([rng.randrange(n) for _ in range(2000)]) for n in (300, 150))
    for seed in (0, 42):
        assert hashing.xxh64(text, at, size, seed).tolist() == [xxhash.xxh64_intdigest(text[a : a + n], seed) for a, n in zip(at, size)]


def test_long_batches_are_taken_in_parts():
    texts = [b"a" * n for n in (5, 9, 0, 30, 2, 2)]
    assert [list(map(len, p)) for p in hashing.in_turn(texts, 10)] == [[5], [9, 0], [30], [2, 2]]


def test_runs_of_one_length_are_split_together():
    """Each piece of each run was a slice and a look-up of its own, and every end a loop over the pieces."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(60)})
    costs = np.array([rng.choice([1.0, 2.0, 2.5, 4.0, 30.0]) for _ in words])
    often, rare = dict(zip(words[::2], costs[::2])), dict(zip(words[1::2], costs[1::2]))
    lengths, reach = sorted({len(w) for w in words}), 9
    for length in (1, 2, 5, 9, 10, 23):
        runs = ["".join(rng.choices("abcABCz", k=length)) for _ in range(40)]
        spots = [[(s, s + n, r.lower()[s : s + n]) for s in range(length) for n in lengths if s + n <= length] for r in runs]
        rarer = [[{"start": s, "end": e, "cost": rare[w]} for s, e, w in mine if w in rare] or None for mine in spots]
        known = [{(s, e): costs[words.index(w)] for s, e, w in mine if w in often or w in rare} for mine in spots]
        found = reading.cheapest_of(reading._letters(runs), reading._Prices(list(often), np.array(list(often.values()))), lengths, reach, rarer)
        for begins, mine in zip(found.tolist(), known):
            cuts, at = [], length
            while at > 0:
                at = begins[at]
                cuts.append(at)
            assert cuts[::-1] == reading.cheapest(length, mine, reach)


def test_texts_are_repaired_once(spark):
    rows = spark.createDataFrame([(1, "mudloss at 2,500mof Pumprate (mudloss)"), (2, None), (1, "Mudloss mudloss ñmudloss"), (None, "pumprate")], "id int, text string")
    words = spark.createDataFrame([("mud", 9), ("loss", 9), ("pump", 5), ("rate", 5), ("at", 7), ("of", 3)], "word string, n long")
    made = reading.recovered(rows, words, ["id"])
    assert "regexp_replace" not in made._jdf.queryExecution().optimizedPlan().toString()  # three times, before
    assert sorted((r.id or 0, r.text or "") for r in made.collect()) == [(0, "pump rate"), (1, "Mud loss mud loss ñmud loss"), (1, "mud loss at 2,500 m of Pump rate (mud loss)"), (2, "")]


def test_stations_are_dealt_once(spark, sf):
    """Stations, points and both as-of unions were each shuffled again, four times the rows of the table."""
    made = records.survey_md_at_tvd(spark, sf)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan parquet")
    left = spark.createDataFrame([(1, "a", 5.0, "x"), (1, "b", 1.0, "y"), (2, "a", 9.0, "z"), (None, "a", 9.0, "n")], "k int, g string, at double, v string")
    right = spark.createDataFrame([(1, "a", 4.0, 1, 40), (1, "a", 4.0, 2, 41), (1, "a", 6.0, 1, 60), (2, "b", 1.0, 1, 10)], "k int, g string, t double, n int, w int")
    found = intervals.asof_join(left, right, ["k", "g"], "at", "t", "n", ["w"])
    assert found.columns == ["k", "g", "at", "v", "asof_t", "w"]
    assert {r.v: (r.k, r.g, r.asof_t, r.w) for r in found.collect()} == {"x": (1, "a", 4.0, 41), "y": (1, "b", None, None), "z": (2, "a", None, None), "n": (None, "a", None, None)}


def test_rising_pairs_are_measured_once(spark):
    """Each pair was measured in both orders, and one of the two dropped."""
    rng = random.Random(3)
    rows = [(k, i, *(None if rng.random() < 0.05 else rng.uniform(0, 90) for _ in range(3))) for k in "ab" for i in "cdefghij" for _ in range(rng.randrange(1, 6))]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0, 1.0)], "key string, id string, x double, y double, z double")
    sides = df.withColumnRenamed("id", "l"), df.withColumnRenamed("id", "r")
    both = {(r.key, r.l, r.r): r.distance for r in trajectory.all_distances(*sides, ["key"], ("l", "r"), block=3).collect()}
    made = trajectory.min_distance(*sides, ["key"], ("l", "r"), rising=True)
    found = {(r.key, r.l, r.r): r.distance for r in made.collect()}
    assert len(both) == 2 * 8 * 7 and found == {k: d for k, d in both.items() if k[1] < k[2]}
    assert found == {(r.key, r.l, r.r): r.distance for r in trajectory.all_distances(*sides, ["key"], ("l", "r"), block=3, rising=True).collect()}


def test_profiles_of_few_items_are_compared_by_bits(spark):
    """A join on the items of prefixes met most pairs several times where there are few items."""
    rng = random.Random(4)
    for letters, how in (("abcdefghijkl", {"block": 7}), ("abcdefghijkl", {"most": 5}), ([f"i{k}" for k in range(150)], {"block": 40})):
        held = {f"e{i}": frozenset(rng.sample(letters, rng.randrange(1, 9))) for i in range(90)} | {"x": frozenset(letters[:6]), "y": frozenset(letters[:7]), "z": frozenset(letters[:6])}
        members = profiles.profiles(spark.createDataFrame([(i, x) for i, s in held.items() for x in s], "e string, i string"), "e", "i")
        found = profiles.alike_with(members.withColumn("n", F.length("entity")), 0.6, ["n"], **how)
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == ("most" in how)
        heads = {min(i for i in held if held[i] == s): s for s in held.values()}
        want = {(a, b, len(a), len(b), len(s & t)): len(s & t) / len(s | t) for a, s in heads.items() for b, t in heads.items() if a < b and len(s & t) >= 0.6 * len(s | t)}
        rows = found.collect()
        assert len(rows) == len(want) > 0 and {(r.left, r.right, r.n_left, r.n_right, r.common): r.jaccard for r in rows} == want
    assert profiles.alike_with(members.where("false").withColumn("n", F.lit(1)), 0.6, ["n"]).count() == 0
