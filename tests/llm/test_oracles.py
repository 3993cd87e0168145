"""Operators that SQL can express: whole tables against their SQL, and odd tables against SQL or brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boresight.llm import divergence, fingerprints, negatives, queries
from tests.oracle import database, spark_rows, sql_rows

ORACLES = queries.oracle_sql()
rng = random.Random(8)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_whole_table(spark, sf, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == sql_rows(database(sf), ORACLES[name])


VOCABULARY = ["".join(rng.choice("abcdeäß😀") for _ in range(rng.randrange(1, 5))) for _ in range(200)]
PROSE = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
DOCS = [
    *[(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "é"])) for i, t in enumerate(PROSE)],
    *[(1000, "Hot hot HOT wörd-wörd 7x", "en", "a")] * 90,
    (1001, None, "en", "b"), (1002, "", "en", "only"), (1003, "12 34 \t\x00\x0b", "xx", "none"), (1004, "...", "yy", "z"), (None, "null id", "en", "a"), (None, "null id, two", None, None),
    (2000, " ".join(rng.choice(VOCABULARY) for _ in range(50_000)), "en", "long"), (-5, "😀" * 7, "de", "b"),
]
CLASHES = ("n", "term", "total", "terms", "value", "rank", "part", "item", "bucket", "at", "side", "words", "info", "mask", "guest", "text_", "a", "b", "tile", "block", "score", "slot", "positives", "row")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    df.coalesce(3).write.parquet(f"{folder}/spark")
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{folder}/spark"), f"{folder}/documents.parquet")
    return str(folder)


def as_rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_divergence_of_odd_rows(spark, odd):
    found = divergence.divergences(spark.read.parquet(f"{odd}/documents.parquet"))
    assert spark_rows(found) == sql_rows(database(odd), divergence.ORACLE_SQL)
    small = divergence.postings(spark.read.parquet(f"{odd}/documents.parquet"), entries=10)  # handed on after nearly each text
    whole = divergence.postings(spark.read.parquet(f"{odd}/documents.parquet"))
    plain = lambda df: as_rows(df.select("lang", "term", "n", F.sort_array("sources").alias("s")), "lang", "term", "n", "s")
    assert plain(small) == plain(whole)


def test_shares_are_exact_beyond_a_long(spark):
    n = 99_999_999_999_999
    df = spark.createDataFrame([(n, 3 * n, 17)], "n long, total long, terms long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"), 10**9).alias("p")).first().p == 1 + 10**9 * (n + 1) // (3 * n + 17)


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 20_000])
def test_fingerprints_of_odd_rows(spark, odd, bucket_bytes):
    found = fingerprints.fingerprints(spark.read.parquet(f"{odd}/documents.parquet"), bucket_bytes=bucket_bytes)
    assert spark_rows(found) == sql_rows(database(odd), fingerprints.ORACLE_SQL)


def test_fingerprints_merge_a_large_lexicon(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    wanted = spark_rows(fingerprints.fingerprints(docs))
    monkeypatch.setattr(fingerprints, "BROADCAST_BYTES", 0)
    assert spark_rows(fingerprints.fingerprints(docs)) == wanted


def test_one_document_is_its_own_next(spark):
    row = fingerprints.fingerprints(spark.createDataFrame([(4, "abcdef gh")], "doc_id long, text string")).first()
    import hashlib

    assert row.edited_sha256 == hashlib.sha256(b"abcdeabcd").hexdigest() and row.near_next == 1.0


def test_equal_texts_and_edits(spark):
    words = [f"w{i}" for i in range(12000)]
    texts = [" ".join(rng.sample(words, 200)) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts), (900, texts[0]), (901, texts[0] + " tail")], "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert rows[900].fingerprint == rows[0].fingerprint
    assert rows[901].near_next > 0.8  # the next of 901 is 900
    half = [rows[i].near_edited for i in range(400)]
    other = [rows[i].near_next for i in range(1, 400)]
    assert sum(half) / len(half) > 0.1 > 0.02 > sum(other) / len(other)


def test_native_plans(spark, sf):
    plan = fingerprints.fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergences(docs).collect() == [] and fingerprints.fingerprints(docs).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def brute(rows, every=100, positives=5, negatives_=10):
    ok = {}
    for v, e, label in rows:
        if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            new = (int(math.fmod(label + 1, 10)) if v % 7 == 0 else label, list(e))
            ok[v] = min(ok.get(v, new), new)
    whole = {v: (label, [math.floor(256 * x) for x in e]) for v, (label, e) in ok.items()}
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[a][1], whole[b][1]))))
    out = []
    for a in whole:
        if a % every == 0:
            all_ = sorted((-score(a, b), b) for b in whole if b != a)
            for p, pid in [x for x in all_ if whole[x[1]][0] == whole[a][0]][:positives]:
                fit = [x for x in all_ if whole[x[1]][0] != whole[a][0] and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives_]
                out += [(a, pid, r, n, -p, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def vectors(dim, n, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(10)) for i in range(n)]


HIT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
HARD = {
    "plain": vectors(40, 500, 0.5),
    "tight": vectors(20, 400, 0.01),
    "hot": vectors(8, 300, 1.0) + [(i, [0.5] * 8, i % 10) for i in range(300, 800)],
    "odd": vectors(6, 250, 1.0) + [(-100, [1.0] * 6, -3), (-7, [1.0] * 6, -3), (300, None, 1), (301, [1.0, None], 1), (302, [math.nan], 1), (303, [math.inf], 2), (304, [1.0], None), (None, [1.0], 1), (400, [], 2), (401, [3.0], 2), (402, [1.0] * 9, 5), (403, [0.0] * 6, 5), (500, [1.0] * 6, 4), (500, [1.0] * 6, 4), (500, [2.0], 4)],
    "huge": vectors(5, 150, 1.0) + [(200 + i, [10.0 ** (3 * i), -1.0, 2.0, 10.0**i, 0.5], i % 3) for i in range(12)] + [(300, [1e150, 1.0, 1.0, 1.0, 1.0], 1), (301, [1e300, 1.0, 1.0, 1.0, 1.0], 2)],
}


@pytest.mark.parametrize("name", sorted(HARD))
@pytest.mark.parametrize("tile", [1 << 16, 60])
def test_negatives(spark, name, tile):
    df = spark.createDataFrame(HARD[name], "vec_id long, embedding array<double>, label int").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    found = negatives.hard_negatives(df, every=20, tile=tile)
    assert sorted(tuple(r) for r in found.select(*HIT).collect()) == brute(HARD[name], every=20)


def test_bounds_discard(spark):
    """Few products are made where leading components tell."""
    n, dim = 5000, 64
    r = np.random.default_rng(3)
    scales = 2.0 ** -np.arange(dim)
    rows = r.normal(size=(n, dim)) * scales
    mix = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    table = pa.table({"vec_id": np.arange(n), "label": r.integers(0, 10, n), "embedding": pa.array((10 * rows @ mix).tolist(), pa.list_(pa.float64()))})
    whole = negatives.matrix(table["embedding"], dim)
    search = negatives.Search(np.linalg.eigh(whole.T @ whole)[1][:, ::-1].copy(), False, 10)
    side = search.side(table)
    search.run(side.part(slice(0, 50)), side, [[negatives.band(10_000_000)]] * 50)
    assert search.verified < 0.2 * search.compared
