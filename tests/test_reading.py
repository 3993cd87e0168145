"""Repair of recognised text against plain loops; the stream's feature state against batch, however the stream is cut."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from boresight.operators import features, reading
from boresight.streaming.buffers import buffered_stream

LINES = {
    "lost 30bb l of mud": "lost 30 bbl of mud",
    'drilled 121/4" hole': 'drilled 12 1/4" hole',
    "at 2,951minBarail": "at 2,951 m in Barail",
    "at 2951mtrs MD": "at 2951 mtrs MD",
    "at 99minutes": "at 99 minutes",
    "from 1.2.345msand": "from 1.2.345 msand",
    "(done).Then ran:casing,9in": "(done). Then ran: casing,9 in",
    "StuckPipe atDEPTH": "Stuck Pipe at DEPTH",
    "Well closed.Pressure rose": "Well closed. Pressure rose",
    "": "",
}


def test_repairs(spark):
    df = spark.createDataFrame([(k,) for k in LINES], "text string").select("text", reading.repaired(F.col("text")).alias("new"))
    assert {r.text: r.new for r in df.collect()} == LINES


def _all_splits(run: str, counts: Counter) -> float:
    """The least cost by trying every split."""
    total = sum(counts.values())
    price = lambda w: -math.log(counts[w] / total) if w in counts else 12.0 + 3.0 * len(w)
    best = math.inf
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        pieces, last = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                pieces.append(run[last:i])
                last = i
        best = min(best, sum(price(p) for p in [*pieces, run[last:]]))
    return best


def test_split_is_cheapest(spark):
    rng = random.Random(5)
    counts = Counter({w: rng.randint(1, 50) for w in ("ab", "abc", "ca", "b", "cab", "bb", "stuck", "pipe", "at")})
    runs = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 11))) for _ in range(40)} | {"StuckPipeat", "zzzzzzz", "stuckxpipe"})
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.run: r.split for r in reading.split_runs(spark.createDataFrame([(r,) for r in runs], "run string"), words).collect()}
    assert got.keys() == set(runs)
    total = sum(counts.values())
    for run, split in got.items():
        assert split.replace(" ", "") == run
        cost = sum(-math.log(counts[p] / total) if p in counts else 12.0 + 3.0 * len(p) for p in split.lower().split(" "))
        assert cost == pytest.approx(_all_splits(run.lower(), counts))
    assert got["StuckPipeat"] == "Stuck Pipe at"


def test_recovered_rows(spark):
    words = reading.word_counts(spark.createDataFrame([("the pipe got stuck in the hole, the hole was tight 12.5",), (None,), ("",)], "text string"))
    rows = spark.createDataFrame([(1, "thepipegotstuck!\nthehole", "x"), (1, "thepipegotstuck!\nthehole", "x"), (None, "inthehole tight", "y"), (2, None, "z"), (3, "", "w")], "doc_id long, text string, split string")
    got = reading.recovered(rows, words, ["doc_id"])
    assert got.columns == rows.columns
    want = [(1, "the pipe got stuck!\nthe hole", "x")] * 2 + [(None, "in the hole tight", "y"), (2, None, "z"), (3, "", "w")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert reading.recovered(rows.limit(0), words, ["doc_id"]).count() == 0
    assert reading.recovered(rows, words.limit(0), ["doc_id"]).count() == 5


def test_recovery_gives_spaces_back(spark, sf):
    """Glued words of real documents come apart into words of the vocabulary."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", "text")
    words = reading.word_counts(docs)
    torn = docs.withColumn("text", F.regexp_replace("text", r"(?<=[a-z]{3}) (?=[a-f][a-z]{2})", ""))
    plain = {r.doc_id: reading_words(r.text) for r in docs.collect()}
    before = {r.doc_id: reading_words(r.text) for r in torn.collect()}
    after = {r.doc_id: reading_words(r.text) for r in reading.recovered(torn, words, ["doc_id"]).collect()}
    missing = lambda found: sum(sum((plain[d] - found[d]).values()) for d in plain)
    assert missing(after) < 0.2 * missing(before)


def reading_words(text: str) -> Counter:
    return Counter(w for w in re.findall("[A-Za-z]+", text.lower()))


def test_document_meta_of_odd_pages(spark):
    pages = spark.createDataFrame([("A-1", None), ("B-2", ""), ("Q-3", "Well : Well A A completion Date : 31-Feb-2020 Depth @ 06:00 : 1.2.3 m"), ("A", "Well: Well B Date: 5-jan-2020 DAILYDRILLING Depth@06:00:1,000ft"), (None, "x")], "doc_id string, text string")
    wells = spark.createDataFrame([("A",), ("B",), ("AA",), (None,)], "well_id string")
    got = {r.doc_id: (r.well_id, r.doc_type, str(r.report_date), r.header_depth and round(r.header_depth, 1), r.identity_check) for r in reading.document_meta(pages, wells).collect()}
    assert got == {"A-1": ("A", "OTHER", "None", None, "unreadable"), "B-2": ("B", "OTHER", "None", None, "unreadable"), "Q-3": ("AA", "WCR", "None", None, "match"), "A": ("A", "DDR", "2020-01-05", 304.8, "mismatch"), None: (None, "OTHER", "None", None, "unreadable")}


FIELDS = ["flow_in", "flow_out", "pit", "spp", "torque", "rop", "gas", "dxc", "on_bottom"]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    """Features of a stream cut at random are those of the whole batch."""
    rng = random.Random(seed)
    rows = []
    for session in ("a", "b"):
        bottom = 1.0
        for i in range(260):
            bottom = bottom if rng.random() < 0.8 else 1.0 - bottom
            rows.append((session, float(i * 10), rng.uniform(480, 560), rng.uniform(480, 560), rng.uniform(0, 40), rng.uniform(100, 200), rng.uniform(5, 20), rng.uniform(1, 30), rng.uniform(0, 5), None if rng.random() < 0.1 else rng.uniform(1, 2), bottom, rng.uniform(80, 130)))
    names = ["session", "t", *FIELDS, "hookload"]
    pdf = pd.DataFrame(rows, columns=names).sort_values(["t", "session"]).reset_index(drop=True)
    schema = ", ".join(["session string", *(f"{n} double" for n in names[1:])])
    clean = [tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False, name=None)]
    cuts = sorted({0, len(clean), *rng.sample(range(1, len(clean)), 3)})
    folder = str(tmp_path / "feed")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = clean[a:b]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    made = features.run_overpull(spark.createDataFrame(clean, schema), ["session"], "t", F.col("on_bottom") == 0, "hookload")
    wanted = features.add_features(features.buffered(made, ["session"], "t", FIELDS).select("session", "t", "overpull", "buffer"))

    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("off", F.col("on_bottom") == 0)
    query = features.add_features(buffered_stream(feed, FIELDS, [])).writeStream.format("memory").queryName(f"features_{seed}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    rounded = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())
    assert rounded(spark.table(f"features_{seed}")) == rounded(wanted)
