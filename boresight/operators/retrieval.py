"""Corpus statistics, BM25 with domain boosts, sentence selection, answers from evidence, case ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.4, 0.75
OUTCOME_WEIGHT = {"resolved": 1.0, "partial": 0.5, "failed": -0.5, "unknown": 0.2}
# K1, B and OUTCOME_WEIGHT above, and the words that are no search terms.
STOP = (
    "a an the of in on at to for from and or is was were be been with by what which who how did do does any all there this that "
    "these those it its as into about near nearby well wells happen happened occur occurred problem problems issue issues "
    "encountered seen observed show tell me please give list"
).split()


def stem(w: Column) -> Column:
    """One of the endings ing, ed, es, s off words of more than four letters."""
    out = w
    for ending in ("s", "es", "ed", "ing"):  # the last test wins
        out = F.when((F.length(w) > 4) & w.endswith(ending), F.substring(w, F.lit(1), F.length(w) - len(ending))).otherwise(out)
    return out


def words(text: Column, stop: tuple[str, ...] | list[str] = STOP) -> Column:
    """Lower-case words that are no stop words, not stemmed."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:-[a-z0-9]+)?"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop))


def tokens(text: Column, stop: tuple[str, ...] | list[str] = STOP) -> Column:
    """Lower-case terms; stop words go before stemming."""
    return F.transform(words(text, stop), stem)


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, term, tf, doc_len`` of a text column.

    The length is taken before the explode: beside it, Spark would split the text again for each term. Stems are made after
    it, where the expression is compiled.
    """
    listed = docs.select(doc_id, words(F.col(text)).alias("__terms")).select(doc_id, F.size("__terms").alias("doc_len"), "__terms")
    exploded = listed.select(doc_id, "doc_len", F.explode("__terms").alias("word")).select(doc_id, "doc_len", stem(F.col("word")).alias("term"))
    return exploded.groupBy(doc_id, "term", "doc_len").agg(F.count("*").alias("tf"))


def corpus_idf(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf`` of postings; ``stats(n_docs, ...)`` is one row."""
    df = posted.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats.select("n_docs")))
    return df.select("term", "df", F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(posted: DataFrame, stats: DataFrame, queries: DataFrame, doc_id: str, k: int) -> DataFrame:
    """Top ``k`` documents of each query; ``queries(query_id, term, weight)``, ``stats(n_docs, avg_len)`` is one row.

    Only postings of query terms are joined; score ties go to the greater doc id.
    """
    terms = queries.select("term").distinct()
    near = posted.join(terms, "term", "left_semi")
    scored = near.join(corpus_idf(near, stats), "term").join(F.broadcast(stats)).join(queries, "term")
    part = F.col("weight") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.greatest("avg_len", F.lit(1e-9))))
    totals = scored.groupBy("query_id", doc_id).agg(F.round(F.sum(part), 4).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(doc_id))
    return totals.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def boosted(base: Column, has_type: Column, family_hit: Column, formation_hit: Column, depth_gap: Column) -> Column:
    """Boosts on top of a positive base score."""
    x = F.when(has_type, base).otherwise(base * 0.5)
    more = 3.0 * family_hit.cast("int") + 2.0 * formation_hit.cast("int") + F.coalesce(1.5 * F.exp(-depth_gap / 50), F.lit(0.0))
    return F.when(x > 0, x + more).otherwise(x)


def select_sentences(candidates: DataFrame, key: str, per_chunk: int = 3, most: int = 6) -> DataFrame:
    """Best sentences of each question: score order, no repeats by ``dedupe``, at most ``per_chunk`` of a chunk and ``most`` in all.

    A sentence that its chunk's cap turns away doesn't mark its text as used, so the choice is a fold over the ordered
    candidates of one question (a handful of hits), not two rankings.
    """
    item = F.struct((-F.col("score")).alias("minus"), "chunk_id", "sent_no", "dedupe", "sentence")
    lists = candidates.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.filter(F.slice("items", 1, 0), lambda x: F.lit(True))

    def step(taken: Column, x: Column) -> Column:
        fresh = ~F.exists(taken, lambda y: y["dedupe"] == x["dedupe"])
        room = (F.size(F.filter(taken, lambda y: y["chunk_id"] == x["chunk_id"])) < per_chunk) & (F.size(taken) < most)
        return F.when(fresh & room, F.concat(taken, F.array(x))).otherwise(taken)

    chosen = lists.withColumn("items", F.aggregate("items", start, step))
    return chosen.select(key, F.posexplode("items").alias("place", "x")).select(key, "place", "x.chunk_id", "x.sent_no", "x.sentence", (-F.col("x.minus")).alias("score"))


def verify_answer(sentences: DataFrame, cited: str = "cited") -> DataFrame:
    """Keep answer sentences that cite ``[n]`` within the evidence and hold no number missing from the cited texts.

    A number is a digit with the digits, commas and stops behind it, without those at its end: "2,951" is looked for whole.
    """
    refs = F.transform(F.regexp_extract_all("sentence", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    plain = F.regexp_replace("sentence", r"\[\d+\]", "")
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(r"\d[\d,.]*"), F.lit(0)), lambda n: F.regexp_replace(n, "[.,]+$", ""))
    valid = (F.size(refs) > 0) & F.forall(refs, lambda r: (r >= 1) & (r <= F.size(cited)))
    texts = F.concat_ws(" ", F.transform(refs, lambda r: F.get(F.col(cited), r - 1)))
    return sentences.where(valid & F.forall(numbers, lambda n: F.contains(texts, n)))


def rank_actions(cases: DataFrame, key: list[str], top: int) -> DataFrame:
    """Actions by weighted outcomes of similar cases: ``cases(key, action, outcome, sim, cost)``.

    Adds score, counts by outcome, success rate, median cost and the place within the key.
    """
    weight = F.lit(OUTCOME_WEIGHT["unknown"])
    for outcome, w in OUTCOME_WEIGHT.items():
        weight = F.when(F.col("outcome") == outcome, w).otherwise(weight)
    n = lambda o: F.count_if(F.col("outcome") == o)
    found = cases.groupBy(*key, "action").agg(F.round(F.sum(F.col("sim") * weight), 4).alias("score"), F.count("*").alias("n"), n("resolved").alias("resolved"), n("partial").alias("partial"), n("failed").alias("failed"), F.round(F.median(F.when(F.col("cost") > 0, F.col("cost"))), 4).alias("median_cost"))
    rated = found.withColumn("success", F.round((F.col("resolved") + 0.5 * F.col("partial")) / F.col("n"), 4))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "action"))
    return rated.withColumn("place", place).where(F.col("place") <= top)


def case_similarity(same_type: Column, family_weight: Column, relevance: Column, ops: Column, param: Column, same_layer: Column) -> Column:
    return 0.35 * F.when(same_type, 1.0).otherwise(0.5) * family_weight + 0.25 * relevance + 0.15 * ops + 0.15 * param + 0.10 * same_layer.cast("int")
