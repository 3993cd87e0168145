"""Queries of text columns, retrieval, event scoring, action ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boresight.functions import text
from boresight.operators import evaluate, events, retrieval
from boresight.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP)
_STEM = "CASE WHEN length(t) > 4 AND t LIKE '%ing' THEN left(t, -3) WHEN length(t) > 4 AND t LIKE '%ed' THEN left(t, -2) WHEN length(t) > 4 AND t LIKE '%es' THEN left(t, -2) WHEN length(t) > 4 AND t LIKE '%s' THEN left(t, -1) ELSE t END"
_TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+(?:-[a-z0-9]+)?'), lambda x: x NOT IN (" + _STOP + "))"
_POSTED = f"""w AS (SELECT doc_id, {_TOKENS.format("text")} l FROM documents), e AS (SELECT doc_id, len(l) doc_len, unnest(l) t FROM w),
posted AS (SELECT doc_id, doc_len, {_STEM} term, count(*) tf FROM e GROUP BY 1, 2, 3), df AS (SELECT term, count(*) df FROM posted GROUP BY 1)"""


def _posted(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(table(spark, d, "documents"), "doc_id", "text")


def corpus_idf(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").agg(F.count("*").alias("n_docs"))
    return retrieval.corpus_idf(_posted(spark, d), n).select("term", "df", F.round("idf", 4).alias("idf"))


CORPUS_IDF = f"WITH {_POSTED} SELECT term, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 4) idf FROM df"


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents for the terms of each benchmark item."""
    items = table(spark, d, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("term"), F.lit(1.0).alias("weight"))
    stats = table(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.avg(F.size(retrieval.words(F.col("text")))).alias("avg_len"))
    return retrieval.bm25(_posted(spark, d), stats, asked, "doc_id", 5).select("query_id", "doc_id", "score", "place")


BM25_TOPK = f"""WITH {_POSTED}, s AS (SELECT count(*) n, avg(len(l)) a FROM w),
q AS (SELECT DISTINCT item_id query_id, {_STEM} term FROM (SELECT item_id, unnest({_TOKENS.format("text")}) t FROM benchmark)),
x AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * doc_len / a))), 4) score FROM q JOIN posted USING (term) JOIN df USING (term), s GROUP BY 1, 2)
SELECT query_id, doc_id, score, place::INT place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) place FROM x) WHERE place <= 5"""


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).alias("longest"))


_BREAK = r"""regexp_replace({}, '([A-Za-z0-9)"''%][.])\s+([A-Z(0-9])', '\1' || chr(1) || '\2', 'g')"""
SENTENCE_SPLIT = f"""WITH s AS (SELECT doc_id, list_filter(string_split(replace({_BREAK.format(_BREAK.format("text"))}, chr(1), chr(10)), chr(10)), lambda x: trim(x) <> '') l FROM documents)
SELECT doc_id, len(l)::INT n_sentences, coalesce(list_max(list_transform(l, lambda x: length(x))), 0)::INT longest FROM s"""


def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    chunks = text.chunk_words(text.sentences(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "body")).select("doc_id", "chunk", F.sha2("body", 256).alias("body_sha256"))


LEXICON = {"number": "[0-9]{3}", "question": r"\?", "link": "https?://", "list": r"(?m)^[-*] ", "licence": "(?i)licen[cs]e"}


def type_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.tags(F.col("text"), LEXICON), ",").alias("tags"))


TYPE_TAGS = "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in LEXICON.items()) + ") tags FROM documents"


# Blanks instead of word borders, which the two regular expression engines place differently beside letters with marks.
_WORD, _DENIED = r"(?:^|[ \n])(?:the|die|que|le)(?:[ \n]|$)", r"(?:^|[ \n])(no|nil|without|not|never|zero|ni|und)(?:[ \n]+[a-z]+){0,3}[ \n]*$"


def negated_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.affirmed(F.col("text"), _WORD, _DENIED).alias("affirmed"))


NEGATED_TERMS = rf"""WITH p AS (SELECT doc_id, regexp_matches(text, '{_WORD}') has, regexp_extract(text, '(?s)^(.*?){_WORD}', 1) before FROM documents)
SELECT doc_id, coalesce(has AND NOT regexp_matches(right(before, 60), '{_DENIED}'), false) affirmed FROM p"""


def unit_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.greatest(F.size(text.depth_mentions(F.col("text"))), F.lit(0)).alias("n_depths"))


_MEASURE = rf"(?:({text.DIGITS})\s*({text.UNITS})?\s*(?:-|to|up to)\s*)?({text.DIGITS})\s*({text.UNITS})(?:[^A-Za-z0-9/]|$)".replace("'", "''")
_PLAIN = "TRY_CAST(CASE WHEN regexp_matches({0}, '^[0-9]{{1,2}}[.,][0-9]{{3}}$') THEN replace(replace({0}, ',', ''), '.', '') ELSE replace({0}, ',', '') END AS DOUBLE) * CASE WHEN lower({1}) IN ('ft', 'feet', chr(39)) THEN 0.3048 ELSE 1 END"
UNIT_NUMBERS = f"""WITH m AS (SELECT doc_id, {', '.join(f"unnest(regexp_extract_all(text, '{_MEASURE}', {k})) g{k}" for k in (1, 2, 3, 4))} FROM documents),
v AS (SELECT doc_id, g1, g2, {_PLAIN.format("g1", "coalesce(nullif(g2, ''), g4)")} a, {_PLAIN.format("g3", "g4")} b FROM m),
n AS (SELECT doc_id, sum(CASE WHEN g1 <> '' AND a BETWEEN 100 AND 7000 AND b BETWEEN a AND 7000 THEN 1 ELSE (g1 <> '' AND g2 <> '' AND a BETWEEN 100 AND 7000)::INT + (b BETWEEN 100 AND 7000)::INT END)::INT n FROM v GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::INT n_depths FROM documents LEFT JOIN n USING (doc_id)"""


def html_text_usable(spark: SparkSession, d: str) -> DataFrame:
    bare = table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))
    return bare.select("page_id", F.length("body").alias("n_chars"), text.usable(F.col("body")).alias("usable"))


HTML_TEXT_USABLE = r"""WITH b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) body FROM pages)
SELECT page_id, length(body)::INT n_chars, length(regexp_replace(body, '\s+', '', 'g')) >= 50 AND len(regexp_extract_all(body, '[A-Za-z]{2,}')) >= 8 usable FROM b"""


def severity_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    hours = F.when(k % 4 != 0, k % 60).cast("double")
    sure = events.confidence(k % 2 == 0, F.when(k % 3 != 0, k % 3 == 1), k % 5 == 0, k % 7 == 0, k % 11 == 0, k % 13 == 0, k % 17 == 0)
    made = o.select("o_orderkey", events.severity(events.subtype_score(F.element_at(F.array(*map(F.lit, ("total", "severe", "partial", "seepage", "poor bond", ""))), (k % 6 + 1).cast("int"))), hours, F.when(F.col("o_orderstatus") == "F", "failed").otherwise("resolved"), k % 19 == 0).alias("severity"), sure.alias("confidence"))
    return made.withColumn("status", events.review_status(F.col("confidence")))


SEVERITY_CONFIDENCE = """WITH k AS (SELECT *, o_orderkey k, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 60 ELSE 0 END h FROM orders),
s AS (SELECT k o_orderkey, CASE WHEN k % 19 = 0 THEN 0 ELSE greatest(CASE k % 6 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END, CASE WHEN h = 0 THEN 2 WHEN o_orderstatus = 'F' THEN 5 WHEN h < 4 THEN 2 WHEN h < 12 THEN 3 WHEN h < 30 THEN 4 ELSE 5 END) END::INT severity,
  (55 + 20 * (k % 2 = 0)::INT + CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 10 ELSE -15 END + 5 * (k % 5 = 0)::INT + 5 * (k % 7 = 0)::INT - 10 * (k % 11 = 0)::INT - 10 * (k % 13 = 0)::INT - 10 * (k % 17 = 0)::INT) c FROM k)
SELECT o_orderkey, severity, least(greatest(c, 0), 100) / 100.0::DOUBLE confidence, CASE WHEN c >= 80 THEN 'auto' ELSE 'needs_review' END status FROM s"""


def action_ranking(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    outcome = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "partial").otherwise("resolved")
    cases = lines.select("p_brand", F.col("p_type").alias("action"), outcome.alias("outcome"), (1 - F.col("l_discount")).alias("sim"), F.col("l_quantity").alias("cost"))
    return retrieval.rank_actions(cases, ["p_brand"], 3)


ACTION_RANKING = """WITH c AS (SELECT p_brand, p_type AS action, l_returnflag f, 1 - l_discount sim, l_quantity cost FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT p_brand, action, round(sum(sim * CASE f WHEN 'R' THEN -0.5 WHEN 'A' THEN 0.5 ELSE 1.0 END::DOUBLE), 4) score, count(*) n, count(*) FILTER (f NOT IN ('R', 'A')) resolved, count(*) FILTER (f = 'A') partial, count(*) FILTER (f = 'R') failed, round(median(cost) FILTER (cost > 0), 4) median_cost FROM c GROUP BY 1, 2)
SELECT *, round((resolved + 0.5::DOUBLE * partial) / n, 4) success, place::INT place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, action) place FROM a) WHERE place <= 3"""
ACTION_RANKING = ACTION_RANKING.replace("SELECT *, round((", "SELECT * EXCLUDE (place), round((")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


_JUDGED = "j AS (SELECT doc_id, lang, n_chars::DOUBLE score, quality FROM documents JOIN labels USING (doc_id))"


def ndcg_at_5(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ndcg(_judged(spark, d), "lang", "quality", [F.desc("score"), F.col("doc_id")]).withColumn("ndcg", F.round("ndcg", 4))


NDCG_AT_5 = f"""WITH {_JUDGED}, p AS (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) p, row_number() OVER (PARTITION BY lang ORDER BY quality DESC) b FROM j),
s AS (SELECT lang, sum(CASE WHEN p <= 5 THEN quality / log2(p + 1) ELSE 0 END) dcg, sum(CASE WHEN b <= 5 THEN quality / log2(b + 1) ELSE 0 END) ideal FROM p GROUP BY 1) SELECT lang, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 4) ndcg FROM s"""


def auc_ranksum(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc(_judged(spark, d), ["lang"], "quality", "score").withColumn("auc", F.round("auc", 4))


AUC_RANKSUM = f"""WITH {_JUDGED}, pairs AS (SELECT a.lang, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END::DOUBLE) w FROM j a JOIN j b ON a.lang = b.lang AND a.quality = 1 AND b.quality <> 1 GROUP BY 1),
c AS (SELECT lang, count(*) FILTER (quality = 1) p, count(*) FILTER (quality <> 1) n FROM j GROUP BY 1) SELECT lang, p, n, round(w / (p * n), 4) auc FROM c LEFT JOIN pairs USING (lang)"""
LEVELS = [250.0, 500.0, 1000.0, 2000.0]


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_sweep(_judged(spark, d), "quality", "score", LEVELS)


THRESHOLD_SWEEP = f"WITH {_JUDGED}, t AS (SELECT unnest({LEVELS})::DOUBLE threshold) SELECT threshold, count(*) alarms, sum(quality)::BIGINT hits FROM t JOIN j ON score >= threshold GROUP BY 1"


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    truth = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("ord"), "at")
    found = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), "at")
    return evaluate.greedy_match(truth, found, ["user_id"], 2.0).withColumn("distance", F.round("distance", 4))


def typed_event_query(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    near = F.exists(F.array(F.lit(20), F.lit(60)), lambda x: F.abs(F.col("k") - x) <= 5)
    return e.where(F.col("event_type").isin("click", "purchase") & near).select("event_id", "user_id", "event_type", "k")


TYPED_EVENT_QUERY = "WITH e AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INT) k FROM events) SELECT event_id, user_id, event_type, k FROM e WHERE event_type IN ('click', 'purchase') AND (abs(k - 20) <= 5 OR abs(k - 60) <= 5)"


def audit_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 entries of the event log."""
    return events.log_tail(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", 50)


AUDIT_TAIL = "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50"

FUNCTIONS = (corpus_idf, bm25_topk, sentence_split, chunk_words, type_tags, negated_terms, unit_numbers, html_text_usable, severity_confidence, action_ranking, ndcg_at_5, auc_ranksum, threshold_sweep, greedy_match, typed_event_query, audit_tail)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
