"""Queries of report reading, top picks, false alarms, citations and answers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boresight.operators import evaluate, questions, reading, records, retrieval
from boresight.sources.tables import table


def document_meta(spark: SparkSession, d: str) -> DataFrame:
    """What headers made of the orders say, read back from their text; five bores are known."""
    o = table(spark, d, "orders")
    kind = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'DAILY  DRILLING REPORT' WHEN 1 THEN 'Well completion report' ELSE 'Memo' END")
    depth = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.when(F.col("o_custkey") % 2 == 0, " ft").otherwise(" mtrs"))
    text = F.concat(kind, F.lit("\nWell : Well "), F.expr("char(65 + o_custkey % 9)"), F.lit(" Date : "), F.upper(F.date_format("o_orderdate", "d-MMM-yyyy")), F.lit("\nDepth @ 06:00 : "), depth)
    pages = o.select(F.concat(F.expr("char(65 + o_orderkey % 7)"), F.lit("-"), F.col("o_orderkey")).alias("doc_id"), text.alias("text"))
    return reading.document_meta(pages, table(spark, d, "nation").where("n_nationkey < 5").select(F.expr("char(65 + n_nationkey)").alias("well_id")))


DOCUMENT_META = """WITH o AS (SELECT *, chr((65 + o_orderkey % 7)::INT) f, chr((65 + o_custkey % 9)::INT) t FROM orders), w AS (SELECT *, CASE WHEN t <= 'E' AND f > 'E' THEN t ELSE f END well_id FROM o)
SELECT f || '-' || o_orderkey doc_id, well_id, CASE o_orderkey % 3 WHEN 0 THEN 'DDR' WHEN 1 THEN 'WCR' ELSE 'OTHER' END doc_type, o_orderdate::DATE report_date,
  floor(o_totalprice)::DOUBLE * CASE WHEN o_custkey % 2 = 0 THEN 0.3048::DOUBLE ELSE 1 END header_depth, CASE WHEN t = well_id THEN 'match' ELSE 'mismatch' END identity_check FROM w"""


def recovered_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lost spaces before words on a to f, repaired by the vocabulary of the documents as they are."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    torn = docs.withColumn("text", F.regexp_replace("text", r"(?<=[a-z]{3}) (?=[a-f][a-z]{2})", ""))
    return reading.recovered(torn, reading.word_counts(docs), ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"))


def _bores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - 1704067200
    made = table(spark, d, "events").select((F.col("user_id") % 25).cast("int").alias("session"), t.alias("t"), (2700 + t / 2592000 * 300).alias("hole_md"))
    top = 2700.0 + F.col("s_suppkey") * 37 % 300
    return made, table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("session"), F.col("s_suppkey").cast("long").alias("code"), top.alias("md_top"), (top + F.col("s_suppkey") % 7 - 3).alias("md_prognosed"))


_BORES = """r AS (SELECT (user_id % 25)::INT AS session, epoch_us(ts) / 1e6::DOUBLE - 1704067200 t FROM events), b AS (SELECT session, min(t) t0 FROM r GROUP BY 1),
s AS (SELECT s_nationkey::INT AS session, s_suppkey::BIGINT code, (2700 + s_suppkey * 37 % 300)::DOUBLE md_top, (2700 + s_suppkey * 37 % 300 + s_suppkey % 7 - 3)::DOUBLE md_prognosed FROM supplier),
k AS (SELECT session, code, md_top, md_prognosed, min(t) t FROM s JOIN r USING (session) WHERE 2700 + t / 2592000 * 300 >= md_top + 2 GROUP BY ALL)"""


def top_picks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as tops of their nation's bore: when each is passed and what was expected."""
    return reading.first_picks(*_bores(spark, d)).withColumn("t", F.round("t", 3))


TOP_PICKS = f"""WITH {_BORES} SELECT session, code, md_top, md_prognosed, round(t, 3) t, md_prognosed + lag(md_top - md_prognosed, 1, 0.0::DOUBLE) OVER w md_expected, (row_number() OVER w)::INT AS version, t > t0 told
FROM k JOIN b USING (session) WINDOW w AS (PARTITION BY session ORDER BY md_top, code)"""


def track_versions(spark: SparkSession, d: str) -> DataFrame:
    """Records of each bore by the number of tops picked by then."""
    made, tops = _bores(spark, d)
    return reading.add_version(made, reading.first_picks(made, tops)).groupBy("session", "version").agg(F.count("*").alias("n_records"))


TRACK_VERSIONS = f"""WITH {_BORES}, v AS (SELECT r.session, r.t, count(k.t)::INT AS version, count(DISTINCT r.t) one FROM (SELECT *, row_number() OVER () n FROM r) r LEFT JOIN k ON r.session = k.session AND k.t <= r.t GROUP BY r.session, r.t, r.n)
SELECT session, version, count(*) n_records FROM v GROUP BY 1, 2"""


def false_alarm_rates(spark: SparkSession, d: str) -> DataFrame:
    """Users as segments of four kinds, values as the probability of two families."""
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("SP", "LC", "TQ", None))), (F.col("user_id") % 4 + 1).cast("int"))
    scored = e.select(F.col("user_id").alias("segment"), kind.alias("kind"), F.explode(F.array(F.lit("SP"), F.lit("LC"))).alias("family"), F.col("event_id").alias("t"), (F.col("value") / 100).alias("p"))
    rates = evaluate.false_alarm_rates(scored, [0.3, 0.5, 0.7])
    return rates.withColumn("false_per_day", F.round("false_per_day", 4))


FALSE_ALARM_RATES = """WITH s AS (SELECT user_id, ['SP', 'LC', 'TQ', NULL][user_id % 4 + 1] kind, unnest(['SP', 'LC']) family, event_id, value / 100 p FROM events),
k AS (SELECT * FROM s WHERE kind IS NULL OR (kind <> family AND NOT (kind = 'TQ' AND family = 'SP'))), x AS (SELECT *, unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) threshold FROM k),
i AS (SELECT *, coalesce(p >= threshold, false) f, sum((NOT coalesce(p >= threshold, false))::INT) OVER (PARTITION BY user_id, family, threshold ORDER BY event_id) island FROM x),
a AS (SELECT *, sum(f::INT) OVER (PARTITION BY user_id, family, threshold, island ORDER BY event_id) streak FROM i)
SELECT family, threshold, round(count(*) FILTER (f AND streak = 2) / (count(*) * 10 / 3600.0::DOUBLE) * 24, 4) false_per_day FROM a GROUP BY 1, 2"""


def answer_check(spark: SparkSession, d: str) -> DataFrame:
    """Sentences on order lines that cite one of two notes; kept where the note bears out their numbers, commas and all."""
    quantity, number = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    note = lambda n: F.concat(F.lit("of line "), number, F.lit(f" note {n} says "), quantity + (F.col("l_orderkey") + n) % 3)
    told = F.concat(F.lit("Line "), number, F.lit(" holds "), F.when(number == 2, F.concat(F.lit("2,"), quantity)).otherwise(quantity.cast("string")), F.lit(" ["), number % 4, F.lit("]."))
    sentences = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", told.alias("sentence"), F.array(note(1), note(2)).alias("cited"))
    return retrieval.verify_answer(sentences).select("l_orderkey", "l_linenumber", "sentence")


ANSWER_CHECK = """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::INT q, l_linenumber::INT n, (l_linenumber % 4)::INT r FROM lineitem),
c AS (SELECT *, 'of line ' || n || ' note ' || r || ' says ' || (q + (l_orderkey + r) % 3) note FROM s WHERE r BETWEEN 1 AND 2),
d AS (SELECT *, CASE WHEN n = 2 THEN '2,' ELSE '' END || q told FROM c)
SELECT l_orderkey, l_linenumber, 'Line ' || n || ' holds ' || told || ' [' || r || '].' sentence FROM d WHERE contains(note, n::VARCHAR) AND contains(note, told)"""


def citing_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the events that name it as one of their two sources."""
    source = lambda c: F.struct(c.cast("long").alias("doc_id"))
    events = table(spark, d, "events").select("event_id", F.array(source(F.col("user_id")), source(F.col("event_id") % 9973)).alias("provenance"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"))
    return records.citing(events, docs).select("doc_id", F.array_join("event_ids", ",").alias("event_ids"))


CITING_DOCUMENTS = """WITH c AS (SELECT event_id, user_id doc_id FROM events UNION SELECT event_id, event_id % 9973 FROM events), g AS (SELECT doc_id, string_agg(event_id, ',' ORDER BY event_id) ids FROM c GROUP BY 1)
SELECT doc_id::BIGINT doc_id, coalesce(ids, '') event_ids FROM documents LEFT JOIN g USING (doc_id)"""


def kept_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of an order's lines without those that overlap an earlier one."""
    start = (F.col("l_linenumber") * 3).cast("long")
    spans = table(spark, d, "lineitem").select("l_orderkey", start.alias("start"), (start + F.col("l_quantity").cast("long") % 8).alias("end"))
    return records.merge_spans(spans, ["l_orderkey"])


KEPT_SPANS = """WITH RECURSIVE s AS (SELECT l_orderkey, (l_linenumber * 3)::BIGINT AS start, (l_linenumber * 3)::BIGINT + l_quantity::BIGINT % 8 AS "end" FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY start, "end") n FROM s),
f AS (SELECT l_orderkey, n, start, "end", true AS kept, "end" AS far FROM o WHERE n = 1
  UNION ALL SELECT o.l_orderkey, o.n, o.start, o."end", o.start >= f.far, CASE WHEN o.start >= f.far THEN o."end" ELSE f.far END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1)
SELECT l_orderkey, start, "end" FROM f WHERE kept"""


_HEADS = ["Losses in well B", "well A, C & D:", "within 12 km of well A", "wells D and XY", "3 km long section,", "nearby problems in", "Wells A", "no name"]


def question_scope(spark: SparkSession, d: str) -> DataFrame:
    """Bores that the turns of users and the headings made of them are about: A is the active one, with B and C around it."""
    head = F.element_at(F.array(*map(F.lit, _HEADS)), ((F.col("conv_id") + F.col("turn")) % len(_HEADS) + 1).cast("int"))
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", head, "text").alias("text"))
    named = questions.named_wells(F.col("text"), F.array(*map(F.lit, "ABCD")))
    parts = questions.parse(F.col("text"))
    wells = questions.scope(named, parts["nearby"], parts["radius_km"], F.lit("A"), F.array(F.lit("B"), F.lit("C")))
    return asked.select("conv_id", "turn", F.array_join(wells, ",").alias("wells"))


_IN = lambda p: f"regexp_matches(t, '{p}')"
QUESTION_SCOPE = rf"""WITH q AS (SELECT conv_id, turn, concat_ws(' ', {_HEADS!r}[(conv_id + turn) % {len(_HEADS)} + 1], text) t FROM conversations WHERE role = 'user'),
g AS (SELECT *, regexp_extract_all(t, '{questions.NAMED}', 1) g1, regexp_extract_all(t, '{questions.NAMED}', 2) g2, regexp_extract_all(t, '{questions.NAMED}', 3) g3 FROM q),
p AS (SELECT *, [w FOR w IN flatten([[g1[i], g2[i], g3[i]] FOR i IN range(1, len(g1) + 1)]) IF w IN ('A', 'B', 'C', 'D')] named, {_IN(questions.NEARBY)} near, TRY_CAST(nullif(regexp_extract(t, '{questions.RADIUS}', 1), '') AS DOUBLE) IS NOT NULL far FROM g)
SELECT conv_id, turn, CASE WHEN len(named) = 0 THEN CASE WHEN near OR far THEN 'B,C' END WHEN list_contains(named, 'A') AND near AND far THEN 'B,C'
  WHEN len([w FOR w IN named IF w <> 'A']) = 0 THEN array_to_string(named, ',') ELSE array_to_string([w FOR w IN named IF w <> 'A'], ',') END wells FROM p"""


FUNCTIONS = (document_meta, recovered_text, top_picks, track_versions, false_alarm_rates, answer_check, citing_documents, kept_spans, question_scope)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
