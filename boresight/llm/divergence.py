"""Source divergence audit: how far the term distributions of a language's sources lie apart, by exact integers.

Every (lang, source) group gives each term that the language keeps a smoothed share ``p = 1 + scale * (count + 1) div (N + V)``.
The divergence of group g from group h is the sum of ``f(p, q) = (p - q)^2 div q`` over all V kept terms, but no plan touches
all terms of all pairs. By inclusion and exclusion over the supports of g and h, with 0 for an absent term,

    sum = V f(p0, q0) + sum over g's terms of [f(p, q0) - f(p0, q0)] + sum over h's terms of [f(p0, q) - f(p0, q0)]
          + sum over shared terms of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)].

The one-sided sums depend on the counts alone, so a histogram of counts a group (count, number of terms) prices them. The shared terms
come from the postings: the sources of a term are paired within the term, and pairs of groups keep a histogram of count
pairs, which is combined before it is shuffled. The first part is a constant.

Texts are counted where they are read, in dictionaries of a bounded size; counts are shuffled once, by (lang, term). A common
term is one row a task and source. A term has at most as many pairs as its language has pairs of sources, which is the size
of the result. The table of groups is broadcast only if its measured size is under ``BROADCAST_BYTES``, and merged otherwise.

Cases: null text, lang and source count as ''; groups without terms take part with N = 0; a language that keeps no term has
pairs of value 0 and no terms; rows that repeat count each, as a document of its own; sources of the same value rank by
their UTF-8 bytes; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boresight.llm.common import cut

SCALE, LEAST_DOCS, RANKS = 1_000_000_000, 3, 200
ENTRIES = 600_000  # counts that a task holds before it hands them on
BROADCAST_BYTES = 32 << 20

#: All that is no ASCII letter becomes a blank, A-Z becomes a-z; bytes of other characters stay.
_TERMS = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(_TERMS).split()


def _count(entries: int):
    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            columns = [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield from pa.Table.from_arrays(columns, schema=COUNTED).to_batches(100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                terms, before = terms_of(text), len(n)
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
                if size > entries:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    return run


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS, entries: int = ENTRIES) -> DataFrame:
    """``lang, term, n, sources``: kept terms with their count in the language and (source, n) of each source that has them."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(_count(entries), "lang string, source string, term string, n long, docs long")
    sums = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    grouped = sums.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return grouped.where(F.col("docs") >= least_docs).select("lang", "term", "n", "sources")


def share(n: Column, total: Column, terms: Column, scale: int) -> Column:
    """The smoothed share of a term that occurs ``n`` times, as a whole number; exact at any count."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(11,0)"), (total + terms).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_table(docs: DataFrame, posted: DataFrame, scale: int) -> DataFrame:
    """``lang, source, total, terms, lang_total, p0`` of every group that occurs; p0 is the share of an absent term."""
    every = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = posted.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = posted.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    joined = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    return joined.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), scale)).otherwise(1))


def _side(groups: DataFrame, name: str) -> DataFrame:
    return groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"), F.col("p0").alias(f"{name}0"))


def pair_values(posted: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    """``lang, source, item, value`` for each ordered pair of a language's sources."""
    exact = lambda c: c.cast("decimal(38,0)")
    sources = posted.select("lang", "sources", F.inline("sources").alias("a", "na"))
    both = sources.select("lang", "a", "na", F.inline("sources").alias("b", "nb")).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("many"))
    terms = groups.select("lang", "terms").distinct()
    priced = both.join(_side(groups, "a"), ["lang", "a"]).join(_side(groups, "b"), ["lang", "b"]).join(terms, "lang")
    p, q = share(F.col("na"), F.col("a_total"), F.col("terms"), scale), share(F.col("nb"), F.col("b_total"), F.col("terms"), scale)
    priced = priced.select("*", p.alias("p"), q.alias("q"))
    mend = lambda p, p0, q, q0: exact(gap(p, q)) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    x = {c: F.col(c) for c in ("p", "a0", "q", "b0", "many")}
    ways = [(F.col("a"), F.col("b"), mend(x["p"], x["a0"], x["q"], x["b0"])), (F.col("b"), F.col("a"), mend(x["q"], x["b0"], x["p"], x["a0"]))]
    shared = priced.select("lang", F.inline(F.array(*[F.struct(g.alias("source"), h.alias("item"), exact(v * x["many"]).alias("part")) for g, h, v in ways])))
    shared = shared.groupBy("lang", "source", "item").agg(F.sum("part").alias("shared"))

    counts = posted.select("lang", F.inline("sources").alias("g", "n")).groupBy("lang", "g", "n").agg(F.count("*").alias("many"))
    mine = counts.join(_side(groups, "g"), ["lang", "g"]).join(terms, "lang").select("lang", "g", "g0", "many", share(F.col("n"), F.col("g_total"), F.col("terms"), scale).alias("p"))
    other = mine.join(_side(groups, "h"), "lang").where("g <> h")
    own = exact((gap(F.col("p"), F.col("h0")) - gap(F.col("g0"), F.col("h0"))).cast("decimal(20,0)") * F.col("many"))
    theirs = exact((gap(F.col("h0"), F.col("p")) - gap(F.col("h0"), F.col("g0"))).cast("decimal(20,0)") * F.col("many"))
    single = other.select("lang", F.inline(F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item"), own.alias("part")), F.struct(F.col("h").alias("source"), F.col("g").alias("item"), theirs.alias("part")))))
    single = single.groupBy("lang", "source", "item").agg(F.sum("part").alias("single"))

    every = _side(groups, "a").join(terms, "lang").join(_side(groups, "b"), "lang").where("a <> b")
    every = every.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), exact(exact(gap(F.col("a0"), F.col("b0"))) * F.col("terms")).alias("constant"))
    found = every.join(single, ["lang", "source", "item"], "left").join(shared, ["lang", "source", "item"], "left")
    value = F.col("constant") + F.coalesce("single", exact(F.lit(0))) + F.coalesce("shared", exact(F.lit(0)))
    return found.select("lang", "source", "item", value.cast("long").alias("value"))


def term_values(posted: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    """``lang, source, item, value`` for the terms of which a group has more than its language."""
    rows = posted.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.inline("sources"))
    small = groups.agg(F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source") + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES
    rows = rows.join(groups.hint("broadcast" if small else "merge"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms"), scale), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), scale)
    return rows.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, scale: int = SCALE) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources (all), and the ``ranks`` first terms of each group."""
    posted = cut(postings(docs, least_docs))
    groups = cut(group_table(docs, posted, scale))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_values(posted, groups, scale), "pair").unionByName(ranked(term_values(posted, groups, scale), "term").where(F.col("rank") <= ranks))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (
  SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce((SELECT sum(c.n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN size s USING (lang)),
p AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(counts.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(counts.n, 0) + 1)) // (grp.n + grp.v) AS p
  FROM grp JOIN kept USING (lang) LEFT JOIN counts ON counts.lang = grp.lang AND counts.source = grp.source AND counts.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT kept.lang, term, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (size.n + size.v) AS q FROM kept JOIN size USING (lang)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
