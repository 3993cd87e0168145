"""I-Match fingerprints over randomised lexicons, in DataFrame functions alone.

The lexicon holds the terms of a middle document frequency: in one of ``rare`` to one of ``common`` documents. It has at most
``rare`` times the mean number of different terms of a document, however large the corpus. A text keeps its terms of the
lexicon, different ones, sorted; the digest of their sequence is its first signature. Eight randomised lexicons are drawn from
it, each in four sizes (a quarter, a 16th, a 64th and a 256th of the terms, nested, by the term's own digest), and the kept
terms in each give a further signature, none if there are none. The fingerprint is all 33, the likeness of two fingerprints
the share of equal signatures among the sparsest size of which four or more have terms in either text: the fewer terms a
lexicon has, the more of it outlives an edit.

A text without a term of the lexicon takes the digest of all its different terms as its first signature, a text without terms
that of its bytes. Equal fingerprints have likeness 1.

One plan: texts are dealt once, by ranges of ids, which puts each document beside the next one; a range also gets the first
row of the following range. Terms are exploded, looked up in the lexicon and gathered again by row within that
partitioning, so no term of a document is shuffled. Document frequencies are counted with map-side sums. The lexicon is
broadcast only if its measured size is under ``BROADCAST_BYTES``; beyond, it is merged by term.

Cases: null text counts as ''; ids go downwards, nulls last, rows of one id by text; rows that repeat are documents of their
own; a single document is its own next; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boresight.llm.common import cut, parts_for, text_bytes

COMMON, RARE = 32, 512
SETS, SIZES = 8, ("40", "10", "04", "01")  # lexicons, and the two hex digits of a term's digest that lie under a size's bound
LEAST = 4  # signatures with terms by which a likeness is told
BUCKET_BYTES, MOST_BUCKETS, BROADCAST_BYTES = 32 << 20, 1 << 16, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def different_terms(text: Column) -> Column:
    """The different runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), BETWEEN)), "")


def lexicon(docs: DataFrame, common: int = COMMON, rare: int = RARE) -> DataFrame:
    """``term, mask``: terms in one of ``rare`` to one of ``common`` documents; three bits a lexicon say in how many sizes of it."""
    many = docs.count()
    counts = docs.select(F.explode(different_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    kept = counts.where((F.col("n") * common <= many) & (F.col("n") * rare >= many))
    digest = F.md5(F.col("term").cast("binary"))
    sizes = [sum((F.substring(digest, 2 * j + 1, 2) < bound).cast("int") for bound in SIZES) for j in range(SETS)]
    return kept.select("term", reduce(lambda a, b: a + b, (F.shiftleft(s, 3 * j) for j, s in enumerate(sizes))).alias("mask"))


def _bucket(docs: DataFrame, buckets: int) -> Column:
    """Number of a row's range of ids; higher ids have lower numbers, null ids a range of their own."""
    id_ = F.col("doc_id")
    if buckets == 1:
        return F.when(id_.isNull(), 1).otherwise(0)
    found = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    bounds = sorted(set(found), reverse=True)
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not blocks:
        return F.lit(0)
    over = lambda column: F.size(F.filter(column, lambda b: b > id_))
    block = F.greatest(over(F.lit([b[0] for b in blocks])), F.lit(1))
    fine = F.element_at(F.array(*[F.lit(b) for b in blocks]), block)
    return F.when(id_.isNull(), len(bounds) + 1).otherwise((block - 1) * width + over(fine))


def ordered(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, text, next_text, bucket, at, guest``: rows dealt by ranges of ids, each with the text of the next one; at the end of a range stands, as a guest, the first row of the next range."""
    placed = docs.withColumn("bucket", _bucket(docs, buckets))
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"), F.lit(True).alias("first"))  # a row a range
    before = Window.orderBy("bucket")
    firsts = firsts.withColumn("guest_of", F.coalesce(F.lag("bucket").over(before), F.max("bucket").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    f = firsts.select(F.col("bucket").alias("b"), F.col("doc_id").alias("d"), "guest_of")
    heads = placed.join(F.broadcast(f), (placed["bucket"] == f["b"]) & placed["doc_id"].eqNullSafe(f["d"])).groupBy(F.col("guest_of").alias("bucket"), "doc_id").agg(F.min("text").alias("text"))
    rows = placed.withColumn("guest", F.lit(False)).unionByName(heads.withColumn("guest", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return rows.repartition(buckets, "bucket").select("doc_id", "text", F.lead("text").over(order).alias("next_text"), "bucket", F.row_number().over(order).alias("at"), "guest")


def _digest(terms: Column) -> Column:
    return F.substring(F.md5(F.array_join(terms, " ").cast("binary")), 1, 8)


def signatures(kept: DataFrame) -> DataFrame:
    """Adds ``signed``, the signatures of ``terms`` (array of term and mask, sorted), with ``whole`` for a text that kept none."""
    under = lambda column, j, size: F.filter(column, lambda x: F.shiftright(x["mask"], 3 * j).bitwiseAND(7) > size)
    sizes = ["terms"]
    for size in range(len(SIZES)):
        last, name = sizes[-1], f"size_{size}"
        kept = kept.withColumn(name, F.array(*[under(F.col(last) if last == "terms" else F.col(last)[j], j, size) for j in range(SETS)]))
        sizes.append(name)
    sign = lambda terms: F.when(F.size(terms) > 0, _digest(F.transform(terms, lambda x: x["term"]))).otherwise("")
    first = F.when(F.size("terms") > 0, sign(F.col("terms"))).otherwise(F.col("whole"))
    return kept.withColumn("signed", F.array(first, *[sign(F.col(name)[j]) for name in sizes[1:] for j in range(SETS)])).drop(*sizes)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two arrays of signatures, 0 to 1."""
    shares = []
    for size in range(len(SIZES)):
        pairs = F.arrays_zip(F.slice(a, 2 + size * SETS, SETS).alias("a"), F.slice(b, 2 + size * SETS, SETS).alias("b"))
        told = F.size(F.filter(pairs, lambda x: (x["a"] != "") | (x["b"] != "")))
        equal = F.size(F.filter(pairs, lambda x: (x["a"] != "") & (x["a"] == x["b"])))
        shares.append((told, F.when(told > 0, equal / told).otherwise(0.0)))
    found = F.when(a == b, 1.0)
    for told, share in reversed(shares):
        found = found.when(told >= LEAST, share)
    return found.otherwise(shares[0][1])


def fingerprints(docs: DataFrame, common: int = COMMON, rare: int = RARE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every document; its edited text ends, for half its length, with the start of the next one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = cut(lexicon(docs, common, rare))
    small = words.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0] <= BROADCAST_BYTES
    spread = docs.sparkSession.sparkContext.defaultParallelism
    buckets = min(parts_for(text_bytes(docs), bucket_bytes, 2 * spread), MOST_BUCKETS)

    rows = ordered(docs, buckets).select("*", F.char_length("text").alias("n_chars"))
    edited = F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next_text, 1, int(n_chars div 2)))")
    bodies = F.when(F.col("guest"), F.array("text")).otherwise(F.array(F.col("text"), edited))
    sides = rows.select("bucket", "at", "guest", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.posexplode(bodies).alias("side", "body"))
    sides = sides.select("*", F.sort_array(different_terms(F.col("body"))).alias("words"))
    whole = _digest(F.when(F.size("words") > 0, F.col("words")).otherwise(F.array("body")))
    # The first row of a side, which has no term, carries what is known of the side.
    info = F.struct("guest", "doc_id", "n_chars", F.when(F.col("side") == 1, F.sha2("body", 256)).alias("sha"), whole.alias("whole")).alias("info")
    held = sides.select("bucket", "at", "side", info, "words").select("bucket", "at", "side", "info", F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    held = held.select("bucket", "at", "side", "term", F.when(F.col("term") == "", F.col("info")).alias("info"))
    met = held.join(words.hint("broadcast" if small else "merge"), "term", "left").where("mask IS NOT NULL OR term = ''")
    found = met.groupBy("bucket", "at", "side").agg(F.max("info").alias("info"), F.sort_array(F.collect_list(F.when(F.col("mask").isNotNull(), F.struct("term", "mask")))).alias("terms"))
    signed = signatures(found.select("bucket", "at", "side", "info", "terms", F.col("info.whole").alias("whole")))
    order = Window.partitionBy("bucket").orderBy("at", "side")
    after = signed.select("side", "info", "signed", F.lead("signed").over(order).alias("edited"), F.lead("signed", 2).over(order).alias("next"), F.lead("info.sha").over(order).alias("sha"))
    return after.where((F.col("side") == 0) & ~F.col("info.guest")).select(
        "info.doc_id", "info.n_chars", F.col("sha").alias("edited_sha256"), F.array_join("signed", "-").alias("fingerprint"), F.array_join("edited", "-").alias("edited_fingerprint"),
        likeness(F.col("signed"), F.col("edited")).alias("near_edited"), likeness(F.col("signed"), F.col("next")).alias("near_next"),
    )


def _oracle() -> str:
    mask = [(j, bound) for bound in SIZES for j in range(SETS)]
    signs = ", ".join(f"substr(md5(string_agg(term, ' ' ORDER BY term) FILTER (substr(h, {2 * j + 1}, 2) < '{bound}')), 1, 8) AS s{i}" for i, (j, bound) in enumerate(mask, 1))
    told = lambda b, size: " + ".join(f"CAST(a.s[{i}] <> '' OR {b}.s[{i}] <> '' AS INT)" for i in range(2 + size * SETS, 2 + (size + 1) * SETS))
    equal = lambda b, size: " + ".join(f"CAST(a.s[{i}] <> '' AND a.s[{i}] = {b}.s[{i}] AS INT)" for i in range(2 + size * SETS, 2 + (size + 1) * SETS))
    share = lambda b, size: f"coalesce(({equal(b, size)}) / nullif(({told(b, size)})::DOUBLE, 0), 0)"
    like = lambda b: f"CASE WHEN a.s = {b}.s THEN 1.0 " + " ".join(f"WHEN ({told(b, size)}) >= {LEAST} THEN {share(b, size)}" for size in reversed(range(len(SIZES)))) + f" ELSE {share(b, 0)} END"
    between = BETWEEN.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS pos FROM documents),
e AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY pos), first_value(text) OVER (ORDER BY pos)) AS next_text, coalesce(lead(pos) OVER (ORDER BY pos), 1) AS next_pos FROM d),
sides AS (
  SELECT pos, 0 AS side, text AS body FROM e
  UNION ALL SELECT pos, 1, substring(text, 1, n_chars - n_chars // 2) || substring(next_text, 1, n_chars // 2) FROM e),
w AS (SELECT pos, side, body, list_sort([x FOR x IN list_distinct(string_split_regex(translate(body, '{UPPER}', '{LOWER}'), '{between}')) IF x <> '']) AS words FROM sides),
u AS (SELECT pos, side, unnest(words) AS term FROM w),
lex AS (SELECT term, md5(term) AS h FROM u WHERE side = 0 GROUP BY term HAVING count(*) * {COMMON} <= (SELECT count(*) FROM d) AND count(*) * {RARE} >= (SELECT count(*) FROM d)),
k AS (SELECT pos, side, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS s0, {signs} FROM u JOIN lex USING (term) GROUP BY pos, side),
f AS (
  SELECT w.pos, w.side, [coalesce(s0, substr(md5(CASE WHEN len(words) > 0 THEN array_to_string(words, ' ') ELSE body END), 1, 8)), {", ".join(f"coalesce(s{i}, '')" for i in range(1, len(mask) + 1))}] AS s
  FROM w LEFT JOIN k ON k.pos = w.pos AND k.side = w.side)
SELECT e.doc_id, e.n_chars, sha256(v.body) AS edited_sha256, array_to_string(a.s, '-') AS fingerprint, array_to_string(b.s, '-') AS edited_fingerprint, {like("b")} AS near_edited, {like("c")} AS near_next
FROM e JOIN sides v ON v.pos = e.pos AND v.side = 1 JOIN f a ON a.pos = e.pos AND a.side = 0 JOIN f b ON b.pos = e.pos AND b.side = 1 JOIN f c ON c.pos = e.next_pos AND c.side = 0
"""


ORACLE_SQL = _oracle()
