"""A training corpus from raw documents: five operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boresight.llm.common import WORD, cut, keep_ids, small_batches, table
from boresight.llm.decontaminate import decontaminate
from boresight.llm.exact_dedup import exact_groups
from boresight.llm.mixing import mix
from boresight.llm.near_copies import near_copies
from boresight.llm.quality import accepted, learn


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; a null text is scored as an empty one, rows that repeat are judged each."""
    small_batches(spark)
    return accepted(docs, learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the longest original, then the smallest doc_id (null last); null counts as empty, rows that repeat the kept doc_id stay with it."""
    small_batches(spark)
    return keep_ids(docs, exact_groups(docs).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies keep the smallest doc_id; null ids stay where no other id stands for them.

    Near copies have a Jaccard similarity of five-word shingles of 0.8 or more; op4's fingerprints find them first, a complete search the rest.
    """
    small_batches(spark, 500)
    return keep_ids(docs, near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item was found; null and empty texts stay, rows that repeat are judged each."""
    small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least once, with ``copies`` and the words ``taken`` (input columns so named go).

    Rows that repeat a doc_id each have copies and words of their own; rows of one doc_id, source and number of words get that
    group's copies in the order of their texts. Null ids, sources and texts take part as any other.
    """
    small_batches(spark)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size"), F.lit(":"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    # the rows of a source differ by one copy at most, so two values and a count tell the copies of a group
    per = mix(docs).groupBy(key.alias("__of")).agg(F.max("copies").alias("__most"), F.min("copies").alias("__least"), F.sum("copies").alias("__sum"), F.count("*").alias("__rows"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c not in ("copies", "taken")]
    rows = docs.select(F.struct(*kept).alias("__row"), size.alias("__size"))  # in a struct, so that no name of an input column counts
    rows = rows.withColumn("__key", F.expr("concat(coalesce(string(__row.doc_id), 'null'), ':', __size, ':', coalesce(concat('s', __row.source), 'null'))"))
    joined = rows.join(per.where("__most > 0").hint("merge"), F.col("__key") == F.col("__of"))  # alike at every size
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__row.text"))
    many = F.when(F.col("__most") > F.col("__least"), (F.col("__sum") - F.col("__rows") * F.col("__least")) / (F.col("__most") - F.col("__least"))).otherwise(F.col("__rows"))
    taken = joined.select("__row", "__size", F.when(place <= many, F.col("__most")).otherwise(F.col("__least")).alias("__copies")).where("__copies > 0")
    return taken.select("__row.*", F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: The classifier, the fingerprints and the random rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
