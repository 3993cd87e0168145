"""Views of the event base: filters, briefs, details by document, summaries by bore, sets of neighbours' codes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRACTICE_FAMILY = "PR"  # fixed value: what events without a risk family count as


def filter_events(events: DataFrame, well: str | None = None, family: str | None = None, formation: str | None = None, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Events by any of these conditions; a missing family counts as ``PRACTICE_FAMILY``."""
    named = events.withColumn("family", F.coalesce("family", F.lit(PRACTICE_FAMILY)))
    for column, value in (("well_id", well), ("family", family), ("formation", formation), ("status", status), ("type", kind)):
        if value is not None:
            named = named.where(F.col(column) == value)
    return named


def brief(events: DataFrame, kept: list[str], provenance: str = "provenance", width: int = 220) -> DataFrame:
    """``kept`` columns with the first source, the number of sources, and a summary from its quote."""
    first = F.get(provenance, F.lit(0))
    return events.select(*kept, first["doc_id"].alias("doc_id"), first["page"].alias("page"), F.left(first["quote"], F.lit(width)).alias("summary"), F.greatest(F.size(provenance), F.lit(0)).alias("n_sources"))


def citing(events: DataFrame, documents: DataFrame, event_id: str = "event_id", provenance: str = "provenance") -> DataFrame:
    """Each document with the ids of the events that cite it, in order; documents without any have none."""
    cited = events.select(event_id, F.explode(provenance).alias("p")).select(event_id, F.col("p.doc_id").alias("doc_id")).distinct()
    ids = cited.groupBy("doc_id").agg(F.sort_array(F.collect_list(event_id)).alias("event_ids"))
    return documents.join(ids, "doc_id", "left").withColumn("event_ids", F.coalesce("event_ids", F.array().cast(ids.schema["event_ids"].dataType)))


def family_counts(events: DataFrame, entity: str, families: list[str], family: str = "family") -> DataFrame:
    """Events of each entity by family, one column a family."""
    return events.groupBy(entity).agg(F.count("*").alias("n_events"), *[F.count_if(F.coalesce(F.col(family), F.lit(PRACTICE_FAMILY)) == f).alias(f"n_{f.lower()}") for f in families])


def adjacent(rows: DataFrame, group: str, ordinal: str, code: str, value: str) -> DataFrame:
    """Lines between neighbours: ``code`` of the row with ``ordinal`` and of the one with the next ordinal, where both have it."""
    left = rows.select(group, ordinal, code, F.col(value).alias("value_from"))
    right = rows.select(group, (F.col(ordinal) - 1).alias(ordinal), code, F.col(value).alias("value_to"))
    return left.join(right, [group, ordinal, code])


def merge_spans(spans: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans in order without those that begin before the end of the last kept one; what a skipped span covers counts for nothing.

    Whether a span stays depends on those kept before, so it is a fold over a key's rows in order, with one number of memory.
    """
    ordered = spans.repartition(*key).sortWithinPartitions(*key, start, end)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, far = None, 0
        for pdf in batches:
            kept = []
            for *here, low, high in zip(*(pdf[k] for k in key), pdf[start], pdf[end]):
                kept.append(here != at or low >= far)
                if kept[-1]:
                    at, far = here, high
            yield pdf[kept]

    return ordered.mapInPandas(fold, ordered.schema)


def set_overlap(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 without elements."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / F.greatest(every, F.lit(1))).otherwise(0.0)
