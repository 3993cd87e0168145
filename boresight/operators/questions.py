"""Questions over reports, a batch at a time: what is asked, which sentences answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boresight.functions import text

# Words that set the intent, the scope and the family of a question, and how it names bores.
COUNT = r"(?i)\b(how many|count|number of|which wells|list|table of)\b"
HOW = r"(?i)\b(how (was|were|did)|mitigat|cure|cured|freed|resolve|remed|what (was|were) done|action|worked)\b"
NEARBY = r"(?i)\b(nearby|offset|near|around|within|surrounding)\b"
RADIUS = r"(?i)within\s+(\d+(?:\.\d+)?)\s*km"
NAMED = r"\b[Ww]ells?\s+([A-Z]{1,2})\b(?:\s*(?:,|and|&)\s*([A-Z]{1,2})\b)?(?:\s*(?:,|and|&)\s*([A-Z]{1,2})\b)?"
PRACTICE = r"(?i)\b(practice|worked|work well|without (losses|problems|trouble)|trouble[- ]free|good|lesson)"
TRIGGERS = {
    "LC": r"(?i)\b(loss|losses|lost circulation|mud loss|returns|lcm)\b", "SP": r"(?i)\b(stuck|sticking|immobili[sz]ed|tight|overpull|pack[- ]?off|jar)", "OP": r"(?i)\b(kick|influx|over[- ]?pressure|high gas|gas|pressure|pit gain)\b",
    "TQ": r"(?i)\b(torque|stick[- ]slip|stall)", "CM": r"(?i)\b(cement|cementing|bond|cbl|squeeze)",
}


def named_wells(question: Column, known: Column) -> Column:
    """Bores that a question names, up to three behind one "well", in the order of the text; ``known`` are those there are."""
    groups = [F.regexp_extract_all(question, F.lit(text.ascii_borders(NAMED)), F.lit(i)) for i in (1, 2, 3)]
    each = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda x: F.array(x["g0"], x["g1"], x["g2"]))
    return F.filter(F.flatten(each), lambda w: F.array_contains(known, w))


def parse(question: Column, triggers: dict[str, str] = TRIGGERS, practice: str = PRACTICE) -> dict[str, Column]:
    """intent, families, depths, radius_km and nearby of a question; words of good practice leave ``PR`` as the only family.

    Words end at anything but A-Z, a-z, 0-9 and the underscore, letters with marks included, as the SQL has it.
    """
    says = lambda p: question.rlike(text.ascii_borders(p))
    families = F.when(says(practice), F.array(F.lit("PR"))).otherwise(text.tags(question, {n: text.ascii_borders(p) for n, p in triggers.items()}))
    return {
        "intent": F.when(says(COUNT), "count").when(says(HOW), "how").otherwise("describe"), "families": families,
        "depths": F.transform(text.depth_mentions(question), lambda d: d["md"]), "radius_km": F.nullif(F.regexp_extract(question, text.ascii_borders(RADIUS), 1), F.lit("")).try_cast("double"), "nearby": says(NEARBY),
    }


def scope(named: Column, nearby: Column, radius_km: Column, active: Column, within: Column) -> Column:
    """Wells that a question is about, null for all; ``within`` are those around the active well.

    Named wells count without the active one, or alone if it is the only one; around the active well are meant where it is
    named with a radius and a word of nearness, or where such a word or a radius stands without names.
    """
    some, others = F.size(named) > 0, F.filter(named, lambda w: w != active)
    around = F.array_contains(named, active) & nearby & radius_km.isNotNull()
    return F.when(some & around, within).when(some & (F.size(others) > 0), others).when(some, named).when(nearby | radius_km.isNotNull(), within)


def sentence_score(terms: Column, asked: Column, expanded: Column, rank: Column, how: Column, deep: Column, incidental: Column) -> Column:
    """Shared terms of the question twice, of its expansion once, less for a late chunk and for what is told in passing."""
    shared = lambda other: F.size(F.array_intersect(terms, other))
    return 2 * shared(asked) + shared(expanded) - 0.15 * rank + 1.5 * how.cast("int") + deep.cast("int") - 2.5 * incidental.cast("int")


def choose_cases(cases: DataFrame, key: list[str], sim: str, exact: str, case_id: str, top: int = 25, enough: int = 3) -> DataFrame:
    """The ``top`` most similar cases of each key, only those of the exact kind where there are ``enough`` of them."""
    from pyspark.sql import Window

    counts = cases.groupBy(*key).agg(F.count_if(F.col(exact)).alias("__exact"))
    meant = cases.join(counts, key).where(F.col(exact) | (F.col("__exact") < enough)).drop("__exact")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(sim), case_id))
    return meant.withColumn("place", place).where(F.col("place") <= top)


def verdict(score: Column, success: Column) -> Column:
    """Whether an action is recommended."""
    return F.when(success < 0.5, "not_effective").when(score > 0, "effective").otherwise("open")
