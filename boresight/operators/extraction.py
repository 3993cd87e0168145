"""Events from report pages: sentences, what each says, which belong together, and what a story tells as a whole.

What a sentence says is native columns. Which sentences tell one story depends on the story so far, so a small fold passes
once over the sentences in order. The rest is aggregates over stories and native columns on their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boresight.functions import lexicon, numeric, text

# How far a sentence's depth may lie from its story's when it names the trouble, and when it only follows up; sentences a story takes by following up.
SAME_M, FOLLOW_M, STORY_SENTENCES = 15.0, 200.0, 9


def any_case(patterns: dict[str, str]) -> dict[str, str]:
    return {n: f"(?i){p}" for n, p in patterns.items()}


def follows_up(sentence: Column) -> Column:
    """Whether a sentence tells of actions, of an outcome or of lost hours."""
    return sentence.rlike("(?i)" + "|".join(f"(?:{p})" for p in [*lexicon.ACTIONS.values(), *(p for _, p in lexicon.OUTCOMES)])) | sentence.rlike(lexicon.LOST_HOURS)


def read_sentences(pages: DataFrame, key: list[str], body: str = "text", events: dict[str, str] | None = None) -> DataFrame:
    """``key, sent_no, start, end, sentence, types, depths, follows`` of each sentence of a page."""
    spans = pages.select(*key, F.posexplode(text.sentence_spans(F.col(body))).alias("sent_no", "s")).select(*key, "sent_no", "s.start", F.col("s.value").alias("sentence"))
    practice = None if events else (lexicon.PRACTICE, lexicon.PRACTICE_PATTERN)
    types = text.typed(F.col("sentence"), events or any_case(lexicon.EVENTS), lexicon.HIDES, practice)
    return spans.select(*key, "sent_no", "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence", types.alias("types"), F.transform(text.depth_mentions(F.col("sentence")), lambda d: d["md"]).alias("depths"), follows_up(F.col("sentence")).alias("follows"))


def belongs(story: dict | None, types: list[str], depths: list[float], follows: bool) -> bool:
    """Whether the next sentence goes on with the open story."""
    if story is None:
        return False
    apart = [abs(d - story["depth"]) for d in depths] if story["depth"] is not None else None
    if types:
        told = {story["type"]} | lexicon.ABSORBS.get(story["type"], set())
        return told.issuperset(types) and not (apart and apart[0] > SAME_M)
    near = not depths or (apart is not None and max(apart) <= FOLLOW_M)
    return follows and near and story["size"] < STORY_SENTENCES


def group_stories(sentences: DataFrame, key: list[str]) -> DataFrame:
    """``key, story, type, sent_no``: the sentences of each story; a sentence that names other troubles too begins a side story for each."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, story, made = None, None, 0
        for pdf in batches:
            out = []
            for *here, n, types, depths, follows in zip(*(pdf[c] for c in (*key, "sent_no", "types", "depths", "follows"))):
                if here != page:
                    page, story, made = here, None, 0
                types, depths = list(types), list(depths)
                if belongs(story, types, depths, follows):
                    story["size"] += 1
                elif types:
                    story, made = {"id": made, "type": types[0], "depth": depths[0] if depths else None, "size": 1}, made + 1
                    for other in types[1:]:
                        if other not in lexicon.ABSORBS.get(types[0], ()):
                            out.append((*here, made, other, n))
                            made += 1
                else:
                    story = None
                    continue
                out.append((*here, story["id"], story["type"], n))
            if out:
                yield pd.DataFrame(out, columns=[*key, "story", "type", "sent_no"])

    kinds = ", ".join(f"{k} {sentences.schema[k].dataType.simpleString()}" for k in key)
    slim = sentences.select(*key, "sent_no", "types", "depths", "follows")
    return slim.repartition(*key).sortWithinPartitions(*key, "sent_no").mapInPandas(fold, f"{kinds}, story int, type string, sent_no int")


def formations(body: Column, aliases: dict[str, str]) -> Column:
    """array<struct(start, code)> of all formation names of a text, the longest alias first at each place."""
    names = "|".join(sorted((a.lower() for a in aliases), key=lambda a: (-len(a), a)))
    codes = F.create_map(*[F.lit(x) for a, c in aliases.items() for x in (a.lower(), c)])
    return F.transform(text.occurrences(F.lower(body), rf"\b(?:{names})\b"), lambda o: F.struct(o["start"].alias("start"), codes[o["value"]].alias("code")))


def tell(stories: DataFrame, sentences: DataFrame, pages: DataFrame, key: list[str], aliases: dict[str, str], body: str = "text", header_depth: str | None = None, report_date: str | None = None) -> DataFrame:
    """One event a story: subtype, depths, formation, rate, lost hours, mud weight, date, outcome, actions with quotes, flags and the quoted span."""
    mine = stories.join(sentences.select(*key, "sent_no", "start", "end", "sentence"), [*key, "sent_no"])
    whole = mine.groupBy(*key, "story", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("sentence", "sent_no").alias("head"), F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))).alias("told"))
    page = pages.select(*key, F.col(body).alias("__page"), (F.col(header_depth) if header_depth else F.lit(None)).cast("double").alias("__header"), (F.col(report_date) if report_date else F.lit(None)).cast("date").alias("__date"))
    e = whole.join(page, key).withColumn("body", F.substring("__page", F.col("start") + 1, F.col("end") - F.col("start")))
    in_head, in_body = text.depth_mentions(F.col("head")), text.depth_mentions(F.col("body"))
    e = e.withColumn("__depths", F.when(F.size(in_head) > 0, in_head).otherwise(in_body))
    depth, second = F.get("__depths", F.lit(0)), F.get("__depths", F.lit(1))
    base = F.when((F.col("type") == lexicon.PRACTICE) & depth["md_base"].isNull(), second["md"]).otherwise(depth["md_base"])
    lower = F.lower("body")
    subtype, outcome = F.lit(None).cast("string"), text.ladder(F.col("body"), [(n, f"(?i){p}") for n, p in lexicon.OUTCOMES], "unknown")
    for name, rules in lexicon.SUBTYPES.items():
        subtype = F.when(F.col("type") == name, text.ladder(lower, rules)).otherwise(subtype)
    named = lambda c: F.get(formations(F.col(c), aliases), F.lit(0))["code"]
    value = lambda pattern, k: F.nullif(F.regexp_extract("body", pattern, k), F.lit(""))
    hours = F.coalesce(*[value(lexicon.LOST_HOURS, k) for k in (1, 2, 3)]).try_cast("double")
    rate = numeric.normalise_rate(value(lexicon.LOSS_RATE, 1).try_cast("double"), value(lexicon.LOSS_RATE, 2))
    weight = numeric.normalise_mud_weight(value(lexicon.MUD_WEIGHT, 1).try_cast("double"), value(lexicon.MUD_WEIGHT, 2))
    dated = F.to_date(F.try_to_timestamp(value(lexicon.DATE, 1), F.lit("d-MMM-yyyy")))
    action = lambda n, p: F.struct(F.lit(n).alias("action"), F.get(F.filter("told", lambda s: s["sentence"].rlike(f"(?i){p}")), F.lit(0)).alias("s"))
    taken = F.filter(F.array(*[action(n, p) for n, p in lexicon.ACTIONS.items()]), lambda a: a["s"].isNotNull())
    flag = F.when(depth.isNotNull(), F.lit(None)).when(F.col("__header").isNotNull(), "depth_from_report_header").otherwise("no_depth")
    return e.select(
        *key, "story", "type", subtype.alias("subtype"), F.round(F.coalesce(depth["md"], F.col("__header")), 1).alias("md_top"), F.round(base, 1).alias("md_base"),
        F.when(depth.isNull() & F.col("__header").isNotNull(), "report_header").otherwise("reported").alias("depth_source"), F.coalesce(named("head"), named("body")).alias("formation_reported"),
        F.when(F.col("type") == "LOST_CIRCULATION", F.round(rate, 2)).alias("loss_rate_m3ph"), hours.alias("npt_h"), F.round(weight, 3).alias("mw_sg"), F.coalesce(dated, "__date").alias("event_date"),
        F.when(F.col("type") == lexicon.PRACTICE, "resolved").otherwise(outcome).alias("outcome"),
        F.transform(taken, lambda a: F.struct(a["action"].alias("action"), F.trim(a["s"]["sentence"]).alias("quote"))).alias("mitigations"), F.array_compact(F.array(flag)).alias("flags"),
        F.trim("body").alias("quote"), "start", "end",
    )


def hold_depths(events: DataFrame, bores: DataFrame, md: str = "md_top", base: str = "md_base", slack: float = 10.0) -> DataFrame:
    """Events with depths that their bore can have; ``bores(well_id, td, ...)``; adds td. Those without a depth, or too deep, are left out.

    A depth of an inferred unit that only fits as feet is converted, with its base, and flagged; depths are held at total
    depth, a base at its top at least, both to a decimal.
    """
    joined = events.join(bores.select("well_id", "td"), "well_id")
    feet = F.array_contains("flags", "depth_unit_inferred") & (F.col(md) > F.col("td") + slack) & (F.col(md) * numeric.FT <= F.col("td") + slack)
    top = F.when(feet, F.col(md) * numeric.FT).otherwise(F.col(md))
    flags = F.when(feet, F.array_union("flags", F.array(F.lit("converted_from_ft")))).otherwise(F.col("flags"))
    held = joined.withColumns({"flags": flags, "__top": top}).where(F.col("__top") <= F.col("td") + slack).withColumn("__top", F.least("__top", "td"))
    low = F.when(F.col(base).isNotNull(), F.round(F.least(F.greatest(base, "__top"), "td"), 1))
    return held.withColumns({md: F.round("__top", 1), base: low}).drop("__top")


def validate(events: DataFrame, bores: DataFrame, tops: DataFrame, event_id: str = "event_id", md: str = "md_top", tvd: str = "tvd") -> DataFrame:
    """Adds what a bore knows about an event at a depth: formation there, position within it, whether the reported one agrees.

    ``bores(well_id, td, spud, completed)``, ``tops(well_id, code, md_top, md_base, tvd_top, tvd_base, td_in_formation)``; events
    have their vertical depth, by ``trajectory.position_at``. The formation is the one at the depth, else the reported one;
    ``formation_source`` says which. ``f_pos`` is the share of its vertical thickness above the event. An event agrees if its
    reported formation is the one at the depth or 20 m above or below; ``consistent`` is null without a report or without a
    formation at the depth. ``off_date`` marks dates outside the bore's time.
    """
    t = tops.select(F.col("well_id").alias("__w"), "code", F.col("md_top").alias("__top"), F.col("md_base").alias("__base"), F.col("tvd_top").alias("__high"), F.col("tvd_base").alias("__low"), "td_in_formation")
    near = lambda shift: (F.col(md) + shift >= F.col("__top")) & ((F.col(md) + shift < F.col("__base")) | F.col("td_in_formation"))
    met = events.join(t, (F.col("well_id") == F.col("__w")) & (near(-20.0) | near(0.0) | near(20.0)), "left")
    here = F.when(near(0.0), F.struct("code", "__high", "__low"))
    found = met.groupBy(event_id).agg(F.max(here).alias("__at"), F.collect_set("code").alias("__near"))
    extra = [c for c in bores.columns if c not in events.columns]
    joined = events.join(found, event_id).join(bores.select("well_id", *extra), "well_id", "left")
    share = (F.col(tvd) - F.col("__at.__high")) / F.greatest(F.col("__at.__low") - F.col("__at.__high"), F.lit(1e-6))
    derived, reported = F.col("__at.code"), F.col("formation_reported")
    agrees = F.when(reported.isNotNull() & derived.isNotNull(), F.array_contains("__near", reported))
    off = ~F.col("event_date").between(F.col("spud"), F.col("completed"))
    return joined.select(
        *events.columns, *[c for c in ("td",) if c in extra], F.coalesce(derived, reported).alias("formation"), F.when(derived.isNotNull(), "tops").when(reported.isNotNull(), "reported").alias("formation_source"),
        F.when(share.isNotNull(), F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), 4)).alias("f_pos"), agrees.alias("consistent"), F.coalesce(off, F.lit(False)).alias("off_date"),
    )
