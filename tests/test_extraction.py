"""Report pages to events, on a page written for it, and depth scanning against a plain reader."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from boresight.functions import lexicon, text
from boresight.operators import extraction

PAGE = (
    "While drilling the Tipam at 2,810 m partial losses of 20 bbl/hr were observed. Pumped LCM pill and reduced the flow rate. Losses were cured. NPT: 6 hrs.\n"
    "No losses were seen at 2500 m. At 9,200 ft the string became stuck. Overpull 30 t with jarring. Pipe came free on 12-Mar-2019. "
    "High torque and a kick at 3100 m MD with MW 1.25 SG. Weather was fine.\n"
    "The 8 1/2 section was drilled from 2000 to 2300 m without losses in the Barail."
)
ALIASES = {"tipam": "TIP", "barail": "BAR", "lower barail": "LBA"}


def told(spark, pages):
    sentences = extraction.read_sentences(pages, ["doc_id", "page"])
    return extraction.tell(extraction.group_stories(sentences, ["doc_id", "page"]), sentences, pages, ["doc_id", "page"], ALIASES)


def test_a_page(spark):
    pages = spark.createDataFrame([("d1", 1, PAGE), ("d1", 2, ""), ("d2", 1, None), ("d3", 1, "Nothing of note. Weather fine.")], "doc_id string, page int, text string")
    found = sorted(told(spark, pages).collect(), key=lambda r: (r.start, r.type))
    assert [r.type for r in found] == ["LOST_CIRCULATION", "STUCK_PIPE", "OVERPRESSURE_KICK", "TORQUE_SPIKE", "NOTABLE_PRACTICE"]
    loss, stuck, kick, torque, practice = found
    assert (loss.subtype, loss.md_top, loss.formation_reported, loss.loss_rate_m3ph, loss.npt_h, loss.outcome) == ("partial", 2810.0, "TIP", 3.18, 6.0, "resolved")
    assert [m.action for m in loss.mitigations] == ["REDUCE_FLOW_ECD", "LCM_PILL"] and loss.quote == PAGE.split("\n")[0]
    assert (stuck.md_top, stuck.outcome, str(stuck.event_date)) == (2804.2, "resolved", "2019-03-12") and stuck.quote.endswith("12-Mar-2019.")
    assert (kick.subtype, kick.md_top, kick.mw_sg, kick.flags) == ("kick", 3100.0, 1.25, []) and (torque.md_top, torque.start) == (3100.0, kick.start)
    assert (practice.md_top, practice.md_base, practice.outcome, practice.formation_reported) == (2000.0, 2300.0, "resolved", "BAR")
    assert all(PAGE[r.start : r.end].strip() == r.quote for r in found)


def test_depths(spark):
    rng = random.Random(2)
    pieces = ["2,810", "3000", "95", "150.5", "12,345", " m", " ft", "m MD", "'", "-", " to ", " up to ", " ", ". ", "x", "/hr", " metres", "7000", "mts"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(400)]
    num, unit = r"([0-9]{1,2}[,.][0-9]{3}(?:[.][0-9]+)?|[0-9]{3,5}(?:[.][0-9]+)?)", r"(m ?MD|mtrs?|metres?|meters?|mts|m|ft|feet|')"

    def metres(n: str, u: str) -> float:
        whole = re.fullmatch(r"[0-9]{1,2}[.,][0-9]{3}", n)
        return float(re.sub("[.,]", "", n) if whole else n.replace(",", "")) * (0.3048 if u.lower() in ("ft", "feet", "'") else 1)

    def plain(t: str) -> list[tuple]:
        out = []
        for m in re.finditer(rf"(?:{num}\s*{unit}?\s*(?:-|to|up to)\s*)?{num}\s*{unit}(?![A-Za-z0-9/])", t, re.ASCII):
            a, b = m[1] and metres(m[1], m[2] or m[4]), metres(m[3], m[4])
            if m[1] and 100 <= a <= b <= 7000:
                out.append((m.start(), a, b))
            else:
                out += [(m.start(), a, None)] * bool(m[1] and m[2] and 100 <= a <= 7000) + [(m.start(3), b, None)] * (100 <= b <= 7000)
        return out

    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.depth_mentions(F.col("t")).alias("d")).collect()
    for r in made:
        assert [(d.start, round(d.md, 6), d.md_base and round(d.md_base, 6)) for d in r.d] == [(s, round(a, 6), b and round(b, 6)) for s, a, b in plain(r.t)], r.t


def test_types(spark):
    rows = {"No kick, but a kick later": ["OVERPRESSURE_KICK"], "tight hole and the pipe got stuck": ["STUCK_PIPE"], "losses during cementing": ["CEMENTING_PROBLEM"], "torque spikes, then cavings": ["TORQUE_SPIKE", "WELLBORE_INSTABILITY"], "fluid loss was 5 cc": [], "nothing": []}
    made = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.typed(F.col("t"), extraction.any_case(lexicon.EVENTS), lexicon.HIDES).alias("x")).collect()
    assert {r.t: r.x for r in made} == rows


def test_validation(spark):
    """The share of a layer is taken of its vertical thickness, on a bore whose vertical depth is half the measured one below 1,000 m."""
    rows = [(1, "w", 1010.0, "B", "2020-01-05"), (2, "w", 1500.0, "A", "2021-01-01"), (3, "w", 1900.0, None, None), (4, "w", None, "A", None), (5, "v", 10.0, "A", None)]
    events = spark.createDataFrame(rows, "event_id int, well_id string, md_top double, formation_reported string, event_date string").withColumn("tvd", F.expr("least(md_top, 1000) + greatest(md_top - 1000, 0) / 2"))
    bores = spark.createDataFrame([("w", 2000.0, "2020-01-01", "2020-03-01")], "well_id string, td double, spud string, completed string")
    tops = spark.createDataFrame([("w", "A", 500.0, 1000.0, 500.0, 1000.0, False), ("w", "B", 1000.0, 1800.0, 1000.0, 1300.0, False), ("w", "C", 1800.0, 1990.0, 1400.0, 1495.0, True)], "well_id string, code string, md_top double, md_base double, tvd_top double, tvd_base double, td_in_formation boolean")
    found = {r.event_id: (r.formation, r.formation_source, r.f_pos, r.consistent, r.off_date) for r in extraction.validate(events, bores, tops).collect()}
    assert found == {1: ("B", "tops", 0.0167, True, False), 2: ("B", "tops", 0.8333, False, True), 3: ("C", "tops", 0.5263, None, False), 4: ("A", "reported", None, None, False), 5: ("A", "reported", None, None, False)}
