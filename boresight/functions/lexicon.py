"""Vocabulary of drilling reports. All values here are fixed: results depend on their exact wording and order."""

from __future__ import annotations

# Event types in the order in which they are looked for, and the risk family that each counts for.
EVENTS = {
    "CEMENTING_PROBLEM": r"loss(es)? (of \w+ )?during (the )?cement(ing|ation|\s+job)|cement(ing)? (job )?(problem|failure|losses)|poor (cement )?bond|\bCBL\b[^.]{0,40}\b(poor|channel)|channel(l)?ing|(top of cement|\bTOC\b)[^.]{0,90}\b(deeper|lower|short)|remedial cement|squeeze (job|cementing)",
    "STUCK_PIPE": r"stuck pipe|(pipe|string|drillstring|drill string|bha)\s+(got|became|was|is|found)\s+(differentially\s+)?stuck|differential(ly)?\s+(stuck|sticking)|(string|drillstring|drill string|pipe)\s+(became|got|was)\s+immobili[sz]ed|unable to (rotate|reciprocate|move)|pack[- ]?off",
    "OVERPRESSURE_KICK": r"\bkick\b|\binflux\b|pit gain|well (flowed|flowing|was flowing)|flow check (was )?positive|high (background |connection |trip )?gas|gas[- ]cut mud|over[- ]?pressure[d]?|abnormal(ly)?\s+(high\s+)?pressure[d]?|pore pressure (increase|ramp|rise)",
    "LOST_CIRCULATION": r"\b(?:(?:partial|severe|total|complete|seepage|heavy|dynamic|static)\s+)?(?:mud\s+)?(?<!fluid )(?<!filtrate )loss(es)?\b(?! of (time|rig))|lost circulation|loss of (circulation|returns)|lost (total |full |partial )?returns|no returns|losing mud|returns (dropped|reduced)",
    "TIGHT_HOLE": r"tight (hole|spot)|hole (was |became )?tight|overpull|excessive drag",
    "WELLBORE_INSTABILITY": r"\bcavings?\b|slough(ing|ed)|(clay|shale) swelling|swelling (clay|shale)|hole (enlargement|collapse)",
    "TORQUE_SPIKE": r"erratic torque|torque spikes?|high (and erratic )?torque|stick[- ]slip|top ?drive stall(ed|ing)?|stalling",
}
FAMILY = {"LOST_CIRCULATION": "LC", "STUCK_PIPE": "SP", "TIGHT_HOLE": "SP", "WELLBORE_INSTABILITY": "SP", "OVERPRESSURE_KICK": "OP", "TORQUE_SPIKE": "TQ", "CEMENTING_PROBLEM": "CM"}
FAMILY_WEIGHT = {"TIGHT_HOLE": 0.6, "WELLBORE_INSTABILITY": 0.5}
PRACTICE = "NOTABLE_PRACTICE"
PRACTICE_PATTERN = r"(?i)\b(was|were|been)\s+(drilled|completed|cased|cemented)\b(?:[^.]|\.(?=\d)){0,180}?\b(without|with no|no)\b[^.]{0,40}?\b(loss|losses|problems?|incidents?|tight hole|stuck pipe|trouble|kick|gas)"
# Types that a type's story takes up, and types that another one of the same sentence hides.
ABSORBS = {"STUCK_PIPE": {"TIGHT_HOLE", "TORQUE_SPIKE", "WELLBORE_INSTABILITY"}, "CEMENTING_PROBLEM": {"LOST_CIRCULATION"}, "TIGHT_HOLE": {"WELLBORE_INSTABILITY"}, "WELLBORE_INSTABILITY": {"TIGHT_HOLE"}}
HIDES = {"CEMENTING_PROBLEM": {"LOST_CIRCULATION"}, "STUCK_PIPE": {"TIGHT_HOLE", "TORQUE_SPIKE"}}
# Actions against trouble, in order.
ACTIONS = {
    "REDUCE_FLOW_ECD": r"(reduced|reduce|cut|lowered|limited|restricted)\s+(the\s+)?(flow rate|pump rate|flow|spm|pump strokes|ecd)|flow rate (was )?(limited|restricted|reduced|kept)|ecd (management|was managed|kept below)",
    "LCM_PILL": r"\blcm\b|lost circulation material|caco3|calcium carbonate|fib(rous|re|er) (pill|lcm)|\bmica\b",
    "REDUCE_MW": r"(reduced|cut back|lowered)\s+(the\s+)?(mw|mud weight)",
    "RAISE_MW": r"(raised|increased)\s+(the\s+)?(mw|mud weight)|weight(ed)? up|mw (was )?(raised|increased)",
    "CEMENT_PLUG": r"cement plug|squeeze",
    "JARRING": r"\bjar(red|ring|s)?\b",
    "SPOTTING_PILL": r"spot(ted)?\s+[^.]{0,30}(pipe[- ]?lax|freeing|spotting|acid|diesel|lubricant) (pill|fluid)|pipe[- ]?lax",
    "BACKREAM_WIPER": r"back[- ]?ream(ed|ing)?|wiper trip|short trip|\breamed\b",
    "CIRCULATE_SWEEP": r"circulated (and conditioned|bottoms? up|hole clean|out)|hi[- ]?vis(cosity)? (pill|sweep)|high[- ]vis(cosity)? (pill|sweep)",
    "WELL_CONTROL": r"shut[- ]?in|shut the well|driller'?s method|wait and weight|circulated out (the )?(kick|influx|gas)|killed the well",
    "DRILLING_PARAMS": r"(reduced|optimi[sz]ed|adjusted|lowered)\s+(the\s+)?(wob|rpm|rotary speed|weight on bit)|controlled (drilling|rop)|rop (was )?(controlled|limited)",
    "INHIBITIVE_MUD": r"\bkcl\b|glycol|inhibit(ive|ed|ion)|\bphpa\b|polyamine|(switched|changed|converted) to (obm|sbm|oil[- ]based)",
    "LUBRICANT": r"lubricant|lubricity",
    "CASING_POINT": r"casing (point|shoe) (was )?(set|selected)|(set|ran) (the )?[\d /]+\"? casing (at|above)",
    "SIDETRACK": r"side ?track(ed)?",
    "FISHING": r"\bfish(ing)?\b|back(ed)?[- ]off",
}
# How a story ended; the first that is found counts.
OUTCOMES = [
    ("failed", r"unable to free|could not be (freed|cured)|not cured|sidetrack|plugged back|abandon|unsuccessful|second squeeze"),
    ("partial", r"partially (cured|successful)|reduced to seepage|continued (drilling )?with (seepage|losses)|persisted"),
    ("resolved", r"(loss|losses) (were )?cured|regained (full )?returns|full returns (were )?(regained|established|restored)|(pipe|string) (was )?(freed|came free)|came free|worked free|freed the (pipe|string)|well (was )?(killed|stabili[sz]ed|static)|stabili[sz]ed|torque (stabili[sz]ed|normali[sz]ed|reduced)|subsequent trip(s)? (was |were )?(smooth|good)|remedial (job|squeeze) (was )?successful|reduced to background|without (losses|problems|incident)|no (further|more)|problem resolved|cavings (reduced|subsided|stopped)|hole (conditioned|in good condition)"),
]
SUBTYPES = {
    "LOST_CIRCULATION": [("total", r"\btotal\b|no returns|complete loss"), ("severe", "severe"), ("partial", "partial"), ("seepage", "seepage")],
    "STUCK_PIPE": [("differential", "differential"), ("pack-off", r"pack[- ]?off|immobili|coal")],
    "OVERPRESSURE_KICK": [("kick", r"\bkick\b|influx|flowed|pit gain|flow check"), ("high gas", "")],
    "CEMENTING_PROBLEM": [("losses during cementing", r"during (the )?cement"), ("poor bond", "bond|cbl|channel"), ("toc deeper", r"top of cement|\btoc\b")],
    PRACTICE: [("lower Tipam drilled without losses", "tipam"), ("Barail drilled without stuck pipe", "barail"), ("practice", "")],
}
LOST_HOURS = r"(?i)(?:NPT[:\s]*(?:of\s*)?(\d+(?:\.\d+)?)\s*(?:hrs?|hours?|h)\b)|(?:(\d+(?:\.\d+)?)\s*(?:hrs?|hours?)\s+lost)|(?:non-productive time[:\s]*(\d+(?:\.\d+)?))"
LOSS_RATE = r"(?i)(\d+(?:\.\d+)?)\s*(bbls?\s*/?\s*hr?\b|bph|m3\s*/?\s*hr?\b)"
MUD_WEIGHT = r"(?i)\b(?:MW|mud weight)\b[^0-9]{0,25}?(\d+(?:\.\d+)?)\s*(ppg|SG|s\.g\.)?"
DATE = r"\b(\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\d{4})\b"
TABLE_ROW = r"\d{2}\s*:\s*\d{2}\s*-\s*\d{2}\s*:\s*\d{2}\s*[|lI!]\s*[\d.]+\s*h\s*[|lI!]\s*[A-Z]{2,5}\s*[|lI!]\s*"
