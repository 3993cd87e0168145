"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes, and cue words of accounts and streets. Local
parsers expand each anchor (an IBAN from its first digit, wherever it stands) to the span around it and validate it: e-mail, IP, card (Luhn) and phone spans are the base
kinds, in the contract's grammar; url, iban (mod 97), account and address spans are added by the same means. A text is
read once, whole, by one task; there is no shuffle.

Cases: null or empty text has no span; spans of a kind never overlap; an anchor inside a span already taken, or one that
fails, gives none. Rows that repeat are scanned each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boresight.llm.common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "address")
# The cue words of accounts and streets.
ACCOUNT_CUES = ("account", "acct", "customer no", "konto", "compte", "cuenta", "ssn")
STREET_CUES = (" street", " avenue", " road", " lane", " boulevard", "straße", "strasse", "rue ", "calle ", "avenida ")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?::[0-9]{1,5})?(?:/[^\x00-\x20\"'<>]*+)?")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: *(?:number|no\.?|nr\.?|id))? *[:=#]? *([0-9][0-9-]{4,20}[0-9])(?![0-9])")
STREET_BEFORE = re.compile(r"(?<![0-9])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){0,2}[A-Z][a-z]{1,20}$")
STREET_AFTER = re.compile(r"(?:[A-Za-z]{1,20} ){0,3}[A-Za-z]{1,20},? [0-9]{1,5}(?![0-9])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for what, cues in (("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("url", ("http://", "https://", "ftp://")), ("account", ACCOUNT_CUES), ("street", STREET_CUES)):
        for cue in cues:
            found.add_word(cue, (what, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number of the IBAN form has its check digits right."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Scanner:
    """Finds the spans of a text; holds the automaton, one a worker."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def email(self, text: str, at: int, free: int) -> tuple[int, int, bool] | None:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start == at or not (m := DOMAIN.match(text, at + 1)):
            return None
        return start, m.end(), True

    def ip(self, text: str, i: int) -> tuple[int, int, bool] | None:
        if not (m := QUAD.match(text, i)):
            return None
        return i, m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups()))

    def card(self, text: str, i: int) -> tuple[int, int, bool] | None:
        if not (m := CARD.match(text, i)):
            return None
        digits = m[0].replace(" ", "").replace("-", "")
        return i, m.end(), 12 <= len(digits) <= 19 and luhn(digits)

    def iban(self, text: str, i: int) -> tuple[int, int, bool] | None:
        m = IBAN.match(text, i)
        return m and (i, m.end(), mod97(m[0].replace(" ", "")))

    def phone(self, text: str, i: int) -> tuple[int, int, bool] | None:
        if not (m := PHONE.match(text, i)):
            return None
        return i, m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15

    def cued(self, what: str, text: str, start: int, end: int) -> tuple[int, int, bool] | None:
        if what == "url":
            m = URL.match(text, start)
            return m and (start, m.end(), True)
        if what == "account":
            m = ACCOUNT.match(text, end)
            return m and (m.start(1), m.end(1), True)
        if m := STREET_BEFORE.search(text[max(0, start - 80) : start]):  # the pattern spans 72 characters at most
            return start - len(m[0]), end, True
        m = STREET_AFTER.match(text, end) if text[start : start + 1].isupper() else None
        return m and (start, m.end(), True)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place in KINDS, end) of all spans, sorted."""
        lower = text.lower()
        if len(lower) != len(text):  # a letter that lower-cases to two
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        free, found = dict.fromkeys(KINDS, 0), []

        def put(kind: str, hit: tuple[int, int, bool] | None) -> None:
            if hit and hit[0] >= free[kind]:
                free[kind] = hit[1]
                if hit[2]:
                    found.append((hit[0], KINDS.index(kind), hit[1]))

        for last, (what, size) in self.anchors.iter(lower):
            start = last - size + 1
            if what == "digit":
                if start and "0" <= text[start - 1] <= "9":
                    continue
                if start >= free["ip"]:
                    put("ip", self.ip(text, start))
                if start >= free["card"]:
                    put("card", self.card(text, start))
                if start - 2 >= free["iban"] and text[start - 1].isupper():
                    put("iban", self.iban(text, start - 2))
            elif what == "at":
                put("email", self.email(text, start, free["email"]))
            elif what == "plus":
                if start >= free["phone"]:
                    put("phone", self.phone(text, start))
            else:
                kind = {"street": "address"}.get(what, what)
                put(kind, self.cued(what, text, start, last + 1))
        return sorted(found)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def find_private(docs: DataFrame) -> DataFrame:
    """``doc_id``, a count a base kind, the digest of the base spans, all spans as text and as structs."""
    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"

    scanner: list[Scanner] = []

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner[:] = scanner or [Scanner()]
        rows = [scanner[0].spans(t) for t in batch.column("text").to_pylist()]
        base = [[s for s in r if s[1] < len(BASE)] for r in rows]
        counts = {f"n_{kind}": pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k, kind in enumerate(BASE)}
        structs = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in r] for r in rows]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), **counts,
            "base_sha256": [hashlib.sha256(joined(r, KINDS).encode()).hexdigest() for r in base],
            "spans": [joined(r, KINDS) for r in rows],
            "found": pa.array(structs, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
        })

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), scan, schema)
