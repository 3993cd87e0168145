"""Secret scan with a password guess-cost model.

Three base grammars give assignments, access keys and hex runs. Each value that stands in a credential context, whatever its
form, is further rated by how many guesses an informed attacker needs: dynamic programming finds the cheapest segmentation
into dictionary words, dates, repeats, keyboard walks and brute-force spans (log10 guesses, additive over segments). The
dictionary is learnt: the ``LEARNT`` commonest words of all documents, behind a few words of passwords.
Values at or over ``strong`` are added as ``guess`` spans: they are too costly to be prose or a placeholder. Cheap ones
(``password: monkey1``) are reported as ``weak`` spans. A text is scanned once, whole, by one task; only word counts are
shuffled.

Cases: null or empty text has no span; a base match that is too short is dropped but still consumes its characters; rows
that repeat are scanned each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Mapping
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boresight.llm.common import cut, map_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess", "weak")
ASSIGN = re.compile(rb"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}+")
CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"pwd", b"passphrase", b"credential")
#: A cue, perhaps "is" or "was", blanks with at most one sign among them, and the value. Blanks are taken once, never given back: a padded page takes linear time.
CONTEXT = re.compile(rb"(?i:(?:password|passwd|pwd|passphrase|secret|token|credential|api_?key))[\"']?+(?:\x20++(?i:is|was)(?![A-Za-z0-9_]))?+\x20*+(?:[:=]\x20*+)?+[\"']?+([\x21-\x26\x28-\x7e]{6,})")
# Common words of passwords, most common first; they come before the words of the corpus.
WORDS = tuple("password qwerty dragon monkey letmein football baseball shadow master sunshine princess welcome iloveyou admin login secret hello freedom whatever trustno test guest root changeme default example summer winter spring autumn".split())
LETTERS = re.compile(rf"(?<![a-z])[a-z]{{4,{16}}}(?![a-z])".encode())
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2})")
LEET = str.maketrans("4@301$57", "aaeoisst")
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST, LEARNT = 16, 20_000  # letters of a word, words learnt


def _neighbours() -> set[tuple[str, str]]:
    """Pairs of keys side by side on a row, or one row apart."""
    out = set()
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            near = [row[c + 1 : c + 2]] + ([ROWS[r + 1][max(0, c - 1) : c + 1]] if r + 1 < len(ROWS) else [])
            for other in "".join(near):
                out |= {(key, other), (other, key)}
    return out


NEAR = _neighbours()


class Lane:
    """Least cost[start] + price(position - start) over the starts given so far, for a price that grows ever more slowly.

    As the price is concave, an older start that has become as good as a newer one stays so. The stack holds, from its top,
    the starts in the order in which each is the best, so a start is put and taken once.
    """

    def __init__(self, price: Callable[[int], float], end: int) -> None:
        self.price, self.end, self.stack = price, end, []  # start, its cost, the last position at which it is the best

    def put(self, start: int, cost: float, now: int) -> None:
        while self.stack:
            old, its, until = self.stack[-1]
            worse = lambda x: cost + self.price(x - start) >= its + self.price(x - old)
            if until < now:
                self.stack.pop()
            elif worse(now):
                return
            elif until < self.end and not worse(until):
                self.stack.pop()
            else:
                low, high = now, min(until, self.end) + 1  # not worse, worse
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (low, mid) if worse(mid) else (mid, high)
                self.stack.append((start, cost, low))
                return
        self.stack.append((start, cost, self.end))

    def least(self, now: int) -> float:
        while self.stack and self.stack[-1][2] < now:
            self.stack.pop()
        if not self.stack:
            return math.inf
        start, cost, _ = self.stack[-1]
        return cost + self.price(now - start)


def stretches(flags: list[bool], least: int) -> list[tuple[int, int]]:
    """Where runs of at least ``least`` true flags begin and end."""
    out, begun = [], None
    for i, flag in enumerate([*flags, False]):
        if flag and begun is None:
            begun = i
        elif not flag and begun is not None:
            if i - begun >= least:
                out.append((begun, i))
            begun = None
    return out


def guess_cost(value: str, words: Mapping[str, int] = RANKS, most: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes, the true minimum where that is below ``most``.

    Segments are words (their rank), dates, walks over neighbouring keys and repeated blocks, from every start and of every
    length, and single characters by brute force. A block of up to ``LONGEST`` characters costs what its own cheapest
    segmentation does, a longer one its characters, and the count of its copies comes on top; long blocks that cost ``most``
    alone are left out. Time grows with the length times the block lengths tried.
    """
    return _least(value, words, most, _alphabet(value))


def _alphabet(value: str) -> float:
    """log10 of the guesses of one character, by the classes that the whole value uses."""
    return math.log10(max(10, 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value)))


def _least(value: str, words: Mapping[str, int], most: float, char: float) -> float:
    low, n = value.lower(), len(value)
    plain = low.translate(LEET)
    blocks: dict[str, float] = {}

    def block(start: int, p: int) -> float:
        if p > LONGEST:
            return p * char
        if (text := value[start : start + p]) not in blocks:
            blocks[text] = _least(text, words, most, char)
        return blocks[text]

    best = [0.0] + [math.inf] * n
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if m := DATE.match(value, i):
            dates.setdefault(m.end(), []).append((i, math.log10(365 * 120) if len(m[0]) > 4 else math.log10(120)))
    opened: dict[int, list[tuple[int, Lane, int, int]]] = {}  # by first end: step of the ends, lane, size of the shortest segment, last end

    def lane(first: int, last: int, shortest: int, step: int, price: Callable[[int], float]) -> None:
        opened.setdefault(first, []).append((step, Lane(price, last), shortest, last))

    for s, e in stretches([(a, b) in NEAR for a, b in zip(low, low[1:])], 2):  # e is the place of the last key
        lane(s + 3, e + 1, 3, 1, lambda size: math.log10(40) + 0.6 * (size - 1) ** 0.5 + math.log10(size))
    for p in range(1, min(n // 2, max(LONGEST, int(min(most / char, n)))) + 1):
        for s, e in stretches([low[i] == low[i + p] for i in range(n - p)], p):  # of period p from s to e + p
            for k in range(min(p, e - s - p + 1)):
                lane(s + k + 2 * p, e + p, 2 * p, p, lambda size, p=p, unit=block(s + k, p): unit + math.log10(size / p))
    for j in range(1, n + 1):
        cost = best[j - 1] + char
        for i in range(max(0, j - LONGEST), j - 2):
            for form, more in ((low, 0.3), (plain, 0.6)):
                if r := words.get(form[i:j]):
                    cost = min(cost, best[i] + math.log10(r) + more + (math.log10(2) if value[i:j] != low[i:j] else 0.0))
        for i, price in dates.get(j, ()):
            cost = min(cost, best[i] + price)
        for step, it, shortest, last in opened.pop(j, ()):
            it.put(j - shortest, best[j - shortest], j)
            cost = min(cost, it.least(j))
            if j + step <= last:
                opened.setdefault(j + step, []).append((step, it, shortest, last))
        best[j] = cost
    return best[n]


def _characters(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if data.isascii():
        return spans
    marks = sorted({x for s, _, e in spans for x in (s, e)})
    at = dict(zip(marks, accumulate(len(data[a:b].decode("utf-8", "replace")) for a, b in zip([0, *marks], marks)), strict=False))
    return [(at[s], k, at[e]) for s, k, e in spans]


def spans_of(data: bytes, strong: float, weak: float, words: Mapping[str, int] = RANKS) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans of a UTF-8 text, in code points, sorted."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    low = data.lower()
    if any(cue in low for cue in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 12]
        costs: dict[str, float] = {}  # a value that a text repeats is rated once
        for m in CONTEXT.finditer(data):
            value = m[1].decode().rstrip(".,;\"'")
            has_sign = b":" in data[m.start() : m.start(1)] or b"=" in data[m.start() : m.start(1)]
            if len(value) < 6 or not (has_sign or any(c.isdigit() for c in value)):
                continue  # prose after a cue word
            if (cost := costs.get(value)) is None:
                cost = costs[value] = guess_cost(value, words, strong)
            if cost >= strong or (has_sign and cost < weak):
                found.append((m.start(1), 3 if cost >= strong else 4, m.start(1) + len(value)))
    return sorted(_characters(data, found)) if found else found


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def ranks(docs: DataFrame, most: int = LEARNT, least_docs: int = 3) -> dict[str, int]:
    """Ranks of words: ``WORDS``, then the ``most`` words of 4 to ``LONGEST`` letters that most documents hold, of ``least_docs`` at least."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter(w for t in batch.column("text").to_pylist() for w in set(LETTERS.findall(t.lower())))
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in found], pa.string()), "n": pa.array(found.values(), pa.int64())})

    counts = map_batches(docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = cut(counts.where(F.col("n") >= least_docs).orderBy(F.desc("n"), "word").limit(most))  # merged by a task: the driver gets ``most`` rows
    learnt = [r.word for r in sorted(top.collect(), key=lambda r: (-r.n, r.word))]
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *learnt]))}


def find_secrets(docs: DataFrame, strong: float = 12.0, weak: float = 6.0) -> DataFrame:
    """``doc_id``, a count a base kind, the digest of the base spans, all spans as text and as structs."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"

    words = ranks(docs)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [spans_of(t, strong, weak, words) for t in batch.column("text").to_pylist()]
        base = [[s for s in r if s[1] < len(BASE)] for r in rows]
        counts = {f"n_{kind}": pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k, kind in enumerate(BASE)}
        structs = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in r] for r in rows]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), **counts,
            "base_sha256": [hashlib.sha256(joined(r).encode()).hexdigest() for r in base],
            "spans": [joined(r) for r in rows],
            "found": pa.array(structs, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
        })

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), scan, schema)
