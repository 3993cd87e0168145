"""Brute-force versions of the contracts, on plain Python lists."""

from __future__ import annotations

import hashlib
import re

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spans_text(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


def luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(d[::-1]):
        x = int(c)
        if i % 2:
            x = 2 * x
            if x > 9:
                x -= 9
        t += x
    return t % 10 == 0


def secrets(text: str | None) -> str:
    t, found = text or "", []
    found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return spans_text(found)


def private(text: str | None) -> str:
    t, found = text or "", []
    found += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end(), "card"))
    found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall(r"[0-9]", m[0])) <= 15]
    return spans_text(found)


BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(docs: list[tuple[int | None, str | None]]) -> dict[int | None, tuple]:
    """doc_id -> keep_id, group_size, kept, text_sha256."""
    groups: dict[str, list] = {}
    for d, t in docs:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    return {m[3]: (min(ms)[3], len(ms), m[3] == min(ms)[3], digest(key)) for key, ms in groups.items() for m in ms}


def simhash(text: str | None) -> int:
    import xxhash

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """doc_id -> fingerprint, smallest doc_id reachable."""
    prints = {d: simhash(t) for d, t in docs}
    ids, root = sorted(prints), {d: d for d in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def conversations(rows: list[tuple[int, int, str, str | None]]) -> dict[int, tuple]:
    """conv_id -> turns, digest of roles and texts, characters and digest of what assistants say."""
    out: dict[int, list] = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role or "", text or ""))
    found = {}
    for conv, turns in out.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        found[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learnt), digest(learnt))
    return found


def targets(docs: list[tuple[str | None, str | None]]) -> dict[str | None, tuple[int, float]]:
    """source -> size, target."""
    size: dict[str | None, int] = {}
    for source, text in docs:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    ordered = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    left, open_, target = 1.5 * sum(size.values()), set(ordered), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    return {s: (size[s], target[s]) for s in ordered}


def repeats(docs: list[tuple[int, str | None]], width: int = 13) -> dict[int, tuple[int, int, str]]:
    """doc_id -> words, words removed, digest of the kept text."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words, reverse=True):
        for i in range(len(words[d]) - width + 1):
            first[tuple(words[d][i : i + width])] = d
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(ws), sum(gone), digest(" ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def distance_within(item: list[str], text: list[str]) -> int:
    """Least word edit distance of an item to any stretch of a text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
