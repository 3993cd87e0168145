"""XXH64 of many short pieces of a batch of texts at once, and the words that they lie between."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_ALL = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
#: Pieces of so many bytes are hashed one at a time.
LONG = 96
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _u(x: int) -> np.uint64:
    return np.uint64(x & _ALL)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _u(by)) | (x >> _u(64 - by))


def _round(kept: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotated(kept + lane * _u(_P2), 31) * _u(_P1)


def _alike(eight: np.ndarray, four: np.ndarray, body: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The hashes of the pieces of one ``size`` that begin ``at``."""
    done = 0
    if size >= 32:
        lanes = [np.full(len(at), _u(s)) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while size - done >= 32:
            lanes = [_round(lane, eight[at + (done + 8 * i)]) for i, lane in enumerate(lanes)]
            done += 32
        h = sum((_rotated(lane, by) for lane, by in zip(lanes[1:], (7, 12, 18))), _rotated(lanes[0], 1))
        for lane in lanes:
            h = (h ^ _round(_u(0), lane)) * _u(_P1) + _u(_P4)
        h += _u(size)
    else:
        h = np.full(len(at), _u(seed + _P5 + size))
    while size - done >= 8:
        h = _rotated(h ^ _round(_u(0), eight[at + done]), 27) * _u(_P1) + _u(_P4)
        done += 8
    if size - done >= 4:
        h = _rotated(h ^ four[at + done] * _u(_P1), 23) * _u(_P2) + _u(_P3)
        done += 4
    for k in range(done, size):
        h = _rotated(h ^ body[at + k] * _u(_P5), 11) * _u(_P1)
    for by, times in ((33, _P2), (29, _P3)):
        h = (h ^ (h >> _u(by))) * _u(times)
    return h ^ (h >> _u(32))


def xxh64(text: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The XXH64 of the pieces of ``text`` that begin at ``starts`` and have ``sizes`` bytes, as unsigned longs; pieces may overlap."""
    body = np.frombuffer(text + bytes(8), np.uint8)
    eight, four = (np.ndarray((len(body) - 7,), kind, body, strides=(1,)) for kind in ("<u8", "<u4"))
    out = np.empty(len(starts), np.uint64)
    short = np.minimum(sizes, LONG).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    ends = np.cumsum(np.bincount(short, minlength=LONG + 1))
    for size in np.unique(short):
        mine = order[ends[size - 1] if size else 0 : ends[size]]
        if size == LONG:
            out[mine] = [xxhash.xxh64_intdigest(text[s : s + n], seed) for s, n in zip(starts[mine].tolist(), sizes[mine].tolist())]
        else:
            out[mine] = _alike(eight, four, body, starts[mine], int(size), seed)
    return out


def in_turn(texts: list[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts in order, in lists of at most so many bytes or of one text, so that what is made of a batch stays small."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words with one blank behind each, A-Z lower-cased; where they begin, their bytes, and how many words each text has. The six ASCII blanks divide."""
    joined = b"\n".join([*texts, b""]).lower()
    body = np.frombuffer(joined, np.uint8)
    inside = np.empty(len(body) + 1, bool)
    inside[0] = False
    np.logical_not(_BLANK[body], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # the last byte is a blank, so words begin and end in turn
    sizes = edges[1::2] - edges[::2]
    after = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    many = np.diff(np.searchsorted(edges[::2], after), prepend=0)
    kept = body[inside[1:] | inside[:-1]]
    ends = np.cumsum(sizes + 1)
    kept[ends - 1] = 32
    return kept.tobytes(), ends - sizes - 1, sizes, many


def windows(many: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and the last word of each window of ``words``, and how many windows each text has; all words of a text that has fewer are one."""
    each = np.where(many > 0, np.maximum(many - words + 1, 1), 0)
    skipped = np.repeat(np.cumsum(many - each) - (many - each), each)  # words of the texts before that begin no window
    first = np.arange(each.sum()) + skipped
    return first, np.minimum(first + words, np.repeat(np.cumsum(many), each)) - 1, each
