"""Word and shingle hashes of whole texts with numpy, a few operations a byte and none a word."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

SHINGLE_WORDS = 5
#: As in the license scan: digits, letters and anything that isn't ASCII, after lower-casing.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.array([chr(b).isdigit() or chr(b).islower() or b >= 0x80 for b in range(256)])
_IS_WORD[0x80:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts are taken in blocks of so many bytes, so that one long text needs little memory at a time.
BLOCK = 1 << 20
#: Bytes of short texts that are hashed together: few enough for the processor's cache.
TOGETHER = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(BLOCK + 64, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _block_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of bytes that don't end within a word, and where each begins: polynomials over prefix sums
    modulo 2^64, finalised."""
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    first, end = edges[::2], edges[1::2]
    up = _UP if len(raw) < len(_UP) else np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(raw), _BASE, np.uint64)])
    down = _DOWN if len(raw) < len(_DOWN) else np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(raw), _INVERSE, np.uint64)])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)), first


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word of the lower-cased text, in order."""
    return _hashes(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8))


def _hashes(raw: np.ndarray) -> np.ndarray:
    if len(raw) <= BLOCK:
        return _block_hashes(raw)[0]
    out, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        if end < len(raw):  # back to the last byte that is in no word; a word longer than a block makes the block longer
            gaps = np.flatnonzero(~_IS_WORD[raw[at:end]])
            while not len(gaps) and end < len(raw):
                end = min(end + BLOCK, len(raw))
                gaps = np.flatnonzero(~_IS_WORD[raw[at:end]])
            end = at + gaps[-1] + 1 if len(gaps) and end < len(raw) else end
        out.append(_block_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(out)


_PLACES = [np.uint64(pow(0xD6E8FEB86659FD93, n + 1, 1 << 64)) for n in range(SHINGLE_WORDS)]


def shingle_hashes(text: str) -> np.ndarray:
    """A hash for each run of SHINGLE_WORDS words, in order; none for shorter texts."""
    return _runs(word_hashes(text))


def _runs(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE_WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, place in enumerate(_PLACES):
        total += words[k : k + n] * place
    return mix(total)


def batch_shingles(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """shingle_hashes of each text (null: as empty); short texts are hashed together, which takes fewer calls."""
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").lower().encode("utf-8", "replace")
        if size + len(raw) > TOGETHER:
            yield from _together(waiting)
            waiting, size = [], 0
        waiting.append(raw)
        size += len(raw) + 1
    yield from _together(waiting)


def _together(raws: list[bytes]) -> Iterator[np.ndarray]:
    if len(raws) == 1:
        yield _runs(_hashes(np.frombuffer(raws[0], np.uint8)))
    elif raws:
        joined = np.frombuffer(b"\n".join(raws), np.uint8)
        words, first = _block_hashes(joined)
        ends = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raws]))
        runs, start = _runs(words), 0
        for end in ends:
            yield runs[start : max(end - SHINGLE_WORDS + 1, start)]
            start = end


def weighted_elements(shingles: np.ndarray) -> np.ndarray:
    """Shingles as a weighted set in unit parts: the n-th occurrence of a shingle is a part of its own. Distinct.

    The Jaccard similarity of such sets is the weighted one of the shingles' counts.
    """
    found = np.sort(shingles)
    if not len(found):
        return found
    starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    nth = np.arange(len(found)) - np.repeat(starts, np.diff(np.r_[starts, len(found)]))
    return mix(found + nth.astype(np.uint64) * _BASE)
