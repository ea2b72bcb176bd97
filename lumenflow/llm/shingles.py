"""Words and five-word shingles of whole texts, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Lower-cases A-Z in UTF-8 bytes. bytes.split() then splits at exactly 0x20 and 0x09 to 0x0D.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WIDTH = 5
WORDS = 100_000  # entries of a worker's cache of word hashes; a full cache starts anew
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a text in UTF-8."""
    return text.translate(LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer than five words make one shingle; no words, none."""
    get = _hashes.__getitem__
    split = [words(t) for t in texts]
    sizes = np.array([len(w) for w in split])
    flat = np.fromiter((get(w) for ws in split for w in ws), np.uint64, int(sizes.sum()))
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(min(WIDTH, len(flat))):
        rolled[: len(flat) - k] += flat[k:] * _MUL[k]
    rolled = mix(rolled)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WIDTH:
            s = np.sort(rolled[at : at + n - WIDTH + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            out.append(mix((flat[at : at + n] * _MUL[:n]).sum(dtype=np.uint64)[None] + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
