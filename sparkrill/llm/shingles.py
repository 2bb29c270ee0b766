"""Tokens, shingles and sets of whole texts, vectorised over a batch.

A token is a run of letters and digits of one word, or one character of a script without blanks between
words. Case, accents, punctuation, look-alikes and blanks make no difference.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from sparkrill.llm.confusables import consistent

_MUL = np.uint64(0x9E3779B97F4A7C15)
_GAP = 0
_DROP = -1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point to folded code point (0: between tokens, -1: no character), and whether it is a token of its own."""
    fold = np.zeros(0x110000, np.int32)
    single = np.zeros(0x110000, bool)
    for code in range(0x30000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf"):
            fold[code] = _DROP
        elif kind[0] in "LN" or kind == "Mc":
            base = unicodedata.normalize("NFD", c.lower())[0]
            fold[code] = ord(base)
            single[code] = 0x2E80 <= code <= 0x9FFF or 0xF900 <= code <= 0xFAFF or 0x20000 <= code <= 0x2FFFF or 0x0E00 <= code <= 0x0EFF
    return fold, single


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, whether each is a single character, and where each text begins (one more than texts)."""
    fold, single = _tables()
    forms = [consistent(t) or "" for t in texts]
    lengths = np.fromiter(map(len, forms), np.int64, len(forms)) + 1
    codes = np.frombuffer((" ".join(forms) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if forms else np.zeros(0, np.uint32)
    ends = np.cumsum(lengths)
    folded = fold[codes]
    alone = single[codes]
    kept = folded != _DROP
    if not kept.all():
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        folded, alone = folded[kept], alone[kept]
    inside = folded > 0
    run = inside & ~alone
    begins = run.copy()
    begins[1:] &= ~run[:-1]
    starts = np.flatnonzero(begins | (inside & alone))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
    # A polynomial hash of each token: the gaps between tokens add nothing.
    place = np.arange(len(folded)) - np.repeat(starts, np.diff(np.append(starts, len(folded)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(folded)) - np.repeat(starts, np.diff(np.append(starts, len(folded))))])
    powers = np.cumprod(np.full(min(int(place.max()) + 1, 4096), _MUL, np.uint64))
    terms = np.where(inside, mixed(folded.astype(np.int64).astype(np.uint64)) * powers[place % len(powers)], np.uint64(0))
    hashes = mixed(np.add.reduceat(terms, starts))
    offsets = np.searchsorted(starts, np.concatenate([[0], ends]))
    return hashes, alone[starts], offsets


def spelled(text: str) -> str:
    """A word for each character that is not blank, for texts of emoji or signs alone."""
    return " ".join(f"u{ord(c):x}" for c in text if not c.isspace())


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each token with the n - 1 after it; the last ones run over the end, the caller cuts them."""
    total = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        total *= _MUL
        total[: len(hashes) - k] += hashes[k:]
    return mixed(total)


def shingles(hashes: np.ndarray, alone: np.ndarray, offsets: np.ndarray, words: int, characters: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle that begins at each token, of so many words or characters, and where each text's begin.

    A text shorter than its shingle has one shingle of all its tokens.
    """
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = offsets[1:][doc] - np.arange(len(hashes))
    n = np.where(alone, characters, words)
    both = np.where(alone, _rolled(hashes, characters), _rolled(hashes, words)) if len(hashes) else hashes
    first = np.zeros(len(hashes), bool)
    first[offsets[:-1][sizes > 0]] = True
    kept = left >= n
    short = first & ~kept
    if short.any():
        at = np.flatnonzero(short)
        both[at] = [mixed(np.array([np.bitwise_xor.reduce(mixed(hashes[i : i + left[i]] + np.arange(left[i], dtype=np.uint64)))], np.uint64))[0] for i in at]
    kept |= short
    return both[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def text_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each text's whole token sequence; 0 for a text without tokens."""
    sizes = np.diff(offsets)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], sizes)
    terms = mixed(hashes + mixed(place.astype(np.uint64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return np.where(sizes > 0, sums[offsets[1:]] - sums[offsets[:-1]], np.uint64(0)).astype(np.uint64)


def bigram_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The set of each text's token pairs as sorted 24-bit hashes: four bytes with the number of tokens, the low 16 bits of all hashes, their high 8 bits."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pair = _rolled(hashes, 2) if len(hashes) else hashes
    left = offsets[1:][doc] - np.arange(len(hashes))
    kept = (left >= 2) | (np.diff(offsets)[doc] == 1)
    doc, pair = doc[kept], pair[kept]
    keys = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (pair & np.uint64(0xFFFFFF)))
    at = np.searchsorted(keys, np.arange(len(sizes) + 1, dtype=np.uint64) << np.uint64(32))
    low, high = keys.astype("<u2"), (keys >> np.uint64(16)).astype(np.uint8)
    counts = sizes.astype("<u4")
    return [c.tobytes() + low[a:b].tobytes() + high[a:b].tobytes() for a, b, c in zip(at[:-1], at[1:], counts)]


def pair_set(data: bytes) -> np.ndarray:
    """The sorted hashes of one set of bigram_sets."""
    n = (len(data) - 4) // 3
    return np.frombuffer(data, "<u2", n, 4).astype(np.uint32) | np.frombuffer(data, np.uint8, n, 4 + 2 * n).astype(np.uint32) << np.uint32(16)


def overlap(a: bytes, b: bytes) -> float:
    """What two sets of bigram_sets have in common, of both taken together; at most the ratio of the texts' lengths in tokens."""
    x, y = pair_set(a), pair_set(b)
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    m, n = int.from_bytes(a[:4], "little"), int.from_bytes(b[:4], "little")
    return min(shared / (len(both) - shared), min(m, n) / max(m, n))
