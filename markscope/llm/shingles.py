"""Sets of word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Bytes of text hashed at once; bounds the arrays of one step.
STEP_BYTES = 8_000_000

_MULTIPLIER = [np.uint64(int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "little") | 1) for i in range(64)]


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k (at most 63) consecutive words, given the words' hashes."""
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = out * _MULTIPLIER[63] + h[j:len(h) - k + 1 + j] * _MULTIPLIER[j]
    return mixed(out)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (uint64) of its k-word shingles; with
    fewer words the whole sequence is one shingle; without words the set is empty."""
    out: list[np.ndarray] = []
    words: list[bytes] = []
    counts: list[int] = []

    def flush() -> None:
        h = word_hashes(words)
        at = 0
        for n in counts:
            own = h[at:at + n]
            out.append(np.unique(window_hashes(own, min(k, n))) if n else np.zeros(0, np.uint64))
            at += n
        words.clear(), counts.clear()

    size = 0
    for t in texts:
        w = ascii_words(t)
        words += w
        counts.append(len(w))
        size += len(t or "")
        if size >= STEP_BYTES:
            flush()
            size = 0
    flush()
    return out
