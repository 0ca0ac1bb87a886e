"""Hashed word-shingle sets, computed batch-wise with numpy inside Spark tasks.

A text is lower-cased on A-Z only and cut on ASCII white space (space and 0x09-0x0D), which is
what ``bytes.lower`` and ``bytes.split`` do on its UTF-8 form.  Its set holds the distinct
``width``-word shingles; a text with fewer words has the whole word sequence as its one element;
a null, empty or blank text has the empty set.  Shingles are 64-bit hashes: two different
shingles of one pair of texts meet with a probability near 2**-40 even for 2,000-word texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts in it) of a batch of texts."""
    words: list[bytes] = []
    bounds = [0]
    for text in texts:
        if isinstance(text, str):
            words.extend(text.encode("utf-8", "surrogatepass").lower().split())
        bounds.append(len(words))
    if not words:
        return np.zeros(0, np.uint64), np.array(bounds)
    array = np.empty(len(words), dtype=object)
    array[:] = words
    codes, uniques = pd.factorize(array)
    return pd.util.hash_array(uniques, categorize=False)[codes], np.array(bounds)


def shingle_sets(texts, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text of a batch."""
    hashes, bounds = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : n - width + 1 + k] * _ODD[k % len(_ODD)] + np.uint64(k)
    rolled = mix64(rolled)
    out = []
    for start, end in zip(bounds[:-1], bounds[1:]):
        count = end - start
        if count >= width:
            out.append(np.unique(rolled[start : end - width + 1]))
        elif count:
            whole = hashlib.blake2b(hashes[start:end].tobytes(), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(whole, np.uint64).copy())
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(values: np.ndarray) -> bytes:
    """A 128-bit digest of a sorted shingle set: equal sets, and only they, share it."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
