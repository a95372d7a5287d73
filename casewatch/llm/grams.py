"""Character n-grams of words, hashed with numpy, and linear scores over them."""

from __future__ import annotations

import numpy as np

MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


class Vocabulary(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_grams(words: list[bytes], bits: int, sizes: tuple[int, ...], whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of ``<word>``, and of each whole word if asked.

    n-grams count characters (code points); buckets are ``bits`` wide.
    """
    marked = ["<" + w.decode("utf-8", "replace") + ">" for w in words]
    flat = np.frombuffer("".join([*marked, "\0" * max(sizes)]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    total = int(lens.sum())
    owner = np.repeat(np.arange(len(marked)), lens)
    ends = np.repeat(np.cumsum(lens), lens)
    at = np.arange(total)
    shift = np.uint64(64 - bits)
    owners, buckets = [], []
    code = np.zeros(total, np.uint64)
    for n in range(1, max(sizes) + 1):
        code = code * STEP + flat[n - 1 : n - 1 + total]
        if n in sizes:
            inside = at + n <= ends
            owners.append(owner[inside])
            buckets.append((((code[inside] + np.uint64(n << 58)) * MIX) ^ (code[inside] >> np.uint64(29))) * MIX >> shift)
    if whole:
        owners.append(np.arange(len(words)))
        buckets.append(whole_words(words) * MIX >> shift)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def whole_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit polynomial hash of each word, seeded apart from its n-grams."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.repeat(np.cumsum(lens) - lens, lens)
    power = np.cumprod(np.full(int(lens.max(initial=0)) + 1, STEP), dtype=np.uint64)
    terms = flat * power[np.arange(len(flat)) - start]
    # Differences of running sums: exact modulo 2^64, and one pass however long a word is.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    ends = np.cumsum(lens)
    return (sums[ends] - sums[ends - lens]) ^ MIX


def pairs(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of pairs of words, given their hashes. A word that is the one before again is read as one token of that
    meaning, whatever the word, so that what it says of a text can be learnt from other words."""
    x = (left * np.uint64(31) + right) * MIX
    return np.where(left == right, 1, ((x ^ (x >> np.uint64(31))) * MIX >> np.uint64(64 - bits)).astype(np.int64))
