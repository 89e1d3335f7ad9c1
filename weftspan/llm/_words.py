"""Words of texts as numbers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: A-Z to lower case; what is no word character becomes a space (words: 0-9, a-z and all above ASCII).
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: UTF-8 bytes that don't begin a code point.
INNER = bytes(range(0x80, 0xC0))
MIX = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """word -> 64-bit hash, the same in every process; emptied when full."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(numbers: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many words; of all words if they are fewer; none of no words."""
    if not len(numbers):
        return numbers
    n = min(width, len(numbers))
    out = np.full(len(numbers) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mixed(out * MIX + numbers[k : len(numbers) - n + 1 + k])
    return out


def crc_remainder(doc_id: int, k: int) -> int:
    """crc32 of the id as text, modulo k; -1 for null."""
    import zlib

    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % k


class Rows(dict):
    """word -> number of its row; compute(words) gives the rows of new words. Emptied when full."""

    def __init__(self, width: int, compute, most: int = 150_000):
        super().__init__()
        self.compute, self.most = compute, most
        self.values_ = np.zeros((1024, width), np.float32)

    def take(self, words: list, step: int = 50_000) -> np.ndarray:
        """The words' rows."""
        parts = [np.zeros((0, self.values_.shape[1]), np.float32)]
        for k in range(0, len(words), step):
            part = words[k : k + step]
            if len(self) > self.most:
                self.clear()
            if new := [w for w in dict.fromkeys(part) if w not in self]:
                start, end = len(self), len(self) + len(new)
                while end > len(self.values_):
                    self.values_ = np.concatenate([self.values_, np.zeros_like(self.values_)])
                self.values_[start:end] = self.compute(new)
                self.update(zip(new, range(start, end), strict=True))
            parts.append(self.values_[np.fromiter(map(self.__getitem__, part), np.int64, len(part))])
        return parts[1] if len(parts) == 2 else np.concatenate(parts)


def gathered(texts: Iterable[list], most: int = 40_000):
    """Neighbouring texts, as lists of words, in lists that hold so many words or a single text."""
    held, size = [], 0
    for words in texts:
        held.append(words)
        size += len(words)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
