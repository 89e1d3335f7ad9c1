"""A supervised text classifier of averaged hashed embeddings, trained by stochastic gradient descent in numpy.

A text's units are its words and its word pairs. A word's vector is the mean of its own row
and the rows of its character n-grams, a pair's vector is one row (words that repeat share
it); all rows are found by hash in one table. The mean of the units' vectors meets a softmax.

Results for odd rows: null and empty texts have a zero vector, so the bias alone scores them;
very long texts and words are taken whole; a null doc_id stays null and such rows are never learned
from, nor is an id with both labels; equal rows get equal results; other columns are neither read
nor returned; an empty table gives an empty result, and with nothing to learn from every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import by_hash, bytes_of, columns, map_batches, one_label, sample
from ._words import MIX, Rows, gathered

BUCKETS, WIDTH = 1 << 16, 16
GRAMS = (3, 4)
#: Labelled documents, and bytes of their text, that training takes at most; its rounds and first step.
SAMPLE, SAMPLE_BYTES, ROUNDS, RATE = 2500, 24_000_000, 6, 0.5
#: Bytes of words whose n-grams are hashed at once (each takes over a hundred bytes a byte); longer words are taken in pieces, which changes no sum.
PIECE = 1 << 17


def _grams(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """n and a row for each n-gram of these bytes, by where it begins."""
    h = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(max(GRAMS), len(text)) + 1):
            h = h[: len(text) - n + 1] * np.uint64(1_000_003) + text[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                yield n, ((h * MIX) >> np.uint64(40)).astype(np.int64) % BUCKETS


def word_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words and, for each row, the number of its word: a word's own row, and those of its character n-grams (of bytes, with ends marked)."""
    shapes = [b"<" + w + b">" for w in words]
    text = np.frombuffer(b"".join(shapes), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, shapes), np.int64, len(shapes))
    owner = np.repeat(np.arange(len(words)), sizes)
    rows = [np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))]
    owners = [np.arange(len(words))]
    for n, row in _grams(text):
        whole = owner[: len(row)] == owner[n - 1 :]
        rows.append(row[whole])
        owners.append(owner[: len(row)][whole])
    return np.concatenate(rows), np.concatenate(owners)


def word_vectors(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """The mean of each word's rows and, as two exact halves, its hash."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    if len(words) > 1 and ends[-1] > PIECE:
        cut = min(max(1, int(np.searchsorted(ends, PIECE, "right"))), len(words) - 1)
        parts = []
        while words:
            parts.append(word_vectors(words[:cut], table))
            words, ends = words[cut:], ends[cut:] - ends[cut - 1]
            cut = max(1, int(np.searchsorted(ends, PIECE, "right")))
        return np.concatenate(parts)
    if len(words) == 1 and len(words[0]) > PIECE:
        return _long_vector(words[0], table)
    rows, owners = word_rows(words)
    order = np.argsort(owners, kind="stable")
    count = np.bincount(owners, minlength=len(words))
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    sums = np.add.reduceat(table[rows[order]], starts, axis=0)
    h = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return np.concatenate([sums / count[:, None], np.stack([h >> 16, h & 0xFFFF], 1)], 1)


def _long_vector(word: bytes, table: np.ndarray) -> np.ndarray:
    """word_vectors() of one word, PIECE bytes at a time."""
    shape, h = b"<" + word + b">", zlib.crc32(word)
    total, count, exact = table[h % BUCKETS].astype(np.float64), 1, table.astype(np.float64)
    for at in range(0, len(shape), PIECE):
        for _, row in _grams(np.frombuffer(shape[at : at + PIECE + max(GRAMS) - 1], np.uint8).astype(np.uint64)):
            total += np.bincount(row[:PIECE], minlength=BUCKETS) @ exact
            count += len(row[:PIECE])
    return np.array([[*(total / count), h >> 16, h & 0xFFFF]])


def pair_rows(hashes: np.ndarray) -> np.ndarray:
    """The row of each two neighbouring words, by their hashes; row 0 for a word that repeats."""
    with np.errstate(over="ignore"):
        x = (hashes[:-1] * MIX + hashes[1:]) * MIX
    out = (x >> np.uint64(48)).astype(np.int64) % BUCKETS
    out[hashes[:-1] == hashes[1:]] = 0
    return out


class Classifier:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.table = ((r.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
        self.out = np.zeros((2, WIDTH), np.float32)
        self.bias = np.zeros(2, np.float32)

    def units(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a text and their shares of its mean."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        kinds: dict[bytes, int] = {}
        for w in words:
            kinds[w] = kinds.get(w, 0) + 1
        rows, owners = word_rows(list(kinds))
        count = np.fromiter(kinds.values(), np.float64, len(kinds))
        shares = (count / np.bincount(owners))[owners]
        hashes = np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words))
        pairs = pair_rows(hashes)
        rows, shares = np.concatenate([rows, pairs]), np.concatenate([shares, np.ones(len(pairs))])
        kept, back = np.unique(rows, return_inverse=True)
        return kept, (np.bincount(back, shares) / (2 * len(words) - 1)).astype(np.float32)

    def probability(self, vector: np.ndarray) -> float:
        """Of label 1."""
        x = self.out @ vector + self.bias
        return float(1 / (1 + np.exp(np.clip(x[0] - x[1], -60, 60))))

    def train(self, texts: list[bytes], labels: list[int], rounds: int = ROUNDS, rate: float = RATE, seed: int = 2) -> Classifier:
        cases = [self.units(t) for t in texts]
        r = np.random.default_rng(seed)
        steps, done = rounds * len(cases), 0
        for _ in range(rounds if len(set(labels)) > 1 else 0):
            for k in r.permutation(len(cases)):
                rows, shares = cases[k]
                step = rate * (1 - done / steps)
                done += 1
                vector = shares @ self.table[rows]
                x = self.out @ vector + self.bias
                p = np.exp(x - x.max())
                p /= p.sum()
                p[labels[k]] -= 1
                back = p @ self.out
                self.out -= step * np.outer(p, vector)
                self.bias -= 0.1 * step * p
                self.table[rows] -= (step * 20) * shares[:, None] * back
        return self


def fit(docs: DataFrame, labels: DataFrame, learned: Column, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Classifier:
    """A classifier of at most `most` labelled documents, and `most_bytes` of their texts, where `learned` holds: the first by a hash of the id."""
    marked = one_label(labels, "quality").where(learned)
    chosen = F.broadcast(by_hash(marked, marked.count(), most).orderBy("place", "doc_id").limit(most))  # at most `most` rows of a few numbers
    rows = sample(columns(docs, "doc_id", "text").join(chosen, "doc_id"), most, most_bytes)
    return Classifier().train([r["text"].encode() for r in rows], [int(r["quality"]) for r in rows])


def score(docs: DataFrame, model: Classifier, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """doc_id (or the columns `keep`) and the probability of label 1 of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH numbers at any size of the input
    chosen = columns(docs, "doc_id", "text") if keep is None else docs.select(*keep)
    fields = [f for f in chosen.schema.fields if keep is not None or f.name != "text"]
    names = [f.name for f in fields]

    def make():
        m = shared.value
        rows = Rows(WIDTH + 2, lambda words: word_vectors(words, m.table))

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for texts in gathered(t.split() for t in bytes_of(batch.column("text"))):
                sizes = np.array([len(w) for w in texts])
                vectors = np.zeros((len(texts), WIDTH))
                if some := int(sizes.sum()):
                    x = rows.take([w for words in texts for w in words])
                    pairs = np.zeros((some, WIDTH), np.float32)
                    pairs[:-1] = m.table[pair_rows((x[:, WIDTH].astype(np.uint64) << np.uint64(16)) + x[:, WIDTH + 1].astype(np.uint64))]
                    ends = np.cumsum(sizes)
                    pairs[ends[sizes > 0] - 1] = 0  # no pair spans two texts
                    starts = (ends - sizes)[sizes > 0]
                    vectors[sizes > 0] = np.add.reduceat((x[:, :WIDTH] + pairs).astype(np.float64), starts, axis=0) / (2 * sizes[sizes > 0] - 1)[:, None]
                out += [m.probability(v) for v in vectors]
            return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.float64())], names=[*names, name])

        return turn

    return map_batches(chosen, make, T.StructType([*fields, T.StructField(name, T.DoubleType())]))
