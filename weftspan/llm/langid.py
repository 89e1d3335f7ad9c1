"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word scores minus log10 of its relative frequency in each language. A word that no
language knows is cut into character n-grams, from the longest length down: the first length
at which some language knows one of them scores the word, by the mean over its n-grams. What
one language lacks costs it a penalty. A text's score is the mean over all of its words.

Results for odd rows: null texts and texts without a letter are "und" with score 0; very long
texts are scored whole; a null doc_id stays null and such rows are never learned from, nor are
rows with a null lang; of languages that score the same the first by code point wins; equal rows
get equal results; other columns are neither read nor returned; an empty table gives an empty
result, and with nothing to learn from every text is "und".
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import columns, forget, map_batches, sample, written
from ._words import Rows, gathered

#: Letters, and numerals that aren't digits; digits, marks of punctuation and underscores part words.
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Bounds of the model: documents of each language it learns from, and bytes of text in all, an equal share for each language. All their words and n-grams are kept.
SAMPLE, SAMPLE_BYTES = 500, 64_000_000
#: Languages up to which their counts are broadcast to find the sample; beyond, a join shuffles.
FEW_LANGUAGES = 10_000
#: Added to the dearest known frequency for what a language lacks.
PENALTY = 1.0


def held_out(k: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % k == remainder, F.lit(False))


def ngrams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Table:
    """Costs by language of words or of n-grams of one length: only what a language knows is held."""

    def __init__(self, counts: list[Counter]):
        sums = [max(1, c.total()) for c in counts]
        #: What a language pays for what it lacks.
        self.lack = max((float(np.log10(s / min(c.values()))) for c, s in zip(counts, sums, strict=True) if c), default=0.0) + PENALTY
        self.place: dict[str, int] = {}
        row, lang, less = [], [], []
        for k, (c, s) in enumerate(zip(counts, sums, strict=True)):
            row.append(np.fromiter((self.place.setdefault(x, len(self.place)) for x in c), np.int64, len(c)))
            lang.append(np.full(len(c), k, np.int32))
            less.append(np.log10(s / np.fromiter(c.values(), np.float64, len(c))) - self.lack)
        row, lang, less = np.concatenate(row), np.concatenate(lang), np.concatenate(less)
        order = np.argsort(row, kind="stable")
        self.lang, self.less = lang[order], less[order].astype(np.float32)
        self.start = np.searchsorted(row[order], np.arange(len(self.place) + 1))

    def means(self, rows: np.ndarray, sizes: np.ndarray, langs: int) -> np.ndarray:
        """Mean costs by language over so many of the rows each time."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums = np.bincount(np.repeat(owner, n) * langs + self.lang[at], self.less[at], len(sizes) * langs)
        return self.lack + sums.reshape(len(sizes), langs) / sizes[:, None]


class Model:
    """tables[0] has words, tables[n] n-grams."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        counts: list[list[Counter]] = [[] for _ in range(LONGEST + 1)]
        for lang in self.langs:
            words: Counter = Counter()
            for t in texts[lang]:
                words.update(WORD.findall(t.lower()))
            counts[0].append(words)
            for n in range(1, LONGEST + 1):
                grams: Counter = Counter()
                for w, c in words.items():
                    for g in ngrams(w, n):
                        grams[g] += c
                counts[n].append(grams)
        self.tables = [Table(c) for c in counts] if texts else []

    def costs(self, words: list[str]) -> np.ndarray:
        """What each word costs each language."""
        out = np.full((len(words), len(self.langs)), self.tables[-1].lack)
        known = self.tables[0].place.get
        rows = [known(w, -1) for w in words]
        hit = [k for k, r in enumerate(rows) if r >= 0]
        if hit:
            out[hit] = self.tables[0].means(np.array([rows[k] for k in hit]), np.ones(len(hit), np.int64), len(self.langs))
        left = [k for k, r in enumerate(rows) if r < 0]
        for n in range(LONGEST, 0, -1):
            known, found, sizes, then, still = self.tables[n].place.get, [], [], [], []
            for k in left:
                p = f" {words[k]} "
                # the least word has one gram of three characters
                mine = [r for i in range(len(p) - n + 1) if (r := known(p[i : i + n])) is not None]
                if mine:
                    found += mine
                    sizes.append(len(mine))
                    then.append(k)
                else:
                    still.append(k)
            if then:
                out[then] = self.tables[n].means(np.array(found), np.array(sizes), len(self.langs))
            left = still
        return out


def fit(docs: DataFrame, learned: Column, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of at most `most` documents a language, of the rows where `learned` holds. The texts are read once, for all languages."""
    rows = columns(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & learned)
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("rows")))
    langs = counts.count()
    small = F.broadcast(counts) if langs <= FEW_LANGUAGES else counts
    parts = 1 << 30
    near = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).join(small, "lang").where(F.col("place") < parts * (2.0 * most / F.col("rows")) + 1)
    found = sample(near.drop("rows"), most, most_bytes // max(1, langs), "lang")
    forget(counts)
    texts: dict[str, list[str]] = {}
    for r in found:
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model(texts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the winner's share of the likelihoods, by mean costs) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_BYTES

    def make():
        m = shared.value
        rows = Rows(len(m.langs), m.costs, most=min(150_000, max(5000, 8_000_000 // len(m.langs)))) if m.langs else None

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = [], []
            found = [WORD.findall(t.lower()) if t and rows is not None and any(map(str.isalpha, t)) else [] for t in batch.column("text").to_pylist()]
            for texts in gathered(found):
                sizes = np.array([len(w) for w in texts])
                starts = (np.cumsum(sizes) - sizes)[sizes > 0]
                sums = iter(np.add.reduceat(rows.take([w for words in texts for w in words]).astype(np.float64), starts, axis=0) if len(starts) else [])
                for n in sizes.tolist():
                    if n:
                        cost = next(sums) / n
                        best = int(cost.argmin())
                        langs.append(m.langs[best])
                        scores.append(float(1 / (10 ** (cost[best] - cost)).sum()))
                    else:
                        langs.append("und")
                        scores.append(0.0)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

        return turn

    return map_batches(columns(docs, "doc_id", "text"), make, "doc_id long, lang_pred string, score double")
