"""Quality rules, and a linear-chain conditional random field over the lines of a text.

Each line with a word has features of its form, and of whether it is one of the lines that the
sample's documents repeat. The field's weights are trained here by gradient ascent on the lines of
a bounded sample of labelled documents. Labels of lines are latent: a line that stands in several
documents, before different lines, or again in its own document, is boilerplate; the other lines
take their document's mark (good: content), until a first field has been trained; then each takes
what that field reads, as long as most of a good text stays content and most of a bad one boilerplate.
Viterbi decoding marks each line of every whole text; the share of the text's characters on lines
marked content decides whether the text is kept.

Results for odd rows: null and empty texts have no words, fail the base rule and aren't kept;
very long texts and lines are read whole; a null doc_id stays null and is never learned from, nor is
an id with both labels; equal rows get equal results; other columns are neither read nor returned;
an empty table gives an empty result. Without usable labels the field keeps the weights of PRIOR.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bytes_of, columns, first_by_hash, map_batches, one_label, sample
from ._words import INNER, Numbers, windows

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS, DIGITS, UPPER, ENDS = b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".!?:;\")'"
#: Documents and bytes of text that training takes at most (smallest hash of the id first).
SAMPLE, SAMPLE_BYTES = 1500, 16_000_000
#: Least share of a text's characters on content lines.
CONTENT_SHARE = 0.3
#: Different lines that must follow a line somewhere for it to count as one that documents repeat; copies of a document have the same.
CONTEXTS = 3
FEATURES = 21
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
SCHEMA = pa.schema([(k, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for k, t in (x.split() for x in OUT.split(", "))])


def repeated(numbers: np.ndarray, width: int = 5) -> int:
    """Words that stand in a window of so many words that occurs twice or more."""
    if len(numbers) < width + 1:
        return 0
    w = windows(numbers, width)
    _, back, count = np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(numbers) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(texts: list[bytes]) -> frozenset[int]:
    """Hashes of lines that stand before CONTEXTS different lines (or ends of texts), in as many texts at least."""
    after: dict[int, set[int]] = {}
    within: dict[int, set[int]] = {}
    for k, text in enumerate(texts):
        lines = [xxhash.xxh3_64_intdigest(x) for x in text.split(b"\n") if x.split()]
        for x, y in zip(lines, [*lines[1:], -1 - k], strict=True):
            after.setdefault(x, set()).add(y)
            within.setdefault(x, set()).add(k)
    return frozenset(x for x, own in after.items() if len(own) >= CONTEXTS and len(within[x]) >= CONTEXTS)


def line_features(line: bytes, words: list[bytes], again: bool, known: bool) -> list[int]:
    """The features that hold for a line."""
    n, chars = len(words), len(line)
    symbols = chars - len(line.translate(None, SYMBOLS))
    digits = chars - len(line.translate(None, DIGITS))
    upper = chars - len(line.translate(None, UPPER))
    out = [0]
    out.append(1 if n < 3 else 2 if n < 8 else 3 if n < 30 else 4)
    if symbols:
        out.append(5 if symbols * 50 < chars else 6 if symbols * 8 < chars else 7)
    if digits:
        out.append(8 if digits * 5 < chars else 9)
    out.append(10 if upper * 10 < chars else 11 if upper * 2 < chars else 12)
    if again:
        out.append(13)
    if line.rstrip()[-1:] in ENDS:
        out.append(14)
    kinds = len(set(words))
    if n >= 8:
        out.append(15 if kinds * 10 >= n * 6 else 16 if kinds * 10 >= n * 3 else 17)
    if b"!!" in line or b"??" in line:
        out.append(18)
    if any(a == b for a, b in zip(words, words[1:], strict=False)):
        out.append(19)
    if known:
        out.append(20)
    return out


def lines_of(text: bytes, known: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the lines with a word: features as 0/1 rows, bytes, and how many equal an earlier one. known: hashes of lines that documents repeat."""
    seen: set[bytes] = set()
    rows, sizes, again = [], [], 0
    for line in text.split(b"\n"):
        if words := line.split():
            dup = line in seen
            again += dup
            seen.add(line)
            row = np.zeros(FEATURES)
            row[line_features(line, words, dup, bool(known) and xxhash.xxh3_64_intdigest(line) in known)] = 1
            rows.append(row)
            sizes.append(len(line))
    return np.array(rows).reshape(-1, FEATURES), np.array(sizes, float), again


class Field:
    """Two labels: 0 boilerplate, 1 content. weights: labels by features; moves: label to label; known: hashes of lines that documents repeat."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, known: frozenset[int] = frozenset()):
        self.weights, self.moves, self.known = weights, moves, known

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best label of each line."""
        score = (features @ self.weights.T).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = 0.0, 0.0
        back = []
        for k, (x, y) in enumerate(score):
            if k:
                p, q = a + m00 >= b + m10, a + m01 > b + m11
                back.append((0 if p else 1, 0 if q else 1))
                a, b = (a + m00 if p else b + m10) + x, (a + m01 if q else b + m11) + y
            else:
                a, b = x, y
        out = np.zeros(len(score), np.int8)
        label = int(b >= a)
        for k in range(len(score) - 1, -1, -1):
            out[k] = label
            if k:
                label = back[k - 1][label]
        return out

    def gradient(self, features: np.ndarray, labels: np.ndarray, sizes: np.ndarray | None = None, heft: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of the labels of texts, by forward and backward sums; and that likelihood.

        Lines of all texts follow one another; sizes: lines of each text, none longer than the one before it; heft: its weight.
        """
        n = len(features)
        sizes = np.array([n]) if sizes is None else sizes
        heft = np.ones(len(sizes)) if heft is None else heft
        s, start = features @ self.weights.T, np.cumsum(sizes) - sizes
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts with more than t lines come first
        up, down = np.empty((n, 2)), np.zeros((n, 2))
        up[start] = s[start]
        for t in range(1, sizes[0]):
            at = start[: live[t]] + t
            x = up[at - 1]
            up[at] = np.logaddexp(x[:, :1] + self.moves[0], x[:, 1:] + self.moves[1]) + s[at]
        for t in range(sizes[0] - 2, -1, -1):
            at = start[: live[t + 1]] + t
            x = s[at + 1] + down[at + 1]
            down[at] = np.logaddexp(x[:, :1] + self.moves[:, 0], x[:, 1:] + self.moves[:, 1])
        last = up[start + sizes - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        each = heft[owner]
        p = np.exp(up + down - z[owner, None])
        p[np.arange(n), labels] -= 1
        later = np.flatnonzero(np.arange(n) != start[owner])
        pair = np.exp(up[later - 1][:, :, None] + self.moves + (s + down)[later][:, None, :] - z[owner[later], None, None])
        moves = -np.tensordot(each[later], pair, 1)
        np.add.at(moves, (labels[later - 1], labels[later]), each[later])
        truth = each @ s[np.arange(n), labels] + each[later] @ self.moves[labels[later - 1], labels[later]]
        return -(p * each[:, None]).T @ features, moves, float(truth - heft @ z)


#: What training starts from and is drawn towards: symbols, capitals and repeats speak against content.
PRIOR = np.zeros((2, FEATURES))
PRIOR[0, [6, 7, 9, 12, 13, 16, 17, 18, 19, 20]] = 0.5
PRIOR[1, [3, 4, 10, 14, 15]] = 0.3


def ascent(field: Field, cases: list[tuple[np.ndarray, np.ndarray, float]], rounds: int, rate: float, pull: float) -> Field:
    """The field after full-gradient steps (Adagrad) on cases of features, labels and weight; `pull` draws the weights to the prior."""
    cases = sorted((c for c in cases if len(c[0])), key=lambda c: -len(c[0]))
    rows, labels = np.concatenate([c[0] for c in cases]), np.concatenate([c[1] for c in cases])
    sizes, heft = np.array([len(c[0]) for c in cases]), np.array([c[2] for c in cases])
    sums = [np.full_like(field.weights, 1e-6), np.full_like(field.moves, 1e-6)]
    for _ in range(rounds):
        w, m, _ = field.gradient(rows, labels, sizes, heft)
        g = [w - pull * (field.weights - PRIOR), m - pull * (field.moves - np.eye(2) * 0.5)]
        for x, grad, s in zip((field.weights, field.moves), g, sums, strict=True):
            s += grad * grad
            x += rate * grad / np.sqrt(s)
    return field


def line_labels(field: Field, rows: np.ndarray, sizes: np.ndarray, good: int, read: bool) -> np.ndarray:
    """Labels of a text's lines: by evidence of repeats and the text's mark, or (read) by the field where most of the text agrees with its mark."""
    labels = np.full(len(rows), good)
    if read:
        seen = field.viterbi(rows).astype(np.int64)
        if 2 * sizes[seen == good].sum() >= sizes.sum():
            labels = seen
    labels[(rows[:, 13] > 0) | (rows[:, 20] > 0)] = 0
    return labels


def train(texts: list[bytes], good: list[int], rounds: int = 150, turns: int = 2, rate: float = 1.0, pull: float = 0.0005) -> Field:
    """A field of these texts and their marks; labels of lines are read anew before each turn. A text's lines are taken in parts of 400."""
    field = Field(PRIOR.copy(), np.eye(2) * 0.5, repeated_lines(list(dict.fromkeys(texts))))
    if len(set(good)) < 2 or not all(any(t.split() for t, y in zip(texts, good, strict=True) if y == k) for k in (0, 1)):
        return field
    read = [(*lines_of(t, field.known)[:2], y) for t, y in zip(texts, good, strict=True)]
    total = sum(len(rows) for rows, _, _ in read)
    for turn in range(turns):
        cases = []
        for rows, sizes, y in read:
            labels = line_labels(field, rows, sizes, y, turn > 0)
            cases += [(rows[at : at + 400], labels[at : at + 400], 1 / total) for at in range(0, len(rows), 400)]
        field = ascent(Field(PRIOR.copy(), np.eye(2) * 0.5, field.known), cases, rounds, rate, pull)
    return field


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Field:
    """A field trained on at most `most` labelled documents, half of them and half of the bytes of each label, chosen by a hash of the id."""
    marked = one_label(labels, "quality")
    count = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    parts = [first_by_hash(marked.where(F.col("quality") == y), count.get(y, 0), most // 2) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most `most` rows of two numbers
    near = columns(docs, "doc_id", "text").join(chosen, "doc_id").withColumn("place", F.xxhash64("doc_id"))
    rows = sample(near, most // 2, most_bytes // 2, "quality")
    return train([r["text"].encode() for r in rows], [int(r["quality"]) for r in rows])


def apply_rules(docs: DataFrame, field: Field, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Base counts of every document, and whether it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves, field.known))  # hashes of the sample's lines at most

    def make():
        model, numbers = Field(*shared.value), Numbers()

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {f.name: [] for f in SCHEMA if f.name != "doc_id"}
            for text in bytes_of(batch.column("text")):
                words = text.split()
                again = repeated(numbers.of(words))
                rows, sizes, dups = lines_of(text, model.known)
                share = float((sizes * model.viterbi(rows)).sum() / sizes.sum()) if len(sizes) else 0.0
                failed = len(words) < 10 or 100 * again > 20 * len(words)
                for x, v in zip(out.values(), (len(words), len(text.translate(None, SPACE + INNER)), len(text) - len(text.translate(None, SYMBOLS)), dups, again, failed, not failed and share >= content_share, share), strict=True):
                    x.append(v)
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out}, schema=SCHEMA)

        return turn

    return map_batches(columns(docs, "doc_id", "text"), make, OUT)


def plain_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the slow way; for tests."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)
