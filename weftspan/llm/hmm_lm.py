"""A hidden Markov language model of whole texts.

Symbols of the chain are the end of a text, the OWN most frequent training words, and hashed
classes of all others: P(word | state) = P(symbol | state) * P(word | symbol), where the
second factor is the word's smoothed share of its class's training tokens. Word counts cover
all training texts. Baum-Welch starts on a bounded sample, which only places the states, and
goes on with PASSES passes over all training texts: each task adds up its expected counts, and
a tree of partial sums joins them; windows of a long text meet by transfer matrices. The passes read
a table of the texts' symbols, written once. A text's
likelihood is the scaled forward recursion over all its tokens; long texts are cut into stretches
whose transfer matrices are multiplied, which is the same sum.

Scoring reads each text once. Counts of the most frequent words, LISTED of them and LISTED_BYTES of
their bytes at most, go to every task; other words of a chunk of texts (bounded bytes) meet the table
of counts in a join, so nothing that grows with the vocabulary is ever in one place.

Results for odd rows: a null text counts as empty, so its only token is the end; very long texts
and words are read whole; rows with a null doc_id are scored and not learned from (held_out is false); equal rows get equal results;
without training texts N and V are 0 and every token scores as unknown; an empty table gives
an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import by_hash, bytes_of, columns, forget, sample, written

#: The token that ends a text; no word has a line feed.
END = b"\n"
STATES, OWN, CLASSES, LISTED, LISTED_BYTES = 8, 2047, 2048, 65_536, 2_000_000
SYMBOLS = 1 + OWN + CLASSES
#: Texts of the first sample, bytes of them, and its rounds; passes over all texts; tokens in a training window; tokens in a stretch of the forward recursion.
SAMPLE, SAMPLE_BYTES, SAMPLE_ROUNDS, PASSES, WINDOW, STRETCH = 300, 2_000_000, 8, 2, 512, 1024
#: Bytes of text in a chunk, distinct words, and bytes of text, that a task holds before it passes counts on, rows that a partial sum joins.
CHUNK, HELD, HELD_BYTES, FAN = 4_000_000, 200_000, 64_000_000, 8
SMOOTH = 0.1
#: Tokens between two rescalings of a recursion: an emission has at least the share that smoothing leaves, so the product of so many doesn't underflow.
RESCALE = 8


def tokens_of(text: bytes) -> list[bytes]:
    out = text.lower().split()  # bytes: A-Z alone are lowered, and these are the six spaces
    out.append(END)
    return out


class Symbols(dict):
    """word -> symbol."""

    def __init__(self, own: list[bytes]):
        super().__init__({END: 0} | {w: k + 1 for k, w in enumerate(own)})
        self.fixed = dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
            self.update(self.fixed)
        self[word] = out = 1 + OWN + zlib.crc32(word) % CLASSES
        return out

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


class Slots(dict):
    """word -> its place among known words, or after them among those that a chunk adds."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.words: list[bytes] = []
        self.symbols: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        self.words.append(word)
        self.symbols.append(1 + OWN + zlib.crc32(word) % CLASSES)
        return out


def laid(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, the longest first, as columns; their lengths; how many have a symbol at each place."""
    sizes = np.array([len(p) for p in parts], np.int64)
    sym = np.zeros((int(sizes[0]) if len(parts) else 0, len(parts)), np.int64)
    for j, p in enumerate(parts):
        sym[: len(p), j] = p
    return sym, sizes, np.searchsorted(-sizes, -np.arange(len(sym)), "left")


ONES = np.ones(STATES)


class Chain:
    """start: by state; moves: state to state; emit: symbols by states."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        self.start, self.moves, self.emit = start, moves, emit

    @staticmethod
    def first(counts: np.ndarray, seed: int = 5) -> Chain:
        r = np.random.default_rng(seed)
        k = STATES
        emit = (counts[:, None] + SMOOTH) * r.uniform(0.5, 1.5, (SYMBOLS, k))
        moves = r.uniform(0.5, 1.0, (k, k)) + 4 * np.eye(k)
        return Chain(np.full(k, 1 / k), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of_counts(total: np.ndarray) -> Chain:
        start, moves, emit = unpacked(total)
        start, moves, emit = start + SMOOTH, moves + SMOOTH, emit + SMOOTH
        return Chain(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))

    def expected(self, texts: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
        """Expected counts of starts, moves and emissions of these whole symbol sequences.

        They are taken in windows, each between the state vectors of all before and all after it.
        """
        parts, before, after = self._windows(texts, window)
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        parts, before, after = [parts[k] for k in order], before[order], after[order]
        first = np.isnan(before[:, 0])
        start, moves, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
        lanes = 512
        for at in range(0, len(parts), lanes):
            some = parts[at : at + lanes]
            sym, sizes, live = laid(some)
            steps, n = sym.shape
            seen = np.arange(n)[None, :] < live[:, None]
            odds = self.emit.take(sym, 0)
            own, later = first[at : at + n], np.flatnonzero(~first[at : at + n])
            enter = before[at : at + n]
            entry = np.tile(self.start, (n, 1))
            entry[later] = enter[later] @ self.moves
            up = np.zeros((steps, n, STATES))
            scale: dict[int, np.ndarray] = {}
            for t in range(steps):
                m = live[t]
                now = np.multiply(odds[t, :m], up[t - 1, :m] @ self.moves if t else entry, out=up[t, :m])
                if t % RESCALE == 0:
                    scale[t] = (now @ ONES)[:, None]
                    now /= scale[t]
            down = after[at : at + n].copy()
            down /= (up[sizes - 1, np.arange(n)] * down).sum(1, keepdims=True)
            for t in range(steps - 1, -1, -1):
                m = live[t]
                if t:
                    weight = odds[t, :m] * down[:m]
                    if t in scale:
                        weight /= scale[t]
                    moves += up[t - 1, :m].T @ weight
                elif len(later):
                    moves += enter[later].T @ (odds[0, later] * down[later] / scale[0][later])
                up[t, :m] *= down[:m]
                if t:
                    down[:m] = weight @ self.moves.T
            start += up[0, own].sum(0)
            flat = sym[seen]
            posterior = up[seen]
            for k in range(STATES):
                emit[:, k] += np.bincount(flat, posterior[:, k], SYMBOLS)
        return np.concatenate([start, (moves * self.moves).ravel(), emit.ravel()])

    def _windows(self, texts: list[np.ndarray], window: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Windows of texts; for each the normed state weights at the token before it (NaN: it begins a text), and what each state at its last token is worth by all that follows."""
        parts = [x[i : i + window] for x in texts for i in range(0, len(x), window)]
        many = [max(0, -(-len(x) // window)) for x in texts]
        before, after = np.full((len(parts), STATES), np.nan), np.ones((len(parts), STATES))
        ends = np.cumsum(many)
        heads = [int(e) - m for e, m in zip(ends, many, strict=True) if m > 1]
        if not heads:
            return parts, before, after
        _, v = self._run([parts[k] for k in heads], np.tile(self.start, (len(heads), 1)))
        rest = [k for e, m in zip(ends, many, strict=True) for k in range(int(e) - m + 1, int(e))]
        _, across = self._across([parts[k] for k in rest])
        place = {k: j for j, k in enumerate(rest)}
        for u, head in zip(v, heads, strict=True):
            k = head + 1
            while k in place:
                before[k] = u
                u = u @ across[place[k]]
                u = u / u.sum()
                k += 1
            for j in range(k - 1, head, -1):
                x = across[place[j]] @ after[j]
                after[j - 1] = x / x.sum()
        return parts, before, after

    def _run(self, parts: list[np.ndarray], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of the mass and the normed state vector after each sequence; `before`: state weights at its first token."""
        order = np.argsort([-len(p) for p in parts], kind="stable")
        n = len(parts)
        sym, sizes, live = laid([parts[k] for k in order])
        v, log = before[order].copy(), np.zeros(n)
        for t in range(len(sym)):
            m = live[t]
            now = np.multiply(self.emit.take(sym[t, :m], 0, mode="clip"), v[:m] @ self.moves if t else v[:m], out=v[:m])
            if t % RESCALE == RESCALE - 1:
                s = now @ ONES
                log[:m] += np.log(s)
                now /= s[:, None]
        s = v @ ONES
        log += np.log(s)
        v /= s[:, None]
        out, logs = np.empty_like(v), np.empty(n)
        out[order], logs[order] = v, log
        return logs, out

    def _across(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each sequence the matrix from the state before it to the state at its last token, divided by e to the power of the log beside it."""
        logs, out = np.zeros(len(parts)), np.empty((len(parts), STATES, STATES))
        order = np.argsort([-len(p) for p in parts], kind="stable")
        lanes = 256
        for at in range(0, len(order), lanes):
            own = order[at : at + lanes]
            sym, sizes, live = laid([parts[k] for k in own])
            n = len(own)
            # [state now, state before, sequence]
            v, log = np.tile(np.eye(STATES)[:, :, None], (1, 1, n)), np.zeros(n)
            for t in range(len(sym)):
                if live[t] < v.shape[2]:
                    done = slice(live[t], v.shape[2])
                    out[own[done]], logs[own[done]] = v[:, :, done].T, log[done]
                    v, log = v[:, :, : live[t]], log[: live[t]]
                v = (self.moves.T @ v.reshape(STATES, -1)).reshape(v.shape)
                v *= self.emit.take(sym[t, : live[t]], 0, mode="clip").T[:, None, :]
                if t % RESCALE == RESCALE - 1:
                    top = v.max((0, 1))
                    log = log + np.log(top)
                    v /= top
            out[own[: v.shape[2]]], logs[own[: v.shape[2]]] = v.T, log
        return logs, out

    def log10(self, texts: list[np.ndarray], stretch: int = STRETCH) -> np.ndarray:
        """log10 of the probability of each symbol sequence, of at least one symbol."""
        logs, v = self._run([x[:stretch] for x in texts], np.tile(self.start, (len(texts), 1)))
        rest = [(k, x[i : i + stretch]) for k, x in enumerate(texts) for i in range(stretch, len(x), stretch)]
        step = 512
        for at in range(0, len(rest), step):
            some = rest[at : at + step]
            for (k, _), log, matrix in zip(some, *self._across([p for _, p in some]), strict=True):
                u = v[k] @ matrix
                mass = u.sum()
                logs[k] += log + np.log(mass)
                v[k] = u / mass
        return logs / np.log(10)


def unpacked(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = STATES
    return total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(SYMBOLS, k)


def word_counts(texts: DataFrame) -> DataFrame:
    """word and c (its occurrences) of all rows of texts, with END once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in bytes_of(batch.column("text")):
                held.update(tokens_of(text))
                size += len(text)
                if len(held) > HELD or size > HELD_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """The sum of vectors in rows (part, v), by a tree of tasks; at most FAN rows come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            for p, v in zip(batch.column("part").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.frombuffer(v)
                total, part = (x.copy(), p) if total is None else (total + x, min(part, p))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).sortWithinPartitions("part").mapInArrow(add, "part long, v binary")
    rows = parts.orderBy("part").collect()
    return sum(np.frombuffer(r["v"]) for r in rows) if rows else None


class Model:
    def __init__(self, own: list[bytes], chain: Chain, listed: dict[bytes, int], classes: np.ndarray, total: int, distinct: int):
        #: classes: tokens and words of each hashed class, without words that are symbols of their own
        self.own, self.chain, self.listed, self.classes, self.total, self.distinct = own, chain, listed, classes, total, distinct


def _coded(texts: DataFrame, own: list[bytes]) -> DataFrame:
    """The symbols of each text, two bytes a token, so that passes neither split nor look up words again."""
    shared = texts.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Symbols(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([names.of(tokens_of(text)).astype(np.int16).tobytes() for text in bytes_of(batch.column("text"))], pa.binary())], names=["symbols"])

    return texts.select("text").mapInArrow(run, "symbols binary")


def _expected(coded: DataFrame, chain: Chain) -> DataFrame:
    """part (its number) and v (expected counts of its texts) of each task."""
    shared = coded.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = None, [], 0

        def add() -> np.ndarray:
            x = shared.value.expected(held)
            return x if total is None else total + x

        for batch in batches:
            for symbols in batch.column("symbols").to_pylist():
                held.append(np.frombuffer(symbols, np.int16))
                size += len(held[-1])
                if size > 250_000:
                    total, held, size = add(), [], 0
        if held:
            total = add()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    return coded.mapInArrow(run, "part long, v binary")


def fit(docs: DataFrame, learned: Column, passes: int = PASSES, most: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model of the rows where `learned` holds, and the table of their word counts."""
    spark = docs.sparkSession
    texts = columns(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & learned)
    counts = written(word_counts(texts))
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    # counts by eighths of powers of two: the least one from which on words and bytes are few enough
    step = F.floor(8 * F.log2("c"))
    some = counts.where("c > 0")
    least, words, size = None, 0, 0
    for r in sorted(some.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word").cast("long")).alias("bytes")).collect(), key=lambda r: -r["s"]):
        words, size = words + r["n"], size + r["bytes"]
        if words > LISTED or size > LISTED_BYTES:
            break
        least = r["s"]
    often = some.where(step >= least).collect() if least is not None else []  # bounded in rows and bytes
    listed = {bytes(r["word"]): r["c"] for r in sorted(often, key=lambda r: (-r["c"], bytes(r["word"])))}
    own = [w for w in listed if w != END][:OWN]
    classes = np.zeros((2, CLASSES))
    for r in counts.groupBy((F.crc32("word") % CLASSES).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        classes[:, r["k"]] = r["c"], r["n"]
    unigram = np.zeros(SYMBOLS)
    for k, w in enumerate([END, *own]):
        if w in listed:
            at = zlib.crc32(w) % CLASSES
            classes[:, at] -= listed[w], 1
            unigram[k] = listed[w]
    unigram[1 + OWN :] = classes[0]
    chain = Chain.first(unigram)
    names = Symbols(own)
    rows = sample(by_hash(texts, docs.count(), most), most, SAMPLE_BYTES)
    some = [names.of(tokens_of(r["text"].encode())) for r in rows]
    for _ in range(SAMPLE_ROUNDS if some else 0):
        learnt = Chain.of_counts(chain.expected(some))
        # classes that the sample lacks keep the corpus's share
        chain = Chain(learnt.start, learnt.moves, 0.9 * learnt.emit + 0.1 * ((unigram + SMOOTH) / (unigram + SMOOTH).sum())[:, None])
    if total and passes:
        coded = written(_coded(texts, own))
        for _ in range(passes):
            # one vector of fixed size for each task
            parts = written(_expected(coded, chain))
            chain = Chain.of_counts(_summed(parts, coded.rdd.getNumPartitions()))
            forget(parts)
        forget(coded)
    return Model(own, chain, listed, classes, int(total or 0), int(distinct)), counts


CHUNKS = "chunk long, doc_ids array<long>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, words array<binary>, row binary, word binary, times binary"


def _chunks(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each chunk of texts: what listed words add to base and score, and the times of each other word by text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SYMBOLS, STATES, LISTED and CLASSES
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())), ("words", pa.list_(pa.binary())), ("row", pa.binary()), ("word", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = list(m.listed)
        fixed = {END: 0} | {w: k + 1 for k, w in enumerate(m.own)}
        kinds = np.fromiter((zlib.crc32(w) % CLASSES for w in words), np.int64, len(words))
        symbol = np.fromiter((fixed.get(w, 1 + OWN + k) for w, k in zip(words, kinds.tolist(), strict=True)), np.int16, len(words))
        count = np.fromiter(m.listed.values(), np.float64, len(words))
        a, n = m.classes[:, kinds]
        base_of = np.log10(count + 0.5) - np.log10(m.total + 0.5 * (m.distinct + 1))
        own_of = np.where(symbol <= OWN, 0.0, np.log10((count + 0.5) / (np.where(symbol <= OWN, count, a) + 0.5 * (n + 1))))
        known = {w: k for k, w in enumerate(words)}
        number, size, slots = 0, 0, Slots(known)
        ids, texts = [], []

        def chunk() -> pa.RecordBatch:
            names = np.concatenate([symbol, np.array(slots.symbols, np.int16)])
            scores = m.chain.log10([names[t] for t in texts])
            n_known, base, cells = [], [], []
            for k, t in enumerate(texts):
                near = t[t < len(words)]
                n_known.append(len(near))
                base.append(float(base_of[near].sum()))
                scores[k] += own_of[near].sum()
                far, times = np.unique(t[t >= len(words)] - len(words), return_counts=True)
                cells.append((np.full(len(far), k, np.int32), far, times))
            join = lambda k: np.concatenate([c[k] for c in cells]).astype(np.int32).tobytes()
            return pa.RecordBatch.from_pydict({"chunk": [(TaskContext.get().partitionId() << 32) + number], "doc_ids": [ids], "n_tokens": [[len(t) for t in texts]], "n_known": [n_known], "base": [base], "score": [scores.tolist()], "words": [slots.words], "row": [join(0)], "word": [join(1)], "times": [join(2)]}, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                tokens = tokens_of(text)
                ids.append(doc_id)
                texts.append(np.fromiter(map(slots.__getitem__, tokens), np.int32, len(tokens)))
                size += len(text) + 64
                if size > CHUNK:
                    yield chunk()
                    number, size, slots = number + 1, 0, Slots(known)
                    ids, texts = [], []
        if ids:
            yield chunk()

    return columns(docs, "doc_id", "text").mapInArrow(run, CHUNKS)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each text."""
    chunks = written(_chunks(docs, model))
    asked = chunks.select("chunk", F.posexplode("words").alias("at", "word"))
    # place and count in one number; a word's count is below 2 ** 38 and a chunk has fewer than 2 ** 25 words
    found = asked.join(counts, "word").groupBy("chunk").agg(F.collect_list(F.col("at").cast("long") * (1 << 38) + F.col("c")).alias("found"))
    back = chunks.select("chunk", "doc_ids", "n_tokens", "n_known", "base", "score", "row", "word", "times", F.size("words").alias("n_words"), F.transform("words", lambda w: (F.crc32(w) % CLASSES).cast("int")).alias("kinds")).join(written(found), "chunk", "left")
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.total, model.distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total, distinct = shared.value
        norm = np.log10(total + 0.5 * (distinct + 1))
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r: batch.column(c)[r]
                array = lambda c: np.asarray(get(c).values)
                c = np.zeros(get("n_words").as_py())
                if get("found").is_valid:
                    x = array("found")
                    c[x >> 38] = x & ((1 << 38) - 1)
                a, n = classes[:, array("kinds")] if len(c) else (np.zeros(0), np.zeros(0))
                base, own = np.log10(c + 0.5) - norm, np.log10((c + 0.5) / (a + 0.5 * (n + 1)))
                row, word, times = (np.frombuffer(get(k).as_py(), np.int32) for k in ("row", "word", "times"))
                docs_ = len(get("doc_ids").values)
                add = lambda v, row=row, docs_=docs_: np.bincount(row, v, docs_)
                known = array("n_known") + add(times * (c[word] > 0)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([get("doc_ids").values, get("n_tokens").values, pa.array(known), pa.array(np.full(docs_, total, np.int64)), pa.array(array("base") + add(times * base[word])), pa.array(array("score") + add(times * own[word]))], names=names)

    return back.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
