"""Personal data: exact detectors, and a semi-Markov conditional random field that adds spans.

The field cuts runs of words that hold a digit or an @, or that stand as the value of a word like
token or password, into segments of at most MOST words. Features look at a whole segment (its shape,
length, checksums, quotes, the word before it); a dynamic program chooses boundaries and types
together. Other words never belong to an entity (but for groups of four capitals within an account
number), so they split a text into runs, and each is decoded on its own, exactly. Weights are trained
here, by gradient ascent on the likelihood of whole segmentations: of generated cases with decoys, and
of runs of a bounded sample of documents that the exact detectors explain. Beyond the exact kinds the
field knows secrets, social security numbers, IBANs and other long account numbers, and more forms of
addresses and phone numbers. Spans of the field that touch an exact one are left out.

Results for odd rows: null and empty texts have no spans; very long texts are read whole; a null
doc_id stays null; equal rows get equal results; find() neither reads nor returns other columns,
redact() keeps them, finds the text by its name in any case, and raises an error where there is
none; an empty table gives an empty result. All scans are linear in the text, also where it has no spaces.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import by_hash, columns, lean, map_batches, sample

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban", "account")
LABELS = ("", *KINDS)
#: Words in a segment; training rounds; documents, and bytes of them, that training takes at most, runs of them, and words of a part of a run.
MOST, ROUNDS, SAMPLE, SAMPLE_BYTES, RUNS, RUN_WORDS = 9, 25, 400, 8_000_000, 1200, 12
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|key|auth)"
TRIGGER = re.compile(rf"[0-9@]\S*|(?i:{NAMES})[\"']?\s?[=:]\s?[\"']?([^\s\"']\S*)")
KEYWORD = re.compile(rf"(?i){NAMES}[\"']?\s?[=:]?\s?[\"']?\Z|(?i:token|secret|passw(?:or)?d|api_?key|auth)\b")
HEX = re.compile(r"[0-9a-fA-F]{20,}\Z")
MIXED = re.compile(r"(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}\Z")
#: How public services' keys begin.
KEYS = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_.-]{20,}|glpat-[A-Za-z0-9_-]{16,})\Z")
BARE_PHONE = re.compile(r"(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\Z")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\Z")
IPV6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\Z|(?=.*::)(?!.*::.*::)[0-9A-Fa-f:]{3,39}\Z")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?\Z")
CAPITALS = re.compile(r"\s*([A-Z]{4})\s*\Z")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(s: str) -> bool:
    """Whether the shape and the remainder by 97 are an IBAN's."""
    if not IBAN.match(s):
        return False
    plain = s.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def exact(text: str) -> list[Span]:
    """The spans of the exact detectors, by kind and start."""
    out: list[Span] = []
    end = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            at = m.start()
            while at > end and text[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                out.append(("email", at, m.end()))
                end = m.end()
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Start and end of neighbouring words that may belong to an entity."""
    run: list[tuple[int, int]] = []
    at = 0
    while m := TRIGGER.search(text, at):
        start = m.start(1) if m[1] else m.start()
        while not m[1] and start > at and not text[start - 1].isspace():
            start -= 1
        if run and (gap := text[run[-1][1] : start]).strip():
            if start - run[-1][1] < 8 and (word := CAPITALS.match(gap)):
                run.append((run[-1][1] + word.start(1), run[-1][1] + word.end(1)))
            else:
                yield run
                run = []
        run.append((start, m.end()))
        at = m.end()
    if run:
        yield run


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


SIZE = 32


def features(text: str, run: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """What holds for the words i to j - 1 of a run, as one segment."""
    start, end = trimmed(text, run[i][0], run[j - 1][1])
    s = text[start:end]
    d = digits_of(s)
    out = [0, 1 if j - i == 1 else 2]
    if "@" in s:
        out.append(3 if j - i == 1 and DOMAIN.search(s) and s.count("@") == 1 else 4)
    parts = s.split(".")
    if len(parts) > 1 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(5 if len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts) else 6)
    plain = all(c in "0123456789 -" for c in s)
    if plain and 13 <= len(d) <= 19:
        out.append(7 if luhn(d) else 8)
    elif plain:
        out.append(9)
    if s[:1] == "+" and all(c in "+0123456789 ().-" for c in s):
        out.append(10 if 9 <= len(d) <= 15 else 11)
    if HEX.match(s):
        out.append(12)
    elif MIXED.match(s):
        out.append(13)
    before = text[max(0, start - 24) : start]
    if KEYWORD.search(before):
        out.append(14)
    if before[-1:] in ('"', "'") or before.rstrip()[-1:] in ("=", ":"):
        out.append(15)
    if any(c.isalpha() for c in s):
        out.append(16)
    out.append(17 if end - start < 6 else 18 if end - start < 16 else 19)
    if any(c in "()" for c in s):
        out.append(20)
    if not s:
        out.append(21)
    if i and text[run[i - 1][0]] == "+":
        out.append(22)
    if 14 in out and (12 in out or 13 in out):
        out.append(23)
    for k, shape in ((24, KEYS), (25, BARE_PHONE), (26, SSN), (27, IPV6)):
        if shape.match(s):
            out.append(k)
    if iban(s):
        out.append(28)
    # the value of a name, in quotes or not, with or without a digit
    if 14 in out and 15 in out and j - i == 1:
        out.append(29 if d else 30 if before[-1:] in ('"', "'") else 31)
    return out


#: Features of shapes that only the field names: no run of a document with one of them teaches anything.
DOUBTFUL = frozenset((8, 12, 13, 23, 24, 25, 26, 27, 28, 29, 30, 31))


class SemiField:
    """weights: labels by features; label 0 (no entity) takes segments of one word."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def _scores(self, cells: list[tuple[int, int, list[int]]]) -> list[list[float]]:
        return [self.weights[:, f].sum(1).tolist() for _, _, f in cells]

    @staticmethod
    def cells(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
        return [(i, j, features(text, run, i, j)) for j in range(1, len(run) + 1) for i in range(max(0, j - MOST), j)]

    def decode(self, text: str, run: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation's entities."""
        cells = self.cells(text, run)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(-np.inf, 0, 0)] * len(run)
        for (i, j, _), score in zip(cells, self._scores(cells), strict=True):
            for y, s in enumerate(score):
                if (y or j - i == 1) and best[i][0] + s > best[j][0]:
                    best[j] = (best[i][0] + s, i, y)
        out, j = [], len(run)
        while j:
            _, i, y = best[j]
            if y:
                start, end = trimmed(text, run[i][0], run[j - 1][1])
                if end > start:
                    out.append((LABELS[y], start, end))
            j = i
        return out[::-1]

    def gradient(self, n: int, cells: list[tuple[int, int, list[int]]], gold: dict[tuple[int, int], int], into: np.ndarray) -> float:
        """Adds the gradient of the log-likelihood of a segmentation; gives that likelihood."""
        scores = self._scores(cells)
        up, down = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        up[0] = down[n] = 0
        mass = [np.logaddexp.reduce(s if j - i == 1 else s[1:]) for (i, j, _), s in zip(cells, scores, strict=True)]
        for (i, j, _), m in zip(cells, mass, strict=True):
            up[j] = np.logaddexp(up[j], up[i] + m)
        for (i, j, _), m in zip(reversed(cells), reversed(mass), strict=True):
            down[i] = np.logaddexp(down[i], down[j] + m)
        truth = 0.0
        for (i, j, f), s in zip(cells, scores, strict=True):
            p = np.exp(up[i] + down[j] - up[n] + np.array(s))
            if j - i > 1:
                p[0] = 0
            if (y := gold.get((i, j))) is not None:
                p[y] -= 1
                truth += s[y]
            into[:, f] -= p[:, None]
        return float(truth - up[n])


def gold_of(text: str, run: list[tuple[int, int]], spans: list[Span]) -> dict[tuple[int, int], int]:
    """The run's words as segments: an entity where a span's words are, else single words."""
    out: dict[tuple[int, int], int] = {}
    k = 0
    while k < len(run):
        hit = next(((y, e) for y, s, e in spans if run[k][0] <= s < run[k][1]), None)
        j = k + 1
        if hit:
            while j < len(run) and run[j][0] < hit[1] and j - k < MOST:
                j += 1
        out[k, j] = LABELS.index(hit[0]) if hit and trimmed(text, run[k][0], run[j - 1][1])[1] == hit[1] else 0
        if not out[k, j] and j - k > 1:
            del out[k, j]
            j = k + 1
            out[k, j] = 0
        k = j
    return out


def generated(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts with one entity or decoy each, and the entity's span."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(k))
    out = []
    for k in range(n):
        quote = ""
        kind = (*KINDS, "", "", "", "", "")[k % 13]
        lead = word(2, 7)
        if kind == "email":
            s = f"{word(2, 8)}{r.choice(['', '.', '_'])}{number(r.randint(0, 2))}@{word(3, 8)}{r.choice(['', number(1)])}.{r.choice(['com', 'org', 'example.net'])}"
        elif kind == "ip":
            s = ".".join(str(r.randint(0, 255)) for _ in range(4)) if r.random() < 0.6 else r.choice([":".join(f"{r.randint(0, 65535):x}" for _ in range(8)), f"fe80::{r.randint(1, 65535):x}:{r.randint(1, 65535):x}", f"20{number(2)}:{r.randint(1, 65535):x}::{number(1)}"])
        elif kind == "card":
            body = number(r.choice([12, 14, 15]))
            d = next(body + c for c in "0123456789" if luhn(body + c))
            s = d if r.random() < 0.6 else r.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4))
        elif kind == "phone":
            s = r.choice([f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"+{number(11)}", f"+{number(2)} {number(3)} {number(4)} {number(2)}", *[f"{number(3)}{c}{number(3)}{c}{number(4)}" for c in "-. "], f"({number(3)}) {number(3)}-{number(4)}"])
        elif kind == "secret":
            s = r.choice([hexes(r.choice([24, 32, 40, 64])), hexes(40), f"{mixed(r.randint(20, 40))}7k", f"{word(5, 9)}{number(2)}", f"{word(3, 5)}-{word(3, 5)}-{word(3, 5)}x"])
            lead, quote = r.choice(["token =", "secret:", "api_key =", "password:", "key =", "token=", "password="]), '"' if r.random() < 0.7 or not any(c.isdigit() for c in s) else ""
            if r.random() < 0.35:
                lead, quote = lead if r.random() < 0.5 else word(2, 6), ""
                s = r.choice([f"AKIA{mixed(16).upper()}", f"ghp_{mixed(36)}", f"sk-{mixed(30)}", f"xoxb-{number(12)}-{mixed(20)}"])
        elif kind == "ssn":
            s = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        elif kind == "iban":
            body = r.choice(["DE", "GB", "FR", "ES"]) + "00" + (number(18) if r.random() < 0.5 else "ABCD" + number(14))
            check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
            body = f"{body[:2]}{check:02d}{body[4:]}"
            s = body if r.random() < 0.5 else " ".join(body[i : i + 4] for i in range(0, len(body), 4))
        elif kind == "account":
            d = next(x for _ in range(99) if not luhn(x := number(r.choice([14, 15, 16, 16, 18]))))
            s = d if r.random() < 0.7 else " ".join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            s = r.choice([number(r.randint(1, 9)), f"{number(1)}.{number(1)}.{number(1)}", "999.1.300.4", f"{word(2, 5)}{number(2)}", f"@{word(3, 6)}", f"{number(4)}-{number(2)}-{number(2)}", f"+{number(3)}", f"{number(2)} {number(4)}", f"{number(25)}", f"v{number(2)}.{number(2)}", f"{number(2)}:{number(2)}", f"{number(2)}:{number(2)}:{number(2)}", f"{number(4)}-{number(4)}", hexes(r.choice([20, 32, 40])), f"({number(4)})", f"{number(3)} {number(3)}"])
            if r.random() < 0.15:
                lead, s = r.choice(["token:", "password:", "secret:", "key:"]), word(2, 9)
        text = f"{word(2, 6)} {lead}{'' if lead[-1:] == '=' and lead[-2:] != ' =' else ' '}{quote}"
        at = len(text)
        tail = r.choice(["", ",", ".", "***", "%%%"])
        out.append((f"{text}{s}{quote}{tail} {word(2, 6)}", [(kind, at, at + len(s))] if kind else []))
    return out


def train(texts: list[str], cases: int = 1300, rounds: int = ROUNDS, rate: float = 0.4, pull: float = 1e-3) -> SemiField:
    """Weights from generated cases and from the first RUNS runs of these texts (long ones in parts), by Adagrad steps over all of them."""
    known = generated(cases)
    named = 0
    for text in texts:
        spans, k = exact(text), 0  # spans are looked at in order
        spans.sort(key=lambda x: x[1])
        for run in runs(text):
            for at in range(0, len(run), RUN_WORDS):
                part = run[at : at + RUN_WORDS]
                s, e = part[0][0], part[-1][1]
                if named >= RUNS or DOUBTFUL & {f for _, _, own in SemiField.cells(text, part) for f in own}:
                    continue
                while k < len(spans) and spans[k][2] <= s:
                    k += 1
                here = [x for x in spans[k : k + RUN_WORDS] if s <= x[1] and x[2] <= e]
                base = max(0, s - 24)
                known.append((text[base : e + 8], [(kind, a - base, b - base) for kind, a, b in here]))
                named += 1
    work = []
    for text, spans in known:
        for run in runs(text):
            work.append((len(run), SemiField.cells(text, run), gold_of(text, run, spans)))
    field = SemiField(np.zeros((len(LABELS), SIZE)))
    sums = np.full_like(field.weights, 1e-6)
    for _ in range(rounds):
        g = np.zeros_like(field.weights)
        for n, cells, gold in work:
            field.gradient(n, cells, gold, g)
        g = g / len(work) - pull * field.weights
        sums += g * g
        field.weights += rate * g / np.sqrt(sums)
    return field


def fit(docs: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> SemiField:
    """A field trained on generated cases and on at most `most` documents, and `most_bytes` of their texts, chosen by a hash of the id."""
    rows = columns(docs, "doc_id", "text").where("text RLIKE '[0-9@]'")
    rows = sample(by_hash(rows, docs.count() // 4, most), most, most_bytes)  # texts with a digit are a part of all
    return train([r["text"] for r in rows])


def spans_of(text: str, field: SemiField) -> tuple[list[Span], list[Span]]:
    """The exact spans, and all spans by kind and start."""
    base = exact(text)
    taken = sorted((a, b) for _, a, b in base)
    more = []
    for run in runs(text):
        if len(run) == 1 and any(a <= run[0][0] and b >= trimmed(text, *run[0])[1] for a, b in taken if a < run[0][1] and b > run[0][0]):
            continue
        more += [x for x in field.decode(text, run) if not any(a < x[2] and x[1] < b for a, b in taken)]
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: SemiField) -> DataFrame:
    """doc_id and spans of every document: `base` and `spans`, arrays of kind, start and end (code points, end exclusive)."""
    weights = field.weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        model = SemiField(weights)

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [spans_of(x or "", model) for x in batch.column("text").to_pylist()]
            named = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[k]] for x in found] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named[0], kind), pa.array(named[1], kind)], names=["doc_id", "base", "spans"])

        return turn

    spans = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(columns(docs, "doc_id", "text"), make, f"doc_id long, base {spans}, spans {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined forms of find()'s rows."""
    form = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(form("base"), 256).alias("base_sha256"), form("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, field: SemiField) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    weights = field.weights
    at = next((k for k, f in enumerate(docs.schema.fields) if f.name.lower() == "text" and f.dataType.typeName() in ("string", "varchar", "char")), None)
    if at is None:
        raise ValueError("there is no column text of strings to mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiField(weights)
        for batch in batches:
            texts = [x if x is None else masked(x, spans_of(x, model)[1]) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sha(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
