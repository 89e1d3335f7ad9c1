"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is license wording with markup. Words outside of markup must all occur, in order
and with nothing between them; ``<<optional>> ... <<end>>`` may be absent (and may nest);
``<<any N>>`` stands for up to N words of any kind. A text matches where an automaton over
its words reaches the end. Punctuation and case never count, as words leave them out.

Results for odd rows: null and empty texts have no words, no places (null first_word and
last_word), empty labels and score 0; equal rows get equal results; a null doc_id stays null;
other columns are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import bytes_of, columns, map_batches
from ._words import ALNUM

#: The phrases that every scan looks for, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Wording of public license notices, as templates.
TEMPLATES = {
    "apache-2.0": "Licensed under the <<optional>>terms of the<<end>> Apache License, Version 2.0 <<optional>>(the \"License\")<<end>>",
    "gpl-2.0": "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>, either<<end>> version 2",
    "gpl-3.0": "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>, either<<end>> version 3",
    "gpl-notice": "free software <<optional>>: you<<end>> <<any 4>> redistribute it and or modify it under the terms of the GNU General Public License",
    "cc-by-4.0": "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-SA 4.0",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<any 3>> to deal in <<any 3>> without restriction",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
#: Whole public license texts; what their authors fill in is replaceable, and numbering and the usual additions are optional.
WARRANTY = "THIS SOFTWARE IS PROVIDED BY <<any 10>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES |= {
    "bsd-2-clause": f"{CONDITIONS} {WARRANTY}",
    "bsd-3-clause": f"{CONDITIONS} <<optional>>3.<<end>> Neither the name of <<any 10>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {WARRANTY}",
    "isc": "Permission to use, copy, modify, and <<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<any 10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
MARK = re.compile(r"<<(optional|end|any (\d+))>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def parse(template: str) -> list:
    """Parts: a word; a list of parts that may be absent; or the most words of a replaceable region."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*MARK.finditer(template), None]:
        stack[-1] += words_of(template[at : mark.start() if mark else len(template)].encode())
        if mark is None:
            break
        at = mark.end()
        if mark[2]:
            stack[-1].append(int(mark[2]))
        elif mark[1] == "optional":
            stack.append([])
        elif len(stack) < 2:
            raise ValueError("<<end>> without <<optional>>")
        else:
            part = stack.pop()
            stack[-1].append(part)
    if len(stack) != 1:
        raise ValueError("<<optional>> without <<end>>")
    return stack[0]


class Automaton:
    """States are numbers; step[s] maps a word (None: any word) to a state, free[s] are moves without a word."""

    def __init__(self, template: str):
        parts = parse(template)
        self.step: list[dict[bytes | None, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.end = self._build(parts, 0)
        runs, run = [], []
        for part in [*parts, None]:
            if isinstance(part, bytes):
                run.append(part)
            else:
                runs.append(run)
                run = []
        #: The longest wording that any match contains: texts without it are not walked.
        self.must = b" " + b" ".join(max(runs, key=len)) + b" "
        self.closed = [self._closure(s) for s in range(len(self.step))]
        if self.end in self.closed[0]:
            raise ValueError("a template needs a word that must occur")

    def _state(self) -> int:
        self.step.append({})
        self.free.append([])
        return len(self.step) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, list):
                inner = self._build(part, at)
                out = self._state()
                self.free[at].append(out)
                self.free[inner].append(out)
            elif isinstance(part, int):
                out = self._state()
                self.free[at].append(out)
                for _ in range(part):
                    then = self._state()
                    self.step[at][None] = then
                    self.free[then].append(out)
                    at = then
            else:
                start, out = self._state(), self._state()
                self.free[at].append(start)
                self.step[start][part] = out
            at = out
        return at

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def accepts(self, words: list[bytes]) -> bool:
        """Whether the template's wording stands somewhere in the words."""
        now: set[int] = set()
        for word in words:
            then: set[int] = set()
            for s in now | self.closed[0]:
                for key in (word, None):
                    if (x := self.step[s].get(key)) is not None:
                        then |= self.closed[x]
            if self.end in then:
                return True
            now = then
        return False


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each document: places of the phrases, and the labels of phrases and templates.

    score: 1 if a template matches, 0.5 if only phrases occur, 0 otherwise.
    """

    def make():
        autos = {label: Automaton(x) for label, x in templates.items()}
        wanted = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k.split()[0]: [] for k in OUT.split(", ")}
            for text in bytes_of(batch.column("text")):
                words = words_of(text)
                line = b" " + b" ".join(words) + b" "
                starts, base = [], set()
                for phrase, label in wanted:
                    at, seen, place = line.find(phrase), 0, 0
                    while at >= 0:
                        place, seen = place + line.count(b" ", seen, at), at
                        starts.append(place)
                        base.add(label)
                        at = line.find(phrase, at + 1)
                more = {label for label, x in autos.items() if x.must in line and x.accepts(words)}
                for k, v in (("n_words", len(words)), ("n_base", len(starts)), ("first_word", min(starts, default=None)), ("last_word", max(starts, default=None)), ("base_labels", ",".join(sorted(base))), ("labels", ",".join(sorted(base | more))), ("score", 1.0 if more else 0.5 if base else 0.0)):
                    out[k].append(v)
            out["doc_id"] = batch.column("doc_id")
            return pa.RecordBatch.from_pydict(out, schema=SCHEMA)

        return turn

    return map_batches(columns(docs, "doc_id", "text"), make, OUT)


SCHEMA = pa.schema([(k, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for k, t in (x.split() for x in OUT.split(", "))])


def oracle() -> str:
    """DuckDB SQL of scan()'s rows: phrases by position, templates as regular expressions over the joined words."""

    def pattern(parts: list) -> str:
        return "".join(f"({pattern(p)})?" if isinstance(p, list) else f"([^ ]+ ){{0,{p}}}" if isinstance(p, int) else p.decode() + " " for p in parts)

    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"(' {pattern(parse(t))}', '{label}')" for label, t in TEMPLATES.items())
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
    p(phrase, label, k) AS (VALUES {phrases}), t(re, label) AS (VALUES {templates}),
    pos AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
    hits AS (SELECT r, i, label FROM pos, p WHERE array_to_string(list_slice(w, i + 1, i + k), ' ') = phrase),
    base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY r),
    full_ AS (SELECT r, label FROM d, t WHERE regexp_matches(' ' || array_to_string(w, ' ') || ' ', re)),
    both_ AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION SELECT r, label FROM full_) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.z AS last_word,
        coalesce(base.labels, '') AS base_labels, coalesce(both_.labels, '') AS labels,
        CASE WHEN d.r IN (SELECT r FROM full_) THEN 1.0 WHEN base.n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM d LEFT JOIN base ON base.r = d.r LEFT JOIN both_ ON both_.r = d.r"""
