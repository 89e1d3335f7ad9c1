from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftspan.llm import licenses as L
from weftspan.llm.licenses import Automaton, words_of

from .conftest import small

CASES = [
    ("a <<optional>>b<<end>> c", "x a c", True), ("a <<optional>>b<<end>> c", "a b c", True), ("a <<optional>>b<<end>> c", "a b b c", False), ("a <<any 2>> c", "a x y c", True), ("a <<any 2>> c", "a x y z c", False), ("a <<any 2>> c", "a c", True),
    ("a <<optional>>b <<optional>>d<<end>> e<<end>> c", "a b e c", True), ("a <<optional>>b <<optional>>d<<end>> e<<end>> c", "a b d c", False), ("A, b!", "(a) B", True), ("a a b", "a a a b", True),
]


@pytest.mark.parametrize(("template", "text", "want"), CASES)
def test_automata(template, text, want):
    assert Automaton(template).accepts(words_of(text.encode())) == want


@pytest.mark.parametrize("bad", ["a <<end>>", "<<optional>>a", "<<optional>>a<<end>>", ""])
def test_bad_templates(bad):
    with pytest.raises((ValueError, IndexError)):
        Automaton(bad)


def pattern(parts):
    return "".join(f"(?:{pattern(p)})?" if isinstance(p, list) else f"(?:[^ ]+ ){{0,{p}}}" if isinstance(p, int) else p.decode() + " " for p in parts)


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.lists(st.sampled_from(["a", "b", "<<any 1>>", "<<any 3>>"]), min_size=1, max_size=4), lambda x: st.lists(x, min_size=1, max_size=3).map(lambda v: ["a", "<<optional>>", *[w for y in v for w in y], "<<end>>"]), max_leaves=4), st.lists(st.sampled_from("abc"), max_size=12))
def test_automata_are_regular_expressions(parts, words):
    template = " ".join(["a", *parts, "b"])
    assert Automaton(template).accepts([w.encode() for w in words]) == bool(re.search("(^| )" + pattern(L.parse(template)), " ".join(words) + " "))


def test_words_and_places(spark):
    got = {r["doc_id"]: r for r in L.scan(small(spark)).collect()}
    for r in small(spark).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r["text"]))
        starts = [i for p in L.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert set(x["base_labels"].split(",")) <= set(x["labels"].split(","))
    assert any("cc-by-nc-4.0" in r["labels"] and r["score"] == 1 for r in got.values())


def test_places_of_many_hits(spark):
    text = "cc by x mit license\n" * 40_000
    row = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (200_000, 80_000, 0, 199_998)


@pytest.mark.parametrize("label", ["bsd-2-clause", "bsd-3-clause", "isc", "mit-license"])
def test_whole_texts(label):
    """A text with every optional region, one with none, and one that lacks a mandatory word."""
    auto, template = Automaton(L.TEMPLATES[label]), L.TEMPLATES[label]
    filled = re.sub(r"<<any \d+>>", "the Example Authors", template)
    full, bare = (words_of(re.sub(r"<<optional>>(.*?)<<end>>", keep, filled).encode()) for keep in (r"\1", ""))
    assert auto.accepts([b"intro", *full, b"more"]) and auto.accepts(bare)
    assert not auto.accepts([w for w in full if w != b"copyright"])
    crowded = re.sub(r"<<any \d+>>", "word " * 11, template)
    assert not auto.accepts(words_of(re.sub(r"<<optional>>(.*?)<<end>>", r"\1", crowded).encode()))
