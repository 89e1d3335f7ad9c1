from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftspan.llm import packing as P

from .conftest import small


def test_ids_are_those_of_the_public_tokenizer(spark, odd):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = small(spark).select("doc_id", "text").unionByName(odd.where("doc_id IN (7, 8, 9)").selectExpr("doc_id + 100000 AS doc_id", "text"))
    pieces: dict = {}
    for r in P.pieces(docs).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for r in docs.collect():
        want = t.encode(r["text"], add_special_tokens=False).ids + [2]
        own = sorted(pieces[r["doc_id"]], key=lambda x: x["piece"])
        assert [int(i) for x in own for i in np.frombuffer(x["ids"], "<u4")] == want
        assert [x["start"] for x in own] == [sum(y["length"] for y in own[:k]) for k in range(len(own))]
        assert all(x["length"] == 1024 for x in own[1:]) and 0 < own[0]["length"] <= 1024


def test_packing_is_valid_and_tight(spark):
    got = P.pack_documents(small(spark)).collect()
    by: dict = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    total = sum(r["length"] for r in got)
    assert len(by) <= 1.005 * total / 1024 + 2


def test_reruns_agree(spark):
    a, b = (P.pack_documents(small(spark), with_ids=False).select("doc_id", "piece", "sequence_id", "offset") for _ in range(2))
    assert a.exceptAll(b).count() == 0


def test_best_fit_with_few_bins():
    bins = P.Bins(10, 2)
    put = [bins.put(n) for n in (6, 7, 3, 8, 4, 10, 2)]
    # 3 fills the bin of 7; 8 opens a third bin after; 4 fills the bin of 6; 10 is alone; 2 fills the bin of 8
    assert put == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (3, 0), (2, 8)] and bins.count == 0
    bins = P.Bins(10, 2)
    assert [bins.put(n)[0] for n in (6, 7, 8, 4, 3)] == [0, 1, 2, 0, 3]  # the fullest, of 7, closed for 8


def test_best_fit_is_the_plain_one():
    r = random.Random(3)
    for most in (1, 3, 50):
        bins, plain, made = P.Bins(100, most), {}, 0
        for _ in range(3000):
            n = r.randint(1, 100)
            got, at = bins.put(n)
            if n == 100:
                made += 1
                continue
            fits = [b for b, f in plain.items() if f >= n]
            if fits:
                assert plain[got] == min(plain[b] for b in fits) and at == 100 - plain[got]
            else:
                if len(plain) == most:
                    least = min(plain.values())
                    # which of the equally full ones closed is known by its absence later
                    full = [b for b, f in plain.items() if f == least]
                    open_ = {b for own in bins.by_free for b in own} | {got}
                    plain.pop(next(b for b in full if b not in open_))
                assert got == made and at == 0
                made += 1
                plain[got] = 100
            plain[got] -= n
            if not plain[got]:
                del plain[got]


def test_general_items(spark):
    items = spark.range(300).select("id", (F.col("id") % 9 + 1).alias("length"), F.lit("x").alias("other"))
    got = P.pack(items, size=9, tasks=3).collect()
    assert len(got) == 300 and {r["other"] for r in got} == {"x"}


@pytest.mark.parametrize("c", [" ", "\n", "x"])
def test_long_runs_of_a_character(c):
    own = P.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})
    text = "a " + c * 1_000_000 + " b"
    assert own.ids(text).tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_bins_close_while_documents_are_packed(spark):
    lengths = [r["length"] for r in P.pieces(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("length").collect()]
    random.Random(1).shuffle(lengths)
    bins, closed = P.Bins(P.SEQUENCE, P.OPEN_BINS), 0
    for k in range(0, len(lengths), P.WINDOW):
        for n in sorted(lengths[k : k + P.WINDOW], reverse=True):
            full = bins.count == bins.most and not bins.free >> n
            bins.put(n)
            closed += full and n < P.SEQUENCE
    assert closed > 0 and bins.count <= P.OPEN_BINS and bins.made <= 1.005 * sum(lengths) / P.SEQUENCE
