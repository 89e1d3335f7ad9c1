"""Best-fit packing of token sequences, online, with a bounded number of open bins.

Documents become token ids and an end id; what is longer than a sequence is cut into full
pieces, the first one taking what is left over. Pieces arrive in an order that a hash gives, through
a buffer of about WINDOW documents that hands them on longest first. A bin that a piece fits into with
the least room left takes it (a bitset keyed by free space finds it in constant time); if there is
none, a new bin opens, and if all are open, the fullest closes first. Bins of full pieces never open.

Results for odd rows: a null text counts as empty, so the document is the end id alone; very long
texts are cut like all others, and runs of any one character have the public tokenizer's ids too;
a null doc_id stays null; equal rows are packed each on their own; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import columns, lean, map_batches

SEQUENCE, END_ID = 1024, 2
#: Bins a packing task keeps open, and documents whose pieces it takes: both bound its memory. A task ends with a few bins half full.
OPEN_BINS, TASK_DOCUMENTS = 256, 20_000
#: Documents of the buffer through which pieces arrive. More need more open bins; one would be plain arrival.
WINDOW = 512


class Tokenizer:
    """Ids of a public vocabulary: by its ranks, which is fast, and by its JSON form for the texts that the fast way refuses (very long runs)."""

    def __init__(self, json_path: str, ranks_path: str, special: dict[str, int]):
        """special: strings that are one id each, as the JSON form has them."""
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.json_path, self.general = json_path, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regular expression's stack ran out
            if self.general is None:
                import tokenizers

                self.general = tokenizers.Tokenizer.from_file(self.json_path)
            return np.array(self.general.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, name: str = "byte_bpe_50k", special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),), length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece of each whole text."""
    if length < 1:
        raise ValueError("a sequence has at least one token")

    def make():
        import public_tokenizers

        coder = Tokenizer(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), dict(special))

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(coder.ids(text or ""), end_id).astype("<u4")
                first = (len(ids) - 1) % length + 1
                cuts = [0, *range(first, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, x in zip(out, (doc_id, k, a, b - a, ids[a:b].tobytes()), strict=True):
                        out[name].append(x)
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]))

        return turn

    return map_batches(columns(docs, "doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids binary")


class Bins:
    """Open bins by free space: bit s of `free` is set while a bin with s tokens left is open."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.count, self.made = size, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes so many tokens, and where in it they begin."""
        if length == self.size:
            self.made += 1
            return self.made - 1, 0
        if fits := self.free >> length:
            room = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            bin_, room = self.made, self.size
            self.made += 1
        if left := room - length:
            self.by_free[left].append(bin_)
            self.free |= 1 << left
            self.count += 1
        return bin_, self.size - room

    def _take(self, room: int) -> int:
        out = self.by_free[room].pop()
        if not self.by_free[room]:
            self.free &= ~(1 << room)
        self.count -= 1
        return out


def pack(items: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, tasks: int = 1, order: Column | None = None) -> DataFrame:
    """items with sequence_id and offset; `length` says how many of a sequence's `size` tokens an item takes.

    Every task packs a share of its own, whatever the share's size, and keeps at most
    `open_bins` bins open, so more tasks leave more bins open at their ends.
    """
    if open_bins < 1:
        raise ValueError("at least one bin must be open")
    names = items.columns
    dealt = items.repartition(tasks).withColumn("__order", order if order is not None else F.lit(0)).sortWithinPartitions("__order", *[c for c, t in items.dtypes if not t.startswith("map")])
    dealt = dealt.withColumn("__task", F.spark_partition_id()).drop("__order")
    out = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(size, open_bins)
        for batch in batches:
            if batch.num_rows:
                task = batch.column("__task")[0].as_py() << 40
                placed = [bins.put(x) for x in batch.column("length").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task + a for a, _ in placed], pa.int64()), pa.array([b for _, b in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(lean(run), out).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, with_ids: bool = True, task_documents: int = TASK_DOCUMENTS) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ids too, or only their crc32 as ids_crc32.

    Rows of the table are counted first (from Parquet's footers), so that a packing task has the
    pieces of about `task_documents` documents at any size of the input.
    """
    rows = docs.count()
    tasks = max(1, -(-rows // task_documents))
    windows = max(1, -(-rows // (tasks * WINDOW)))
    cut = pieces(docs).withColumn("ids_crc32", F.crc32("ids"))
    cut = cut if with_ids else cut.drop("ids")
    return pack(cut, tasks=tasks, order=F.struct(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(windows)), -F.col("length")))
