"""Near-duplicate classes by the exact Jaccard similarity of word shingles.

Equal sets become one class by a digest. How many texts have a shingle is counted exactly, by a
shuffle of sorted, packed shingles of whole chunks of texts, in as many ranges as the bytes of
text ask for; each chunk gets back only those of its shingles that several texts have. A set with
too few of them links with nothing. The others are indexed by their prefix in order of rarity:
sets that link share a shingle there. Shingles with the same index list count once. In each list,
two sets may link only if their sizes and their sketches allow it (a parity bit for each of about
n places: equal shingles cancel, so the bits that differ are at most the shingles that differ);
a forest of what may link makes blocks, linear in the lists, and each block is joined in one task:

- the index list of a shingle holds its sets by size, in runs with their largest size and
  least position; a probe skips the runs whose sizes or positions can't reach the threshold;
- a set that meets a highly similar one whose overlaps are known derives its own overlaps
  from those, by the lists of the shingles in which the two differ;
- a set all of whose candidates are linked with it already is not compared at all.

A list of more than LIST sets becomes a star without looking at sketches, so that no task holds
more. A block over the bounds is split by hash. Its parts are joined, and what is not in its largest
class by then meets every part, so that tasks stay bounded and no link is lost.

Results for odd rows: null and empty texts have no shingles and link with nothing; texts with
fewer words than a shingle have one, the whole sequence; a very long text is a chunk of its own;
rows that share a doc_id count as one document with several texts; rows with a null doc_id link
with nothing and have a null component; an empty table gives an empty result; other columns are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bytes_of, columns, forget, groups, lean, written
from ._words import Numbers, windows
from .graph import components, forest

WIDTH, PERCENT = 4, 85
#: Bytes of text for each range of hashes; shingles of a chunk, for each range and at least and at most.
RANGE_BYTES, EACH, LEAST, CHUNK = 8_000_000, 5000, 250_000, 3_000_000
#: Sets of a list that are compared by sketches; sets and shingles of one part of a block.
LIST, PART_SETS, PART_SHINGLES = 1000, 500, 1_000_000
#: Tasks among which the copies of one set are dealt.
SALTS = 16
#: Entries of a run of an index list.
RUN = 32


def shingles(text: bytes, numbers: Numbers, width: int = WIDTH) -> np.ndarray:
    """The set of a text, sorted. bytes.lower() lowers A-Z alone."""
    return np.unique(windows(numbers.of(text.lower().split()), width))


def prefix(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n, first in order, one of which each set that links with it has in its own prefix."""
    return n - -(-percent * n // 100) + 1


def packed(x: np.ndarray, delta: bool = True) -> bytes:
    """Numbers by planes of bytes, as differences if asked for: small where they rise slowly."""
    d = np.diff(x, prepend=x.dtype.type(0)) if delta else x
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def unpacked(b: bytes, kind: type, delta: bool = True) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    d = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(d, dtype=kind) if delta else d


CHUNKS = "key long, chunk long, r int, start long, ids array<long>, n array<long>, a array<long>, b array<long>, first binary, second binary, third binary"


def _chunks(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """Chunks of texts, each as 1 + `ranges` rows.

    r = -1: ids, sizes and digests of the texts, and their sets as places (first) among the chunk's
    sorted shingles. Else: those shingles that fall in range r (first), how many texts of the chunk
    have each (second), and the place of the first of them (start).
    """
    schema = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("r", pa.int32()), ("start", pa.int64()), *[(k, pa.list_(pa.int64())) for k in ("ids", "n", "a", "b")], *[(k, pa.binary()) for k in ("first", "second", "third")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, number = Numbers(), 0
        most = min(CHUNK, max(LEAST, EACH * ranges))  # small chunks are kind to memory, but a range's part must be worth a row
        ids, sets, size = [], [], 0
        edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)

        def chunk() -> pa.RecordBatch:
            name = (TaskContext.get().partitionId() << 32) + number
            kinds, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            cuts = np.concatenate([[0], np.searchsorted(kinds, edges), [len(kinds)]])
            half = lambda k: [int.from_bytes(d[k : k + 8], "big", signed=True) for d in digests]
            rows = [{"key": -1 - name, "chunk": name, "r": -1, "start": 0, "ids": ids, "n": [len(s) for s in sets], "a": half(0), "b": half(8), "first": packed(place.astype(np.uint32))}]
            for r, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if hi > lo:
                    rows.append({"key": r, "chunk": name, "r": r, "start": lo, "first": packed(kinds[lo:hi]), "second": packed(count[lo:hi].astype(np.uint32), False)})
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                s = shingles(text, numbers, width)
                ids.append(doc_id)
                sets.append(s)
                size += len(s) + 16
                if size > most:
                    yield chunk()
                    number, size = number + 1, 0
                    ids, sets = [], []
        if ids:
            yield chunk()

    return docs.mapInArrow(lean(run), CHUNKS)


def _shared(chunks: DataFrame, ranges: int) -> DataFrame:
    """Rows r = -1 as they are. Of each range of each chunk the shingles that several texts have anywhere: places (first), shingles (second), texts (third).

    A task has one range, and its share of the rows r = -1, which only pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groups(batches, "key"):
            if key < 0:
                yield from rows.to_batches()
                continue
            each = [unpacked(b, np.uint64) for b in rows.column("first").to_pylist()]
            count = np.concatenate([unpacked(b, np.uint32, False) for b in rows.column("second").to_pylist()]).astype(np.int64)
            _, back = np.unique(np.concatenate(each), return_inverse=True)
            texts = np.bincount(back, count)[back]
            out, at = [], 0
            for chunk, start, x in zip(rows.column("chunk").to_pylist(), rows.column("start").to_pylist(), each, strict=True):
                mine = texts[at : at + len(x)]
                at += len(x)
                often = np.flatnonzero(mine > 1)
                if len(often):
                    out.append({"key": key, "chunk": chunk, "r": key, "start": start, "first": packed(often.astype(np.uint32)), "second": packed(x[often]), "third": packed(mine[often].astype(np.uint64), False)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=rows.schema)

    task = F.when(F.col("r") < 0, F.pmod(F.xxhash64("chunk"), F.lit(ranges))).otherwise(F.col("r")).cast("int")
    return chunks.repartitionById(ranges, task).sortWithinPartitions("key").mapInArrow(lean(run), CHUNKS)


def sketch(names: np.ndarray, n: int) -> bytes:
    """Parities of the shingles that fall in each of at least n places, a power of two; n: the size of the whole set."""
    places = 1 << max(6, (n - 1).bit_length())
    odd = np.bincount((names.view(np.uint64) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _candidates(chunks: DataFrame, reps: DataFrame, parts: int, percent: int) -> DataFrame:
    """id, n, shingles shared with others (rarest first), how many of them are in the prefix, and their sketch, of each representative that shares enough.

    reps: chunk and the places of its texts that represent a class. A set that links shares at
    least `percent` of its own shingles, so all other sets end here.
    """
    own = chunks.select("chunk", "r", "start", "ids", "n", "first", "second", "third").unionByName(reps.select("chunk", F.lit(-2).alias("r"), F.col("places").alias("ids")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "chunk"):
            kind = rows.column("r").to_pylist()
            if -2 not in kind:
                continue
            at = kind.index(-1)
            get = lambda c, k: rows.column(c)[k].as_py()
            ids, sizes = get("ids", at), np.array(get("n", at), np.int64)
            place = unpacked(get("first", at), np.uint32).astype(np.int64)
            most = int(place.max()) + 1 if len(place) else 0
            texts, names = np.zeros(most, np.int64), np.zeros(most, np.int64)
            for k, r in enumerate(kind):
                if r >= 0:
                    where = get("start", k) + unpacked(get("first", k), np.uint32).astype(np.int64)
                    names[where] = unpacked(get("second", k), np.uint64).astype(np.int64)
                    texts[where] = unpacked(get("third", k), np.uint64, False).astype(np.int64)
            ends = np.cumsum(sizes)
            out: dict[str, list] = {"id": [], "n": [], "shared": [], "k": [], "sketch": []}
            for p in sorted(x for k, r in enumerate(kind) if r == -2 for x in get("ids", k)):
                n = int(sizes[p])
                mine = place[ends[p] - n : ends[p]]
                mine = mine[texts[mine] > 1]
                if 100 * len(mine) < percent * n:
                    continue
                mine = mine[np.lexsort((names[mine], texts[mine]))]
                for name, v in zip(out, (ids[p], n, names[mine], prefix(n, percent) - (n - len(mine)), sketch(names[mine], n)), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["shared"], pa.list_(pa.int64())), pa.array(out["k"], pa.int32()), pa.array(out["sketch"], pa.binary())], names=list(out))

    return own.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(lean(run), "id long, n long, shared array<long>, k int, sketch binary")


def may_link(ids: np.ndarray, n: np.ndarray, shared: np.ndarray, sketches: list[bytes], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """A forest (x, y) that connects the sets of a list which sizes and sketches allow to link; none that link are apart.

    n: sizes of the whole sets; shared: of what the sketches are of.
    """
    m = len(ids)
    order = np.argsort(n, kind="stable")
    size, part, left = n[order], shared[order], ids[order]
    longest = size * 100 // percent  # of a set that links with this one, no smaller
    # by places: a set meets those of as many places, and those of more, folded
    places = np.array([len(sketches[k]) for k in order])
    xs, ys = [], []
    for p in np.unique(places).tolist():
        own = np.flatnonzero(places == p)
        others = np.flatnonzero((places >= p) & (size <= longest[own].max()))
        folded = np.empty((len(others), p // 8), np.uint64)
        for row, k in enumerate(others.tolist()):
            b = np.frombuffer(sketches[order[k]], np.uint64)
            folded[row] = np.bitwise_xor.reduce(b.reshape(-1, p // 8), axis=0)
        at = np.searchsorted(others, own)
        for j, k in zip(at.tolist(), own.tolist(), strict=True):
            end = int(np.searchsorted(size[others], longest[k], "right"))
            if end <= j + 1:
                continue
            apart = np.bitwise_count(folded[j + 1 : end] ^ folded[j]).sum(1)
            there = others[j + 1 : end]
            both = -(-percent * (size[k] + size[there]) // (100 + percent))
            hit = there[apart <= part[k] + part[there] - 2 * both]
            if len(hit):
                xs.append(np.full(len(hit), left[k]))
                ys.append(left[hit])
    if m < 2 or not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(xs), np.concatenate(ys))


def _edges(found: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links (a, b) between candidates such that no two sets that link are in different components."""
    posted = found.select("id", F.explode(F.slice("shared", F.lit(1), F.greatest("k", F.lit(0)))).alias("token"))
    # the members of a list as two sums of hashes: lists with equal members are one
    lists = posted.groupBy("token").agg(F.count("*").alias("m"), F.min("id").alias("lead"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("m > 1")
    lists = written(lists.groupBy("m", "x", "y").agg(F.min("token").alias("token"), F.min("lead").alias("lead")).select("token", "m", "lead"))
    members = posted.join(lists, "token")
    stars = members.where(F.col("m") > LIST).select(F.col("id").alias("a"), F.col("lead").alias("b"))
    marks = found.select("id", "n", F.size("shared").cast("long").alias("s"), "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "token"):
            get = lambda c, rows=rows: rows.column(c).to_numpy()
            a, b = may_link(get("id"), get("n"), get("s"), rows.column("sketch").to_pylist(), percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    small = members.where(F.col("m") <= LIST).select("token", "id").join(marks, "id")
    near = small.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(lean(run), "a long, b long")
    out = written(near.unionByName(stars))
    forget(lists)
    return out


def link_sets(sets: list[np.ndarray], sizes: list[int] | None = None, percent: int = PERCENT) -> np.ndarray:
    """A number for each set, equal where links connect them: 100 * overlap >= percent * union.

    sizes: those of the whole sets, if what no other set has was left out.
    """
    m = len(sets)
    given = np.array([len(s) for s in sets], np.int64)
    size = given if sizes is None else np.array(sizes, np.int64)
    label = np.arange(m)
    if m == 2:
        o = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.zeros(2, np.int64) if 100 * o >= percent * (size.sum() - o) and o else label
    order = np.argsort(size, kind="stable")
    size = size[order]
    owner = np.repeat(np.arange(m), given[order])
    kinds, token, count = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    # rarest first; shingles of one set alone come before all others and need no list
    rank = np.empty(len(kinds), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(kinds))
    shared = count[token] > 1
    alone = size - np.bincount(owner[shared], minlength=m)
    token, owner = rank[token[shared]], owner[shared]
    own = np.lexsort((token, owner))
    token, owner = token[own], owner[own]
    start = np.searchsorted(owner, np.arange(m + 1))
    place = np.arange(len(token)) - start[owner] + alone[owner]
    by_token = np.lexsort((owner, token))
    list_owner, list_place, list_token = owner[by_token], place[by_token], token[by_token]
    reach = np.array([prefix(int(n), percent) for n in size])
    indexed = list_place < reach[list_owner]
    index_owner, index_place, index_token = list_owner[indexed], list_place[indexed], list_token[indexed]
    overlaps: dict[int, np.ndarray] = {}

    def listed(tokens: np.ndarray) -> np.ndarray:
        """How often each set stands in the lists of these tokens."""
        lo, hi = np.searchsorted(list_token, tokens), np.searchsorted(list_token, tokens, "right")
        parts = [list_owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return np.bincount(np.concatenate(parts), minlength=m) if parts else np.zeros(m, np.int64)

    def probe(y: int) -> list[int]:
        """Smaller sets, not yet connected with y, that a list of y's prefix can't rule out."""
        found: set[int] = set()
        n = int(size[y])
        mine = token[start[y] : start[y + 1]][: max(0, int(reach[y] - alone[y]))]
        lo, hi = np.searchsorted(index_token, mine), np.searchsorted(index_token, mine, "right")
        for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            at = int(alone[y]) + k
            a += int(np.searchsorted(size[index_owner[a:b]], -(-percent * n // 100)))  # sizes rise within a list
            for run in range(a, b, RUN):
                end = min(b, run + RUN)
                if index_owner[run] >= y:
                    break
                small, large, early = int(size[index_owner[run]]), int(size[index_owner[end - 1]]), int(index_place[run:end].min())
                if (100 + percent) * (1 + min(n - at - 1, large - early - 1)) < percent * (n + small):
                    continue
                x = index_owner[run:end]
                bound = 1 + np.minimum(n - at - 1, size[x] - index_place[run:end] - 1)
                x = x[(x < y) & ((100 + percent) * bound >= percent * (n + size[x])) & (label[x] != label[y])]
                found.update(x.tolist())
        return sorted(found)

    for y in range(m):
        near = probe(y)
        if not near:
            continue
        mine = token[start[y] : start[y + 1]]
        known = next((x for x in near if x in overlaps), None)
        if known is not None:
            other = token[start[known] : start[known + 1]]
            plus, minus = np.setdiff1d(mine, other, assume_unique=True), np.setdiff1d(other, mine, assume_unique=True)
        if known is not None and len(plus) + len(minus) < len(mine):
            o = overlaps[known] + listed(plus) - listed(minus)
        else:
            o = listed(mine)
        overlaps[y] = o
        linked = np.flatnonzero((100 + percent) * o >= percent * (size + size[y]))
        linked = linked[o[linked] > 0]
        if len(linked):
            joined = np.unique(label[np.append(linked, y)])
            label[np.isin(label, joined)] = joined[0]
    out = np.empty(m, np.int64)
    out[order] = label
    return out


def _joined(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is connected within each `task` of rows task, id, n, shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "task"):
            ids = rows.column("id").to_numpy()
            label = link_sets([x.values.to_numpy() for x in rows.column("shared")], rows.column("n").to_pylist(), percent)
            # the first row of each label stands for it
            _, first, back = np.unique(label, return_index=True, return_inverse=True)
            lead = ids[first][back]
            keep = lead != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(lead[keep], pa.int64())], names=["a", "b"])

    return blocks.mapInArrow(lean(run), "a long, b long")


def _tasks(found: DataFrame, tasks: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links within each task of rows id, task."""
    work = found.select("id", "n", "shared").join(tasks, "id")
    return _joined(work.repartition(parts, "task").sortWithinPartitions("task"), percent)


def _pieces(rows: int | str = "*", s: str = "s"):
    """How many parts so many sets and shingles need."""
    return F.greatest(F.ceil(F.count(rows) / PART_SETS), F.ceil(F.sum(s) / PART_SHINGLES))


def _large(found: DataFrame, members: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links of blocks that are too large for a task: id, s (its shingles), component, parts.

    Parts of a block are joined each on its own, then one set of each class that this finds. What is
    in the block's largest class by then needs no comparison with the rest of that class. All others
    meet every part of the block, a part of theirs and a part of the block in a task.
    """
    members = written(members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))))
    own = written(_tasks(found, members.select("id", F.xxhash64("component", "part").alias("task")), parts, percent))

    def classed(links: DataFrame) -> DataFrame:
        roots = components(links)
        out = written(members.join(roots.withColumnRenamed("component", "class"), "id", "left").withColumn("class", F.coalesce("class", "id")))
        forget(roots)
        return out

    first = classed(own)
    leads = first.groupBy("component", "part", "class").agg(F.min(F.struct("id", "s")).alias("lead"), F.count("*").alias("m")).where("m > 1").select("component", "lead.id", "lead.s")
    some = written(leads.groupBy("component").agg(_pieces().alias("groups")))
    leads = leads.join(some, "component").select("id", F.xxhash64("component", F.lit("lead"), F.pmod(F.xxhash64("id"), F.col("groups"))).alias("task"))
    links = written(own.unionByName(_tasks(found, leads, parts, percent)))
    now = classed(links)
    forget(first, some)
    counts = now.groupBy("component", "class").agg(F.count("*").alias("m"), F.sum("s").alias("s"))
    most = written(counts.groupBy("component").agg(F.max_by("class", F.struct("m", "class")).alias("most")))
    rest = now.join(most, "component").where("class <> most").groupBy("component").agg(_pieces().alias("groups"))
    most = written(most.join(rest, "component"))
    now = now.join(most, "component")
    meet = lambda i, j: F.xxhash64("component", F.lit("meet"), i, j).alias("task")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    all_ = now.withColumn("j", each("groups")).select("id", meet(F.col("part"), F.col("j")))
    others = now.where("class <> most").withColumn("i", each("parts")).select("id", meet(F.col("i"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups"))))
    return links.unionByName(_tasks(found, written(all_.unionByName(others).distinct()), parts, percent))


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    texts = columns(docs, "doc_id", "text")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    parts = max(ranges, _parts(docs.sparkSession))
    chunks = written(_shared(_chunks(texts, width, ranges), ranges))
    flat = chunks.where("r = -1").select("chunk", F.posexplode(F.arrays_zip("ids", "n", "a", "b")).alias("place", "d"))
    rows = written(flat.select("chunk", "place", F.col("d.ids").alias("doc_id"), "d.n", "d.a", "d.b"))
    sets = rows.where("n > 0 AND doc_id IS NOT NULL")
    first = written(sets.groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "chunk", "place")).alias("rep"), F.count("*").alias("m")).select("a", "b", "n", "m", F.col("rep.doc_id").alias("rep"), "rep.chunk", "rep.place"))
    # a set of very many copies meets them in SALTS tasks
    several = first.where("m > 1").select("a", "b", "n", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sets.select("a", "b", "n", "doc_id", F.pmod(F.xxhash64("doc_id", "chunk", "place"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = salted.join(several, ["a", "b", "n", "salt"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = first.groupBy("chunk").agg(F.collect_list(F.col("place").cast("long")).alias("places"))  # at most a chunk's texts
    found = written(_candidates(chunks, reps, parts, percent))
    forget(chunks)
    edges = _edges(found, parts, percent)
    roots = components(edges)
    blocks = written(found.select("id", F.size("shared").cast("long").alias("s")).join(roots, "id"))
    forget(edges, roots)
    totals = written(blocks.groupBy("component").agg(_pieces().alias("parts")))
    members = written(blocks.join(totals, "component"))
    links = _tasks(found, members.where("parts = 1").select("id", F.xxhash64("component").alias("task")), parts, percent)
    if totals.where("parts > 1").limit(1).count():
        links = links.unionByName(_large(found, members.where("parts > 1"), parts, percent))
    ends = components(links.unionByName(copies))
    linked = written(ends)
    forget(found, first, blocks, totals, members, ends)
    # most documents link with nothing; those that do are one row each here
    out = rows.join(linked, rows["doc_id"] == linked["id"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def oracle() -> str:
    """DuckDB SQL of classes()'s rows of documents."""
    return """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS g FROM w),
    s AS (SELECT doc_id, len(g) AS n FROM g), t AS (SELECT doc_id, unnest(g) AS t FROM g),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM t x JOIN t y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
    l AS (SELECT a, b FROM o JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
    SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.n"""
