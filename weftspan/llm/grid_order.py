"""Near-duplicate vectors: an epsilon grid order join.

Vectors become unit vectors, so a cosine of at least `cosine` is a distance of at most
epsilon = sqrt(2 - 2 * cosine). All vectors are projected on their leading principal
directions and sorted by label and by the cells, epsilon wide, of the first projections. The sorted
sequence is cut into blocks of bounded size. A block's box holds its vectors' projections and the
length of what the projections leave of them. Two blocks whose boxes are farther apart than epsilon
hold no link, as neither projections nor that length ever lengthen a distance; others are joined by
halving both sequences again and again, skipping halves that are provably distant, until a
small product of matrices decides. Equal vectors are one vector with a count throughout.

Results for odd rows: a vector that is null, zero or empty, holds null or non-finite numbers,
or whose label or vec_id is null, links with nothing (its component is its vec_id); vectors of
different lengths don't link; rows that share a vec_id count as one vector of several forms
for components, and as rows for n_links; an empty table gives an empty result; other columns
are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import columns, forget, map_batches, written
from .graph import components, forest

COSINE = 0.98
#: Directions of the grid, and of the boxes; vectors in a block, and in a leaf of the recursion.
DIRECTIONS, CARRIED, BLOCK, LEAF = 3, 8, 1024, 128


def unit(x: np.ndarray) -> bytes | None:
    """The unit vector as doubles; None for what links with nothing."""
    if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return (x / np.sqrt(x @ x)).tobytes()


def _units(vectors: DataFrame) -> DataFrame:
    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("embedding")
            values = column.flatten().to_numpy(zero_copy_only=False)  # NaN for null
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            known = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            out = [unit(values[a:b]) if k else None for a, b, k in zip([0, *ends[:-1].tolist()], ends.tolist(), known.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "x"])

        return turn

    plain = columns(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return map_batches(plain, make, "vec_id long, label string, x binary")


def _sums(units: DataFrame, width: int, basis: np.ndarray) -> np.ndarray:
    """Row sums of x (x . basis) and, last, of x, over all unit vectors of this width: width rows of a few numbers."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, k + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, width)
                total[:, :k] += x.T @ (x @ basis)
                total[:, k] += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(k + 1)]], names=["i", *[f"y{j}" for j in range(k + 1)]])

    cols = [f"y{j}" for j in range(k + 1)]
    part = units.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in cols))
    rows = part.groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).collect()  # width rows
    out = np.zeros((width, k + 1))
    for r in rows:
        out[r["i"]] = r[1:]
    return out


def directions(units: DataFrame, width: int) -> np.ndarray:
    """Orthonormal leading principal directions (width x at most CARRIED) of all unit vectors, by two rounds of a range finder."""
    k = min(CARRIED, width)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((width, k)))[0]
    n = max(1, units.count())
    for _ in range(2):
        s = _sums(units, width, basis)
        mean = s[:, k] / n
        y = s[:, :k] / n - np.outer(mean, mean @ basis)
        last = basis
        basis = np.linalg.qr(y)[0]
    w, v = np.linalg.eigh(last.T @ y)
    return np.linalg.qr(last @ v[:, ::-1])[0]


def _blocks(rows: DataFrame, bases: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Blocks of the sequence in grid order: label, width, box (lo, hi), ids, counts and vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(bases)

    def make():
        known = shared.value

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = np.zeros((batch.num_rows, CARRIED + 1))
            widths, x = batch.column("width").to_numpy(), batch.column("x").to_pylist()
            for w in np.unique(widths).tolist():
                own = np.flatnonzero(widths == w)
                basis = known[w]
                p[own, : basis.shape[1]] = np.frombuffer(b"".join(x[n] for n in own)).reshape(-1, w) @ basis
            p[:, CARRIED] = np.sqrt(np.maximum(0, 1 - (p**2).sum(1)))
            cells = np.floor(p[:, :DIRECTIONS] / eps).astype(np.int64)
            at = pa.array([row.tobytes() for row in p], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, j]) for j in range(DIRECTIONS)], *[pa.array(p[:, j]) for j in range(DIRECTIONS)], at], names=[*batch.schema.names, *cell_names, *places, "at"])

        return turn

    cell_names, places = [f"c{j}" for j in range(DIRECTIONS)], [f"p{j}" for j in range(DIRECTIONS)]
    placed = map_batches(rows, make, "label string, rep long, copies long, x binary, width int, " + ", ".join([f"{c} long" for c in cell_names] + [f"{c} double" for c in places]) + ", at binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = ["label", "width", *cell_names, *places, "rep"]
    placed = written(placed)
    sequence = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key = 0, None
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            p = np.frombuffer(b"".join(h[3] for h in held)).reshape(len(held), -1)
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + number], "label": [key[0]], "width": [key[1]], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()], "ids": [np.array([h[0] for h in held], np.int64).tobytes()], "copies": [np.array([h[1] for h in held], np.int64).tobytes()], "at": [p.tobytes()], "x": [b"".join(h[2] for h in held)]}, schema=schema)

        schema = pa.schema([("block", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("copies", pa.binary()), ("at", pa.binary()), ("x", pa.binary())])
        part = 0
        for batch in batches:
            cols = batch.to_pydict()
            for n in range(batch.num_rows):
                now = (cols["label"][n], cols["width"][n])
                if held and (now != key or len(held) == BLOCK):
                    yield block()
                    held, number = [], number + 1
                key, part = now, cols["part"][n]
                held.append((cols["rep"][n], cols["copies"][n], cols["x"][n], cols["at"][n]))
        if held:
            yield block()

    out = written(sequence.mapInArrow(cut, "block long, label string, width int, lo array<double>, hi array<double>, ids binary, copies binary, at binary, x binary"))
    forget(placed)
    return out


class Side:
    """A block's vectors, in grid order."""

    def __init__(self, ids: bytes, copies: bytes, at: bytes, x: bytes, width: int):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.at, self.x = np.frombuffer(at).reshape(len(self.ids), -1), np.frombuffer(x).reshape(-1, width)


def join_sides(a: Side, b: Side, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For each vector of a and of b the copies it links with on the other side; links that connect what is connected; leaves compared.

    same: b is a; then only the first array counts, with a vector's links to all others of the block.
    """
    from_a, from_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    leaves = 0
    todo = [(0, len(a.ids), 0, len(b.ids))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m:
            continue
        gap = np.maximum(0, np.maximum(a.at[i:j].min(0) - b.at[k:m].max(0), b.at[k:m].min(0) - a.at[i:j].max(0)))
        if gap @ gap > eps * eps:
            continue
        if j - i > LEAF or m - k > LEAF:
            h, g = (i + j) // 2 if j - i > LEAF else j, (k + m) // 2 if m - k > LEAF else m
            halves = [(i, h, k, g), (h, j, k, g), (i, h, g, m), (h, j, g, m)]
            todo += [t for t in halves if not same or t[0] <= t[2]]  # a block's halves meet once
            continue
        leaves += 1
        hit = a.x[i:j] @ b.x[k:m].T >= cosine
        inner = same and i == k
        if inner:
            hit = np.triu(hit, 1)
        r, c = np.nonzero(hit)
        from_a[i:j] += hit @ b.copies[k:m]
        back = a.copies[i:j] @ hit
        if same:
            from_a[k:m] += back
        else:
            from_b[k:m] += back
        if len(r):
            ends.append(forest(a.ids[i:j][r], b.ids[k:m][c]))
    if not ends:
        return from_a, from_b, np.zeros(0, np.int64), np.zeros(0, np.int64), leaves
    x, y = forest(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
    return from_a, from_b, x, y, leaves


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """a and b: numbers of blocks of one label, a <= b, whose boxes are at most epsilon apart. Boxes meet by cells of the first direction."""
    wide = 2 * eps
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / wide), F.floor(hi / wide)))
    meta = blocks.select("block", "label", "width", "lo", "hi")
    left = meta.select(F.col("block").alias("a"), "label", "width", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), cells(F.col("lo")[0] - eps, F.col("hi")[0] + eps).alias("cell"))
    right = meta.select(F.col("block").alias("b"), "label", "width", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), cells(F.col("lo")[0], F.col("hi")[0]).alias("cell"))
    gap = lambda j: F.greatest(F.lit(0.0), F.col("lo_a")[j] - F.col("hi_b")[j], F.col("lo_b")[j] - F.col("hi_a")[j])
    near = sum((gap(j) * gap(j) for j in range(1, CARRIED + 1)), gap(0) * gap(0)) <= eps * eps
    return left.join(right, ["label", "width", "cell"]).where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def _linked(blocks: DataFrame, pairs: DataFrame, cosine: float, eps: float) -> DataFrame:
    """id, links (copies linked with, within a pair of blocks) and root (an id it is connected with, or null)."""
    side = lambda n: blocks.select(F.col("block").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("ids", "copies", "at", "x")], *([F.col("width")] if n == "a" else []))
    work = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r: batch.column(c)[r].as_py()
                left, right = (Side(*[get(f"{c}_{n}") for c in ("ids", "copies", "at", "x")], get("width")) for n in ("a", "b"))
                same = get("a") == get("b")
                from_a, from_b, x, y, _ = join_sides(left, right, same, cosine, eps)
                ids, links = [left.ids[from_a > 0], x], [from_a[from_a > 0], np.zeros(len(x), np.int64)]
                if not same:
                    ids.insert(1, right.ids[from_b > 0])
                    links.insert(1, from_b[from_b > 0])
                none = sum(len(i) for i in ids[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links)), pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(y, pa.int64())])], names=["id", "links", "root"])

    return written(work.mapInArrow(run, "id long, links long, root long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors."""
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    rows = written(_units(vectors))
    sets = rows.where("x IS NOT NULL")
    first = written(sets.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("width", (F.length("x") / 8).cast("int")))
    bases = {w: directions(first.where(F.col("width") == w).select("x"), w) for w in [r["width"] for r in first.select("width").distinct().orderBy("width").collect()]}
    blocks = _blocks(first.select("label", "rep", "copies", "x", "width"), bases, eps)
    pairs = written(_pairs(blocks, eps))
    found = _linked(blocks, pairs, cosine, eps)
    forget(blocks, pairs)
    links = written(found.groupBy("id").agg(F.sum("links").alias("links")))
    member = written(sets.join(first, ["label", "x"]).select("vec_id", "rep", "copies", "label"))
    edges = found.where("root IS NOT NULL").select(F.col("id").alias("a"), F.col("root").alias("b"))
    ends = components(edges.unionByName(member.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    linked = written(ends)
    forget(ends, found, first)
    some = member.join(links, member["rep"] == links["id"], "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rest = rows.where("x IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = some.unionByName(rest)
    out = out.join(linked, out["vec_id"] == linked["id"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def oracle(cosine: float = COSINE) -> str:
    """DuckDB SQL of near_duplicates()'s rows of embeddings with distinct ids."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    u AS (SELECT vec_id, label, x, len(x) AS k FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
        AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
    l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.k = q.k AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= {cosine}),
    r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
    c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
    SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.x = e.vec_id"""
