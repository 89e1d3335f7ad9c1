"""Mixing sources to target weights by Pareto order sampling; DataFrame and SQL functions only.

A source's target is its weight's share of all words, at most `cap` times its own words; what
a cap leaves over is shared again by weight. A document's expected copies are its source's
target divided by the source's words, times its importance, at most `cap`; the importance is the number
of binary digits of its size, scaled to mean 1 over the source's words, so longer documents have
higher odds. Their whole part is certain. The rest is its inclusion probability for one copy more:
documents are ranked by random odds divided by inclusion odds, and the first are taken up to the words
that the target still lacks. Where the next one is too long for what is left, ROUNDS further passes
take the first that fit, and at last the one whose size is nearest to what lacks is taken if that
comes nearer. Random numbers are hashes of the id, so reruns agree.

A source may hold any share of the rows: its cut in the order is found from sums over PARTS
parts of the order, then over PARTS parts of one part, and only the rows of one part of a part
(1 of PARTS * PARTS) meet in one task. Rows are written once, with a number; what a pass takes is
told by a few numbers a source (the quota, and the last row that it took), so nothing is written again.

Results for odd rows: a null text has size 0 and a null source is a source of its own, last in
order; a very long text is a document like all others; a null doc_id takes its random number
from the text; equal rows are ranked one after the other; sources without words have target 0 and take
nothing; an empty table gives an empty result; other columns are neither read nor returned by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import columns, forget, written

WEIGHTS, CAP, PARTS, ROUNDS = (5, 2, 1), 3, 256, 2
#: Sources up to which tables of a row of a few numbers for each source are broadcast; beyond, joins shuffle.
FEW_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, number, source_size, weight and target of each source; weights repeat over the sources by code point."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), *[F.sum(F.col("size") * F.col(c)).alias("heft") for c in ("importance",) if c in sized.columns])
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full", "number")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    numbered = sums.withColumn("number", F.row_number().over(by_name) - 1)
    numbered = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    # level: words for each unit of weight if all that fill up earlier are at their caps; it rises as long as they do
    filled = numbered.withColumn("full", cap * F.col("source_size") / F.col("weight")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    filled = filled.withColumn("level", (F.col("total") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after))
    filled = filled.withColumn("final", F.max("level").over(Window.partitionBy()))
    target = F.least(F.col("final") * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return filled.select("source", "number", "source_size", "weight", target.alias("target"), *[c for c in ("heft",) if c in sums.columns])


#: The order of rows in a source; `row` parts equal ones.
KEY = ("order", "u", "doc_id", "size", "row")
KEY_TYPE = "struct<order:double,u:double,doc_id:bigint,size:bigint,row:bigint>"
CUTS = f"array<struct<quota:double,last:{KEY_TYPE},first:{KEY_TYPE}>>"
#: What is known of a source between passes: `lacks` is what the target lacks, a cut what a pass took.
STATE = ("source", "source_size", "target", "heft", "lacks", "cuts")


def _rows(sized: DataFrame, state: DataFrame, cap: int, small) -> DataFrame:
    """sized with its source's state, its certain copies (`whole`), its place in the order, and whether a cut has taken it (`extra`)."""
    rows = sized.join(small(state), sized["source"].eqNullSafe(state["source"])).drop(sized["source"])
    rate = F.least(F.lit(float(cap)), F.when(F.col("heft") > 0, F.col("target") * F.col("importance") / F.col("heft")).otherwise(0.0))
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("order", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(1.0)).withColumn("key", F.struct(*KEY))
    place = F.least(F.floor(F.col("order") * PARTS * PARTS), F.lit(PARTS * PARTS - 1))
    rows = rows.withColumn("a", F.floor(place / PARTS)).withColumn("b", place % PARTS)
    free = (F.col("whole") < cap) & (F.col("size") > 0)
    # all before the last row taken; where the edge had none, all before its first row
    within = lambda c: F.when(c["last"].isNotNull(), F.col("key") <= c["last"]).otherwise(F.coalesce(F.col("key") < c["first"], F.lit(False)))
    extra = free & F.exists("cuts", lambda c: (F.col("size") <= c["quota"]) & within(c))
    return rows.withColumn("extra", extra.cast("int")).withColumn("free", free & ~extra)


def _cut(sized: DataFrame, state: DataFrame, cap: int, small) -> DataFrame:
    """state after a pass that takes, of the free rows of at most the size that lacks, those that come first and fit together."""
    cands = _rows(sized, state, cap, small).where(F.col("free") & (F.col("size") <= F.col("lacks"))).select("number", "a", "b", "size", "key", "lacks")
    run = Window.partitionBy("number").orderBy("part")

    def edge(rows: DataFrame, at: str, *more: str) -> DataFrame:
        """number, the first part whose words no longer fit (the last one if all do), `had` by then, and `more`."""
        had = F.first("had") if "had" in rows.columns else F.lit(0)
        sums = rows.groupBy("number", F.col(at).alias("part")).agg(F.sum("size").alias("words"), F.first("lacks").alias("lacks"), had.alias("had"), *[F.first(c).alias(c) for c in more])
        sums = sums.withColumn("upto", F.col("had") + F.sum("words").over(run))
        # at most PARTS parts of a source
        rest = sums.groupBy("number").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("lacks"), F.col("part"))), F.max("part")).alias("cut"), F.collect_list(F.struct("part", (F.col("upto") - F.col("words")).alias("had"))).alias("all"), *[F.first(c).alias(c) for c in more])
        return rest.select("number", F.col("cut").alias(f"cut_{at}"), F.expr("filter(all, x -> x.part = cut)[0].had").alias("had"), *more)

    first = edge(cands, "a")
    both = edge(cands.join(small(first), "number").where("a = cut_a"), "b", "cut_a")
    close = cands.join(small(both), "number").where("a = cut_a AND b = cut_b")
    order = Window.partitionBy("number").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    close = close.withColumn("upto", F.col("had") + F.sum("size").over(order)).withColumn("fits", F.col("upto") <= F.col("lacks"))
    if_fits = lambda c: F.max(F.when(F.col("fits"), F.col(c)))
    now = close.groupBy("number").agg(if_fits("key").alias("last"), F.min("key").alias("first"), F.coalesce(if_fits("upto"), F.first("had")).alias("words"))
    out = state.join(now, "number", "left")
    cut = F.struct(F.col("lacks").alias("quota"), "last", "first")
    out = out.withColumn("cuts", F.when(F.col("words").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array(cut))))
    return written(out.withColumn("lacks", F.col("lacks") - F.coalesce("words", F.lit(0))).select("number", *STATE))


def taken(docs: DataFrame, keep: list[str], weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix", rounds: int = ROUNDS) -> DataFrame:
    """The columns `keep` of docs as a struct `kept`, and doc_id, size, source_size, target and copies of every document."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    random = (F.conv(F.substring(F.md5(F.concat(named, F.lit(":" + seed))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    names = {c: f"kept {k}" for k, c in enumerate(keep)}
    both = columns(docs.select("*", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), "doc_id", "text", "source", *names.values())
    sized = both.select(*[f"`{n}`" for n in names.values()], F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), random.alias("u"))
    sized = written(sized.withColumn("importance", F.length(F.bin("size")).cast("long")).withColumn("row", F.monotonically_increasing_id()))
    slim = sized.drop(*names.values())
    sources = written(targets(slim, weights, cap).withColumn("lacks", F.lit(0.0)).withColumn("cuts", F.array().cast(CUTS)))
    small = F.broadcast if sources.count() <= FEW_SOURCES else (lambda x: x)
    first = _rows(slim, sources, cap, small).groupBy("number").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"))
    state = written(sources.join(first, "number").withColumn("lacks", F.col("target") - F.col("sure")).select("number", *STATE))
    forget(sources)
    for _ in range(1 + rounds):
        before, state = state, _cut(slim, state, cap, small)
        forget(before)
    near = _rows(slim, state, cap, small).where(F.col("free") & (F.col("size") < 2 * F.col("lacks")))
    best = near.groupBy("number").agg(F.min(F.struct(F.abs(F.col("size") - F.col("lacks")), "key")).alias("best")).select("number", F.col("best.key.row").alias("best"))
    last = written(state.join(best, "number", "left").select("number", *STATE, "best"))
    forget(state)
    out = _rows(sized, last, cap, small)
    copies = (F.col("whole") + F.col("extra") + F.coalesce(F.col("row") == F.col("best"), F.lit(False)).cast("int")).cast("long")
    kept = F.struct(*[F.col(f"`{n}`").alias(c) for c, n in names.items()]) if keep else F.lit(None)
    return out.select(kept.alias("kept"), "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (size times copies) of every document."""
    rows = taken(docs, [], **how)
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix has them: a row that it takes k times comes k times. Rows count each for themselves, whatever their ids."""
    rows = taken(docs, docs.columns, **how).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of mix()'s rows for documents, with plain windows."""
    passes = []
    for k in range(1 + rounds):
        passes.append(f"""
    q{k} AS (SELECT source_no, any_value(target) - sum(size * (whole + extra)) AS quota FROM r{k} GROUP BY source_no),
    c{k} AS (SELECT i, sum(size) OVER (PARTITION BY source_no ORDER BY ord, u, doc_id, size, i ROWS UNBOUNDED PRECEDING) <= quota AS fits
        FROM r{k} JOIN q{k} USING (source_no) WHERE extra = 0 AND whole < 3 AND size > 0 AND size <= quota),
    r{k + 1} AS (SELECT r{k}.* EXCLUDE (extra), CASE WHEN c{k}.fits THEN 1 ELSE extra END AS extra FROM r{k} LEFT JOIN c{k} USING (i))""")
    k = 1 + rounds
    passes.append(f"""
    q{k} AS (SELECT source_no, any_value(target) - sum(size * (whole + extra)) AS quota FROM r{k} GROUP BY source_no),
    c{k} AS (SELECT i, row_number() OVER (PARTITION BY source_no ORDER BY abs(size - quota), ord, u, doc_id, size, i) AS place FROM r{k} JOIN q{k} USING (source_no) WHERE extra = 0 AND whole < 3 AND size > 0 AND size < 2 * quota),
    r{k + 1} AS (SELECT r{k}.* EXCLUDE (extra), CASE WHEN c{k}.place = 1 THEN 1 ELSE extra END AS extra FROM r{k} LEFT JOIN c{k} USING (i))""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, ''))) || ':mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * length(bin(size)))::BIGINT AS heft, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source),
    w AS (SELECT *, CASE source_no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, sum(source_size) OVER () AS total FROM s),
    f AS (SELECT *, 3 * source_size / weight AS brim FROM w),
    l AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY brim, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY brim, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM f),
    t AS (SELECT source, source_no, source_size, heft, least((SELECT max(lev) FROM l) * weight, 3.0 * source_size)::DOUBLE AS target FROM l),
    e AS (SELECT d.i, d.doc_id, d.size, d.u, t.source_no, t.source_size, t.target, least(3.0, CASE WHEN heft > 0 THEN target * length(bin(size)) / heft ELSE 0.0 END)::DOUBLE AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS p FROM e),
    o AS (SELECT *, (u / (1 - u)) / CASE WHEN p > 0 THEN p / (1 - p) END AS odds FROM p),
    r0 AS (SELECT i, doc_id, size, u, source_no, source_size, target, whole, CASE WHEN p > 0 THEN odds / (1 + odds) ELSE 1.0 END AS ord, 0 AS extra FROM o),
    {",".join(passes)}
    SELECT doc_id, size, source_size, target, CAST(whole + extra AS BIGINT) AS copies, CAST(size * (whole + extra) AS BIGINT) AS taken FROM r{2 + rounds}"""
