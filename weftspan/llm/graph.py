"""Connected components of a graph of links, by alternating star operations on DataFrames.

Neither links nor components leave the executors. Each step takes the least neighbour of every
node (summed up before any shuffle) into a written table, so that the join that follows has
plain exchanges on both sides and a node with very many links is split among tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every id with the least one it is connected with, of links between x and y."""
    ids, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = back[: len(x)], back[len(x) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """edges (hi, lo), hi > lo. Large: a node's greater neighbours join its least one. Small: its lesser ones and itself do."""
    there = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    both = there.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))) if large else there
    least = written(both.groupBy("u").agg(F.min("v").alias("m")))
    if large:
        joined = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
    else:
        joined = there.join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        joined = joined.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    out = written(joined.where("hi <> lo").distinct())
    forget(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every node of links (a, b: long, in any order, with repeats).

    Links with a null end or to a node itself count for nothing. Tables of earlier rounds are deleted.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.where("a <> b").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        large = _step(edges, True)
        forget(edges)
        edges = _step(large, False)
        forget(large)
    roots = edges.select(F.col("lo").alias("id")).distinct()
    out = edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
    out.table_path = edges.table_path  # what forget() deletes once the components have been read
    return out
