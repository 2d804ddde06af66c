"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import shared


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).collect()[0]
    return r["n"], r["x"]


def _stars(edges: DataFrame, least: Column) -> DataFrame:
    """u, v and the least of each u as m: added up in each task before it moves, so that the hub of a star is no hot key of the
    aggregate, and joined by key, where adaptive execution splits such a hub.
    """
    return edges.join(edges.groupBy("u").agg(least.alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of longs, any order and repeats, to (node, component): each node of an edge and the least node it connects to.

    Each round is written to the shared folder, so that lineage stays short; rounds are about the
    logarithm of the longest path. Nulls and loops are left out; no edges give no rows.
    """
    least, greatest = F.least("u", "v"), F.greatest("u", "v")
    current = shared.table(edges.where("u is not null and v is not null and u <> v").select(greatest.alias("u"), least.alias("v")).distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, F.least("u", F.min("v"))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _stars(large, F.min("v"))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        current = shared.table(small, "edges")
        last, state = state, _state(current)
        if last == state:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
