"""Consolidating pairwise matches into groups by randomised contraction.

Every round draws a fresh pseudo-random order of the vertices, lets each vertex hook to the
smallest vertex of its closed neighbourhood under that order, renames the edges to the hooked
representatives, drops loops and repeated edges, and goes on until no edge is left. The
expected number of vertices with edges falls by a constant factor a round, whatever the shape
of the graph, so long chains need no more rounds than stars. The per-round mappings are then
expanded from the last round back to the first.

The order is ``xxhash64(seed, id)``. With the seed fixed this hash is a bijection on 64-bit
integers (each of its steps can be undone), so the hash itself serves as the vertex's next
name: one ``min`` over longs, with map-side partial aggregation, finds every representative.

Hot vertices: neighbourhood minima are partially aggregated before the shuffle; the two
renaming joins are equi-joins that adaptive execution splits when a vertex is hot. Nothing is
collected to the driver but the number of edges left, and every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import trimmed
from ..storage import Scratch

#: Rounds shrink the vertices by a constant factor, so this is never reached by a graph that fits on disks.
MAX_ROUNDS = 200


def _mix(seed: int, c: Column) -> Column:
    return F.xxhash64(F.lit(seed), c)


def _name(seed: int, c: Column) -> Column:
    """The 64-bit name of a vertex known by a string."""
    return F.xxhash64(F.lit(seed), c)


def contract(edges: DataFrame, scratch: Scratch, seed: int = 1) -> DataFrame | None:
    """(v, round, label) for all vertices of ``edges`` (a long, b long; no loops).

    Two vertices are linked exactly when round and label are equal. Labels of one round are images
    of distinct vertices under one bijection; those of different rounds may be equal by chance and
    are told apart by the round. None when there is no edge. ``edges`` is read twice, so it should
    be a written table.
    """
    maps: list[DataFrame] = []
    for r in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        ha, hb = _mix(seed + r, F.col("a")), _mix(seed + r, F.col("b"))
        near = edges.select(F.explode(F.array(
            F.struct(F.col("a").alias("v"), F.least(ha, hb).alias("h")),
            F.struct(F.col("b").alias("v"), F.least(ha, hb).alias("h")),
        )).alias("e")).select("e.v", "e.h")
        # v's own hash takes part in every pair, so min(h) is over the closed neighbourhood
        hook = scratch.cut(near.groupBy("v").agg(F.min("h").alias("rep")), f"map{r}")
        maps.append(hook)
        left = edges.join(hook.select(F.col("v").alias("a"), F.col("rep").alias("ra")), "a")
        both = left.join(hook.select(F.col("v").alias("b"), F.col("rep").alias("rb")), "b")
        renamed = both.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = scratch.cut(renamed, f"edges{r}")
        if r:
            scratch.drop(f"edges{r - 1}")
    else:
        raise RuntimeError(f"{MAX_ROUNDS} rounds of contraction left edges")
    if not maps:
        return None
    labels = maps[-1].select("v", F.lit(len(maps) - 1).alias("round"), F.col("rep").alias("label"))
    for r in reversed(range(len(maps) - 1)):
        later = labels.select(F.col("v").alias("rep"), "round", "label")
        labels = maps[r].join(later, "rep", "left").select("v", F.coalesce("round", F.lit(r)).alias("round"), F.coalesce("label", "rep").alias("label"))
    return labels


def _numbered(pairs: DataFrame, ids: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges with running numbers for names: always distinct, at the price of two joins on the ids."""
    vertices = scratch.cut(ids.select(F.monotonically_increasing_id().alias("v"), "name"), "numbers")
    left = vertices.select(F.col("name").alias("x"), F.col("v").alias("vx"))
    right = vertices.select(F.col("name").alias("y"), F.col("v").alias("vy"))
    met = pairs.join(left, "x").join(right, "y")
    return vertices, met.select(F.least("vx", "vy").alias("a"), F.greatest("vx", "vy").alias("b")).distinct()


def group_ids(links: DataFrame, a: str, b: str, seed: int = 1) -> DataFrame:
    """(fragment_id, group_id): each distinct id in ``a`` or ``b`` with the smallest id of its group.

    Outer white space is no part of an id. A row with two ids links them; a row with one null
    (or blank) id links nothing but still names a vertex; a row without ids names none. Links
    in both directions, repeated links and links of an id with itself change nothing. Ids
    compare by code point. An empty table gives no rows. Other columns, whatever their names,
    are not read.

    Vertices are named by a 64-bit hash of their id, which saves the joins of edges with a table of
    numbers. Names are checked, never trusted: where two ids share one, as some will among 1e10,
    all ids are numbered instead.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "groups")
    pairs = links.select(trimmed(F.col(a).cast("string")).alias("x"), trimmed(F.col(b).cast("string")).alias("y"))
    ids = pairs.select(F.explode(F.array("x", "y")).alias("name")).where("name is not null")
    # distinct over (name, hash) and counts over longs are hash aggregations; min and max of strings would sort
    vertices = scratch.cut(ids.select(_name(seed, F.col("name")).alias("v"), "name").distinct(), "vertices")
    linked = pairs.where("x is not null and y is not null and x <> y")
    if vertices.groupBy("v").count().where("count > 1").isEmpty():
        hx, hy = _name(seed, F.col("x")), _name(seed, F.col("y"))
        drawn = linked.select(F.least(hx, hy).alias("a"), F.greatest(hx, hy).alias("b")).distinct()
    else:
        vertices, drawn = _numbered(linked, vertices.select("name"), scratch)
    labels = contract(scratch.cut(drawn, "edges"), scratch, seed)
    if labels is None:
        return vertices.select(F.col("name").alias("fragment_id"), F.col("name").alias("group_id"))
    tagged = scratch.cut(vertices.join(labels, "v", "left").select("name", "round", "label"), "tagged")
    least = tagged.where("label is not null").groupBy("round", "label").agg(F.min("name").alias("group_id"))
    grouped = tagged.where("label is not null").join(least, ["round", "label"]).select(F.col("name").alias("fragment_id"), "group_id")
    lone = tagged.where("label is null").select(F.col("name").alias("fragment_id"), F.col("name").alias("group_id"))
    return grouped.unionByName(lone)
