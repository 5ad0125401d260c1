"""Connected components by alternating large and small stars, as joins and aggregations on edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, stage

#: Edges that one task contracts at once, when no more are left.
AT_ONCE = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes of the edges ``(a, b)``; the root is the smallest node of the component.

    Rounds go on until the edges no longer change, whatever the diameter, or until at most ``AT_ONCE`` are left for
    a single task to contract. A round is two aggregations and two joins over the edges, written to the shared folder. The aggregates are staged before they are joined: both
    sides of a join then come from shuffles of their own, and the edges of a node with very many of them
    are a skewed partition that adaptive execution can split. Self edges and repeated edges are allowed.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = _mark(e)
    while seen[0] > AT_ONCE:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star-roots")
        large = stage(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "small-star-roots")
        joined = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stage(least.select("u", F.col("m").alias("v")).unionAll(joined).distinct(), "small-star")
        discard(e, near, large, least)
        e, now = small, _mark(small)
        if now == seen:
            break
        seen = now
    else:
        kind = e.schema["u"].dataType.simpleString()
        return stage(e.coalesce(1).mapInArrow(_contract, f"node {kind}, root {kind}"), "roots")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame):
    """Number of the edges and sum of their hashes."""
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _contract(batches):
    """Components of all edges given, in arrays: every node takes the smallest name that its neighbours have, until none changes."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array(table.column("u").chunks + table.column("v").chunks)
    order = ends.unique().sort()
    code = pc.index_in(ends, value_set=order).to_numpy().astype(np.int64)
    a, b = code[: len(table)], code[len(table) :]
    name = np.arange(len(order))
    while True:
        x, y = name[a], name[b]
        if (x == y).all():
            break
        least = np.minimum(x, y)
        np.minimum.at(name, x, least)
        np.minimum.at(name, y, least)
        while (name != name[name]).any():
            name = name[name]
    for i in range(0, len(order), 100_000):
        yield pa.RecordBatch.from_arrays([order[i : i + 100_000], order.take(pa.array(name[i : i + 100_000]))], names=["node", "root"])
