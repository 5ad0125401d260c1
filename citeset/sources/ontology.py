"""Ontology terms in OBO files, and their level (shortest way to a root) and depth (longest)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(terms, edges)``: a stanza per record through the line separator; edges lead from child to parent."""
    stanzas = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").rlike(r"^\[?Term\]"))
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^{name}: (.*?)\s*$", 1), F.lit(""))
    terms = stanzas.select(
        tag("id").alias("go_id"),
        tag("name").alias("name"),
        F.nullif(F.regexp_extract("value", r'(?m)^def: "((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("definition"),
        tag("namespace").alias("namespace"),
        F.coalesce(tag("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"),
        F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)).alias("parents"),
    ).where("go_id IS NOT NULL")
    return terms.drop("parents"), terms.select(F.col("go_id").alias("child"), F.explode("parents").alias("parent"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, level, depth`` for ``nodes(node)`` and ``edges(child, parent)``.

    Takes off the nodes all of whose parents are gone, round by round: a node's round is its depth, and its level is one more
    than its parents' least. Every edge is followed once, however many paths there are; a round per depth is written
    to the shared folder. Edges to or from other nodes don't count. Where nodes are left that wait for one another, the graph
    has a cycle and ``ValueError`` is raised, however deep it is.
    """
    names = nodes.select("node").distinct()
    both = edges.select("child", "parent").distinct().join(names.withColumnRenamed("node", "parent"), "parent", "left_semi").join(names.withColumnRenamed("node", "child"), "child", "left_semi")
    down = stage(both, "dag-edges")
    waits = down.groupBy("child").agg(F.count("*").alias("waits")).withColumnRenamed("child", "node")
    state = stage(names.join(waits, "node", "left").select("node", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(None).cast("int").alias("level")), "dag-nodes")
    found, depth = [], 0
    while True:
        front = state.where("waits = 0").select("node", F.coalesce("level", F.lit(0)).alias("level"), F.lit(depth).alias("depth"))
        left = state.where("waits > 0")
        found.append(front)
        if left.isEmpty():
            return reduce(DataFrame.unionAll, found)
        if front.isEmpty():
            raise ValueError("the graph has a cycle")
        gone = down.join(front, down["parent"] == front["node"]).groupBy("child").agg(F.count("*").alias("gone"), (F.min("level") + 1).alias("via"))
        met = left.join(gone.withColumnRenamed("child", "node"), "node", "left")
        state = stage(met.select("node", (F.col("waits") - F.coalesce("gone", F.lit(0))).alias("waits"), F.least("level", "via").alias("level")), "dag-nodes")
        depth += 1


def terms_up_to(terms: DataFrame, edges: DataFrame, max_level: int, metric: str = "level", namespace: str | None = None, include_obsolete: bool = False) -> DataFrame:
    """Terms whose level (or depth) is at most ``max_level``, ordered by namespace, metric and id."""
    if max_level < 0:
        raise ValueError("max_level must not be negative")
    if metric not in ("level", "depth"):
        raise ValueError("metric must be level or depth")
    known = terms if include_obsolete else terms.where(~F.col("is_obsolete"))
    placed = known.join(levels(known.select(F.col("go_id").alias("node")), edges).withColumnRenamed("node", "go_id"), "go_id")
    if namespace is not None:
        placed = placed.where(F.col("namespace") == namespace)
    return placed.where(F.col(metric) <= max_level).select("go_id", "name", "definition", "namespace", "level", "depth", "is_obsolete").orderBy("namespace", metric, "go_id")
