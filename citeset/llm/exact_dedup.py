"""Exact duplicates by progressive refinement.

Rows are grouped by the length of their normalised text, groups of several by the hash of its first
``prefix`` characters, and only rows of groups that still have several members are hashed in full. One row of each
group of equal texts stays: the one with the most code points in the original text, then the smallest id.

Texts are read twice and never shuffled: lengths and hashes are. The groups that survive the first two steps
reach the second reading as a bitmap of fixed size (``SLOTS`` bits). A row whose slot another group
set is hashed in vain and found alone.

Null texts count as empty, so all null, empty and blank texts are one group. A null id sorts before any
other. Repeated rows (same id and text) are members like any other; one of them stays, and ``kept`` is
true for that one only. A text may have any length: it is hashed as a whole by one task. Empty tables give an
empty result. Only id and text are read, so other columns may have any names. A group holding a third of all
rows is one row after partial aggregation; the groups are staged before they are joined back, so that the
rows of a large group are a skewed partition that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, lean, slices, stage

#: White space that normalisation deletes (fixed by the contract).
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
PREFIX = 256
#: Bits of the map of surviving groups: a power of two, a multiple of 32768.
SLOTS = 1 << 24


def _normal(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANKS)


def _slot(length: int, head: int) -> int:
    return (length * 0x9E3779B1 ^ head * 0x85EBCA6B) >> 3 & SLOTS - 1


def _keys(prefix: int):
    """Length of the normal form and hash of its beginning, with their slot; nothing behind that is hashed."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(len(x), zlib.crc32(x[:prefix])) for x in map(_normal, part.column("text").to_pylist())]
                columns = [[x[0] for x in found], [x[1] for x in found], [_slot(*x) for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["n_bytes", "head", "slot"])

    return lean(run)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """The bits of the slots; at most ``SLOTS / 32768`` rows of 4 KiB come to the driver."""
    bits = np.zeros(SLOTS // 8, np.uint8)
    for x in slots.groupBy(F.shiftright("slot", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits")).collect():
        bits[x["block"] * 4096 : (x["block"] + 1) * 4096] = np.frombuffer(x["bits"], np.uint8)
    return bits


def _hash(prefix: int, every: bool, shared):
    """Full hash of the rows of surviving groups, or of every row if the caller reports digests."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                full = []
                for x in map(_normal, part.column("text").to_pylist()):
                    slot = 0 if every else _slot(len(x), zlib.crc32(x[:prefix]))
                    full.append(hashlib.sha256(x).hexdigest() if every or bits[slot >> 3] >> (slot & 7) & 1 else None)
                yield pa.RecordBatch.from_arrays([*map(part.column, ("doc_id", "n_points")), pa.array(full, pa.string())], names=["doc_id", "n_points", "text_sha256"])

    return lean(run)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256`` (the digest of rows that are alone only with ``digest_all``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_points", F.length("text"))
    keys = stage(rows.select("text").mapInArrow(_keys(prefix), "n_bytes long, head long, slot long"), "dedup-keys")
    several = F.count("*").alias("n")
    lengths = bounded(stage(keys.groupBy("n_bytes").agg(several).where("n > 1").select("n_bytes"), "dedup-lengths"))
    heads = keys.join(lengths, "n_bytes", "left_semi").groupBy("n_bytes", "head", "slot").agg(several).where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(heads))  # SLOTS bits
    full = rows.mapInArrow(_hash(prefix, digest_all, shared), f"doc_id {kind}, n_points int, text_sha256 string")
    hashed = stage(full.withColumn("row", F.monotonically_increasing_id()), "dedup-hashes")
    discard(keys)
    best = F.min(F.struct((-F.col("n_points")).alias("p"), "doc_id", "row"))
    groups = hashed.where("text_sha256 IS NOT NULL").groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1")
    groups = bounded(stage(groups, "dedup-groups"))
    alone = hashed.where("text_sha256 IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    found = hashed.where("text_sha256 IS NOT NULL").join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    return found.unionByName(alone)
