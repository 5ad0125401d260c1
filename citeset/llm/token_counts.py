"""Token counts from a digest cache.

The cache is a table ``(text_digest, tokenizer_digest, n_tokens)``. Texts are reduced to the digest of
their normalised content, joined to the stored counts of the tokenizer's own digest, and only one text
of each missing digest is encoded; its count is appended to the cache. Normalisation here is the UTF-8
form with null as empty, since the tokenizer's count depends on every byte.

Null texts count as empty (0 bytes, 0 tokens). Null or repeated ids and repeated rows each keep their
row. A text may have any length: it is encoded as a whole by one task. Empty tables give an empty result. Only the
id and text columns are read, so other columns may have any names. A digest that a third of the rows share is
one row after the partial aggregation; the other sides of joins are staged first, so that its rows are a skewed
partition that adaptive execution can split.

The cache has a folder for each tokenizer's digest. A run that is repeated may append a digest twice; equal
digests have equal counts, and readers take one.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, slices, stage, trimmed
from .tokens import CHARACTERS, encoder

CACHE = "text_digest binary, n_tokens long, tokenizer_digest string"


def tokenizer_digest(path: str) -> str:
    import tokenizers

    return hashlib.sha256(Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()


def _count(tokenizer: str):
    def run(batches):
        enc = encoder(tokenizer)
        for batch in trimmed(batches):
            for piece in slices(batch, "text", CHARACTERS):
                yield pa.RecordBatch.from_arrays([piece.column("text_digest"), pa.array(enc.counts(piece.column("text")), pa.int64())], names=["text_digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int, cache: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts per row, and the rows to append to the cache.

    The counts have ``doc_id, n_bytes, n_tokens, over_limit, text_digest``.
    """
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("text_digest", F.unhex(F.sha2("text", 256)))
    keys = stage(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text_digest"), "count-keys")
    # One row of each digest stands for it: one (digest, id) per distinct text.
    first = keys.groupBy("text_digest").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-1))).alias("doc_id"))
    stored = None
    if cache is not None:
        stored = stage(cache.where(F.col("tokenizer_digest") == version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens")), "count-stored")
        first = first.join(stored, "text_digest", "left_anti")
    first = bounded(stage(first, "count-misses"))
    ask = rows.alias("r").join(first.alias("f"), (F.col("r.text_digest") == F.col("f.text_digest")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), "left_semi")
    fresh = ask.select("text_digest", "text").mapInArrow(_count(tokenizer), "text_digest binary, n_tokens long")
    # Rows that repeat both id and text are encoded once each.
    fresh = stage(stage(fresh, "count-encoded").groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens")), "count-fresh")
    known = fresh if stored is None else stage(fresh.unionByName(stored), "count-known")
    counts = keys.join(known, "text_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("text_digest").alias("text_digest"))
    return counts, fresh.select("text_digest", "n_tokens", F.lit(version).alias("tokenizer_digest"))


def stored_counts(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache at a path; empty where nothing was appended yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.read.schema(CACHE).parquet(cache_path)


def append(cache_path: str, rows: DataFrame) -> None:
    rows.write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
