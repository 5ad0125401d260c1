"""Token-id output in directly addressable codes (see ``dac``).

Documents are range-partitioned by id, so that the files in order of (shard, part) hold the ids of
all documents in ascending order. A task starts a new file every ``FILE_TOKENS`` tokens, so its memory
doesn't grow with its share of the input. Only a manifest of one row per file is summed in order.

Null texts count as empty: they hold the end id alone. Rows with a null id come first; repeated ids
stay separate documents, in order of their texts' hash. A text of any length is encoded by one task and lies in one
file. An empty table gives no files. Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dac
from .common import lean, new_path, partitions, slices, stage, trimmed, write_file
from .tokens import CHARACTERS, encoder

FILE_TOKENS = 4_000_000
READ_TOKENS = 500_000
MANIFEST = "shard int, part int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the files; returns the staged manifest with each file's first token position."""

    def write(batches):
        shard, part, keys, lengths, held = TaskContext.get().partitionId(), 0, [], [], []

        def flush():
            path = f"{folder}/{shard:06d}-{part:06d}.dac"
            sizes, tokens = np.concatenate(lengths), np.concatenate(held)
            write_file(path, dac.encode(keys, sizes, tokens))
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": path, "n_docs": len(keys), "n_tokens": len(tokens)}], schema=SCHEMA)

        enc = encoder(tokenizer)
        for batch in trimmed(batches):
            for piece in slices(batch, "text", CHARACTERS):
                ids, at = enc.flat(piece.column("text"))
                held.append(np.insert(ids, at[1:], end_id))
                lengths.append(np.diff(at) + 1)
                keys += piece.column("id").to_pylist()
                if sum(map(len, held)) >= FILE_TOKENS:
                    yield flush()
                    part, keys, lengths, held = part + 1, [], [], []
        if keys:
            yield flush()

    SCHEMA = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    files = stage(ordered.mapInArrow(write, MANIFEST), "token-files")
    return files.withColumn("first", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``; neighbouring documents are decoded together."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = dac.Reader(row["path"])
                ids, offsets = reader.documents()
                i = 0
                while i < len(ids):  # as many documents at a time as READ_TOKENS allow, one at least
                    e = max(i + 1, int(np.searchsorted(offsets, offsets[i] + READ_TOKENS, "right")) - 1)
                    at = offsets[i : e + 1]
                    raw = memoryview(reader.slice(int(at[0]), int(at[-1])).astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[a:b]) for a, b in itertools.pairwise((4 * (at - at[0])).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:e], pa.int64()), pa.array(row["first"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=schema)
                    i = e
                reader.close()

    n = partitions(manifest.sparkSession)
    return manifest.repartitionByRange(n, "shard", "part").select("path", "first").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer, end_id, new_path(docs.sparkSession, "tokens")))
