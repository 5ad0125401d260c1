"""Packing token sequences by exact-complement hashing, then best fit.

The plan works on the counts per length, at most ``size`` numbers whatever the corpus is. Starting from
the longest length with pieces left, the gap is looked up in an index of single lengths, then of sums of
two and of three lengths; a combination that fills it exactly is consumed as often as its lengths are
available. Where none fills it, the longest length that fits goes in (best fit), and the search repeats
with the smaller gap. Every step uses up a length, or closes a sequence, so the plan has few patterns.

Pieces get their place without a global sort: a task numbers its pieces of a length while it writes them,
and the counts per (task, length) give each task its first number. A hot length (a third of all documents
empty, say) is therefore never gathered. The plan is shared with the tasks as arrays of runs: a few patterns for
each length, of at most 90 runs each at 4096 tokens, so 29 MB at most and far less in practice.

Null texts count as empty and hold the end id alone. Repeated rows are packed as often as they occur,
and null ids are kept. A text of any length is encoded by one task and cut into pieces. An empty table gives an
empty result. Only id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, slices, stage, trimmed
from .tokens import CHARACTERS, encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens; ``nth`` numbers the pieces of a length within a task."""

    def run(batches):
        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in trimmed(batches):
            for part in slices(batch, "text", CHARACTERS):
                ids, at = enc.flat(part.column("text"))
                raw = memoryview(np.insert(ids, at[1:], end_id)).cast("B")
                at = at + np.arange(len(at))
                rows = []
                for key, begin, close in zip(part.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for k, b in enumerate(range(begin, close, size)):
                        n = min(size, close - b)
                        rows.append((key, k, b - begin, n, zlib.crc32(raw[4 * b : 4 * (b + n)]), task, seen[n]))
                        seen[n] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES_DDL)


class _Sums:
    """Indexes of the lengths, and of their sums in pairs and in threes, that fill a gap exactly.

    The pairs of lengths that exist are listed by sum, the one with the longer part first; a sum of three is
    a length and a pair of the rest. Availability never grows, so each sum has a mark that only moves on: before it,
    nothing is left to use. A lookup costs what the marks move, and all lookups together what the indexes hold.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        some = np.flatnonzero(left > 0).astype(np.int32)
        self._lengths = some[::-1].tolist()
        size = len(left) - 1
        sums, longer = [], []
        for i, a in enumerate(some):
            b = some[: i + 1][: np.searchsorted(some[: i + 1], size - a, "right")]  # at most size * size / 4 pairs
            sums.append((a + b).astype(np.int16 if size < 1 << 15 else np.int32))
            longer.append(np.full(len(b), a, sums[-1].dtype))
        sums, longer = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (sums, longer))
        order = np.argsort(sums, kind="stable")
        self._longer = longer[order]
        edge = np.searchsorted(sums[order], np.arange(size + 2))
        self._first, self._last = edge[:-1].tolist(), edge[1:].tolist()  # the longest is last
        self._pair, self._triple = list(self._last), [0] * (size + 1)

    def pair(self, gap: int, used: int = 0) -> tuple[int, int] | None:
        """Two lengths that are left when one of length ``used`` is taken besides."""
        left, longer = self.left, self._longer
        at, marked = self._pair[gap], True
        while at > self._first[gap]:
            a = int(longer[at - 1])
            b = gap - a
            if left[a] > (a == b) and left[b] > 0:
                if left[a] > (a == b) + (a == used) and left[b] > (b == used) + (a == b and a == used):
                    return a, b
                marked = False  # only the length in use is in the way
            at -= 1
            if marked:
                self._pair[gap] = at
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap] > 0:
            return (gap,)
        if two := self.pair(gap):
            return two
        at = self._triple[gap]
        while at < len(self._lengths) and 3 * self._lengths[at] >= gap:
            a = self._lengths[at]
            if a < gap and self.left[a] > 0 and (two := self.pair(gap - a, a)):
                return a, *two
            at += 1
            self._triple[gap] = at
        return None


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each. counts[n]: pieces of length n."""
    left, out = counts.astype(np.int64).copy(), []
    sums = _Sums(left)
    for longest in range(size, 0, -1):
        while left[longest] > 0:
            pattern, gap = [longest], size - longest
            left[longest] -= 1
            while gap:
                found = sums.fill(gap)
                if found is None:
                    fits = np.flatnonzero(left[1 : gap + 1] > 0)
                    if not len(fits):
                        break
                    found = (int(fits[-1]) + 1,)
                for x in found:
                    left[x] -= 1
                pattern += found
                gap -= sum(found)
            more = min((int(left[x]) // pattern.count(x) for x in set(pattern)), default=0)
            for x in pattern:
                left[x] -= more
            out.append((tuple(pattern), 1 + more))
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, ...]:
    """For each length in turn, runs of piece numbers: first number, sequences of the pattern, first sequence, first offset.

    Equal lengths of a pattern lie side by side and are one run: its numbers go through all sequences at the first place, then
    at the next. A pattern has at most about ``sqrt(2 * size)`` runs, since its different lengths add up to ``size`` at most.
    """
    lengths, firsts, widths, sequences, offsets, used, sequence = [], [], [], [], [], np.zeros(size + 1, np.int64), 0
    for pattern, n in patterns:
        at = 0
        for x, times in Counter(pattern).items():
            lengths.append(x)
            firsts.append(used[x])
            widths.append(n)
            sequences.append(sequence)
            offsets.append(at)
            used[x] += n * times
            at += x * times
        sequence += n
    order = np.lexsort((firsts, lengths)) if lengths else np.zeros(0, np.int64)
    return tuple(np.array(x, np.int64)[order] for x in (lengths, firsts, widths, sequences, offsets))


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces."""
    spark = pieces.sparkSession
    shares = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stage(shares.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for x in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[x["length"]] = x["n"]
    shared = spark.sparkContext.broadcast(_slots(plan(counts, size), size))

    def place(batches):
        lengths, starts, widths, sequences, offsets = shared.value
        begin = np.searchsorted(lengths, np.arange(size + 2))
        for batch in batches:
            length, nth = (batch.column(x).to_numpy() for x in ("length", "number"))
            run = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                run[own] = begin[x] + np.searchsorted(starts[begin[x] : begin[x + 1]], nth[own], "right") - 1
            columns = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            slot, turn = np.divmod(nth - starts[run], widths[run])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[run] + turn), pa.array(offsets[run] + slot * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # The counts grow with the tasks, so they are never broadcast.
    numbered = pieces.join(firsts.select("task", "length", "before").hint("merge"), ["task", "length"]).withColumn("number", F.col("nth") + F.col("before"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    return pack(stage(cut(docs, tokenizer, end_id, size), "pieces"), size)
