"""Repeated byte strings of ``length`` bytes, by suffix sorting around shared anchors.

A position is an anchor if the hash of the ``K`` bytes there is the least in some window of ``length``
bytes: equal strings of that length have equal anchors at equal places, so two of them meet in the
group of an anchor's hash. Anchors are a few hundredths of all positions.

1. Anchors of all documents; groups whose hash occurs once are done.
2. Around each surviving anchor, the context a string of that length can reach: up to ``length - K``
   bytes to either side. Equal contexts are merged, with a count, before they meet.
3. Per group, the contexts to the right and the reversed ones to the left are suffix-sorted (deep-shallow,
   see ``suffixes``). For each share of a string to the right of its anchor, the common prefixes of both
   orders give the classes of equal strings; a class of two or more is a repeat.
4. The covered stretches are brought back to the documents, merged and cut out.

A group of over ``LARGEST`` different contexts is split by the next bytes and its parts are sorted. A group stands for the
strings that have between ``low`` and ``high`` bytes to the right, 0 to ``length - K`` at first: they share
``low`` bytes to the right and all but ``high`` of the rest to the left. Its halves are dealt by the further bytes that
each shares, and so on, until a part is small or stands for one share: then all its contexts hold one string.

Documents with equal texts are one class throughout: a class of several rows of at least ``length`` bytes
is removed whole, and takes part once in the search. Texts are equal by the first 128 bits of their SHA-256;
anchors by two hashes of 64 bits, their contexts by a third.

Null and empty texts have 0 bytes and no spans, as any text shorter than ``length``. Null and repeated ids
each keep their row; repeated rows are copies and lose everything if long enough. An empty table gives an
empty result. Only id and text are read, so other columns may have any names. A text may have any length: it is held by
one task and hashed in overlapping blocks. What joins a frequent key is staged first, so that adaptive execution
can split its rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, lean, partitions, slices, stage
from .suffixes import deep_shallow

LENGTH, K = 200, 64
BLOCK = 1 << 20
LARGEST = 50_000
#: Contexts sorted at once, in whole groups.
BATCH = 60_000

#: What names a context (two hashes of its anchor, one of the rest), and a group of contexts.
NAME, GROUP = ("hash", "anchor", "digest"), ("hash", "anchor", "part")

_BASE = 0x9E3779B97F4A7C15
_powers: dict[bool, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    if inverse not in _powers or len(_powers[inverse]) < n:
        x = np.full(max(n, 1 << 16), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        x[0] = 1
        _powers[inverse] = np.multiply.accumulate(x)
    return _powers[inverse][:n]


def _hashes(t: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the K bytes from each position."""
    code = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(29)
    code *= _power(len(t), False)
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(code, out=total[1:])
    h = (total[K:] - total[:-K]) * _power(len(t) - K + 1, True)
    for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h ^= h >> np.uint64(32)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, and their hashes."""
    places, hashes, w = [], [], length - K + 1
    edge = np.zeros(w - 1, np.uint64)
    for begin in range(0, max(1, len(raw) - length + 1), BLOCK):
        low = max(0, begin - length)
        t = np.frombuffer(raw[low : begin + BLOCK + 2 * length], np.uint8)
        if len(t) < length:
            continue
        h = _hashes(t)
        least = _sliding(h, w, np.minimum)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h)
        last = begin + BLOCK if begin + BLOCK < len(raw) - length + 1 else len(raw)
        chosen = chosen[(chosen + low >= begin) & (chosen + low < last)]
        places.append(chosen + low)
        hashes.append(h[chosen])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _find(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [anchors((x or "").encode(), length) for x in part.column("text").to_pylist()]
                n = np.array([len(p) for p, _ in found])
                keys = part.column("key").take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for _, h in found]).view(np.int64)), keys, pa.array(np.concatenate([p for p, _ in found]).astype(np.int64))], names=["hash", "key", "pos"])

    return lean(run)


def _contexts(length: int, content: bool):
    """Per anchor: its two hashes, digest of its context, and either the context or the anchor's place."""
    reach = length - K

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, merged = [], {}
                for key, text, found in zip(*(part.column(c).to_pylist() for c in ("key", "text", "found")), strict=True):
                    raw = text.encode()
                    for x in found:
                        h, p = x["hash"], x["pos"]
                        left, right = raw[max(0, p - reach) : p], raw[p + K : p + length]
                        digest = xxhash.xxh3_64_intdigest(left + bytes([len(left)]) + right) - (1 << 63)
                        name = h, xxhash.xxh3_64_intdigest(raw[p : p + K]) - (1 << 63), digest
                        if not content:
                            rows.append((*name, key, p))
                        elif (old := merged.get(name)) is None:
                            merged[name] = [1, left, right]
                        else:
                            old[0] += 1
                rows += [(*k, *v) for k, v in merged.items()]
                if rows:
                    types = [pa.int64()] * 3 + ([pa.int64(), pa.binary(), pa.binary()] if content else [pa.binary(), pa.int64()])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*NAME, *(("n", "left", "right") if content else ("key", "pos"))])

    return lean(run)


def repeats(group: np.ndarray, left: list[bytes], right: list[bytes], reach: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For different contexts in groups: how far strings that repeat reach to the left and right of the anchor's K bytes; -1: none.

    A group looks for strings of ``low`` to ``high`` bytes to the right.
    """
    n = len(left)
    where, common = [], []
    for side in ([x[::-1] for x in left], right):
        order, lcp = deep_shallow(side, group)
        where.append(order)
        common.append(lcp)
    far_left, far_right = np.full(n, -1), np.full(n, -1)
    for s in range(reach + 1):  # s bytes to the right, reach - s to the left
        ids = []
        for order, lcp, depth in zip(where, common, (reach - s, s), strict=True):
            x = np.empty(n, np.int64)
            x[order] = np.cumsum(lcp < depth)
            ids.append(x)
        both = ids[0] * (n + 1) + ids[1]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        hit = np.zeros(n, bool)
        hit[by[1:][same]] = hit[by[:-1][same]] = True
        if low is not None:
            hit &= (low <= s) & (s <= high)
        far_left[hit] = np.maximum(far_left[hit], reach - s)
        far_right[hit] = s
    return far_left, far_right


def _cover(length: int):
    """Rows sorted by group; gives per context that holds a repeat its name and its reach to the left and right."""
    reach = length - K

    def emit(rows):
        groups = [r[:4] for r in rows]
        group = np.cumsum([0, *(a != b for a, b in itertools.pairwise(groups))])
        left, right, count = [r[6] for r in rows], [r[7] for r in rows], np.array([r[5] for r in rows])
        low, high = (np.array([r[i] for r in rows]) for i in (8, 9))
        size = np.bincount(group)
        far_left, far_right = np.full(len(rows), -1), np.full(len(rows), -1)
        some = np.flatnonzero(size[group] > 1)
        if len(some):
            far_left[some], far_right[some] = repeats(np.unique(group[some], return_inverse=True)[1], [left[i] for i in some], [right[i] for i in some], reach, low[some], high[some])
        whole = count > 1
        far_left[whole] = [len(left[i]) for i in np.flatnonzero(whole)]
        far_right[whole] = [len(right[i]) for i in np.flatnonzero(whole)]
        keep = np.flatnonzero(far_left >= 0)
        names = [pa.array([rows[i][j] for i in keep], pa.int64()) for j in (0, 1, 4)]
        return pa.RecordBatch.from_arrays([*names, pa.array(far_left[keep]), pa.array(far_right[keep])], names=[*NAME, "l", "r"])

    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in (*GROUP, "low", "digest", "n", "left", "right", "low", "high")), strict=True)
            if len(rows) > BATCH:
                cut = len(rows)  # the last group may go on
                while cut and rows[cut - 1][:4] == rows[-1][:4]:
                    cut -= 1
                if cut:
                    yield emit(rows[:cut])
                    rows = rows[cut:]
        if rows:
            yield emit(rows)

    return lean(run)


def split_groups(contexts: DataFrame, reach: int) -> tuple[DataFrame, DataFrame | None]:
    """``(parts, alike)``: contexts in groups of at most ``LARGEST``, and those of larger groups whose contexts all hold one string."""
    names, small, alike = list(GROUP), None, None
    todo = contexts.withColumns({"part": F.lit(""), "low": F.lit(0), "high": F.lit(reach)})
    while True:
        large = stage(todo.groupBy(*names).agg(F.count("*").alias("m")).where(F.col("m") > LARGEST).select(*names), "large-groups")
        if large.isEmpty():
            return (todo if small is None else small.unionByName(todo)), alike
        large = bounded(large)
        rest = todo.join(large, names, "left_anti")
        small = rest if small is None else small.unionByName(rest)
        big = todo.join(large, names, "left_semi")
        one = big.where("low = high")
        alike = one if alike is None else alike.unionByName(one)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = [big.where("low < high").withColumns({"low": a, "high": b}) for a, b in ((F.col("low"), middle), (middle + 1, F.col("high")))]
        behind = F.lit(reach) - F.col("high")
        held = halves[0].unionByName(halves[1]).where((F.octet_length("right") >= F.col("low")) & (F.octet_length("left") >= behind))
        shared = F.concat(F.encode(F.concat_ws(":", "low", "high", F.lit("")), "UTF-8"), F.substring(F.col("right"), F.lit(1), F.col("low")), F.substring(F.col("left"), F.octet_length("left") - behind + 1, behind))
        todo = stage(held.withColumn("part", F.sha2(shared, 256)), "group-parts")


def _cut(batches):
    """Merge the stretches of each text and take them out."""
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for key, text, spans in zip(*(part.column(c).to_pylist() for c in ("key", "text", "spans")), strict=True):
                raw, kept, end, count, removed = text.encode(), hashlib.sha256(), 0, 0, 0
                for x in sorted((x["begin"], x["end"]) for x in spans):
                    if count == 0 or x[0] > end:
                        kept.update(raw[end : x[0]])
                        count, end, removed = count + 1, x[1], removed + x[1] - x[0]
                    elif x[1] > end:
                        removed, end = removed + x[1] - end, x[1]
                kept.update(raw[end:])
                out.append((key, removed, count, kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["key", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, spans, texts)``: per row ``doc_id, key, n_bytes, sha``; per class of texts its covered stretches; one text per class with stretches."""
    if length - K > 255 or length <= K:
        raise ValueError(f"length must be {K + 1} to {K + 255}")
    spark, reach = docs.sparkSession, length - K
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    texts = texts.withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    rows = stage(texts.select("doc_id", "key", "n_bytes", "sha"), "text-keys")
    found = texts.where(F.col("n_bytes") >= length).select("key", "text").mapInArrow(_find(length), "hash long, key binary, pos long")
    found = stage(found, "anchors")
    counts = bounded(stage(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "anchor-counts"))
    alive = found.join(counts, "hash", "left_semi").groupBy("key").agg(F.collect_set(F.struct("hash", "pos")).alias("found"))
    first = rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    alive = stage(alive.join(first, "key"), "live-anchors")
    discard(found)
    names = bounded(alive.select("key", "doc_id"))

    def one_text(other: DataFrame) -> DataFrame:
        """A text of each class that has rows in ``other``."""
        t = texts.alias("t").join(names.alias("a"), (F.col("t.key") == F.col("a.key")) & F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")), "left_semi")
        return t.join(other, "key")

    around = one_text(alive.drop("doc_id"))
    contexts = around.select("key", "text", "found").mapInArrow(_contexts(length, True), "hash long, anchor long, digest long, n long, left binary, right binary")
    contexts = contexts.groupBy(*NAME).agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    contexts = stage(contexts, "contexts")
    parts, alike = split_groups(contexts, reach)
    cover = parts.repartition(partitions(spark), *GROUP).sortWithinPartitions(*GROUP).mapInArrow(_cover(length), "hash long, anchor long, digest long, l long, r long")
    if alike is not None:
        cover = cover.unionByName(alike.select(*NAME, (F.lit(reach) - F.col("low")).cast("long").alias("l"), F.col("low").cast("long").alias("r")))
    cover = stage(cover.groupBy(*NAME).agg(F.max("l").alias("l"), F.max("r").alias("r")), "cover")
    discard(contexts)
    places = around.select("key", "text", "found").mapInArrow(_contexts(length, False), "hash long, anchor long, digest long, key binary, pos long")
    spans = places.join(cover, list(NAME)).select("key", (F.col("pos") - F.col("l")).alias("begin"), (F.col("pos") + K + F.col("r")).alias("end"))
    spans = stage(spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    discard(cover)
    return rows, spans, one_text(spans)


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` after removing every byte of a repeated string."""
    rows, _, texts = repeated_spans(docs, length, id_col, text_col)
    cut = texts.select("key", "text", "spans").mapInArrow(lean(_cut), "key binary, n_removed long, n_spans long, kept_sha256 string")
    copies = rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_removed")).where("n > 1")
    cut = cut.dropDuplicates(["key"]).withColumn("n", F.lit(1).cast("long"))
    whole = copies.select("key", "n_removed", F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"), "n")
    done = cut.unionByName(whole).groupBy("key").agg(F.max_by(F.struct("n_removed", "n_spans", "kept_sha256"), "n").alias("c"))
    joined = rows.join(bounded(stage(done, "cut-texts")), "key", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("c.n_removed", F.lit(0)).alias("n_removed"), F.coalesce("c.n_spans", F.lit(0)).alias("n_spans"), F.coalesce("c.kept_sha256", "sha").alias("kept_sha256"))
