"""Jaccard self-join on word shingles: size-aware, light sets by subsets, heavy sets by inverted lists.

A document's set has the distinct shingles of ``k`` words (a shorter text is one shingle). Sets are
linked when the intersection is at least ``num / den`` of the union.

* Light sets (at most ``boundary`` shingles): a linked pair of sizes m and n shares c(m, n) shingles, so
  each set lists its subsets of the sizes c that occur for it, and linked pairs have a subset in common.
  Every member of a subset's list is linked to the list's smallest set if c is enough for both sizes, and
  to no member otherwise: these links are certain and need no texts.
* Heavy sets: linked sets differ in at most d shingles, so of more than d parts of the hash space one has
  the same shingles in both, frequent ones left out. A set enters one inverted list per part, named by all its
  shingles there (about five), for its own band of sizes and for the next. A set with so many empty parts that the equal one
  may be empty (it is mostly made of frequent shingles) enters, besides, the lists of its rarest shingles, as many as
  its necessary prefix in rarity order. Members of a list are tied to
  its largest set; the components of these ties contain every link of a heavy set. Within each, the inverted lists
  of single shingles are scanned with counts: a set is compared only with sets that nothing reached before and that share
  one of its rarest shingles, by the counts in the component.
* The boundary minimises the cost of both ways, from the subsets of light sets and the lengths that
  their lists have. It is at most ``most(t)``, up to where a set has no more subsets than twice its shingles.

Which shingles are frequent decides the length of lists, not the links: any choice is right that is the same for all
sets. Those are taken that blocks of texts hold in several sets; a shingle need not be in more than about the square
root of the number of blocks to be found.

A list never yields its pairs. Equal signatures of a block of texts meet before they are shuffled, so a
list that a third of all sets share has one entry per block. Components beyond ``LARGEST`` shingles are first
parted anew by lists of single shingles, rarest first by counts in these components, and by narrow bands of sizes. Those still beyond it are
verified in several tasks: blocks of their sets, each with some pivots, until all sets outside the component's
largest cluster have been pivots (one or two rounds for a group of near copies).

Hashes of shingles and subsets have 64 bits, a set's key 128. Null, empty and blank texts have no shingles and no
links; each is its own component. A null id counts in classes but is never a component's name unless all
its ids are null. Repeated rows are members of one class; rows with one id and other texts are other
sets. A text may have any length: its shingles are held by one task, 8 bytes each. Empty tables give an
empty result. Only id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounded, discard, lean, partitions, slices, stage

#: Shingles of a component that one task verifies.
LARGEST = 2_000_000
#: Bytes of text in a block that a task shingles at once.
BLOCK = 2 << 20
#: A shingle is frequent if it was counted so often; the most frequent so many are used.
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: Buckets of signatures for each shuffle partition.
BUCKETS = 4
_A = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("node", "<u4"), ("n", "u1")])  # 40 bits of a signature


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles, lowering A-Z only, cut at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words), np.uint64, len(words))
    codes = flat.indices.to_numpy()
    real = np.array([x != "" for x in words], bool)[codes] if words else np.zeros(0, bool)
    h = hashes[codes[real]] if words else np.zeros(0, np.uint64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    at = np.concatenate([[0], np.cumsum(real)])[edge]
    whole = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        whole = whole * _A + h[i : len(whole) + i]
    whole = _mix(whole)
    out = []
    for b, e in itertools.pairwise(at.tolist()):
        if e - b >= k:
            out.append(np.unique(whole[b : e - k + 1]))
        elif e == b:
            out.append(np.zeros(0, np.uint64))
        else:
            x = np.full(1, e - b, np.uint64)
            for i in range(b, e):
                x = x * _A + h[i]
            out.append(_mix(x))
    return out


class Threshold:
    """Jaccard of at least num/den, in whole numbers, and the bands of sizes: linked sizes are in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts, self.parts, self.spare = [1], [], []  # per band: first size, parts of the hash space, parts that may be empty

    def shared(self, m: int, n: int) -> int:
        """Least intersection of linked sets of sizes m and n."""
        return -(-self.num * (m + n) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def subset_sizes(self, n: int, most: int) -> list[int]:
        return sorted({self.shared(n, m) for m in self.partners(n) if m <= most and self.shared(n, m) <= min(m, n)})

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, c) for c in self.subset_sizes(n, self.den * n // self.num))

    def most(self) -> int:
        """Up to this size a set has at most twice as many subsets as shingles."""
        return next(n for n in itertools.count(1) if self.subsets(n + 1) > 2 * (n + 1))

    def prefix(self, n: int) -> int:
        """Linked sets have a shingle in common among the first so many of either, in any common order."""
        return n - -(-self.num * n // self.den) + 1

    def reach(self, n: int) -> None:
        """Make the bands up to size n and the one after it."""
        while len(self.parts) < 2 or self.starts[-2] <= n:
            start, end = self.starts[-1], self.den * self.starts[-1] // self.num + 1
            differ = 2 * (end - 1) * (self.den - self.num) // (self.num + self.den)
            least, k = -(-self.num * start // self.den), differ + 1
            for _ in range(4):  # most of the smallest sets at this band have no more empty parts than are spare
                empty = k * math.exp(-least / k)
                k = differ + 1 + math.ceil(empty + math.sqrt(empty))
            self.parts.append(k)
            self.spare.append(k - differ - 1)
            self.starts.append(end)


class Frequent:
    """Shingles known to be frequent, with their counts. Rarity is the order of (count, hash), 0 being the count of others."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order]

    def seen(self, x: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, x), len(self.shingles) - 1)
        return np.where(self.shingles[at] == x, self.counts[at], 0)

    def prefix(self, s: np.ndarray, n: int) -> np.ndarray:
        """The n rarest shingles of a set."""
        return s[np.lexsort((s, self.seen(s)))[:n]]


def signatures(sets: list[np.ndarray], t: Threshold, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Names of the lists that sets enter, and the number of the set for each."""
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t.reach(int(size.max()))
    starts, parts, spare = np.array(t.starts), np.array(t.parts), np.array(t.spare)
    own = np.searchsorted(starts, size, "right") - 1
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    rare = frequent.seen(flat) == 0
    flat, owner = flat[rare], owner[rare]
    names, who = [], []
    for up in (0, 1):
        band = own + up
        here = (size > 0) if not up else (size > 0) & (t.den * size >= t.num * starts[band])  # may be linked to a set of the next band
        use = here[owner]
        x, o = flat[use], owner[use]
        if len(x):
            k = parts[band].astype(np.uint64)
            part = ((x >> np.uint64(32)) * k[o]) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (part[1:] != part[:-1])]))
            sums, o = np.add.reduceat(x, first), o[first]
            names.append(_mix(sums * _A + (band[o].astype(np.uint64) << np.uint64(1))))
            who.append(o)
        filled = np.bincount(o, minlength=len(sets))
        for i in np.flatnonzero(here & (parts[band] - filled > spare[band])):
            p = frequent.prefix(sets[i], t.prefix(int(size[i])))
            names.append(_mix(p * _A + ((np.uint64(band[i]) << np.uint64(1)) | np.uint64(1))))
            who.append(np.full(len(p), i))
    return np.concatenate(names), np.concatenate(who)


def _ties(name: np.ndarray, node: np.ndarray, n: np.ndarray, most: int):
    """Of entries of lists: which is the largest set of each list, ties to it, and for each small size the lengths of its lists."""
    order = np.lexsort((node, -n.astype(np.int64), name))
    name, node, n = name[order], node[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    length = np.diff(np.append(first, len(name)))
    cost = np.bincount(np.minimum(n, most + 1), weights=np.repeat(length, length), minlength=most + 2)[: most + 1].astype(np.int64)
    top = np.repeat(first, length)
    tied = np.flatnonzero(node != node[top])
    a, b = node[tied], node[top[tied]]
    if len(a):
        by = np.lexsort((b, a))
        tied, a, b = tied[by], a[by], b[by]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        tied, a, b = tied[once], a[once], b[once]
    return order[first], (a, b, n[tied], n[top[tied]]), cost


_TIE_NAMES = ["a", "b", "na", "nb"]


def _tie_rows(ties, cost) -> list[pa.Array]:
    """Ties, and rows without ties that hold a small size and the lengths of its lists."""
    sizes = np.flatnonzero(cost)
    none = pa.nulls(len(sizes), pa.int64())
    a, b, na, nb = (pa.array(np.asarray(x, np.int64)) for x in ties)
    more = (none, none, pa.array(sizes, pa.int64()), pa.array(cost[sizes], pa.int64()))
    return [pa.concat_arrays(x) for x in zip((a, b, na, nb), more, strict=True)]


def _repeated(k: int):
    """Shingles that occur in several different sets of a block of texts, with the number of these."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                sets = {xxhash.xxh3_128_digest(s.tobytes()): s for s in shingle_sets(part.column("text"), k)}
                flat = np.sort(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]))
                first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
                seen = np.diff(np.append(first, len(flat)))
                many = seen > 1
                yield pa.RecordBatch.from_arrays([pa.array(flat[first[many]].view(np.int64)), pa.array(seen[many])], names=["shingle", "seen"])

    return lean(run)


def frequent_shingles(texts: DataFrame, k: int) -> Frequent:
    """Shingles counted ``FREQUENT`` times in blocks of texts that have them several times; of more than ``MOST_FREQUENT`` the most frequent."""
    counts = texts.select("text").mapInArrow(_repeated(k), "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT)
    got = counts.orderBy(F.desc("seen"), "shingle").limit(MOST_FREQUENT).toArrow()
    return Frequent(got.column("shingle").to_numpy().view(np.uint64), got.column("seen").to_numpy())


def _scan(k: int, t: Threshold, buckets: int, shared):
    """Rows for documents, for ties within a block of texts, and for what each bucket of signatures gets of the block."""
    most = t.most()
    types = {"hash": pa.int64(), "n": pa.int64(), "key": pa.binary(), "node": pa.int64(), "small": pa.binary(), "a": pa.int64(), "b": pa.int64(), "na": pa.int64(), "nb": pa.int64(), "bucket": pa.int32(), "base": pa.int64(), "entries": pa.binary()}

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            kind = batch.schema.field("doc_id").type

            def rows(kind=kind, **given):
                size = len(next(iter(given.values())))
                columns = [given[c] if c in given else pa.nulls(size, x) for c, x in {"doc_id": kind, **types}.items()]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", *types])

            for part in slices(batch, "text", BLOCK):
                sets = shingle_sets(part.column("text"), k)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                place: dict[bytes, int] = {}
                local = [place.setdefault(x, len(place)) for x in keys]
                one = [sets[i] for i in np.unique(local, return_index=True)[1]]
                small = [s.astype("<u8").tobytes() if 0 < len(s) <= most else None for s in sets]
                yield rows(doc_id=part.column("doc_id"), hash=part.column("hash"), n=pa.array([len(s) for s in sets], pa.int64()), key=pa.array(keys, pa.binary()), node=pa.array(base + np.array(local, np.int64)), small=pa.array(small, pa.binary()))
                name, who = signatures(one, t, shared.value)
                if len(name):
                    n = np.minimum([len(s) for s in one], 255)
                    kept, ties, cost = _ties(name, who, n[who], most)
                    a, b, na, nb = _tie_rows((ties[0] + base, ties[1] + base, *ties[2:]), cost * 0)
                    yield rows(a=a, b=b, na=na, nb=nb)
                    name, who = name[kept], who[kept]
                    bucket = (name >> np.uint64(40)) % np.uint64(buckets)
                    order = np.argsort(bucket, kind="stable")
                    entries = np.empty(len(order), _ENTRY)
                    entries["low"], entries["high"], entries["node"], entries["n"] = name[order] & np.uint64(0xFFFFFFFF), (name[order] >> np.uint64(32)) & np.uint64(255), who[order], n[who[order]]
                    used, first = np.unique(bucket[order], return_index=True)
                    held = [entries[x:y].tobytes() for x, y in itertools.pairwise([*first.tolist(), len(order)])]
                    yield rows(bucket=pa.array(used.astype(np.int32)), base=pa.array(np.full(len(used), base)), entries=pa.array(held, pa.binary()))
                base += len(place)

    return lean(run)


def _meet(most: int):
    """Blocks sorted by bucket; gives ties and costs of each bucket."""

    def emit(base, held):
        x = np.frombuffer(b"".join(held), _ENTRY)
        node = np.repeat(np.array(base, np.int64), [len(b) // _ENTRY.itemsize for b in held]) + x["node"]
        name = (x["high"].astype(np.uint64) << np.uint64(32)) | x["low"]
        _, ties, cost = _ties(name, node, x["n"], most)
        return pa.RecordBatch.from_arrays(_tie_rows(ties, cost), names=_TIE_NAMES)

    def run(batches):
        current, base, held = None, [], []
        for batch in batches:
            for bucket, first, entries in zip(*(batch.column(c).to_pylist() for c in ("bucket", "base", "entries")), strict=True):
                if bucket != current and held:
                    yield emit(base, held)
                    base, held = [], []
                current = bucket
                base.append(first)
                held.append(entries)
        if held:
            yield emit(base, held)

    return lean(run)


def boundary(counts: dict[int, int], lengths: dict[int, int], t: Threshold) -> int:
    """The size of light sets that costs least: their subsets against the lists that heavy sets scan."""
    best, where, total = 0, 0, 0
    for n in range(1, t.most() + 1):
        total += counts.get(n, 0) * t.subsets(n) - lengths.get(n, 0)
        if total < best:
            best, where = total, n
    return where


def _subsets(t: Threshold, most: int):
    def run(batches):
        for batch in batches:
            out = []
            for node, n, small in zip(*(batch.column(x).to_pylist() for x in ("node", "n", "small")), strict=True):
                ids = [small[8 * i : 8 * i + 8] for i in range(n)]
                for c in t.subset_sizes(n, most):
                    out += [(int.from_bytes(xxhash.xxh3_64_digest(b"".join(x)), "little", signed=True), c, node, n) for x in itertools.combinations(ids, c)]
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["list", "c", "node", "n"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["list", "c", "node", "n"])

    return lean(run)


def light_links(classes: DataFrame, t: Threshold, light: int) -> DataFrame:
    """Links ``(a, b)`` between sets of at most ``light`` shingles: each list's members with its smallest set."""
    rows = classes.where(F.col("n") <= light).select("node", "n", "small").mapInArrow(_subsets(t, light), "list long, c long, node long, n long")
    rows = stage(rows, "subsets")
    # Staged apart, so that a list which very many sets share is a skewed partition that can be split.
    first = stage(rows.groupBy("list", "c").agg(F.min(F.struct("n", "node")).alias("first"), F.count("*").alias("m")).where("m > 1").select("list", "c", "first"), "subset-lists")
    met = rows.join(first, ["list", "c"]).where((F.col("node") != F.col("first.node")) & ((t.num + t.den) * F.col("c") >= t.num * (F.col("n") + F.col("first.n"))))
    return met.select(F.col("node").alias("a"), F.col("first.node").alias("b"))


def _members(sets: list[np.ndarray], t: Threshold) -> list[int]:
    """For sets of one candidate component, the first set of each set's true component.

    A set is compared only with sets that nothing reached before and that share one of its rarest shingles: in the order of
    (count in the component, hash), the first shingle that linked sets share lies so early in both that as many as they must share are left.
    """
    size = np.array([len(s) for s in sets])
    edge = np.concatenate([[0], np.cumsum(size)])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(seen))
    flat = rank[code]
    flat = flat[np.lexsort((flat, owner))]  # each set from rare to frequent
    seen = np.sort(seen)
    place = np.arange(len(flat)) - edge[owner]
    early = np.array([t.prefix(int(n)) for n in size])
    held = np.flatnonzero((place < early[owner]) & (seen[flat] > 1))
    held = held[np.argsort(flat[held], kind="stable")]  # the inverted lists, one after another
    names, members, places = flat[held], owner[held], place[held]
    root = np.full(len(sets), -1)
    inside = np.zeros(len(seen), bool)
    queue: list[int] = []
    current, start, wasted = -1, 0, 0
    while True:
        if not queue:
            while start < len(sets) and root[start] >= 0:
                start += 1
            if start == len(sets):
                return root.tolist()
            current = start
            root[current] = current
            queue.append(current)
        x = queue.pop()
        if wasted > len(names):  # leave out sets that were reached
            alive = root[members] < 0
            names, members, places, wasted = names[alive], members[alive], places[alive], 0
        own = flat[edge[x] : edge[x + 1]]
        begin = np.searchsorted(names, own[: early[x]], "left")
        n = np.searchsorted(names, own[: early[x]], "right") - begin
        if not n.any():
            continue
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        y, here = members[at], np.repeat(np.arange(len(n)), n)
        shared = -(-t.num * (size[y] + size[x]) // (t.num + t.den))
        use = root[y] < 0
        wasted += len(y) - int(use.sum())
        use &= (size[x] - here >= shared) & (size[y] - places[at] >= shared)
        near = np.unique(y[use])
        inside[own] = True
        for some in np.array_split(near, 1 + int(size[near].sum()) // LARGEST):
            if len(some):
                first = np.concatenate([[0], np.cumsum(size[some])])
                inter = np.add.reduceat(inside[flat[np.repeat(edge[some] - first[:-1], size[some]) + np.arange(first[-1])]].astype(np.int64), first[:-1])
                linked = some[t.den * inter >= t.num * (size[some] + size[x] - inter)]
                root[linked] = current
                queue.extend(linked.tolist())
        inside[own] = False


def _verify(k: int, t: Threshold):
    """Rows sorted by group; gives ``(a, b)``: each set and the first set of its true component within the group."""

    def groups(batches):
        name, nodes, sets = None, [], []
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                for g, b, node, key, s in zip(*(part.column(x).to_pylist() for x in ("root", "block", "node", "key")), shingle_sets(part.column("text"), k), strict=True):
                    if (g, b) != name:
                        if nodes:
                            yield nodes, sets
                        name, nodes, sets = (g, b), [], []
                    if (not nodes or nodes[-1] != node) and xxhash.xxh3_128_digest(s.tobytes()) == key:
                        nodes.append(node)
                        sets.append(s)
        if nodes:
            yield nodes, sets

    def run(batches):
        out = []
        for nodes, sets in groups(batches):
            out += [(node, nodes[root]) for node, root in zip(nodes, _members(sets, t), strict=True) if node != nodes[root]]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return lean(run)


def _fine_lists(k: int, t: Threshold, shared):
    """Names of the lists that sets of large components enter: one of their rarest shingles, and narrow bands of their own and the partner's size."""

    def run(batches):
        starts, frequent = [1], shared.value
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                names, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for root, node, key, s in zip(*(part.column(x).to_pylist() for x in ("root", "node", "key")), shingle_sets(part.column("text"), k), strict=True):
                    if xxhash.xxh3_128_digest(s.tobytes()) != key:
                        continue
                    n, sizes = len(s), t.partners(len(s))
                    while starts[-1] <= sizes[-1]:
                        starts.append(max(starts[-1] + 1, starts[-1] * 21 // 20))
                    own, low, high = (bisect.bisect_right(starts, x) - 1 for x in (n, sizes[0], sizes[-1]))
                    rare = frequent.prefix(s, t.prefix(n))
                    for band in range(low, high + 1):
                        least = t.shared(n, max(starts[band], sizes[0]))  # with any partner of this band
                        tag = xxhash.xxh3_64_intdigest(f"{root} {min(own, band)} {max(own, band)}")
                        names.append(_mix(rare[: n - least + 1] * _A + np.uint64(tag)))
                        nodes.append(np.full(n - least + 1, node))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(nodes))], names=["list", "node"])

    return lean(run)


def refined(found: DataFrame, sets: DataFrame, k: int, t: Threshold) -> DataFrame:
    """``sets`` with the roots of finer candidate components; those that can have no link are left out.

    ``found`` has ``root, node, key, text`` of the sets. Frequent shingles are counted among these texts alone. Of a linked pair, the first
    shingle in common by rarity lies so early in both sets that both enter its list.
    """
    shared = found.sparkSession.sparkContext.broadcast(frequent_shingles(found, k))  # at most MOST_FREQUENT rows of 16 bytes
    lists = stage(found.mapInArrow(_fine_lists(k, t, shared), "list long, node long"), "fine-lists")
    top = stage(lists.groupBy("list").agg(F.max("node").alias("top"), F.min("node").alias("least")).where("top <> least").select("list", "top"), "fine-list-tops")
    roots = components(lists.join(top, "list").where("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b")))
    out = stage(sets.drop("root").join(roots, "node").select(*sets.columns), "fine-candidates")
    discard(lists, top)
    return out


def verified_links(texts: DataFrame, own: DataFrame, k: int, t: Threshold) -> DataFrame:
    """True links ``(a, b)`` that connect every true component within the candidate components.

    ``own`` has a row ``node, root, n, key, one`` for each set, ``one`` being the id and hash of a text that has it.
    """
    spark = texts.sparkSession

    def texts_of(tasks: DataFrame) -> DataFrame:
        """``tasks`` has a row ``root, block, node, key, one`` for each set that a block holds."""
        # The hash keeps the texts apart that share an id, or have none.
        same = (F.col("d.hash") == F.col("i.one.hash")) & F.col("d.doc_id").eqNullSafe(F.col("i.one.doc_id"))
        return texts.alias("d").join(bounded(tasks).alias("i"), same).select("root", "block", "node", "key", "text")

    def compare(tasks: DataFrame, name: str) -> DataFrame:
        found = texts_of(tasks)
        return stage(found.repartition(partitions(spark), "root", "block").sortWithinPartitions("root", "block", "node").mapInArrow(_verify(k, t), "a long, b long"), name)

    def sized(sets: DataFrame) -> DataFrame:
        """With the number of blocks that a component needs."""
        weight = stage(sets.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1"), "component-sizes")
        return sets.join(weight.select("root", F.ceil(F.col("total") / LARGEST).alias("blocks")), "root")

    whole = F.lit(0).cast("long").alias("block")
    coarse = sized(own)
    single = coarse.where("blocks = 1").select("root", whole, "node", "key", "one")
    large = stage(coarse.where("blocks > 1").select(*own.columns), "large-candidates")
    if not large.isEmpty():
        found = stage(texts_of(large.select("root", whole, "node", "key", "one")).drop("block"), "large-texts")
        fine = sized(refined(found, large, k, t))
        discard(found)
        single = stage(single.unionByName(fine.where("blocks = 1").select("root", whole, "node", "key", "one")), "single-blocks")
        large = fine.where("blocks > 1")
    else:
        large = coarse.where("blocks > 1")
    links = compare(single, "verified")
    large = stage(large.select("root", "node", "n", "key", "one", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")), "large-components")
    left, turn = large, 0  # sets that are to be pivots
    while not left.isEmpty():
        # A share of the sets that is left, chosen by hash, of about LARGEST shingles in each component.
        share = stage(left.groupBy("root").agg((F.lit(LARGEST) / F.sum("n")).alias("share")), "pivot-shares")
        picked = (F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).alias("picked")
        chosen = stage(left.join(share, "root").where(picked), "pivots")
        copies = chosen.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "node", "key", "one")
        tasks = copies.unionByName(large.select("root", "block", "node", "key", "one")).distinct()
        links = stage(links.unionByName(compare(tasks, "verified-block")), "links")
        clusters = _clusters(large, links)
        main = clusters.groupBy("root", "cluster").agg(F.count("*").alias("m")).groupBy("root").agg(F.max_by("cluster", F.struct("m", "cluster")).alias("main"))
        outside = clusters.join(stage(main, "main-clusters"), "root").where("cluster <> main").select("node")
        left = stage(left.join(outside, "node", "left_semi").join(chosen.select("node"), "node", "left_anti"), "left-sets")
        turn += 1
    return links


def _clusters(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``root, node, cluster``: the component by true links so far of each set of a candidate component."""
    named = components(links).select("node", F.col("root").alias("c"))
    return stage(sets.select("root", "node").join(named, "node", "left").select("root", "node", F.coalesce("c", "node").alias("cluster")), "clusters")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, class_id`` (the class: rows with equal sets)."""
    spark, t = docs.sparkSession, Threshold(num, den)
    kind, most = docs.schema[id_col].dataType.simpleString(), t.most()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    ddl = f"doc_id {kind}, hash long, n long, key binary, node long, small binary, a long, b long, na long, nb long, bucket int, base long, entries binary"
    shared = spark.sparkContext.broadcast(frequent_shingles(texts, k))  # at most MOST_FREQUENT rows of 16 bytes
    scanned = stage(texts.mapInArrow(_scan(k, t, BUCKETS * partitions(spark), shared), ddl), "sets")
    rows = scanned.where("key IS NOT NULL").select("doc_id", "hash", "n", "key", "node", "small")
    blocks = scanned.where("bucket IS NOT NULL").select("bucket", "base", "entries")
    met = blocks.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(most), "a long, b long, na long, nb long")
    met = stage(met, "ties")

    # Equal sets of several blocks of texts are one class; its node is the smallest.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("one")
    grouped = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), one, F.min("node").alias("node"), F.first("n").alias("n"), F.first("small").alias("small"))
    classes = stage(grouped, "classes")
    counts = {x["n"]: x["count"] for x in classes.where(F.col("n") <= most).groupBy("n").count().collect()}  # at most ``most`` rows
    lengths = {x["na"]: x["cost"] for x in met.where("a IS NULL").groupBy("na").agg(F.sum("nb").alias("cost")).collect()}  # the same
    light = boundary(counts, lengths, t)

    # Lists whose largest set is light hold light sets only.
    ties = met.unionByName(scanned.select("a", "b", "na", "nb")).where((F.col("a") != F.col("b")) & (F.col("nb") > light)).select("a", "b")
    copies = rows.where("n > 0").select("key", F.col("node").alias("a")).distinct().join(classes.select("key", F.col("node").alias("b")), "key").where("a <> b").select("a", "b")
    candidates = components(ties.unionByName(copies))
    own = stage(candidates.join(classes, "node").select("node", "root", "n", "key", "one"), "candidates")
    discard(met)
    links = verified_links(texts, own, k, t)
    discard(own)
    if light:
        links = links.unionByName(light_links(classes, t, light))
    roots = components(links)
    named = stage(classes.select("node", "key", "first").join(roots, "node", "left").select("key", "first", F.coalesce("root", "node").alias("root")), "class-roots")
    names = stage(named.groupBy("root").agg(F.min("first").alias("component_id")), "component-names")
    result = stage(named.join(names, "root").select("key", "component_id", F.col("first").alias("class_id")), "class-components")
    joined = rows.select("doc_id", "n", "key").join(result, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
