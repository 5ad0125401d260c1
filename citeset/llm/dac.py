"""Directly addressable codes for token ids.

Each id is split into chunks of ``widths`` bits, lowest first. Level k holds the k-th chunk of
every id that has one, and a bitmap with a set bit where the id goes on at level k + 1. A rank
directory holds the number of set bits before each block of 512. Token i is read by reading its
chunk at level 0 and, while its bit is set, going to position rank(bit) of the next level: no
block is decoded.

File: ``CSDAC01\\0``; unsigned 64-bit little-endian: documents, tokens, levels, then for each level
width, chunks and byte offset of its low plane, high plane, bitmap and directory; the document
ids as signed 64-bit with a null bitmap; the token offset of every document and of the end.
A plane holds the lower 8 bits of a chunk in bytes, or its upper (or only) 4 in nibbles.
"""

from __future__ import annotations

import numpy as np

from .common import RangeReader

MAGIC = b"CSDAC01\0"
WIDTHS = (12, 4, 8, 8)
BLOCK = 512


def _nibbles(x: np.ndarray) -> bytes:
    x = x.astype(np.uint8)
    if len(x) % 2:
        x = np.append(x, np.uint8(0))
    return (x[0::2] | (x[1::2] << 4)).tobytes()


def encode(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> list[bytes]:
    """The parts of a file for the concatenated ids of some documents."""
    head, body, rest = [], [], ids.astype(np.uint32)
    levels = []
    for k, width in enumerate(WIDTHS):
        if k and not len(rest):
            break
        chunk, more = rest & np.uint32((1 << width) - 1), rest >> np.uint32(width)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        whole = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(whole.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)])
        low = (chunk & np.uint32(255)).astype(np.uint8).tobytes() if width >= 8 else b""
        high = _nibbles(chunk >> np.uint32(8 if width >= 8 else 0)) if width % 8 else b""
        levels.append((width, len(rest), low, high, whole.tobytes(), directory.astype("<u8").tobytes()))
        rest = more[on]
    at = len(MAGIC) + 8 * (3 + 6 * len(levels))
    known = np.packbits([x is not None for x in doc_ids], bitorder="little").tobytes()
    docs = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known, np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    at += sum(map(len, docs))
    for width, n, *planes in levels:
        head += [width, n]
        for x in planes:
            head.append(at)
            body.append(x)
            at += len(x)
    return [MAGIC, np.array([len(doc_ids), len(ids), len(levels), *head], "<u8").tobytes(), *docs, *body]


class Reader:
    """Random access to the tokens of a file."""

    def __init__(self, uri: str):
        self._f = RangeReader(uri)
        if self._f.read(0, 8) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.n_docs, self.n_tokens, levels = map(int, np.frombuffer(self._f.read(8, 24), "<u8"))
        table = np.frombuffer(self._f.read(32, 48 * levels), "<u8").reshape(-1, 6)
        self._levels = [tuple(map(int, x)) for x in table]
        self._docs = 32 + 48 * levels

    def close(self) -> None:
        self._f._file.close()

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids, and the token offset of each document and of the end."""
        n = self.n_docs
        ids = np.frombuffer(self._f.read(self._docs, 8 * n), "<i8").tolist()
        at = self._docs + 8 * n
        known = np.unpackbits(np.frombuffer(self._f.read(at, -(-n // 8)), np.uint8), count=n, bitorder="little")
        at += -(-n // 8)
        return [x if k else None for x, k in zip(ids, known, strict=True)], np.frombuffer(self._f.read(at, 8 * (n + 1)), "<u8").astype(np.int64)

    def _rank(self, level: tuple, i: int) -> int:
        """Set bits of a level's bitmap before position i."""
        *_, bitmap, directory = level
        block = i // BLOCK
        before = int.from_bytes(self._f.read(directory + 8 * block, 8), "little")
        raw = self._f.read(bitmap + block * BLOCK // 8, -(-(i % BLOCK) // 8))
        return before + (int.from_bytes(raw, "little") & ((1 << i % BLOCK) - 1)).bit_count()

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids of tokens begin..end-1: one short read per plane and level."""
        out = np.zeros(end - begin, np.uint32)
        place, shift = np.arange(end - begin), 0
        for k, level in enumerate(self._levels):
            width, _, low, high, bitmap, _ = level
            if begin == end:
                break
            value = np.zeros(end - begin, np.uint32)
            if width >= 8:
                value |= np.frombuffer(self._f.read(low + begin, end - begin), np.uint8)
            if width % 8:
                raw = np.frombuffer(self._f.read(high + begin // 2, (end + 1) // 2 - begin // 2), np.uint8)
                both = np.stack([raw & 15, raw >> 4], axis=1).reshape(-1)[begin % 2 :][: end - begin].astype(np.uint32)
                value |= both << np.uint32(8 if width >= 8 else 0)
            out[place] |= value << np.uint32(shift)
            shift += width
            raw = np.frombuffer(self._f.read(bitmap + begin // 8, -(-end // 8) - begin // 8), np.uint8)
            on = np.unpackbits(raw, bitorder="little")[begin % 8 :][: end - begin].astype(bool)
            if k + 1 == len(self._levels):
                break
            begin, end = (r := self._rank(level, begin)), r + int(on.sum())
            place = place[on]
        return out

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])
