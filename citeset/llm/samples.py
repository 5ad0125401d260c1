"""Bounded samples of labelled rows, and word ids remembered by each worker."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory

#: Characters of the longest text that a classifier learns from; longer ones are scored as a whole.
LONGEST = 50_000
_EDGES = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)


def fold(modulus: int):
    """crc32 of the document id as text, modulo ``modulus``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int, columns: tuple[str, ...] = (), longest: int = LONGEST) -> DataFrame:
    """At most ``rows`` different documents of each label, 0 and 1, of at most ``longest`` characters, where ``allowed`` holds.

    Those with the smallest hash of the id come first; repeated ids and repeated rows count towards the bound. Rows without a label are left out;
    of several labels of a document the largest counts.
    """
    known = labels.where(allowed & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    no, yes = (known.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows) for x in (0, 1))
    chosen = F.broadcast(no.unionAll(yes))  # at most 4 * rows ids
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns).where(F.length("text") <= longest)
    found = texts.join(chosen, "doc_id")
    order = (F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), *columns)
    no, yes = (found.where(F.col("label") == x).orderBy(*order).limit(rows) for x in (0, 1))
    return no.unionAll(yes)


def parts(word: str) -> tuple[str, str, str]:
    """Leading marks, core in its case, trailing marks of a word."""
    return _EDGES.match(word).groups()


def hash32(token: str) -> int:
    return zlib.crc32(token.encode())


class Words(Memory):
    """Remembers a value per distinct word; starts anew beyond ``limit`` words."""

    def __init__(self, make: Callable[[str], object], limit: int = 150_000):
        super().__init__()
        self._make, self._limit, self._known = make, limit, {}

    def clear(self) -> None:
        self._known = {}

    def __call__(self, words: list[str]) -> list:
        self.use()
        known = self._known
        if len(known) > self._limit:
            known.clear()
        for x in set(words).difference(known):
            known[x] = self._make(x)
        return list(map(known.__getitem__, words))
