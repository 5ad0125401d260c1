"""Benchmark decontamination by a prefix-filtered join; DataFrame functions only.

An item's windows (``size`` consecutive words; the whole item if it has fewer) must occur as a whole, so
the necessary prefix of a window is one token: its rarest shingle of ``SHINGLE`` words. Steps:

1. Distinct windows of the benchmark, and their distinct shingles.
2. One pass over the documents counts their words and finds every occurrence ``(document, position)`` of a
   benchmark shingle. These occurrences give each shingle's exact frequency over all documents, the rarity order.
3. Each window is joined to the occurrences of its rarest shingle only. A shingle that occurs nowhere
   settles its windows. The position of the shingle in the window fixes where the window must lie
   (positional bound), and the document must have room for it (length bound).
4. Candidates are verified exactly: the SHA-256 of the document's words from there on must be that of the
   window's words, which names the window.

Only texts with candidates move. Tables of the benchmark's size are broadcast if they were counted to be small and
joined by a shuffle otherwise; they are staged first, so that a frequent shingle is a skewed partition that
can be split. It costs rows in proportion to its occurrences, since a window has one prefix and equal windows are one.

Null and empty texts have no words and are never hit; null or wordless items have no windows. Rows with
the same id and text get the same result, each its own row; rows with the same id but other texts are
kept apart by the text's hash. A null id is a value like any other. Equal items are all reported. A text may have any
length: its words are one row of one task. An empty benchmark or document table gives zero hits or an
empty result. Only ids and texts are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, partitions, stage

SIZE, SHINGLE = 13, 4
#: Words and the letters that are lowered (fixed by the contract).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words after lowering A-Z only: the fast ``lower`` where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _shingle(w: Column, at: Column, n: int) -> Column:
    """Hash of the n words from 0-based position ``at``, and of n."""
    return F.xxhash64(F.lit(n), *[F.get(w, at + k) for k in range(n)])


def _name(w: Column) -> Column:
    """The name of a window: the hash of its words, which hold no spaces."""
    return F.sha2(F.array_join(w, " "), 256)


def windows(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window, words, n)``, and which items have them ``(item, window)``."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("words"))
    cut = cut.withColumn("window", _name(F.col("words"))).distinct()
    return cut.groupBy("window").agg(F.first("words").alias("words"), F.first(F.size("words")).alias("n")), cut.select("item", "window").distinct()


def _same(a: str, b: str) -> Column:
    """Rows of two tables with the same id and text; null ids match."""
    return (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words per document row ``(doc_id, hash, n_words)``, verified window places ``(doc_id, hash, window, at, n)`` and ``(item, window)``."""
    wins, owners = (stage(x, "benchmark-windows") for x in windows(benchmark, size))
    lengths = sorted({x["n"] for x in wins.select(F.least("n", F.lit(SHINGLE)).alias("n")).distinct().collect()})  # at most SHINGLE values
    whole = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    texts = whole.select("doc_id", "hash", words(F.col("text")).alias("w"))
    kind = "array<struct<k:int,spot:int,shingle:bigint>>"

    def spots(n: int) -> Column:
        last = F.size("w") - n
        found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.lit(n).alias("k"), i.alias("spot"), _shingle(F.col("w"), i, n).alias("shingle")))
        return F.when(last >= 0, found).otherwise(F.array().cast(kind))

    own = wins.select("window", "n", F.col("words").alias("w"), F.least("n", F.lit(SHINGLE)).alias("own"))
    own = own.select("window", "n", "own", F.explode(F.concat(F.array().cast(kind), *map(spots, lengths))).alias("s")).where("s.k = own").select("window", "n", "s.k", "s.spot", "s.shingle")
    own = stage(own, "window-shingles")
    # The shingle 0 of no words stands for every document: its spot is the number of words.
    wanted = stage(own.select("shingle").unionByName(docs.sparkSession.range(1).select(F.col("id").alias("shingle"))).distinct(), "wanted-shingles")
    every = F.array(F.struct(F.lit(0).alias("k"), F.size("w").alias("spot"), F.lit(0).cast("long").alias("shingle")))
    exploded = texts.select("doc_id", "hash", F.size("w").alias("n_words"), F.explode(F.concat(every, *map(spots, lengths))).alias("s"))
    seen = stage(exploded.select("doc_id", "hash", "n_words", "s.k", "s.spot", "s.shingle").join(bounded(wanted), "shingle", "left_semi"), "shingle-places")
    rows, found = seen.where("k = 0").select("doc_id", "hash", "n_words"), seen.where("k > 0")
    rarity = stage(found.groupBy("shingle").agg(F.count("*").alias("seen")), "shingle-counts")
    ranked = own.join(rarity, "shingle", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "spot", "n")).alias("rare")
    )
    prefix = ranked.where(F.col("rare.seen") > 0).select("window", "rare.shingle", F.col("rare.spot").alias("lead"), "rare.n")
    places = found.join(bounded(stage(prefix, "window-prefixes")), "shingle").withColumn("at", F.col("spot") - F.col("lead"))
    candidates = places.where((F.col("at") >= 0) & (F.col("at") + F.col("n") <= F.col("n_words"))).select("doc_id", "hash", F.struct("window", "at", "n").alias("c"))
    # At most one candidate a word and window with that prefix: the array is in proportion to the text.
    per_doc = stage(candidates.groupBy("doc_id", "hash").agg(F.collect_set("c").alias("c")), "window-candidates")
    some = whole.alias("w").join(bounded(per_doc.select("doc_id", "hash")).alias("k"), _same("w", "k"), "left_semi").dropDuplicates(["doc_id", "hash"])
    # As many partitions as usual whatever the bytes, since the work is in words.
    met = some.alias("t").join(per_doc.alias("c"), _same("t", "c")).select("t.doc_id", "t.hash", "t.text", "c.c").repartition(partitions(docs.sparkSession))
    # A lambda's argument is made once; a column of words would be made again for every candidate, as the optimizer inlines it.
    true_ones = lambda w: F.filter("c", lambda x: _name(F.slice(w, x["at"] + 1, x["n"])) == x["window"])
    true = met.select("doc_id", "hash", F.get(F.transform(F.array(words(F.col("text"))), true_ones), F.lit(0)).alias("c"))
    verified = true.select("doc_id", "hash", F.explode("c").alias("c")).select("doc_id", "hash", "c.window", "c.at", "c.n")
    verified = stage(verified, "window-places")
    discard(own, rarity, per_doc)
    return rows, verified, owners


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the text's ``hash``.

    A document is contaminated if at least one word in ``share`` is hit.
    """
    rows, places, owners = occurrences(docs, benchmark, size, id_col, text_col)
    spots = places.select("doc_id", "hash", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("p")).distinct()
    hit = spots.groupBy("doc_id", "hash").agg(F.count("*").alias("n_hit"))
    items = places.select("doc_id", "hash", "window").distinct().join(owners, "window").select("doc_id", "hash", "item").distinct()
    named = items.groupBy("doc_id", "hash").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    both = stage(hit.alias("h").join(named.alias("i"), _same("h", "i")).select("h.*", "n_items", "items"), "window-hits")
    out = rows.alias("r").join(bounded(both).alias("b"), _same("r", "b"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "r.doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.col("r.hash").alias("hash"),
    )
