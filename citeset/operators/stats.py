"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..staging import stage


def reference_counts(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``pmcid, n_entries, n_refs``: bibliography entries and different ids per article, 0 if none."""
    found = sources.groupBy(F.col("source_pmcid").alias("pmcid")).agg(F.count("*").alias("n_entries"), F.count_distinct("pmid").alias("n_refs"))
    return articles.select("pmcid").join(found, "pmcid", "left").na.fill(0, ["n_entries", "n_refs"])


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, least, quartiles, mean, 90th percentile and largest, to one decimal; exact percentiles."""
    p = lambda q: F.round(F.percentile(column, F.lit(q)), 1)
    return df.agg(
        F.count(column).alias("n"), F.round(F.min(column).cast("double"), 1).alias("min"), p(0.25).alias("p25"), p(0.5).alias("p50"),
        F.round(F.avg(column), 1).alias("mean"), p(0.75).alias("p75"), p(0.9).alias("p90"), F.round(F.max(column).cast("double"), 1).alias("max"),
    )


def bin_of(value: Column) -> Column:
    """Number of the right-closed bin of a count."""
    out = F.lit(len(fixed.BINS) - 1)
    for i, (top, _) in reversed(list(enumerate(fixed.BINS[:-1]))):
        out = F.when(value <= top, F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``bin, label, n, share``: all bins, empty ones too; shares in percent to one decimal."""
    bins = df.sparkSession.createDataFrame([(i, x[1]) for i, x in enumerate(fixed.BINS)], "bin int, label string")
    found = df.groupBy(bin_of(F.col(column)).alias("bin")).agg(F.count("*").alias("n"))
    rows = bins.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(True))), 1))


def eligible_share(df: DataFrame, column: str, least: int = 25) -> DataFrame:
    return df.agg(F.count_if(F.col(column) >= least).alias("n_eligible"), F.round(100 * F.avg((F.col(column) >= least).cast("int")), 1).alias("share"))


def eligible_articles(contexts: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """``source_pmcid, n_queries`` of articles with low to high queries."""
    return contexts.groupBy("source_pmcid").agg(F.count("*").alias("n_queries")).where(F.col("n_queries").between(low, high))


def group_seeds(seeds: DataFrame) -> DataFrame:
    """``pmcid, title, queries, mesh``: search hits folded to one row each; corrections and foreign ids left out."""
    rows = seeds.where(~F.lower(F.coalesce("title", F.lit(""))).contains("correction") & F.startswith(F.col("pmcid"), F.lit("PMC")))
    listed = rows.groupBy("pmcid", "title").agg(F.array_sort(F.collect_list(F.struct("ordinal", "query", "mesh"))).alias("r"))
    return listed.select("pmcid", "title", F.col("r.query").alias("queries"), F.col("r.mesh").alias("mesh"))


def coverage(rows: DataFrame, ids: str, terms: DataFrame) -> DataFrame:
    """Share of the ids in an array column that have terms."""
    flat = rows.select(F.explode(ids).alias("pmid"))
    marked = flat.join(terms.select("pmid", F.lit(1).alias("has")).distinct(), "pmid", "left")
    return marked.agg(F.count("*").alias("n_ids"), F.round(F.avg(F.col("has").isNotNull().cast("int")), 6).alias("covered"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


def previous_query(contexts: DataFrame) -> DataFrame:
    """Add ``context``: the query emitted before in the same section."""
    order = Window.partitionBy("source_pmcid", "section_index").orderBy("paragraph_index", "sentence_index")
    return contexts.withColumn("context", F.lag("query").over(order))


def assert_all(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Raise unless the condition holds for every row."""
    if not df.agg(F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))).first()[0]:
        raise ValueError(message)
    return df


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Add ``batch``: runs of ``size`` rows in order, for requests of a fixed size.

    Rows are dealt by ranges of the order column; a partition numbers its own rows after the counts of those before it,
    so no task holds them all. Ties and nulls are allowed.
    """
    rows = stage(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "ordered-rows")
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)) / size)).drop("_id", "_part", "_before")
