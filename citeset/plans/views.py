"""The driver's star schema in the shape of a citation data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import dealt

# Fixed values. What is appended to the text of a document, by doc_id % 12.
DECORATIONS = (
    "", " (Nordin, 2011) and", " Nordin (2011)", " Nordin et al.", " [3, 7]", " doi: 10.1/x", " unpublished data", " (e.g.)", " ▸", " [xref:R1] ends", " Nordin, 2011", " (2.5%)",
)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per order: its article is the customer, its hits are the parts ordered."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    joined = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    rows = joined.groupBy("o_orderkey", "o_custkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("hits"))
    return rows.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("PMC"), "o_custkey").alias("source_pmcid"), "hits", F.size("hits").alias("n_hits"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference per customer and part, with the suppliers seen as authors."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    rows = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_custkey", "l_partkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("Sn"), F.col("l_suppkey").cast("string")))).alias("authors"))
    pmid = F.col("l_partkey").cast("string")
    return rows.select(F.concat(F.lit("PMC"), "o_custkey").alias("source_pmcid"), pmid.alias("pmid"), F.concat(F.lit("R"), pmid).alias("rid"), F.col("l_partkey").cast("int").alias("ref_ordinal"), "authors")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article per customer with two suppliers as authors."""
    n = t(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    rows = t(spark, sf_dir, "customer").join(F.broadcast(n))  # one row
    author = lambda k: F.concat(F.lit("Sn"), ((F.col("c_custkey") + k) % F.col("n")).cast("string"))
    return rows.select(F.concat(F.lit("PMC"), "c_custkey").alias("pmcid"), F.array(author(0), author(1)).alias("authors"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, decorated by ``doc_id % 12``."""
    extra = F.get(F.array(*map(F.lit, DECORATIONS)), (F.col("doc_id") % 12).cast("int"))
    return t(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", extra).alias("query"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with the text of a document."""
    return with_texts(spark, sf_dir, contexts(spark, sf_dir)).select("query_id", "source_pmcid", "hits", "n_hits", "query")


def with_texts(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows with a ``query_id`` and the text of its document. They are many to a document, so they are dealt by their number."""
    n = t(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    c = rows.join(F.broadcast(n)).withColumn("doc_id", F.col("query_id") % F.col("n")).drop("n")  # one row
    d = texts(spark, sf_dir).select("doc_id", F.col("query").alias("_text"))
    tail = F.when(F.col("query_id") % 5 == 0, F.concat(F.lit(" SN"), (F.col("query_id") % 97).cast("string"))).otherwise(F.lit(""))
    return dealt(c, 20_000, t(spark, sf_dir, "orders"), "doc_id").join(d, "doc_id").withColumn("query", F.concat("_text", tail)).drop("_text", "doc_id")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a part: brand, type, size class and the words of its name; none for every tenth."""
    p = t(spark, sf_dir, "part")
    words = F.array_distinct(F.concat(F.array("p_brand", "p_type", F.concat(F.lit("size"), (F.col("p_size") / 10).cast("int").cast("string"))), F.split("p_name", " ")))
    return p.select(F.col("p_partkey").cast("string").alias("pmid"), F.when(F.col("p_partkey") % 10 == 0, F.array().cast("array<string>")).otherwise(words).alias("terms"))


#: The same views for the oracle, as DuckDB common table expressions.
SQL = {
    "v_ctx": "SELECT o_orderkey AS query_id, 'PMC' || o_custkey AS source_pmcid, list_sort(list(DISTINCT l_partkey::VARCHAR)) AS hits, len(list(DISTINCT l_partkey)) AS n_hits FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    "v_src": "SELECT 'PMC' || o_custkey AS source_pmcid, l_partkey::VARCHAR AS pmid, 'R' || l_partkey AS rid, l_partkey::INT AS ref_ordinal, list_sort(list(DISTINCT 'Sn' || l_suppkey)) AS authors FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey",
    "v_meta": "SELECT 'PMC' || c_custkey AS pmcid, ['Sn' || (c_custkey % n), 'Sn' || ((c_custkey + 1) % n)] AS authors FROM customer, (SELECT count(*) AS n FROM supplier)",
    "v_text": "SELECT doc_id, lang, text || list_extract([" + ", ".join(f"'{x}'" for x in DECORATIONS) + "], (doc_id % 12 + 1)::INT) AS query FROM documents",
    "v_qtext": "SELECT query_id, source_pmcid, hits, n_hits, query || CASE WHEN query_id % 5 = 0 THEN ' SN' || (query_id % 97) ELSE '' END AS query FROM (SELECT *, query_id % (SELECT count(*) FROM documents) AS doc_id FROM v_ctx) JOIN v_text USING (doc_id)",
    "v_terms": "SELECT p_partkey::VARCHAR AS pmid, CASE WHEN p_partkey % 10 = 0 THEN [] ELSE list_distinct([p_brand, p_type, 'size' || (p_size // 10)] || string_split(p_name, ' ')) END AS terms FROM part",
}
_NEEDS = {"v_qtext": ("v_ctx", "v_text", "v_qtext")}


def oracle(*views: str, body: str, recursive: bool = False) -> str:
    names = list(dict.fromkeys(n for v in views for n in _NEEDS.get(v, (v,))))
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {'RECURSIVE ' * recursive}{parts}{', ' if parts and body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"
