"""Queries whose core is Python: checked by tests and by the rows they give."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import parse_hits
from ..jats.sentences import split
from ..operators.filters import coreferent_keys
from ..sources import articles, biblio
from ..staging import dealt
from . import views
from .catalogue import _phrases, query
from .views import t


@query()
def sentence_positions(s, d):
    """Sentences of documents with their places."""
    docs = t(s, d, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_sentences, f"doc_id {kind}, sentence_index int, text string")


#: Characters of documents that a task cuts into sentences at once; a single document is cut whole.
AT_ONCE = 2 << 20


def _sentences(batches):
    """``doc_id, sentence_index, text`` of documents, handed on by pieces, so that a batch isn't held with all its sentences."""
    for batch in batches:
        ids, places, texts, size = [], [], [], 0
        for i, text in enumerate(batch.column("text")):
            got = split(text.as_py() or "")
            ids += [i] * len(got)
            places += range(len(got))
            texts += got
            size += sum(map(len, got))
            if size >= AT_ONCE or i + 1 == len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "sentence_index", "text"])
                ids, places, texts, size = [], [], [], 0


@query("SELECT query_id, array_to_string(hits, ',') AS hits FROM (" + views.SQL["v_ctx"] + ")")
def hits_parsing(s, d):
    """Serialised lists, as legacy tables hold them, read again."""
    literal = F.concat(F.lit("['"), F.array_join("hits", "', '"), F.lit("']"))
    return views.contexts(s, d).select("query_id", F.array_join(parse_hits(literal), ",").alias("hits"))


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("WITH v_ctx AS (" + views.SQL["v_ctx"] + """), p AS (SELECT *, row_number() OVER (PARTITION BY source_pmcid ORDER BY query_id) - 1 AS n FROM v_ctx)
    SELECT source_pmcid, n::INT AS paragraph_index, 0 AS sentence_index, 'Claim ' || query_id || ' holds.' AS query, array_to_string(hits, ',') AS hits, n_hits::INT AS n_hits,
           lag('Claim ' || query_id || ' holds.') OVER (PARTITION BY source_pmcid ORDER BY query_id) AS context FROM p""")
def jats_parse(s, d):
    """Articles written as XML from the orders, and parsed into contexts again. Labels are places in the bibliography: a label has up to four digits."""
    listed = views.sources(s, d).groupBy("source_pmcid").agg(F.array_sort(F.collect_list(F.struct("ref_ordinal", "pmid"))).alias("r")).select("source_pmcid", F.col("r.pmid").alias("refs"))
    queries = views.contexts(s, d).groupBy("source_pmcid").agg(F.array_sort(F.collect_list(F.struct("query_id", "hits"))).alias("queries"))
    joined = dealt(queries.join(listed, "source_pmcid"), 500, t(s, d, "customer"))
    label = lambda h: F.array_position("refs", h).cast("string")
    cite = lambda hits: F.array_join(F.transform(hits, lambda h: F.concat(F.lit('<xref ref-type="bibr" rid="R'), h, F.lit('">'), label(h), F.lit("</xref>"))), ",")
    para = F.transform("queries", lambda q: F.concat(F.lit("<p>Claim "), q["query_id"].cast("string"), F.lit(" holds ["), cite(q["hits"]), F.lit("]. Another follows.</p>")))
    ref = lambda p, i: F.concat(F.lit('<ref id="R'), p, F.lit('"><label>'), (i + 1).cast("string"), F.lit('</label><element-citation><article-title>T</article-title><year>2001</year><pub-id pub-id-type="pmid">'), p, F.lit("</pub-id></element-citation></ref>"))
    xml = F.concat(F.lit('<article xmlns="http://jats.nlm.nih.gov"><front><article-meta><article-id pub-id-type="pmcid">'), "source_pmcid", F.lit("</article-id></article-meta></front><body><sec><title>S</title>"), F.array_join(para, ""), F.lit("</sec></body><back><ref-list>"), F.array_join(F.transform("refs", ref), ""), F.lit("</ref-list></back></article>"))
    files = joined.select(F.col("source_pmcid").alias("pmcid"), F.concat("source_pmcid", F.lit(".nxml")).alias("path"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"), F.encode(xml, "UTF-8").alias("content"))
    found, _ = articles.contexts(articles.parse(files))
    return found.select("source_pmcid", "paragraph_index", "sentence_index", "query", F.array_join("hits", ",").alias("hits"), "n_hits", "context")


def _pubmed(s, d):
    rows = dealt(t(s, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")).select(F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), F.col("p_partkey").cast("string"), F.lit("</PMID><Article><Abstract><AbstractText Label=\"NAME\">"), _escaped(F.col("p_name")),
        F.lit("</AbstractText><AbstractText>"), _escaped(F.col("p_type")), F.lit("</AbstractText></Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName UI=\"D"), F.col("p_size").cast("string"),
        F.lit("\" MajorTopicYN=\"Y\">"), _escaped(F.col("p_brand")), F.lit("</DescriptorName><QualifierName UI=\"Q1\" MajorTopicYN=\"N\">use</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></PubmedArticleSet>"),
    ).alias("content"))
    return rows


@query("SELECT p_partkey::VARCHAR AS pmid, 'D' || p_size AS descriptor_ui, p_brand AS descriptor_name, true AS descriptor_major_topic, 'Q1' AS qualifier_ui, 'use' AS qualifier_name, false AS qualifier_major_topic FROM part")
def pubmed_terms(s, d):
    return biblio.mesh_terms(_pubmed(s, d))


@query("SELECT p_partkey::VARCHAR AS pmid, 'NAME: ' || p_name || chr(10) || p_type AS abstract FROM part")
def pubmed_abstracts(s, d):
    return biblio.abstracts(_pubmed(s, d))


class _Rule:
    """A stand-in for a language model: a first-word anaphor is linked to the first word of the context."""

    class Doc:
        def __init__(self, clusters):
            self._ = type("Extensions", (), {"coref_clusters": clusters})()

    def pipe(self, texts, *, batch_size):
        for x in texts:
            border = x.find("\x1e")
            word = x[border + 2 :].split(" ", 1)[0]
            yield self.Doc([[(0, max(1, x.find(" "))), (border + 2, border + 2 + len(word))]])


@query(rf"""SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    WHERE before IS NOT NULL AND regexp_matches(lower(split_part(text, ' ', 1)), '^\s*(?:{_phrases(fixed.ANAPHORIC_STARTS)})(?:$|[ ,:;])')""")
def coref_filter(s, d):
    """Turns of conversations that refer back to the turn before."""
    from pyspark.sql import Window

    c = t(s, d, "conversations").withColumn("context", F.concat(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("\x1e")))
    return coreferent_keys(c.withColumnRenamed("text", "query"), _Rule, ("conv_id", "turn"))


@query()
def pages_text(s, d):
    """Plain text of pages by the tolerant reader."""

    @F.pandas_udf("string")
    def plain(x: pd.Series) -> pd.Series:
        from ..jats.reader import flatten, read

        def one(page):
            try:
                return flatten(read((page or "").encode())[0])
            except ValueError:
                return None

        return x.map(one)

    return t(s, d, "pages").select("page_id", plain("html").alias("text"))
