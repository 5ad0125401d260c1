"""Work grows with the rows and is dealt by them."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeset import staging
from citeset.functions import fixed, text
from citeset.jats.sentences import split
from citeset.operators import decoys, spoilers
from citeset.plans import article_queries, catalogue, python_queries
from citeset.sources import articles, biblio, export
from citeset.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [article_queries._forms, article_queries._suppliers, python_queries._pubmed])
def test_rows_that_become_documents_are_dealt_by_their_number(spark, rows, monkeypatch):
    monkeypatch.setattr(staging, "ROWS", 3)
    assert rows(spark, SF).rdd.getNumPartitions() >= 3


def test_parsed_articles_come_in_pieces_by_bytes(spark, monkeypatch):
    """One batch of files isn't held parsed as a whole, and every file has its row in its place."""
    monkeypatch.setattr(articles, "AT_ONCE", 40)
    docs = [(f"PMC{i}", f"PMC{i}.nxml", i, None, bytearray(f'<article><front><article-meta><article-id pub-id-type="pmcid">PMC{i}</article-id></article-meta></front></article>'.encode()) if i % 3 else None) for i in range(20)]
    files = spark.createDataFrame(docs, "pmcid string, path string, length bigint, modificationTime timestamp, content binary").coalesce(1)
    got = articles.parse(files).select("pmcid", "length", "status", "metadata.pmcid").collect()
    assert [tuple(x) for x in got] == [(f"PMC{i}", i, "complete" if i % 3 else "parse_error", f"PMC{i}" if i % 3 else None) for i in range(20)]


def test_payloads_are_handed_on_together():
    one = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>{}</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"
    batch = pa.RecordBatch.from_pydict({"content": [one.format(i) if i % 4 else "no XML <" for i in range(40)]})
    got = list(biblio._extracted(biblio.abstract_rows, pa.schema([("pmid", pa.string()), ("abstract", pa.string())]))([batch]))
    assert len(got) == 1
    assert got[0].column("pmid").to_pylist() == [str(i) for i in range(40) if i % 4]


def test_articles_of_high_numbers_equal_their_sql(spark, tmp_path):
    """Ids of more digits than a label has."""
    con = duckdb.connect()
    for name in ("orders", "lineitem", "customer"):
        con.execute(f"COPY (SELECT * {'REPLACE (l_partkey + 20000 AS l_partkey)' if name == 'lineitem' else ''} FROM '{SF}/{name}.parquet') TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    theirs = con.execute(catalogue.ORACLES["jats_parse"])
    names = [c[0] for c in theirs.description]
    ours = catalogue.QUERIES["jats_parse"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, ours), key=repr) == sorted(theirs.fetchall(), key=repr)


def test_a_capital_is_one_letter_as_in_sql(spark):
    letters = ["a", "é", "ǆ", "1", "", *(chr(i) for i in range(0x80, 0x10000) if len(chr(i).upper()) > 1)]
    ours = spark.createDataFrame([(c, c + "ßx") for c in letters], "c string, x string").select("c", text.raise_first(F.col("x"))).collect()
    con = duckdb.connect()
    assert {x[0]: x[1] for x in ours} == {c: con.execute("SELECT upper(left(?, 1)) || substring(?, 2)", [c + "ßx"] * 2).fetchall()[0][0] for c in letters}


def test_cover_looks_at_all_queries_only_once():
    """A reference costs its own queries: 20 times the queries of chosen references cost no more than 40 times as much."""

    def seconds(queries: int) -> float:
        near = np.repeat(np.arange(queries), 8)
        cover, begin = decoys._Cover(near, near * 2 + np.tile(np.arange(8), queries), 4), time.process_time()
        cover.greedy()
        return time.process_time() - begin

    seconds(100)
    assert seconds(40_000) < 40 * seconds(2_000)


def test_texts_come_to_rows_that_have_their_names(spark):
    """With texts added by a function, they aren't moved by the key, and the result is the same."""
    rows = [(1, "A", ["1", "2"], "As Roe-Ek and ROE, 2001"), (2, "A", ["2"], "roed et al."), (3, "A", ["3"], "Straße [3]"), (4, "A", [], None), (5, "A", ["4"], "x.y (2001)"), (6, "A", ["5"], "strasse")]
    contexts = spark.createDataFrame(rows, "query_id int, source_pmcid string, hits array<string>, query string")
    sources = spark.createDataFrame([("A", "1", ["Roe J"]), ("A", "2", ["Ek", "Roe\\E| K"]), ("A", "3", ["straße X"]), ("A", "4", ["x.y A", "xzy B"]), ("A", "5", [])], "source_pmcid string, pmid string, authors array<string>")
    seen = []

    def texts(df):
        seen.append(df.columns)
        return df.join(contexts.select("query_id", "query"), "query_id")

    names = ("query_id", "author_spoiling", "citation_spoiler_reasons", "positive_author_metadata_complete")
    whole = spoilers.annotate_spoilers(contexts, sources, ("query_id",)).select(*names).orderBy("query_id").collect()
    apart = spoilers.annotate_spoilers(contexts.drop("query"), sources, ("query_id",), texts=texts).select(*names).orderBy("query_id").collect()
    assert apart == whole
    assert [x[1] for x in whole] == [True, False, True, False, True, False]
    for both in zip(spoilers.split_spoilers(contexts, sources, ("query_id",)), spoilers.split_spoilers(contexts.drop("query"), sources, ("query_id",), texts=texts), strict=True):
        one, other = (sorted(map(str, df.select("query_id", "query", "citation_spoiler_reasons").collect())) for df in both)
        assert one == other
    assert "query" not in seen[0]
    assert {"_names", "_known"} <= set(seen[0])


def test_what_is_looked_for_first_loses_no_match(spark):
    rng = random.Random(5)
    parts = ["(", ")", "[", "]", "Ek", " and ", "2001", "1899a", ", ", " et al.", " ET AL. ", "3", "–", "doi: 10.1/x", "PMID:7", "unpublished data", "in  PRESS", "(e.g., )", "▸", "[xref:R1]", "[XREF:r 2", "é", " ", "٣", "．"]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 7))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "q string")
    wrong = [name for name, p in fixed.RESIDUAL_PATTERNS.items() if df.where(spoilers._has(F.col("q"), name) != F.col("q").rlike(p)).count()]
    assert wrong == []


def test_sentences_are_handed_on_by_pieces(monkeypatch):
    monkeypatch.setattr(python_queries, "AT_ONCE", 30)
    texts = ["One is here. Two is there.", None, "", "Alone", "A long one stands here. And more. And more."] * 3
    got = list(python_queries._sentences([pa.RecordBatch.from_pydict({"doc_id": list(range(15)), "text": texts})]))
    assert len(got) > 3
    rows = [(i, n, x) for i, text in enumerate(texts) for n, x in enumerate(split(text or ""))]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows


def test_articles_are_written_by_their_tasks(spark, tmp_path):
    """And only a batch's own files are looked up when ids are ingested."""
    files = spark.createDataFrame([(f"PMC{i}", bytearray(b"x%d" % i)) for i in range(10)], "pmcid string, content binary").repartition(4)
    assert ingest.write_articles(files, f"file://{tmp_path}") == 10
    assert {p.name: p.read_bytes() for p in (tmp_path / "xml_jats").iterdir()} == {f"PMC{i}.nxml": b"x%d" % i for i in range(10)}


def test_sentence_folders_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """Adaptive execution would make one task of so few bytes."""
    tasks = []

    def dealt(df, **given):
        out = staging.dealt(df, 10, **given)
        tasks.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(export, "dealt", dealt)
    rows = spark.range(60).selectExpr("concat('PMC', id) AS pmcid", "0 AS section_index", "0 AS paragraph_index", "0 AS sentence_index", "'x' AS text")
    export.write_sentences(rows, f"file://{tmp_path}/out")
    assert tasks[0] >= 6
    assert spark.read.text(f"file://{tmp_path}/out").select("pmcid", "value").distinct().count() == 60


def test_descriptors_are_several_files(spark, monkeypatch):
    """A file without end is read by few tasks."""
    monkeypatch.setattr(staging, "ROWS", 50)
    assert len(catalogue.QUERIES["descriptor_file"](spark, SF).inputFiles()) >= 4
