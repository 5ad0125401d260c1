import pytest
from pyspark.sql import functions as F

from citeset.functions import people, text
from citeset.operators import decoys, spoilers, stats
from citeset.operators.filters import QueryFilters, coreferent_keys
from citeset.sources import biblio, export, ontology
from citeset.streaming import ingest

KEY = ("query_id",)


@pytest.fixture(scope="module")
def small(spark):
    contexts = spark.createDataFrame(
        [
            (1, "A", "Clean query.", ["1"], 1),
            (2, "A", "Smith reported the effect.", ["2"], 1),
            (3, "A", "Seen by Jones et al. before.", ["1"], 1),
            (4, "A", "Known as (Brown, 2011) said.", ["1"], 1),
            (5, "B", "Doe told it.", ["3"], 1),
            (6, "A", None, ["1", "2"], 2),
        ],
        "query_id long, source_pmcid string, query string, hits array<string>, n_hits int",
    )
    sources = spark.createDataFrame(
        [("A", "1", ["Roe J"], 0), ("A", "2", ["Black K"], 1), ("A", "4", ["Smith A"], 2), ("B", "3", ["Doe J. B."], 0), ("B", None, ["X Y"], 1)],
        "source_pmcid string, pmid string, authors array<string>, ref_ordinal int",
    )
    metadata = spark.createDataFrame([("A", ["Black K"]), ("B", ["Z Z"])], "pmcid string, authors array<string>")
    return QueryFilters(contexts, sources, metadata, KEY)


def ids(chain):
    return sorted(r[0] for r in chain.df.select("query_id").collect())


def test_chain(small):
    assert ids(small.min_hit_queries(1).no_et_al()) == [1, 2, 4, 5]
    assert ids(small.no_explicit_spoilers()) == [1, 2, 6]
    assert ids(small.no_self_citations()) == [1, 3, 4, 5]
    assert ids(small.min_source_count(2)) == [1, 2, 3, 4, 6]
    assert ids(small.max_strangeness(0.3)) == [1, 2, 3, 4, 5]
    split = small.no_citation_spoilers()
    assert sorted(r[0] for r in split.rejected.select("query_id").collect()) == [3, 4, 5]
    chain = small.min_hit_queries(1)
    chain.df.collect()
    assert chain.counts() == [("hits", 6, 5)]
    assert ids(split.reset()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="between"):
        small.max_strangeness(2)
    with pytest.raises(ValueError, match="at least"):
        small.min_source_count(0)


def test_gate(small):
    with pytest.raises(spoilers.CitationSpoilerError, match="et al"):
        small.min_hit_queries(1).assert_no_citation_spoilers()
    assert small.min_hit_queries(1).no_citation_spoilers().assert_no_citation_spoilers()
    with pytest.raises(TypeError):
        spoilers.assert_no_residual_spoilers(small.df, "n_hits")


def test_incomplete_metadata(small, spark):
    c = spark.createDataFrame([(1, "A", "Fine.", ["9"], 1), (2, "A", "Fine.", ["1"], 1)], small.df.schema)
    kept, lost = spoilers.split_spoilers(c, small.sources, KEY, require_complete_author_metadata=True)
    assert [r[0] for r in kept.select("query_id").collect()] == [2]
    assert lost.first()["citation_spoiler_reasons"] == ["incomplete_positive_author_metadata"]


@pytest.mark.parametrize(
    ("query", "reasons"),
    [
        ("The share (2.5%) and (75 nmol/L) fell.", []),
        ("As [3, 7-9] show; doi: 10.1/x; in press.", ["numeric_citation", "bibliographic_identifier", "nonpublic_citation"]),
        ("Nordin and Ek (2011a) did", ["narrative_author_year"]),
        ("Nordin, 2011 did (e.g.,) ▸ [xref:R1]", ["unwrapped_author_year", "empty_citation_placeholder", "publisher_artifact", "internal_xref_marker"]),
        ("(see Nordin and Ek, 2011)", ["parenthetical_author_year"]),
    ],
)
def test_reasons(spark, query, reasons):
    assert spark.range(1).select(spoilers.residual_reasons(F.lit(query))).first()[0] == reasons


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.strip_connectives(F.lit("However, in addition: the  cells grew."))) == "The cells grew."
    assert one(text.strip_connectives(F.lit("Thus"))) == ""
    assert one(text.matching_prefix(F.lit("In Addition, x"), ("in", "in addition"))) == "In Addition"
    assert one(text.starts_with_phrase(F.lit("This. is"), ("this",))) is False
    assert one(text.coerce_pmid(F.lit(" 31.0 "))) == "31"
    assert one(text.coerce_pmid(F.lit("  "))) is None
    assert one(text.parse_hits(F.lit("['1', '2', '1']"))) == ["1", "2", "1"]
    assert one(text.word_count(F.lit(" a\tb  c "))) == 3
    assert one(text.strangeness(F.lit(None).cast("string"))) == 1.0
    assert one(people.normal_form(F.lit("van der Berg J"))) == "van dBJ"
    assert one(people.parse_authors(F.lit("('Roe J', 'Doe K',)"))) == ["Roe J", "Doe K"]
    assert one(people.parse_authors(F.lit("Roe J, Doe K"))) == ["Roe J", "Doe K"]
    with pytest.raises(Exception, match="not a list"):
        one(text.parse_hits(F.lit("['1', ")))


def test_decoys(spark):
    c = spark.createDataFrame([(1, "A", ["10"]), (2, "A", ["11"])], "query_id long, source_pmcid string, hits array<string>")
    s = spark.createDataFrame([("A", x, i) for i, x in enumerate(("10", "11", "12"))], "source_pmcid string, pmid string, ref_ordinal int")
    for mode in ("exact", "components"):
        got = {r[0]: r[1] for r in decoys.shared_decoys(c, s, 2, mode=mode).collect()}
        assert got == {1: ["11", "12"], 2: ["10", "12"]}
    with pytest.raises(decoys.DecoyError):
        decoys.shared_decoys(c, s, 3)


def test_shared_references_are_reused(spark):
    c = spark.createDataFrame([(i, a, [f"h{i}"]) for i, a in ((1, "A"), (2, "B"), (3, "C"))], "query_id long, source_pmcid string, hits array<string>")
    s = spark.createDataFrame([(a, p, i) for a in "ABC" for i, p in enumerate(("1", "2", f"{a}x"))], "source_pmcid string, pmid string, ref_ordinal int")
    got = {r[0]: r[1] for r in decoys.shared_decoys(c, s, 2, mode="exact").collect()}
    assert got == dict.fromkeys((1, 2, 3), ["1", "2"])


class Model:
    def pipe(self, texts, *, batch_size):
        for t in texts:
            spans = [[(0, 5), (t.index("|") + 2, len(t))]] if "|" in t else []
            yield type("D", (), {"_": type("U", (), {"coref_clusters": spans})()})()


def test_coreference(spark):
    rows = spark.createDataFrame([(1, "Cells. |", "these"), (2, "Cells.", "these"), (3, None, "these"), (4, "Cells. |", "mice"), (5, " \t", "these"), (6, "Cells. |", " ")], "query_id long, context string, query string")
    assert [r[0] for r in coreferent_keys(rows, Model, KEY).collect()] == [1]


def test_stats(spark):
    df = spark.createDataFrame([(0,), (1,), (24,), (25,), (500,)], "n int")
    assert [r["n"] for r in stats.histogram(df, "n").orderBy("bin").collect()] == [1, 1, 0, 1, 1, 0, 0, 1]
    assert stats.eligible_share(df, "n").first() == (2, 40.0)
    with pytest.raises(ValueError, match="odd"):
        stats.assert_all(df, F.col("n") < 100, "odd")


PUBMED = b"""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Abstract><AbstractText Label="AIM">To <i>see</i>.</AbstractText><AbstractText>Seen.</AbstractText></Abstract></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="Y">Cats</DescriptorName><QualifierName UI="Q1" MajorTopicYN="N">care</QualifierName><QualifierName UI="Q2" MajorTopicYN="Y">diet</QualifierName></MeshHeading><MeshHeading><DescriptorName UI="D2" MajorTopicYN="N">Dogs</DescriptorName></MeshHeading><MeshHeading/></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_records(spark):
    p = spark.createDataFrame([(bytearray(PUBMED),)], "content binary")
    assert biblio.mesh_terms(p).count() == 3
    assert biblio.mesh_terms(p, include_qualifiers=False).count() == 2
    assert {r[0]: r[1] for r in biblio.abstracts(p).collect()} == {"1": "AIM: To see.\nSeen.", "2": None}
    tree = spark.createDataFrame([("D1", "a", "A01"), ("D2", "b", "A01.111"), ("D2", "b", "B02.222.333")], "ui string, name string, tree_number string")
    assert [r[0] for r in biblio.tree_level(tree, 2).collect()] == ["D2"]
    with pytest.raises(ValueError, match="level"):
        biblio.tree_level(tree, 3)


def test_descriptors(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<DescriptorRecordSet><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Cats</String></DescriptorName><TreeNumberList><TreeNumber>A01</TreeNumber><TreeNumber>B01.1</TreeNumber></TreeNumberList></DescriptorRecord></DescriptorRecordSet>")
    assert sorted(map(tuple, biblio.descriptors(spark, str(tmp_path / "d.xml")).collect())) == [("D1", "Cats", "A01"), ("D1", "Cats", "B01.1")]


def test_ontology(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1.2\n\n[Term]\nid: T:1\nname: root\nnamespace: n\ndef: "The root." [x]\n\n[Term]\nid: T:2\nname: mid\nnamespace: n\nis_a: T:1 ! root\n\n[Term]\nid: T:3\nname: low\nnamespace: n\nis_a: T:2 ! mid\nis_a: T:1 ! root\n\n[Term]\nid: T:4\nname: gone\nnamespace: n\nis_obsolete: true\n\n[Typedef]\nid: part_of\n')
    terms, edges = ontology.read_obo(spark, str(tmp_path / "x.obo"))
    got = ontology.terms_up_to(terms, edges, 1).collect()
    assert [(r["go_id"], r["level"], r["depth"]) for r in got] == [("T:1", 0, 0), ("T:2", 1, 1), ("T:3", 1, 2)]
    assert [r["go_id"] for r in ontology.terms_up_to(terms, edges, 1, "depth").collect()] == ["T:1", "T:2"]
    with pytest.raises(ValueError, match="negative"):
        ontology.terms_up_to(terms, edges, -1)


DOC = '<article xmlns="u"><front><article-meta><article-id pub-id-type="pmcid">{0}</article-id></article-meta></front><body><sec><title>S</title><p>First <xref ref-type="bibr" rid="r1">1</xref>. Second <xref ref-type="bibr" rid="r1">1</xref>. As <xref ref-type="bibr" rid="r2">Doe, 2001</xref> said.</p></sec></body><back><ref-list><ref id="r1"><label>1</label><element-citation><pub-id pub-id-type="pmid">11</pub-id></element-citation></ref><ref id="r2"><label>2</label><element-citation><pub-id pub-id-type="pmid">22</pub-id></element-citation></ref></ref-list></back></article>'


def test_ingestion(spark, tmp_path):
    xml = tmp_path / "xml_jats"
    xml.mkdir()
    (xml / "PMC1.nxml").write_text(DOC.format("PMC1"))
    (xml / "PMC2.nxml").write_text(DOC.format("PMC9"))
    got = {r["pmcid"]: r for r in ingest.ingest(spark, str(tmp_path)).collect()}
    assert (got["PMC1"]["status"], got["PMC1"]["n_contexts"], got["PMC1"]["n_unsafe"]) == ("complete", 2, 1)
    assert got["PMC2"]["status"] == "parse_error"
    rows = ingest.load_table(spark, str(tmp_path), "contexts").orderBy("sentence_index").collect()
    assert [(r["query"], r["hits"], r["context"]) for r in rows] == [("First.", ["11"], None), ("Second.", ["11"], "First.")]
    layout = ingest.Layout(str(tmp_path))
    from citeset.sources import articles

    todo = ingest.to_process(articles.scan(spark, layout.xml), ingest.read_status(spark, layout))
    assert [r["pmcid"] for r in todo.select("pmcid").collect()] == ["PMC2"]
    (xml / "PMC2.nxml").write_text(DOC.format("PMC2"))
    ingest.ingest(spark, str(tmp_path), delete_sources=True)
    assert not (xml / "PMC2.nxml").exists()
    assert ingest.load_table(spark, str(tmp_path), "metadata").count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "xml_jats").mkdir()
    (tmp_path / "xml_jats" / "PMC1.nxml").write_text(DOC.format("PMC1"))
    ingest.stream(spark, str(tmp_path)).awaitTermination()
    (tmp_path / "xml_jats" / "PMC3.nxml").write_text(DOC.format("PMC3"))
    ingest.stream(spark, str(tmp_path)).awaitTermination()
    assert ingest.load_table(spark, str(tmp_path), "metadata").count() == 2
    assert ingest.read_status(spark, ingest.Layout(str(tmp_path))).count() == 2


def test_legacy_csv(spark, tmp_path):
    (tmp_path / "extracted_contexts.csv").write_text("query,hits,n_hits,source_pmcid\nClean.,\"['1', '2']\",2,PMC1\n")
    (tmp_path / "extracted_sources.csv").write_text("source_pmcid,pmid,authors\nPMC1,1.0,\"['Roe J']\"\nPMC1,,\"Doe K, Poe L\"\n")
    with pytest.raises(FileNotFoundError):
        export.read_legacy(spark, str(tmp_path))
    (tmp_path / "extracted_metadata.csv").write_text("abstract,authors,pmcid,pmid,title\nx,\"['Roe J']\",PMC1,5.0,t\n")
    c, s, m = export.read_legacy(spark, str(tmp_path))
    assert (c.first()["hits"], m.first()["pmid"]) == (["1", "2"], "5")
    assert sorted(((r["pmid"] or "", r["authors"]) for r in s.collect())) == [("", ["Doe K", "Poe L"]), ("1", ["Roe J"])]


def test_article_groups_of_a_long_chain(spark):
    edges = [(f"A{i:03}", f"r{i + k}") for i in range(120) for k in (0, 1)] + [("B1", "s"), ("B2", "s"), ("C", "t")]
    found = decoys.article_groups(spark.createDataFrame(edges, "source_pmcid string, pmid string")).collect()
    assert {(x["source_pmcid"], x["part"]) for x in found} == {(f"A{i:03}", "A000") for i in range(120)} | {("B1", "B1"), ("B2", "B1"), ("C", "C")}
    assert len(found) == 123


def covered(options, n):
    """Brute force: the list of waiting references is sorted anew for every one that is looked at."""
    users = {}
    for q, refs in options.items():
        for r in refs:
            users.setdefault(r, set()).add(q)
    need, taken = dict.fromkeys(options, n), []
    waiting = [(len(q), len(q), r) for r, q in users.items()]
    while any(need.values()):
        waiting.sort(key=lambda x: (-x[0], -x[1], x[2]))
        _, size, r = waiting.pop(0)
        gain = sum(need[q] > 0 for q in users[r])
        if gain and waiting and waiting[0][0] > gain:
            waiting.append((gain, size, r))
        elif gain:
            taken.append(r)
            for q in users[r]:
                need[q] = max(0, need[q] - 1)
    chosen = set(taken)
    for r in reversed(taken):
        if all(len(chosen & set(options[q])) > n for q in users[r]):
            chosen.discard(r)
    return {q: [r for r in refs if r in chosen][:n] for q, refs in options.items()}


def test_shared_decoys_equal_brute_force(spark):
    from citeset.plans import catalogue, views

    sf = "/root/testdata/sf0.001"
    rows = decoys.decoy_options(catalogue._benchmark(spark, sf), views.sources(spark, sf)).collect()
    parts = {}
    for x in rows:  # articles that share a reference are one part
        own = {x["query_id"]}
        refs = set(x["options"])
        for key in [k for k, (_, r) in parts.items() if r & refs]:
            q, r = parts.pop(key)
            own, refs = own | q, refs | r
        parts[x["query_id"]] = (own, refs)
    want = {}
    for queries, _ in parts.values():
        want |= covered({x["query_id"]: x["options"] for x in rows if x["query_id"] in queries}, 19)
    got = {x["query_id"]: x["selected_decoys"].split(",") for x in catalogue.shared_decoys(spark, sf).collect()}
    assert got == want
    assert len(got) > 50


def test_cover_equals_brute_force():
    import random

    import pandas as pd

    for seed in range(60):
        r = random.Random(seed)
        options = {q: [f"{x:02}" for x in sorted(r.sample(range(25), r.randint(4, 12)))] for q in range(r.randint(1, 15))}
        edges = pd.DataFrame([(q, x) for q, refs in options.items() for x in refs], columns=["query", "pmid"])
        chosen = set(decoys._cover(edges.sample(frac=1, random_state=seed), 4)["pmid"])
        assert {q: [x for x in refs if x in chosen][:4] for q, refs in options.items()} == covered(options, 4)


def test_soft_sample_on_a_ring_of_many_blocks(spark, monkeypatch):
    """Small blocks, so that queries ask for more of them."""
    import hashlib

    monkeypatch.setattr(decoys, "BLOCK", 4)
    hard = [(q, f"A{q % 3}", [f"p{q}"], [f"d{(7 * q + i) % 60}" for i in range(5)]) for q in range(20)] + [(99, "Z", ["d1"], [])]
    df = spark.createDataFrame(hard, "query_id long, source_pmcid string, hits array<string>, decoys array<string>")
    marked = [f"d{i}" for i in range(0, 60, 4)]
    every = {d for x in hard for d in x[3]}
    h = lambda s: hashlib.md5(s.encode()).hexdigest()  # noqa: E731, S324
    want = {}
    for q, article, hits, _ in hard:
        without = {d for x in hard if x[1] == article for d in x[3]} | set(hits)
        drawn = []
        for kind in (True, False):
            pool = [d for d in every if (d in marked) == kind]
            ring = -(-len(pool) // 4)
            block = lambda s, ring=ring: int(h(s)[:8], 16) * ring >> 32
            drawn += sorted((d for d in pool if d not in without), key=lambda d: ((block(f"42:{d}") - block(f"42/{q}")) % ring, h(f"42:{d}")))
        want[q] = drawn[:9]
    got = {x["query_id"]: x["soft"] for x in decoys.soft_sample(df, spark.createDataFrame([(x,) for x in marked], "pmid string"), 9, 42).collect()}
    assert got == {q: x for q, x in want.items() if x}


def test_graphs_with_cycles_raise(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    edges = lambda *e: spark.createDataFrame(list(e), "child long, parent long")
    chain = ontology.levels(nodes, edges((1, 0), (2, 1), (3, 2), (3, 0), (4, 99))).collect()
    assert sorted(map(tuple, chain)) == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 1, 3), (4, 0, 0), (5, 0, 0)]
    with pytest.raises(ValueError, match="cycle"):
        ontology.levels(nodes, edges((1, 0), (2, 1), (1, 2)))


def test_bad_payloads_have_a_status(spark):
    p = spark.createDataFrame([(bytearray(PUBMED),), (bytearray(b"<a"),)], "content binary")
    assert biblio.mesh_terms(p).count() == 3
    assert sorted(x["status"] for x in biblio.payload_status(p).collect()) == ["complete", "parse_error"]


def test_batches_and_ids(spark):
    got = stats.batches(spark.createDataFrame([(i % 50,) for i in range(120)], "n int"), "n", 50).groupBy("batch").count().collect()
    assert {x["batch"]: x["count"] for x in got} == {0: 50, 1: 50, 2: 20}
    raw = spark.createDataFrame([("pmc2", 0), (" 1 ", 1), ("PMC2", 2)], "id string, n int")
    assert sorted(map(tuple, text.stable_ids(raw, "id", "n").collect())) == [("PMC1", 1), ("PMC2", 0)]
    with pytest.raises(Exception, match="not an article id"):
        text.stable_ids(spark.createDataFrame([("x", 0)], "id string, n int"), "id", "n").collect()
    one = spark.range(1).select(text.oai_url(F.lit("PMC7"), "http://h/"), text.article_path(F.lit("PMC7"), "/x/")).first()
    assert tuple(one) == ("http://h/?verb=GetRecord&identifier=oai%3Apubmedcentral.nih.gov%3A7&metadataPrefix=pmc", "/x/PMC7.nxml")


def test_ingestion_by_ids(spark, tmp_path, monkeypatch):
    from citeset.sources import connectors as net

    (tmp_path / "xml_jats").mkdir()
    (tmp_path / "xml_jats" / "PMC1.nxml").write_text(DOC.format("PMC1"))
    wrap = lambda x: f'<OAI-PMH xmlns="o">{x}</OAI-PMH>'.encode()
    asked = []

    def send(method, url, params):
        key = params["identifier"].rpartition(":")[2]
        asked.append(key)
        if key == "2":
            return 200, wrap("<GetRecord><record><metadata>" + DOC.format("PMC2") + "</metadata></record></GetRecord>")
        if key == "5":
            return 200, wrap("<GetRecord><record><metadata>" + DOC.format("PMC99") + "</metadata></record></GetRecord>")
        return (404, b"") if key == "6" else (200, wrap('<error code="idDoesNotExist">no</error>' if key == "3" else '<error code="noFulltext">no</error>'))

    said = []
    run = lambda ids: {r["pmcid"]: r["status"] for r in ingest.ingest_ids(spark, str(tmp_path), ids, net.Client(send, net.Spacing(0.0), tries=1), lambda c, n, t: said.append((dict(c), n, t)), at_once=2).collect()}
    want = {"PMC1": "complete", "PMC2": "complete", "PMC3": "not_found", "PMC4": "no_fulltext", "PMC5": "parse_error", "PMC6": "download_error"}
    assert run(["pmc2", "PMC1", "3", "4", "5", "6", "2"]) == want
    assert sorted(asked) == ["2", "3", "4", "5", "6"]
    assert said[-1] == ({"complete": 2, "not_found": 1, "no_fulltext": 1, "parse_error": 1, "download_error": 1}, 6, 6)
    assert [n for _, n, _ in said] == sorted(n for _, n, _ in said)
    asked.clear()
    said.clear()
    assert run(["PMC1", "PMC2"]) == want
    assert not asked
    assert said[-1][0]["complete"] == 2
    assert ingest.load_table(spark, str(tmp_path), "metadata").count() == 2
    # A complete status without its tables doesn't count.
    layout = ingest.Layout(str(tmp_path))
    import shutil

    shutil.rmtree(layout.table("sentences"))
    assert ingest.reusable(spark, layout).where("status = 'complete'").count() == 0


def test_tables_that_cannot_be_written(spark, tmp_path, monkeypatch):
    (tmp_path / "xml_jats").mkdir()
    (tmp_path / "xml_jats" / "PMC1.nxml").write_text(DOC.format("PMC1"))
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "sources").write_text("in the way")
    got = ingest.ingest(spark, str(tmp_path)).collect()
    assert [(r["pmcid"], r["status"]) for r in got] == [("PMC1", "persist_error")]
    assert "sources" in got[0]["reason"]
    (tmp_path / "tables" / "sources").unlink()
    assert [r["status"] for r in ingest.ingest(spark, str(tmp_path)).collect()] == ["complete"]
    assert ingest.load_table(spark, str(tmp_path), "metadata").count() == 1
