"""Queries over articles written as XML from the driver's tables and parsed again, and over files written and read back.

The input is made of numbers, so SQL can state what parsing, citation rules and files must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import people, text
from ..jats.document import UNTITLED
from ..operators import spoilers, stats
from ..sources import articles, biblio, export, ontology
from ..staging import dealt, new_path
from . import views
from .catalogue import KEY, _chain, _joined, query
from .views import oracle, t


def _xref(rid: Column, shown: Column) -> Column:
    return F.concat(F.lit('<xref ref-type="bibr" rid="'), rid, F.lit('">'), shown, F.lit("</xref>"))


def _article(pmcid: Column, front: Column, body: Column, refs: Column) -> Column:
    parts = F.lit('<article xmlns="http://jats.nlm.nih.gov"><front><article-meta><article-id pub-id-type="pmcid">'), pmcid, F.lit("</article-id>"), front, F.lit("</article-meta></front><body>"), body, F.lit("</body><back><ref-list>"), refs, F.lit("</ref-list></back></article>")
    return F.encode(F.concat(*parts), "UTF-8")


def _files(rows: DataFrame) -> DataFrame:
    """``pmcid, content`` in the shape of a file scan."""
    return rows.select("pmcid", F.concat("pmcid", F.lit(".nxml")).alias("path"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"), "content")


def _numbered(n: Column, label: bool = True) -> Column:
    """A list of n references r1, r2, … with their numbers as labels and ids."""
    tag = lambda i: F.concat(F.lit("<label>"), i, F.lit("</label>")) if label else F.lit("")
    one = lambda i: F.concat(F.lit('<ref id="r'), i, F.lit('">'), tag(i), F.lit('<element-citation><pub-id pub-id-type="pmid">'), i, F.lit("</pub-id></element-citation></ref>"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: one(i.cast("string"))), "")


def _suppliers(s, d) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    who = lambda family, given: F.concat(F.lit('<contrib contrib-type="author"><name><surname>'), family, F.lit("</surname><given-names>"), given, F.lit("</given-names></name></contrib>"))
    front = F.concat(
        F.lit('<article-id pub-id-type="pmid">9'), k, F.lit("</article-id><title-group><article-title>On <i>"), F.col("s_name"), F.lit("</i>\n at  large</article-title></title-group><contrib-group>"),
        who(F.concat(F.lit("Fam"), k), F.lit("Anna Bea")), who(F.lit("Ek"), F.lit("H. N.")), F.lit("</contrib-group><abstract><p>Nation "), F.col("s_nationkey").cast("string"), F.lit(".</p></abstract>"),
    )
    n = (F.col("s_suppkey") % 7 + 3).cast("int")
    ref = lambda i: F.concat(
        F.lit('<ref id="b'), i, F.lit('"><label>['), i, F.lit('].</label><mixed-citation><person-group><name><surname>Roe</surname><given-names>Jo Kim</given-names></name></person-group><article-title>Part '), i,
        F.lit("</article-title><source>J</source><year>200"), i, F.lit('</year><pub-id pub-id-type="pmid">'), i, k, F.lit("</pub-id> doi:10.1234/x."), i, F.lit(").</mixed-citation></ref>"),
    )
    refs = F.concat(F.lit('<ref id="none"><label>0</label></ref>'), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: ref(i.cast("string"))), ""))
    body = F.concat(
        F.lit("<p>Loose "), k, F.lit(".</p><sec><title>Main</title><p>First "), _xref(F.lit("b1"), F.lit("1")), F.lit(". Second "), k, F.lit(".</p><sec><title>Inner</title><p>Deep "), k,
        F.lit(".</p></sec><fig><label>Fig. 1</label><caption><p>Seen "), k, F.lit(".</p></caption></fig></sec><sec><p>Untold "), k, F.lit(".</p></sec>"),
    )
    return _files(dealt(t(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")).select(F.concat(F.lit("PMC"), k).alias("pmcid"), _article(F.concat(F.lit("PMC"), k), front, body, refs).alias("content")))


@query("""SELECT 'PMC' || s_suppkey AS pmcid, '9' || s_suppkey AS pmid, 'On ' || s_name || ' at large' AS title, 'Nation ' || s_nationkey || '.' AS abstract, 'Fam' || s_suppkey || ' AB,Ek HN' AS authors FROM supplier""")
def jats_metadata(s, d):
    """Metadata and authors of articles."""
    return articles.metadata(articles.parse(_suppliers(s, d))).select("pmcid", "pmid", "title", "abstract", _joined(F.col("authors")).alias("authors"))


@query("""SELECT 'PMC' || s_suppkey AS source_pmcid, 'b' || i AS rid, '[' || i || '].' AS label, '10.1234/x.' || i AS doi, i || '' || s_suppkey AS pmid, NULL::VARCHAR AS pmcid, 2000 + i AS year, 'Part ' || i AS title, 'J' AS journal, 'Roe JK' AS authors, i AS ref_ordinal
    FROM (SELECT s_suppkey, unnest(range(1, s_suppkey % 7 + 4))::INT AS i FROM supplier)""")
def jats_sources(s, d):
    """Bibliography entries: ids of each kind, year, names; an entry without a citation is skipped but has its place."""
    rows = articles.sources(articles.parse(_suppliers(s, d)))
    return rows.select("source_pmcid", "rid", "label", "doi", "pmid", "pmcid", "year", "title", "journal", _joined(F.col("authors")).alias("authors"), "ref_ordinal")


@query(f"""SELECT 'PMC' || s_suppkey AS pmcid, s AS section_index, p AS paragraph_index, n AS sentence_index, replace(x, '@', s_suppkey::VARCHAR) AS text FROM supplier,
    (VALUES (0, 0, 0, '{UNTITLED}', 'Loose @.'), (1, 0, 0, 'Main > Inner', 'Deep @.'), (2, 0, 0, 'Main', 'First [xref:b1].'), (2, 0, 1, 'Main', 'Second @.'), (2, 1, 0, 'Main', 'Fig. 1 Seen @.'), (3, 0, 0, '{UNTITLED}', 'Untold @.')) v(s, p, n, sec, x)""")
def jats_sentences(s, d):
    """Sections in order, sub-sections first, captions as blocks of their own, sentences with markers."""
    return articles.sentences(articles.parse(_suppliers(s, d)))


def _cited(s, d, body, refs) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    rows = dealt(t(s, d, "part").select("p_partkey", "p_size"))
    return articles.parse(_files(rows.select(F.concat(F.lit("PMC"), k).alias("pmcid"), _article(F.concat(F.lit("PMC"), k), F.lit(""), F.concat(F.lit("<sec><title>S</title><p>"), body, F.lit("</p></sec>")), refs).alias("content"))))


def _contexts(parsed: DataFrame) -> DataFrame:
    rows, _ = articles.contexts(parsed)
    return rows.select("source_pmcid", "query", _joined(F.col("hits")).alias("hits"), F.col("n_hits").cast("long").alias("n_hits"))


_RANGE = "SELECT p_partkey, p_size % 9 + 1 AS a, p_size % 9 + 1 + p_partkey % 6 AS b FROM part"


@query(f"SELECT 'PMC' || p_partkey AS source_pmcid, 'Claim ' || p_partkey || ' holds.' AS query, array_to_string(range(a, b + 1), ',') AS hits, b - a + 1 AS n_hits FROM ({_RANGE})")
def citation_ranges(s, d):
    """Ranges between two marks, by labels."""
    a, b = (F.col("p_size") % 9 + 1).cast("string"), (F.col("p_size") % 9 + 1 + F.col("p_partkey") % 6).cast("string")
    body = F.concat(F.lit("Claim "), F.col("p_partkey").cast("string"), F.lit(" holds ["), _xref(F.concat(F.lit("r"), a), a), F.lit("–"), _xref(F.concat(F.lit("r"), b), b), F.lit("]."))
    return _contexts(_cited(s, d, body, _numbered(F.lit(15))))


@query(f"SELECT 'PMC' || p_partkey AS source_pmcid, 'Claim ' || p_partkey || ' holds.' AS query, array_to_string(range(a, b + 1), ',') AS hits, b - a + 1 AS n_hits FROM ({_RANGE})")
def citation_ranges_by_order(s, d):
    """The same where no reference has a label: by place in the bibliography."""
    a, b = (F.col("p_size") % 9 + 1).cast("string"), (F.col("p_size") % 9 + 1 + F.col("p_partkey") % 6).cast("string")
    body = F.concat(F.lit("Claim "), F.col("p_partkey").cast("string"), F.lit(" holds ["), _xref(F.concat(F.lit("r"), a), a), F.lit("-"), _xref(F.concat(F.lit("r"), b), b), F.lit("]."))
    return _contexts(_cited(s, d, body, _numbered(F.lit(15), label=False)))


@query(f"""SELECT 'PMC' || p_partkey AS source_pmcid, 'Claim ' || p_partkey || ' holds.' AS query,
    CASE p_partkey % 3 WHEN 0 THEN array_to_string(range(a, b + 1), ',') WHEN 1 THEN CASE WHEN a = b THEN a::VARCHAR ELSE a || ',' || b END ELSE b || ',' || (b + 1) || ',' || (b + 2) END AS hits,
    CASE p_partkey % 3 WHEN 0 THEN b - a + 1 WHEN 1 THEN CASE WHEN a = b THEN 1 ELSE 2 END ELSE 3 END AS n_hits FROM ({_RANGE})""")
def citation_lists(s, d):
    """One mark that shows a range or a list: by labels, and without labels by the distance from its own reference."""
    a, b = F.col("p_size") % 9 + 1, F.col("p_size") % 9 + 1 + F.col("p_partkey") % 6
    text_of = lambda c: c.cast("string")
    kind = F.col("p_partkey") % 3
    shown = F.when(kind == 0, F.concat(text_of(a), F.lit("-"), text_of(b))).when(kind == 1, F.concat(text_of(a), F.lit(" and "), text_of(b))).otherwise(F.concat(text_of(b), F.lit(", "), text_of(b + 1), F.lit(", "), text_of(b + 2)))
    rid = F.concat(F.lit("r"), text_of(F.when(kind == 2, b).otherwise(a)))
    body = F.concat(F.lit("Claim "), text_of(F.col("p_partkey")), F.lit(" holds "), _xref(rid, shown), F.lit("."))
    return _contexts(_cited(s, d, body, F.when(kind == 2, _numbered(F.lit(17), label=False)).otherwise(_numbered(F.lit(17)))))


_FORMS = "CASE p_partkey % 5 WHEN 0 THEN 'label_only' WHEN 1 THEN 'parenthetical_author_year' WHEN 2 THEN 'narrative_author_year' WHEN 3 THEN 'malformed' ELSE 'missing' END"


def _forms(s, d) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    bodies = (
        F.concat(F.lit("Claim "), k, F.lit(" holds "), _xref(F.lit("r1"), F.lit("1")), F.lit(".")),
        F.concat(F.lit("Claim "), k, F.lit(" holds ("), _xref(F.lit("r1"), F.lit("Ek, 2001")), F.lit(").")),
        F.concat(F.lit("As "), _xref(F.lit("r1"), F.lit("Ek (2001)")), F.lit(" showed, "), k, F.lit(" holds.")),
        F.concat(F.lit("As "), _xref(F.lit("r1"), F.lit("before")), F.lit(", "), k, F.lit(" holds.")),
        F.concat(F.lit("Claim "), k, F.lit(' holds <xref ref-type="bibr">2</xref>.')),
    )
    body = F.get(F.array(*bodies), (F.col("p_partkey") % 5).cast("int"))
    return _cited(s, d, body, _numbered(F.lit(3)))


@query(f"SELECT 'PMC' || p_partkey AS pmcid, form FROM (SELECT p_partkey, {_FORMS} AS form FROM part) WHERE form <> 'missing'")
def citation_forms(s, d):
    """The form of each citation: a label, an author and year in brackets or in the sentence, or anything else."""
    rows = _forms(s, d).select("pmcid", F.explode("sentences").alias("s")).select("pmcid", F.explode("s.occurrences").alias("o"))
    return rows.where(F.size("o.rids") > 0).select("pmcid", F.col("o.form").alias("form"))


@query(f"SELECT 'PMC' || p_partkey AS source_pmcid, 1 AS n_unsafe FROM part WHERE {_FORMS} IN ('narrative_author_year', 'malformed')")
def unsafe_citations(s, d):
    """Sentences that can't be separated from their citation, per article."""
    _, unsafe = articles.contexts(_forms(s, d))
    return unsafe.select("source_pmcid", F.col("n_unsafe").cast("int").alias("n_unsafe"))


@query(f"SELECT 'PMC' || p_partkey AS pmcid, unnest(CASE WHEN {_FORMS} = 'missing' THEN ['missing_rid', 'unsafe_citation'] ELSE ['unsafe_citation'] END) AS code FROM part WHERE {_FORMS} NOT IN ('label_only', 'parenthetical_author_year')")
def citation_diagnostics(s, d):
    """What the normaliser reports."""
    return articles.diagnostics(_forms(s, d)).select("pmcid", "code").distinct()


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'parse_error' ELSE 'complete' END AS status, c_custkey % 3 = 1 AS recovered, count(*) AS n FROM customer GROUP BY 1, 2")
def parse_statuses(s, d):
    """Every file ends in a status: another id than the name says, unclosed elements, well-formed."""
    k = F.col("c_custkey").cast("string")
    own = F.when(F.col("c_custkey") % 3 == 0, F.concat(k, F.lit("0"))).otherwise(k)
    body = F.when(F.col("c_custkey") % 3 == 1, F.lit("<p>Some <b>open</p>")).otherwise(F.lit("<p>Some.</p>"))
    rows = dealt(t(s, d, "customer").select("c_custkey")).select(F.concat(F.lit("PMC"), k).alias("pmcid"), _article(F.concat(F.lit("PMC"), own), F.lit(""), body, F.lit("")).alias("content"))
    return articles.parse(_files(rows)).groupBy("status", "recovered").agg(F.count("*").alias("n"))


# Files that are written and read back --------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS pmid, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'a \"b\", c' ELSE o_orderpriority END AS title, '[\"' || o_orderstatus || '\",\"é\"]' AS authors FROM orders")
def csv_round_trip(s, d):
    """A table as CSV: quotes, nulls and arrays come back."""
    path = new_path(s, "csv")
    title = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 1, F.lit('a "b", c')).otherwise(F.col("o_orderpriority"))
    export.write_csv(t(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), title.alias("title"), F.array("o_orderstatus", F.lit("é")).alias("authors")), path)
    return s.read.option("header", True).option("escape", '"').schema("pmid string, title string, authors string").csv(path)


@query("SELECT 'PMC' || s_suppkey AS pmcid, string_agg(replace(x, '@', s_suppkey::VARCHAR), '|' ORDER BY replace(x, '@', s_suppkey::VARCHAR)) AS lines FROM supplier, (VALUES ('0/0/0\tLoose @.'), ('1/0/0\tDeep @.'), ('2/0/0\tFirst .'), ('2/0/1\tSecond @.'), ('2/1/0\tFig. 1 Seen @.'), ('3/0/0\tUntold @.')) v(x) GROUP BY 1")
def sentence_files(s, d):
    """Sentences in a folder per article."""
    path = new_path(s, "sentences")
    export.write_sentences(articles.sentences(articles.parse(_suppliers(s, d))), path)
    rows = s.read.text(path).withColumn("value", F.regexp_replace("value", r"\[xref:[^\]]*\]", ""))
    return rows.groupBy("pmcid").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("lines"))


@query("SELECT 'D' || p_partkey AS ui, p_name AS name, unnest(['A' || lpad((p_partkey % 100)::VARCHAR, 2, '0'), 'B01.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0')]) AS tree_number FROM part")
def descriptor_file(s, d):
    """Descriptor records written as one kind of XML and scanned by row tag."""
    path, k = new_path(s, "descriptors"), F.col("p_partkey")
    places = F.array(F.concat(F.lit("A"), F.lpad((k % 100).cast("string"), 2, "0")), F.concat(F.lit("B01."), F.lpad((k % 1000).cast("string"), 3, "0")))
    rows = dealt(t(s, d, "part").select("p_partkey", "p_name")).select(F.concat(F.lit("D"), k.cast("string")).alias("DescriptorUI"), F.struct(F.col("p_name").alias("String")).alias("DescriptorName"), F.struct(places.alias("TreeNumber")).alias("TreeNumberList"))
    rows.write.format("xml").option("rootTag", "DescriptorRecordSet").option("rowTag", "DescriptorRecord").save(path)
    return biblio.descriptors(s, path)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size % 10 = 0 AS gone FROM part), e AS (SELECT k AS child, k // 4 AS parent FROM p WHERE k >= 4 AND NOT gone AND k // 4 IN (SELECT k FROM p WHERE NOT gone)),
    w AS (SELECT k AS node, 0 AS d FROM p WHERE NOT gone AND k NOT IN (SELECT child FROM e) UNION ALL SELECT child, d + 1 FROM w JOIN e ON parent = node)
    SELECT 'T:' || node AS go_id, p_name AS name, 'About ' || p_brand AS definition, 'n' || (node % 3) AS namespace, d AS level, d AS depth, false AS is_obsolete FROM w JOIN part ON p_partkey = node WHERE d <= 3""")
def ontology_file(s, d):
    """An ontology file scanned into terms and edges, and cut at a level; obsolete terms are left out."""
    path, k = new_path(s, "ontology"), F.col("p_partkey")
    lines = F.concat(
        F.lit("[Term]\nid: T:"), k.cast("string"), F.lit("\nname: "), F.col("p_name"), F.lit("\nnamespace: n"), (k % 3).cast("string"), F.lit('\ndef: "About '), F.col("p_brand"), F.lit('" [x]'),
        F.when(F.col("p_size") % 10 == 0, F.lit("\nis_obsolete: true")).when(k < 4, F.lit("")).otherwise(F.concat(F.lit("\nis_a: T:"), F.expr("p_partkey div 4").cast("string"), F.lit(" ! up"))), F.lit("\n"),
    )
    t(s, d, "part").select(lines.alias("value")).write.text(path)
    return ontology.terms_up_to(*ontology.read_obo(s, path), 3)


# Steps of the chain and column functions -----------------------------------------------------------


@query(oracle("v_ctx", "v_src", "v_meta", body="+ own AS (SELECT source_pmcid, pmid FROM v_src JOIN v_meta ON source_pmcid = pmcid WHERE list_has_any(v_src.authors, v_meta.authors)) SELECT query_id FROM v_ctx WHERE query_id NOT IN (SELECT query_id FROM (SELECT query_id, source_pmcid, unnest(hits) AS pmid FROM v_ctx) JOIN own USING (source_pmcid, pmid))"))
def self_citation_filter(s, d):
    return _chain(s, d, views.contexts(s, d)).no_self_citations().df.select("query_id")


@query(oracle("v_ctx", body="SELECT query_id, source_pmcid FROM v_ctx WHERE source_pmcid IN (SELECT 'PMC' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"))
def article_subset(s, d):
    """Rows of listed articles, after steps that were taken back."""
    ids = t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("PMC"), "c_custkey").alias("pmcid"))
    return _chain(s, d, views.contexts(s, d)).min_hit_queries(1).reset().articles(ids).df.select("query_id", "source_pmcid")


@query(oracle("v_text", body=r"SELECT doc_id FROM v_text WHERE NOT regexp_matches(query, '(?i)(?:^|[^0-9a-z_à-ÿ])et al\.')"))
def gated_texts(s, d):
    """Texts without a residual of one kind pass the gate for it."""
    kept = _chain(s, d, views.texts(s, d)).no_et_al().df.select("doc_id", "query")
    stats.assert_all(kept, ~F.array_contains(spoilers.residual_reasons(F.col("query")), "et_al"), "a text has et al.")
    return kept.select("doc_id")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Roe J|Doe K' WHEN 1 THEN s_name || '|Ek H' ELSE '' END AS authors FROM supplier")
def author_lists(s, d):
    """Serialised lists and comma-separated names."""
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.lit("('Roe J', 'Doe K',)")).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" , Ek H"))).otherwise(F.lit(None))
    return t(s, d, "supplier").select("s_suppkey", _joined(people.parse_authors(raw), "|").alias("authors"))


@query("SELECT s_suppkey, '{\"authors\":[\"' || string_split(s_name, '#')[1] || ' A\"],\"cited_authors\":[[\"Roe J\"]]}' AS payload FROM supplier")
def author_payloads(s, d):
    name = F.concat(F.get(F.split("s_name", "#"), F.lit(0)), F.lit(" Anna B."))
    return t(s, d, "supplier").select("s_suppkey", F.to_json(people.author_payload(F.array(name), F.array(F.array(F.lit("Roe Jo"))))).alias("payload"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'In Addition' WHEN 1 THEN 'in' END AS prefix FROM part")
def longest_prefixes(s, d):
    lead = F.get(F.array(*map(F.lit, ("In Addition, ", "in ", "Inside ", "Added "))), (F.col("p_partkey") % 4).cast("int"))
    return t(s, d, "part").select("p_partkey", text.matching_prefix(F.concat(lead, "p_name"), ("in", "in addition")).alias("prefix"))


@query("SELECT c_custkey, 'http://h/?verb=GetRecord&identifier=oai%3Apubmedcentral.nih.gov%3A' || c_custkey || '&metadataPrefix=pmc' AS url, '/x/PMC' || c_custkey || '.nxml' AS path FROM customer")
def article_addresses(s, d):
    pmcid = F.concat(F.lit("PMC"), F.col("c_custkey").cast("string"))
    return t(s, d, "customer").select("c_custkey", text.oai_url(pmcid, "http://h/").alias("url"), text.article_path(pmcid, "/x/").alias("path"))


@query("SELECT 'PMC' || c_nationkey AS pmcid, min(c_custkey) AS ordinal FROM customer GROUP BY 1")
def stable_id_table(s, d):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" pmc"), "c_nationkey")).otherwise(F.col("c_nationkey").cast("string"))
    return text.stable_ids(t(s, d, "customer").select(raw.alias("id"), F.col("c_custkey").alias("ordinal")), "id", "ordinal")


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 200 AS batch FROM part")
def request_batches(s, d):
    return stats.batches(t(s, d, "part").select("p_partkey"), "p_partkey", 200).select("p_partkey", "batch")


@query(oracle("v_ctx", "v_src", body="SELECT query_id FROM v_ctx WHERE query_id NOT IN (SELECT query_id FROM v_ctx WHERE n_hits > 3)"))
def keys_left_out(s, d):
    """Rows whose key a table doesn't hold."""
    c = views.contexts(s, d)
    return c.join(c.where("n_hits > 3").select(*KEY), list(KEY), "left_anti").select("query_id")


# Ingestion -------------------------------------------------------------------------------------------


@query("""SELECT 'PMC' || s_suppkey AS pmcid, CASE s_suppkey % 5 WHEN 1 THEN 'not_found' WHEN 2 THEN 'no_fulltext' WHEN 3 THEN 'download_error' WHEN 4 THEN 'parse_error' ELSE 'complete' END AS status,
    CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS n_contexts FROM supplier""")
def ingestion_by_ids(s, d):
    """Requested articles, asked for from a stand-in for the service: each ends in its status."""
    from ..sources import connectors
    from ..streaming import ingest

    contents = {x["pmcid"]: bytes(x["content"]) for x in _suppliers(s, d).select("pmcid", "content").collect()}

    def send(method, url, params):
        k = int(params["identifier"].rpartition(":")[2])
        if k % 5 == 3:
            return 404, b""
        inside = {1: '<error code="idDoesNotExist">none</error>', 2: '<error code="noFulltext">none</error>'}.get(k % 5)
        if inside is None:
            article = contents[f"PMC{k}"].decode()
            inside = "<GetRecord><record><metadata>" + (article.replace(f">PMC{k}<", ">PMC999999<") if k % 5 == 4 else article) + "</metadata></record></GetRecord>"
        return 200, f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/">{inside}</OAI-PMH>'.encode()

    with connectors.Client(send, connectors.Spacing(0.0), tries=1) as client:
        got = ingest.ingest_ids(s, new_path(s, "ingestion"), sorted(contents), client)
    return got.select("pmcid", "status", "n_contexts")


@query("SELECT 'PMC' || s_suppkey AS pmcid, '9' || s_suppkey AS pmid, 'On ' || s_name || ' at large' AS title FROM supplier")
def ingested_tables(s, d):
    """Files in a folder, scanned and parsed; a second run over the same files parses nothing and changes nothing."""
    from ..streaming import ingest

    root = new_path(s, "ingestion")
    ingest.write_articles(_suppliers(s, d), root)
    ingest.ingest(s, root)
    ingest.ingest(s, root, delete_sources=True)
    return ingest.load_table(s, root, "metadata").select("pmcid", "pmid", "title")
