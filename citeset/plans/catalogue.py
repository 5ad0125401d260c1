"""Named queries over the driver's tables, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, people, text
from ..operators import contexts as building
from ..operators import decoys, spoilers, stats
from ..operators.filters import QueryFilters
from ..sources import biblio, ontology
from . import views
from .views import oracle, t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = ("query_id",)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _joined(c, sep: str = ","):
    return F.array_join(c, sep)


def _chain(s: SparkSession, d: str, df: DataFrame) -> QueryFilters:
    return QueryFilters(df, views.sources(s, d), views.metadata(s, d), KEY)


def _phrases(p) -> str:
    return "|".join(x.replace(".", r"\.") for x in sorted(p, key=lambda x: (-len(x), x)))


def _starts(p, column: str = "query") -> str:
    return rf"regexp_matches(lower(trim({column}, E' \t\n\r\v\f')), '^(?:{_phrases(p)})(?:$|[ ,:;])')"


_WORDS = r"CASE WHEN trim(regexp_replace(text, '[\s\x0b\x85\xa0]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\s\x0b\x85\xa0]+', ' ', 'g')), ' ')) END"
# The reasons in RE2, which has no look-ahead: parentheses are found first and tested one by one.
_NAME = "[A-ZÀ-ÖØ-Þ][0-9A-Za-z_À-ÖØ-öø-ÿ''’‐‑–-]+(?:\\s+(?:et\\s+al\\.|and|&)\\s*[A-ZÀ-ÖØ-Þ][0-9A-Za-z_À-ÖØ-öø-ÿ''’‐‑–-]+)?"
_REASONS = rf"""list_filter([
    CASE WHEN len(list_filter(regexp_extract_all(query, '\([^()\n]{{1,240}}\)'), lambda x: regexp_matches(x, '(?i)[^0-9a-z_](?:18|19|20)\d{{2}}[a-z]?[^0-9a-z_]') AND regexp_matches(x, '(?i)[,;&]|\band\b|\bet\s+al\.'))) > 0 THEN 'parenthetical_author_year'
         WHEN regexp_matches(query, '(?:^|[^0-9A-Za-z_À-ÿ]){_NAME}\s*\(\s*(?:18|19|20)\d{{2}}[a-z]?\s*\)') THEN 'narrative_author_year'
         WHEN regexp_matches(query, '(?:^|[^0-9A-Za-z_À-ÿ]){_NAME}\s*,\s*(?:18|19|20)\d{{2}}[a-z]?(?:$|[^0-9A-Za-z_À-ÿ])') THEN 'unwrapped_author_year' END,
    CASE WHEN regexp_matches(query, '(?i)(?:^|[^0-9a-z_à-ÿ])et al\.') THEN 'et_al' END,
    CASE WHEN regexp_matches(query, '(?i)\[\s*\d{{1,4}}[a-z]?(?:\s*(?:[,;/]|[-–—−]|\band\b)\s*\d{{1,4}}[a-z]?)*\s*\]') THEN 'numeric_citation' END,
    CASE WHEN regexp_matches(query, '(?i)(?:^|[^0-9a-z_à-ÿ])(?:doi|pmid|pmcid)\s*:\s*(?:10\.)?[a-z0-9./_-]+') THEN 'bibliographic_identifier' END,
    CASE WHEN regexp_matches(query, '(?i)(?:^|[^0-9a-z_à-ÿ])(?:unpublished\s+data|personal\s+communication|in\s+press)(?:$|[^0-9a-z_à-ÿ])') THEN 'nonpublic_citation' END,
    CASE WHEN regexp_matches(query, '(?i)\(\s*(?:e\.g\.|i\.e\.)\s*,?\s*\)') THEN 'empty_citation_placeholder' END,
    CASE WHEN contains(query, '▸') THEN 'publisher_artifact' END,
    CASE WHEN regexp_matches(query, '(?i)\[xref:[^\]\s]+\]') THEN 'internal_xref_marker' END], lambda x: x IS NOT NULL)"""
_SURNAMES = r"SELECT query_id, bool_or(coalesce(len(list_filter(authors, lambda a: regexp_matches(query, '(?i)(?:^|[^0-9a-z_à-ÿ])' || a || '(?:$|[^0-9a-z_à-ÿ])'))) > 0, false)) AS named, bool_and(coalesce(len(authors) > 0, false)) AS complete FROM (SELECT query_id, source_pmcid, query, unnest(hits) AS pmid FROM v_qtext) LEFT JOIN v_src USING (source_pmcid, pmid) GROUP BY query_id"


# Filters and annotations -------------------------------------------------------------------------


@query(oracle("v_ctx", body="SELECT query_id, source_pmcid, n_hits FROM v_ctx WHERE n_hits = 1"))
def exact_hits(s, d):
    return _chain(s, d, views.contexts(s, d)).min_hit_queries(1).df.select("query_id", "source_pmcid", F.col("n_hits").cast("long").alias("n_hits"))


@query(oracle("v_src", body="SELECT source_pmcid, count(DISTINCT pmid) AS n_sources FROM v_src GROUP BY 1"))
def source_counts(s, d):
    return spoilers.source_counts(views.sources(s, d)).select("source_pmcid", F.col("n_sources").cast("long").alias("n_sources"))


@query(oracle("v_ctx", "v_src", body="SELECT query_id, n AS n_sources FROM v_ctx JOIN (SELECT source_pmcid, count(DISTINCT pmid) AS n FROM v_src GROUP BY 1) USING (source_pmcid) WHERE n >= 25"))
def min_source_filter(s, d):
    return _chain(s, d, views.contexts(s, d)).min_source_count(25).df.select("query_id", F.col("n_sources").cast("long").alias("n_sources"))


@query(f"SELECT doc_id, n AS query_length FROM (SELECT doc_id, {_WORDS} AS n FROM documents) WHERE n BETWEEN 6 AND 100")
def word_window(s, d):
    rows = t(s, d, "documents").select("doc_id", F.col("text").alias("query"))
    return _chain(s, d, rows).min_query_length(6).max_query_length(100).df.select("doc_id", F.col("query_length").cast("long").alias("query_length"))


@query("SELECT doc_id, round(x, 6) AS strangeness FROM (SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[a-zA-Z0-9 ]', '', 'g')) / length(text) END AS x FROM documents) WHERE x <= 0.3")
def strangeness(s, d):
    rows = t(s, d, "documents").select("doc_id", F.col("text").alias("query"))
    return _chain(s, d, rows).max_strangeness(0.3).df.select("doc_id", F.round("strangeness", 6).alias("strangeness"))


def _start_query(name: str, phrases, step: str):
    def run(s, d):
        return getattr(_chain(s, d, t(s, d, "documents").select("doc_id", F.col("text").alias("query"))), step)().df.select("doc_id")

    run.__name__ = name
    query(f"SELECT doc_id FROM documents WHERE NOT {_starts(phrases, 'text')}")(run)


_start_query("anaphoric_starts", fixed.ANAPHORIC_STARTS, "no_anaphoric_starts")
_start_query("framing_starts", fixed.REFERENCE_FRAMING_STARTS, "no_reference_framing_starts")
_start_query("summary_starts", fixed.SUMMARY_STARTS, "no_summary_starts")


@query(oracle("v_text", body=rf"""SELECT doc_id FROM v_text WHERE NOT {_starts((*fixed.REFERENCE_FRAMING_STARTS, *fixed.LOCAL_CONTEXT_STARTS))}
    AND NOT regexp_matches(query, '(?i)(?:^|[^0-9a-z_à-ÿ])(?:figure|fig\.|table|section|appendix|supplementary\s+(?:figure|fig\.|table))\s+[a-z0-9ivx.-]*[a-z0-9](?:$|[^0-9a-z_à-ÿ])')
    AND NOT regexp_matches(query, '(?i)(?:^|[^0-9a-z_à-ÿ])(?:as\s+(?:described|discussed|mentioned|reported|shown)|see)\s+(?:above|below)(?:$|[^0-9a-z_à-ÿ])')"""))
def self_contained(s, d):
    return _chain(s, d, views.texts(s, d)).self_contained().df.select("doc_id")


_CONN = ("however", "in addition", "as a result", "therefore", "notably", "")


@query(oracle("v_text", body=rf"""SELECT doc_id, upper(left(q, 1)) || substring(q, 2) AS query FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(trim(q0), '(?i)^(?:(?:{_phrases(fixed.CONNECTIVES)})(?:$|[ ,:;])[ ,;:-]*)+', ''), '\s+', ' ', 'g')) AS q
    FROM (SELECT doc_id, list_extract(['However, ', 'in addition: ', 'As a result ', 'THEREFORE; ', 'Notably, thus, ', ''], (doc_id % 6 + 1)::INT) || query AS q0 FROM v_text))"""))
def strip_connectives(s, d):
    lead = F.get(F.array(*map(F.lit, ("However, ", "in addition: ", "As a result ", "THEREFORE; ", "Notably, thus, ", ""))), (F.col("doc_id") % 6).cast("int"))
    rows = views.texts(s, d).withColumn("query", F.concat(lead, "query"))
    return _chain(s, d, rows).cleanup().df.select("doc_id", "query")


@query(oracle("v_text", body=f"SELECT doc_id, array_to_string({_REASONS}, ',') AS reasons FROM v_text"))
def spoiler_reasons(s, d):
    return views.texts(s, d).select("doc_id", _joined(spoilers.residual_reasons(F.col("query"))).alias("reasons"))


@query(oracle("v_text", body=r"SELECT doc_id FROM v_text WHERE NOT regexp_matches(query, '(?i)(?:^|[^0-9a-z_à-ÿ])et al\.')"))
def et_al_filter(s, d):
    return _chain(s, d, views.texts(s, d)).no_et_al().df.select("doc_id")


@query(oracle("v_qtext", "v_src", body=f"+ p AS ({_SURNAMES}) SELECT query_id, named OR len({_REASONS}) > 0 AS rejected FROM v_qtext JOIN p USING (query_id)"))
def spoiler_split(s, d):
    kept, lost = spoilers.split_spoilers(views.contexts(s, d), views.sources(s, d), KEY, texts=lambda rows: views.with_texts(s, d, rows))
    return kept.select("query_id", F.lit(False).alias("rejected")).unionAll(lost.select("query_id", F.lit(True).alias("rejected")))


@query(oracle("v_qtext", "v_src", body=f"+ p AS ({_SURNAMES}) SELECT query_id, named AS author_spoiling, complete AS positive_author_metadata_complete FROM p"))
def positive_authors(s, d):
    return spoilers.annotate_spoilers(views.contexts(s, d), views.sources(s, d), KEY, texts=lambda rows: views.with_texts(s, d, rows)).select("query_id", "author_spoiling", "positive_author_metadata_complete")


@query(oracle("v_ctx", "v_src", "v_meta", body="+ own AS (SELECT source_pmcid, pmid FROM v_src JOIN v_meta ON source_pmcid = pmcid WHERE list_has_any(v_src.authors, v_meta.authors)) SELECT query_id, coalesce(n, 0) AS self_citation FROM v_ctx LEFT JOIN (SELECT query_id, count(DISTINCT pmid) AS n FROM (SELECT query_id, source_pmcid, unnest(hits) AS pmid FROM v_ctx) JOIN own USING (source_pmcid, pmid) GROUP BY 1) USING (query_id)"))
def self_citations(s, d):
    return spoilers.annotate_self_citations(views.contexts(s, d), views.sources(s, d), views.metadata(s, d), KEY).select("query_id", F.col("self_citation").cast("long").alias("self_citation"))


@query("SELECT s_suppkey, string_split(n, ' ')[1] || ' ' || array_to_string(list_transform(string_split(n, ' ')[2:], lambda x: left(x, 1)), '') AS name FROM (SELECT s_suppkey, replace(s_name, '#', ' ') || ' Anna B.' AS n FROM supplier)")
def author_normal_form(s, d):
    return t(s, d, "supplier").select("s_suppkey", people.normal_form(F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" Anna B."))).alias("name"))


@query("SELECT s_suppkey, string_split(n, ' ')[1] || ' ' || left(string_split(n, ' ')[2], 1) AS name FROM (SELECT s_suppkey, replace(s_name, '#', ' ') || ' Anna B.' AS n FROM supplier)")
def author_short_form(s, d):
    return t(s, d, "supplier").select("s_suppkey", people.short_form(F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" Anna B."))).alias("name"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderkey::VARCHAR END AS pmid FROM orders")
def pmid_coercion(s, d):
    k = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(k, F.lit(".0"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" "), k, F.lit("\t"))).when(F.col("o_orderkey") % 4 == 2, k).otherwise(F.lit("  "))
    return t(s, d, "orders").select("o_orderkey", text.coerce_pmid(raw).alias("pmid"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'PMC' || c_custkey END AS pmcid FROM customer")
def id_normalisation(s, d):
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, k).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" pmc"), k, F.lit(" "))).otherwise(F.concat(F.lit("PMCx"), k))
    return t(s, d, "customer").select("c_custkey", text.normalize_pmcid(raw).alias("pmcid"))


# Negatives ---------------------------------------------------------------------------------------

_OPTIONS = "opt AS (SELECT query_id, source_pmcid, hits, list_filter(refs, lambda r: NOT list_contains(hits, r)) AS options FROM v_ctx JOIN (SELECT source_pmcid, list(pmid ORDER BY ref_ordinal) AS refs FROM v_src GROUP BY 1) USING (source_pmcid))"


@query(oracle("v_ctx", "v_src", body=f"+ {_OPTIONS} SELECT query_id, len(options) AS n_options, array_to_string(options, ',') AS options FROM opt"))
def decoy_options(s, d):
    return decoys.decoy_options(views.contexts(s, d), views.sources(s, d)).select("query_id", F.size("options").cast("long").alias("n_options"), _joined(F.col("options")).alias("options"))


@query(oracle("v_ctx", "v_src", body=f"+ {_OPTIONS} SELECT query_id, array_to_string(options[1:19], ',') AS candidates FROM opt"))
def first_n_candidates(s, d):
    return decoys.first_candidates(decoys.decoy_options(views.contexts(s, d), views.sources(s, d)), 19).select("query_id", _joined(F.col("candidates")).alias("candidates"))


def _benchmark(s, d) -> DataFrame:
    """Queries of articles with few single-hit queries and enough references."""
    base = _chain(s, d, views.contexts(s, d)).min_hit_queries(1).min_source_count(25)
    return base.articles(stats.eligible_articles(base.df), "source_pmcid").df


@query()
def shared_decoys(s, d):
    return decoys.shared_decoys(_benchmark(s, d), views.sources(s, d), 19).select("query_id", _joined(F.col("selected_decoys")).alias("selected_decoys"), "n_selected_decoys")


_HARD = f"{_OPTIONS}, hard AS (SELECT query_id, source_pmcid, hits, options[1:19] AS decoys FROM opt WHERE len(hits) = 1)"


def _hard(s, d, n: int = 19) -> DataFrame:
    rows = decoys.decoy_options(views.contexts(s, d).where("n_hits = 1"), views.sources(s, d))
    return rows.join(views.contexts(s, d).select("query_id", "hits"), "query_id").select("query_id", "source_pmcid", "hits", F.slice("options", 1, n).alias("decoys"))


@query(oracle("v_ctx", "v_src", body=f"+ {_HARD}, ev AS (SELECT DISTINCT unnest(decoys) AS x FROM hard), own AS (SELECT DISTINCT source_pmcid, unnest(decoys) AS x FROM hard) SELECT query_id, count(ev.x) AS n_pool FROM hard JOIN ev ON NOT list_contains(hits, ev.x) AND NOT EXISTS (SELECT 1 FROM own WHERE own.source_pmcid = hard.source_pmcid AND own.x = ev.x) GROUP BY 1"))
def soft_pool(s, d):
    return decoys.soft_pool_sizes(_hard(s, d)).select("query_id", F.col("n_pool").cast("long").alias("n_pool"))


# Ids and queries lie on a ring of blocks of 256, one ring for ids with terms and one for the others.
_RING = "CAST(floor(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) * ring / 4294967296) AS BIGINT)"


@query(oracle("v_ctx", "v_src", "v_terms", body=f"""+ {_HARD}, ev AS (SELECT DISTINCT unnest(decoys) AS x FROM hard), own AS (SELECT DISTINCT source_pmcid, unnest(decoys) AS x FROM hard),
    marked AS (SELECT x, x IN (SELECT pmid FROM v_terms WHERE len(terms) > 0) AS m FROM ev), rings AS (SELECT m, (count(*) + 255) // 256 AS ring FROM marked GROUP BY 1),
    placed AS (SELECT x, m, ring, md5('42:' || x) AS h, {_RING.format(x="'42:' || x")} AS b FROM marked JOIN rings USING (m)),
    r AS (SELECT query_id, x, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, (b - {_RING.format(x="'42/' || query_id")} + ring) % ring, h) AS k
          FROM hard JOIN placed ON NOT list_contains(hits, x) AND NOT EXISTS (SELECT 1 FROM own WHERE own.source_pmcid = hard.source_pmcid AND own.x = placed.x))
    SELECT query_id, string_agg(x, ',' ORDER BY k) AS soft FROM r WHERE k <= 80 GROUP BY 1"""))
def soft_sample(s, d):
    marked = views.terms(s, d).where(F.size("terms") > 0)
    return decoys.soft_sample(_hard(s, d), marked, 80, 42).select("query_id", _joined(F.col("soft")).alias("soft"))


@query(oracle("v_ctx", "v_src", "v_terms", body=f"+ {_HARD}, p AS (SELECT query_id, hits[1] AS positive, unnest(decoys) AS pmid, generate_subscripts(decoys, 1) AS o FROM hard) SELECT query_id, o - 1 AS o, round(CASE WHEN len(a.terms) > 0 AND len(b.terms) > 0 THEN len(list_intersect(a.terms, b.terms)) / len(list_distinct(a.terms || b.terms)) END, 6) AS similarity FROM p JOIN v_terms a ON a.pmid = positive JOIN v_terms b ON b.pmid = p.pmid"))
def mesh_jaccard(s, d):
    rows = _hard(s, d).select("query_id", F.get("hits", F.lit(0)).alias("positive"), "decoys")
    found = decoys.decoy_similarity(rows, views.terms(s, d), "decoys")
    return found.select("query_id", F.posexplode("similarity").alias("o", "x")).select("query_id", F.col("o").cast("long").alias("o"), F.round("x", 6).alias("similarity"))


@query(oracle("v_ctx", "v_src", "v_terms", body=f"+ {_HARD} SELECT count(*) AS n_ids, round(avg(CASE WHEN len(terms) > 0 THEN 1 ELSE 0 END), 6) AS covered FROM (SELECT unnest(decoys) AS pmid FROM hard) LEFT JOIN v_terms USING (pmid)"))
def mesh_coverage(s, d):
    return stats.coverage(_hard(s, d), "decoys", views.terms(s, d).where(F.size("terms") > 0))


# Statistics --------------------------------------------------------------------------------------

_COUNTS = "c AS (SELECT pmcid, count(DISTINCT pmid) AS n FROM v_meta LEFT JOIN v_src ON pmcid = source_pmcid GROUP BY 1)"


def _ref_counts(s, d) -> DataFrame:
    return stats.reference_counts(views.metadata(s, d), views.sources(s, d))


@query(oracle("v_src", "v_meta", body=f"+ {_COUNTS} SELECT count(n) AS n, round(min(n)::DOUBLE, 1) AS min, round(quantile_cont(n, 0.25), 1) AS p25, round(quantile_cont(n, 0.5), 1) AS p50, round(avg(n), 1) AS mean, round(quantile_cont(n, 0.75), 1) AS p75, round(quantile_cont(n, 0.9), 1) AS p90, round(max(n)::DOUBLE, 1) AS max FROM c"))
def reference_summary(s, d):
    return stats.summary(_ref_counts(s, d), "n_refs")


_CASE = "CASE " + " ".join(f"WHEN n <= {top} THEN '{label}'" for top, label in fixed.BINS[:-1]) + f" ELSE '{fixed.BINS[-1][1]}' END"


@query(oracle("v_src", "v_meta", body=f"+ {_COUNTS}, b AS (SELECT {_CASE} AS label, count(*) AS n FROM c GROUP BY 1) SELECT x.label, coalesce(b.n, 0) AS n, round(100.0 * coalesce(b.n, 0) / (SELECT count(*) FROM c), 1) AS share FROM (SELECT unnest([{', '.join(repr(x[1]) for x in fixed.BINS)}]) AS label) x LEFT JOIN b USING (label)"))
def reference_histogram(s, d):
    return stats.histogram(_ref_counts(s, d), "n_refs").select("label", "n", "share")


@query(oracle("v_src", "v_meta", body=f"+ {_COUNTS} SELECT count(*) FILTER (n >= 25) AS n_eligible, round(100 * avg(CASE WHEN n >= 25 THEN 1 ELSE 0 END), 1) AS share FROM c"))
def eligible_share(s, d):
    return stats.eligible_share(_ref_counts(s, d), "n_refs")


@query(oracle("v_ctx", body="SELECT source_pmcid, count(*) AS n_queries FROM v_ctx WHERE n_hits = 1 GROUP BY 1 HAVING count(*) BETWEEN 1 AND 5"))
def article_eligibility(s, d):
    return stats.eligible_articles(views.contexts(s, d).where("n_hits = 1"))


@query("SELECT pmcid, title, string_agg(query, ',' ORDER BY ordinal) AS queries FROM (SELECT 'PMC' || p_size AS pmcid, p_brand AS title, p_type AS query, p_partkey AS ordinal FROM part) GROUP BY 1, 2")
def seed_grouping(s, d):
    seeds = t(s, d, "part").select(F.concat(F.lit("PMC"), "p_size").alias("pmcid"), F.col("p_brand").alias("title"), F.col("p_type").alias("query"), F.col("p_name").alias("mesh"), F.col("p_partkey").alias("ordinal"))
    return stats.group_seeds(seeds).select("pmcid", "title", _joined(F.col("queries")).alias("queries"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(s, d):
    return stats.status_counts(t(s, d, "orders").withColumnRenamed("o_orderstatus", "status"))


@query(oracle("v_ctx", body="SELECT query_id, lag(query_id) OVER (PARTITION BY source_pmcid ORDER BY query_id) AS previous_id FROM v_ctx"))
def previous_query(s, d):
    rows = views.contexts(s, d).select("query_id", "source_pmcid", F.lit(0).alias("section_index"), F.col("query_id").alias("paragraph_index"), F.lit(0).alias("sentence_index"), F.col("query_id").alias("query"))
    return stats.previous_query(rows).select("query_id", F.col("context").alias("previous_id"))


# Text --------------------------------------------------------------------------------------------

_MARKED = r"m AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' [xref:R1], [xref:R2], ends' WHEN 1 THEN ' ([xref:R3]) here.' WHEN 2 THEN ' [[xref:R4] - [xref:R5]] . x' ELSE ' foo() []' END AS x FROM documents)"


def _marked(s, d) -> DataFrame:
    tail = F.get(F.array(*map(F.lit, (" [xref:R1], [xref:R2], ends", " ([xref:R3]) here.", " [[xref:R4] - [xref:R5]] . x", " foo() []"))), (F.col("doc_id") % 4).cast("int"))
    return t(s, d, "documents").select("doc_id", F.concat("text", tail).alias("x"))


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace({x}, '▪', ' '), '[\s\x0b\x85\xa0]+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g'), '\s+([)\]}}])', '\1', 'g')"
_RUN = r"\[xref:[^\]\s]+\](?:\s*(?:(?:[,;/&–—−-]|\band\b|\bto\b)\s*)?\[xref:[^\]\s]+\])*"


@query(f"WITH {_MARKED} SELECT doc_id, " + _NORMAL.format(x=rf"regexp_replace(regexp_replace(x, '(?i)(?:\(\s*{_RUN}\s*\)|\[\s*{_RUN}\s*\])', ' ', 'g'), '(?i){_RUN}', ' ', 'g')") + " AS query FROM m")
def marker_removal(s, d):
    return _marked(s, d).select("doc_id", text.remove_markers(F.col("x")).alias("query"))


@query(f"WITH {_MARKED} " + r"SELECT doc_id, array_to_string(regexp_extract_all(x, '\[xref:([^\]\s]+)\]', 1), ',') AS rids FROM m")
def marker_rids(s, d):
    return _marked(s, d).select("doc_id", _joined(text.marker_rids(F.col("x"))).alias("rids"))


@query("SELECT p_partkey, CASE WHEN a <= b AND b - a <= 500 THEN array_to_string(range(a, b + 1), ',') END AS labels FROM (SELECT p_partkey, p_partkey % 50 + 1 AS a, p_partkey % 70 + p_size AS b FROM part)")
def label_ranges(s, d):
    a, b = (F.col("p_partkey") % 50 + 1).cast("string"), (F.col("p_partkey") % 70 + F.col("p_size")).cast("string")
    keys = text.label_key(F.concat(F.lit("["), a, F.lit("]"))), text.label_key(F.concat(F.lit("0"), b, F.lit(".")))
    return t(s, d, "part").select("p_partkey", _joined(text.expand_label_range(*keys)).alias("labels"))


@query("SELECT doc_id, " + _NORMAL.format(x="text") + " AS text FROM documents")
def whitespace_normal_form(s, d):
    return t(s, d, "documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


@query(oracle("v_ctx", "v_src", body="SELECT query_id, 'Claim. ' || query_id AS query, array_to_string(hits, ',') AS hits, lag('Claim. ' || query_id) OVER (PARTITION BY source_pmcid ORDER BY query_id) AS context FROM v_ctx WHERE query_id % 7 <> 0"))
def context_build(s, d):
    """Marker sentences built from the orders, turned into queries again."""
    rows = views.contexts(s, d).select(
        F.col("source_pmcid"), F.lit(0).alias("section_index"), F.col("query_id").cast("int").alias("paragraph_index"), F.lit(0).alias("sentence_index"),
        F.concat(F.lit("Claim. "), F.col("query_id").cast("string"), F.lit(" "), text.render_markers(F.transform("hits", lambda h: F.concat(F.lit("R"), h)))).alias("text"),
        F.lit(None).cast("string").alias("raw"),
        F.when(F.col("query_id") % 7 == 0, F.transform("hits", lambda h: F.concat(F.lit("R"), h))).alias("unsafe_rids"),
        F.array(F.struct(F.lit("label_only").alias("form"), F.transform("hits", lambda h: F.concat(F.lit("R"), h)).alias("rids"))).alias("occurrences"),
    )
    found, _ = building.build_contexts(rows, views.sources(s, d))
    return found.select(F.col("paragraph_index").cast("long").alias("query_id"), "query", _joined(F.col("hits")).alias("hits"), "context")


# Ontologies and ingestion ------------------------------------------------------------------------


@query("SELECT ui, name, tree_number FROM (SELECT 'D' || n_nationkey AS ui, n_name AS name, chr(65 + n_regionkey) || lpad(n_nationkey::VARCHAR, 2, '0') AS tree_number FROM nation UNION ALL SELECT 'D' || c_custkey, c_name, 'A' || lpad(c_nationkey::VARCHAR, 2, '0') || '.' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') FROM customer) WHERE regexp_full_match(tree_number, '[A-Z][0-9]{2}')")
def tree_level_filter(s, d):
    n, c = t(s, d, "nation"), t(s, d, "customer")
    a = n.select(F.concat(F.lit("D"), "n_nationkey").alias("ui"), F.col("n_name").alias("name"), F.concat(F.char(65 + F.col("n_regionkey")), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("tree_number"))
    b = c.select(F.concat(F.lit("D"), "c_custkey").alias("ui"), F.col("c_name").alias("name"), F.concat(F.lit("A"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")).alias("tree_number"))
    return biblio.tree_level(a.unionAll(b), 1)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey // 2 >= 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 >= 1),
    w AS (SELECT p_partkey AS node, 0 AS d FROM part WHERE p_partkey NOT IN (SELECT child FROM e) AND p_partkey >= 1 UNION SELECT child, d + 1 FROM w JOIN e ON parent = node)
    SELECT node, min(d) AS level, max(d) AS depth FROM w GROUP BY 1""")
def dag_levels(s, d):
    p = t(s, d, "part").where("p_partkey >= 1")
    edges = p.select(F.col("p_partkey").alias("child"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("parent")).where("parent >= 1").distinct()
    return ontology.levels(p.select(F.col("p_partkey").alias("node")), edges)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0)")
def incremental_todo(s, d):
    from ..streaming.ingest import to_process

    o = t(s, d, "orders")
    files = o.select(F.col("o_orderkey").alias("pmcid"), F.lit(1).cast("long").alias("length"), F.col("o_orderdate").alias("modificationTime"))
    done = o.where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("pmcid"), F.lit("complete").alias("status"), F.lit(1).cast("long").alias("source_size"), F.col("o_orderdate").alias("source_mtime"), F.lit(1).alias("schema_version"), F.col("o_orderdate").alias("updated_at"))
    return to_process(files, done).select(F.col("pmcid").alias("o_orderkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 3")
def materialise_union(s, d):
    from ..streaming.ingest import materialise

    c = t(s, d, "customer").select("c_custkey", "c_name")
    shards = [c.where(F.col("c_custkey") % 4 == i) for i in (0, 1)] + [c.where("c_custkey % 4 >= 2").select("c_name", "c_custkey")]
    return materialise(shards, c.where("c_custkey % 4 <> 3").select("c_custkey"), "c_custkey")


from . import article_queries, python_queries  # noqa: E402, F401
