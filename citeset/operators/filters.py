"""The filter chain: an immutable object around one lazily composed DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import spoilers

DEPENDENT = ("query_length", "strangeness", "author_spoiling", "citation_spoiler", "citation_spoiler_reasons", "positive_author_metadata_complete", "explicit_spoiler")


def _positive(n: int) -> int:
    if n < 1:
        raise ValueError("n must be at least 1")
    return n


@dataclass(frozen=True)
class QueryFilters:
    """Steps return a new chain, so the base stays available and every prefix is a plan of its own.

    Rows that a step drops can be counted by ``counts`` after an action, at no job of their own.
    """

    contexts: DataFrame
    sources: DataFrame
    metadata: DataFrame
    key: tuple[str, ...] = spoilers.KEY
    base: DataFrame | None = None
    rejected: DataFrame | None = None
    observed: tuple[tuple[str, Observation], ...] = field(default=())

    @property
    def df(self) -> DataFrame:
        return self.contexts

    def reset(self) -> QueryFilters:
        return replace(self, contexts=self.base if self.base is not None else self.contexts, rejected=None, observed=())

    def _with(self, df: DataFrame, **more) -> QueryFilters:
        return replace(self, contexts=df, base=self.base if self.base is not None else self.contexts, **more)

    def _keep(self, name: str, condition: Column, df: DataFrame | None = None) -> QueryFilters:
        seen = Observation(f"{name}-{len(self.observed)}")
        df = (df if df is not None else self.contexts).observe(seen, F.count(F.lit(1)).alias("before"), F.count_if(condition).alias("after"))
        return self._with(df.where(condition), observed=(*self.observed, (name, seen)))

    def counts(self) -> list[tuple[str, int, int]]:
        """Step, rows before and after; call it after an action on ``df``."""
        return [(name, x.get["before"], x.get["after"]) for name, x in self.observed]

    def min_hit_queries(self, n: int = 1) -> QueryFilters:
        """Queries with exactly n hits."""
        return self._keep("hits", F.col("n_hits") == _positive(n))

    def no_et_al(self) -> QueryFilters:
        return self._keep("et al", ~F.coalesce("query", F.lit("")).rlike(fixed.RESIDUAL_PATTERNS["et_al"]))

    def _annotated(self) -> DataFrame:
        return self.contexts if "explicit_spoiler" in self.contexts.columns else spoilers.annotate_spoilers(self.contexts, self.sources, self.key)

    def no_explicit_spoilers(self) -> QueryFilters:
        return self._keep("explicit spoilers", ~F.col("explicit_spoiler"), self._annotated())

    def no_citation_spoilers(self) -> QueryFilters:
        """As above, and the complement is kept in ``rejected``. Persist ``contexts`` first if both are used."""
        rows = self._annotated()
        lost = rows.where("citation_spoiler").withColumn("rejection_stage", F.lit("citation_spoiler"))
        kept = self._keep("citation spoilers", ~F.col("citation_spoiler"), rows)
        return replace(kept, rejected=lost if self.rejected is None else self.rejected.unionByName(lost, allowMissingColumns=True))

    def assert_no_citation_spoilers(self) -> QueryFilters:
        spoilers.assert_no_spoilers(self.contexts.drop(*DEPENDENT), self.sources, self.key)
        return self

    def no_self_citations(self) -> QueryFilters:
        rows = self.contexts if "self_citation" in self.contexts.columns else spoilers.annotate_self_citations(self.contexts, self.sources, self.metadata, self.key)
        return self._keep("self citations", F.col("self_citation") == 0, rows)

    def min_source_count(self, n: int) -> QueryFilters:
        rows = self.contexts
        if "n_sources" not in rows.columns:
            rows = rows.join(spoilers.source_counts(self.sources), "source_pmcid", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
        return self._keep("source count", F.col("n_sources") >= _positive(n), rows)

    def max_strangeness(self, most: float = 0.3) -> QueryFilters:
        if not 0 <= most <= 1:
            raise ValueError("the threshold must be between 0 and 1")
        value = F.coalesce(F.col("strangeness").try_cast("double"), F.lit(1.0)) if "strangeness" in self.contexts.columns else text.strangeness(F.col("query"))
        return self._keep("strangeness", F.col("strangeness") <= most, self.contexts.withColumn("strangeness", value))

    def _length(self) -> DataFrame:
        value = F.coalesce(F.col("query_length").try_cast("int"), F.lit(0)) if "query_length" in self.contexts.columns else text.word_count(F.col("query"))
        return self.contexts.withColumn("query_length", value)

    def min_query_length(self, n: int) -> QueryFilters:
        return self._keep("least length", F.col("query_length") >= _positive(n), self._length())

    def max_query_length(self, n: int) -> QueryFilters:
        return self._keep("largest length", F.col("query_length") <= _positive(n), self._length())

    def _not_starting(self, name: str, phrases: Iterable[str] | None, usual: Iterable[str]) -> QueryFilters:
        return self._keep(name, ~text.starts_with_phrase(F.col("query"), usual if phrases is None else phrases))

    def no_anaphoric_starts(self, starts: Iterable[str] | None = None) -> QueryFilters:
        return self._not_starting("anaphoric starts", starts, fixed.ANAPHORIC_STARTS)

    def no_reference_framing_starts(self, starts: Iterable[str] | None = None) -> QueryFilters:
        return self._not_starting("framing starts", starts, fixed.REFERENCE_FRAMING_STARTS)

    def no_summary_starts(self, starts: Iterable[str] | None = None) -> QueryFilters:
        return self._not_starting("summary starts", starts, fixed.SUMMARY_STARTS)

    def self_contained(self) -> QueryFilters:
        phrases = (*fixed.REFERENCE_FRAMING_STARTS, *fixed.LOCAL_CONTEXT_STARTS)
        inside = F.coalesce("query", F.lit("")).rlike(fixed.LOCAL_REFERENCE)
        return self._keep("self-contained", ~text.starts_with_phrase(F.col("query"), phrases) & ~inside)

    def cleanup(self, connectives: Iterable[str] | None = None) -> QueryFilters:
        """Strip leading connectives; annotations that depend on the text are dropped."""
        return self._with(self.contexts.withColumn("query", text.strip_connectives(F.col("query"), fixed.CONNECTIVES if connectives is None else connectives)).drop(*DEPENDENT))

    def articles(self, ids: DataFrame, column: str = "pmcid") -> QueryFilters:
        wanted = ids.where(F.col(column).isNotNull()).select(F.col(column).alias("source_pmcid")).distinct()
        return self._with(self.contexts.join(wanted, "source_pmcid", "left_semi"))

    def apply(self, name: str, condition: Column) -> QueryFilters:
        """Any other condition as a step."""
        return self._keep(name, condition)

    def cross_context_coreferences(self, model: Callable[[], object], batch_size: int = 512) -> QueryFilters:
        """Drop queries with an anaphor whose antecedent lies in the preceding query."""
        dependent = coreferent_keys(self.contexts, model, self.key, batch_size)
        return self._with(self.contexts.join(dependent, list(self.key), "left_anti"))


def coreferent_keys(contexts: DataFrame, model: Callable[[], object], key: tuple[str, ...] = spoilers.KEY, batch_size: int = 512, markers: Iterable[str] = fixed.ANAPHORIC_STARTS) -> DataFrame:
    """Keys of queries that refer back across the border between ``context`` and ``query``.

    ``model()`` is called once per task and gives an object whose ``pipe(texts, batch_size=…)`` yields
    documents with ``_.coref_clusters``: lists of (begin, end) character spans. A query depends on its
    context if a cluster has a mention inside the context and one in the query that begins as an anaphor does.
    Rows with a blank context or query are independent.
    """
    begins = re.compile(rf"\s*(?:{'|'.join(re.escape(x) for x in sorted(markers, key=len, reverse=True))})(?:$|[ ,:;])", re.IGNORECASE)

    def run(batches: Iterator):
        nlp = model()
        for pdf in batches:
            ends = [len(c) for c in pdf["context"]]
            texts = [f"{c} {q}" for c, q in zip(pdf["context"], pdf["query"], strict=True)]
            keep = []
            for t, border, doc in zip(texts, ends, nlp.pipe(texts, batch_size=batch_size), strict=True):
                crossing = lambda spans: any(e <= border for _, e in spans) and any(b > border and begins.match(t[b:e]) for b, e in spans)  # noqa: B023, E731
                keep.append(any(crossing(x) for x in doc._.coref_clusters or ()))
            yield pdf.loc[keep, list(key)]

    rows = contexts.where(F.col("context").rlike(r"(?U)\S") & F.col("query").rlike(r"(?U)\S")).select(*key, "context", "query")
    schema = ", ".join(f"{k} {contexts.schema[k].dataType.simpleString()}" for k in key)
    return rows.mapInPandas(run, schema).distinct()
