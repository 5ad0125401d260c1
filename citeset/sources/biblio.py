"""PubMed records and MeSH descriptors from XML: one row per term, abstract or tree place."""

from __future__ import annotations

import contextlib
import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import schemas

LEVELS = {1: r"^[A-Z][0-9]{2}$", 2: r"^[A-Z][0-9]{2}\.[0-9]{3}$"}


def _text(e: ET.Element | None) -> str | None:
    """All text of an element, white space collapsed; null if there is none."""
    if e is None:
        return None
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip() or None


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _major(e: ET.Element) -> bool:
    return e.get("MajorTopicYN") == "Y"


def term_rows(payload: bytes, include_qualifiers: bool = True) -> list[tuple]:
    """A row per qualifier, or per heading without (or regardless of) qualifiers."""
    out = []
    for article in ET.fromstring(payload).iter("PubmedArticle"):
        pmid = _text(article.find(".//MedlineCitation/PMID"))
        for heading in article.iterfind(".//MeshHeadingList/MeshHeading"):
            d = heading.find("DescriptorName")
            if d is None:
                continue
            base = (pmid, d.get("UI"), _text(d), _major(d))
            qualifiers = heading.findall("QualifierName") if include_qualifiers else []
            out += [(*base, q.get("UI"), _text(q), _major(q)) for q in qualifiers] or [(*base, None, None, None)]
    return out


def abstract_rows(payload: bytes) -> list[tuple]:
    """The parts of each abstract on lines of their own, with their labels; null where there is none."""
    out = []
    for article in ET.fromstring(payload).iter("PubmedArticle"):
        parts = []
        for part in article.iterfind(".//Abstract/AbstractText"):
            body = _text(part)
            if body:
                parts.append(f"{part.get('Label')}: {body}" if part.get("Label") else body)
        out.append((_text(article.find(".//MedlineCitation/PMID")), "\n".join(parts) or None))
    return out


def descriptor_rows(payload: bytes) -> list[tuple]:
    return [(_text(r.find("DescriptorUI")), _text(r.find("DescriptorName/String")), _text(t)) for r in ET.fromstring(payload).iter("DescriptorRecord") for t in r.iterfind("TreeNumberList/TreeNumber")]


#: Rows of payloads that are handed on at once.
AT_ONCE = 10_000


def _extracted(rows: Callable[[bytes], list[tuple]], schema: pa.Schema):
    """Payloads, the first column, to rows of the schema, many payloads at once."""

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.column(0):
                with contextlib.suppress(ET.ParseError):
                    out += rows(_bytes(x.as_py()))
                if len(out) >= AT_ONCE:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return run


def _extract(payloads: DataFrame, column: str, rows: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows of all payloads; those that aren't XML have none here, and a status in ``payload_status``."""
    return payloads.select(column).where(F.col(column).isNotNull()).mapInArrow(_extracted(rows, to_arrow_schema(T.StructType.fromDDL(schema))), schema)


def payload_status(payloads: DataFrame, column: str = "content") -> DataFrame:
    """``digest, status, reason`` of each payload: ``complete``, or ``parse_error`` for what isn't XML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x in pdf[column]:
                try:
                    ET.fromstring(_bytes(x))
                    out.append((hashlib.sha256(_bytes(x)).hexdigest(), "complete", None))
                except ET.ParseError as e:
                    out.append((hashlib.sha256(_bytes(x)).hexdigest(), "parse_error", str(e)))
            yield pd.DataFrame(out, columns=["digest", "status", "reason"])

    return payloads.select(column).where(F.col(column).isNotNull()).mapInPandas(run, "digest string, status string, reason string")


def mesh_terms(payloads: DataFrame, column: str = "content", include_qualifiers: bool = True) -> DataFrame:
    return _extract(payloads, column, lambda x: term_rows(x, include_qualifiers), schemas.MESH_TERMS)


def abstracts(payloads: DataFrame, column: str = "content") -> DataFrame:
    return _extract(payloads, column, abstract_rows, schemas.ABSTRACTS)


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """Descriptor records by Spark's XML reader, which splits large files by row tag."""
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema("DescriptorUI string, DescriptorName struct<String: string>, TreeNumberList struct<TreeNumber: array<string>>").load(path)
    return raw.select(F.col("DescriptorUI").alias("ui"), F.col("DescriptorName.String").alias("name"), F.explode("TreeNumberList.TreeNumber").alias("tree_number"))


def tree_level(rows: DataFrame, level: int) -> DataFrame:
    """Categories at level 1 or 2 of the tree, each once, by tree number."""
    if level not in LEVELS:
        raise ValueError("level must be 1 or 2")
    return rows.where(F.col("tree_number").rlike(LEVELS[level])).select("ui", "name", "tree_number").distinct().orderBy("tree_number", "ui")


def in_branches(rows: DataFrame, letters: list[str]) -> DataFrame:
    return rows.where(F.left("tree_number", F.lit(1)).isin(letters))
