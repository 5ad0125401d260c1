"""Sinks and legacy imports: CSV with typed keys, text lines, YAML and JSON, appended stores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import people, text
from ..operators.contexts import sentence_lines
from ..staging import dealt, discard, stage

# Fixed values. File names of a legacy data set.
LEGACY = {"contexts": "extracted_contexts.csv", "sources": "extracted_sources.csv", "metadata": "extracted_metadata.csv"}


def read_legacy(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(contexts, sources, metadata)`` with typed keys and real arrays; a missing file raises."""
    fs = spark._jvm.org.apache.hadoop.fs
    out = {}
    for name, file in LEGACY.items():
        path = fs.Path(f"{folder}/{file}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(f"{folder}/{file}")
        out[name] = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{file}")
    c = out["contexts"].withColumn("hits", text.parse_hits(F.col("hits"))).withColumn("n_hits", F.col("n_hits").try_cast("double").cast("int"))
    s = out["sources"].withColumn("pmid", text.coerce_pmid(F.col("pmid"))).withColumn("authors", people.parse_authors(F.col("authors"))).withColumn("ref_ordinal", F.monotonically_increasing_id())
    m = out["metadata"].withColumn("pmid", text.coerce_pmid(F.col("pmid"))).withColumn("authors", people.parse_authors(F.col("authors")))
    return c, s, m


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays as JSON; null stays distinct from the empty string."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path)


def write_sentences(sentences: DataFrame, path: str) -> None:
    """Text lines in a folder per article."""
    place = ("pmcid", "section_index", "paragraph_index", "sentence_index")
    rows = stage(sentences, "sentences")
    sentence_lines(dealt(rows, by="pmcid").sortWithinPartitions(*place)).write.mode("overwrite").partitionBy("pmcid").text(path)
    discard(rows)


def write_authors(payload: DataFrame, path: str, kind: str = "json") -> None:
    """``pmcid, payload`` as JSON lines, or as one YAML document per article."""
    if kind == "json":
        payload.write.mode("overwrite").json(path)
        return

    @F.pandas_udf("string")
    def dump(x: pd.Series) -> pd.Series:
        import json

        import yaml

        return x.map(lambda s: yaml.safe_dump(json.loads(s), allow_unicode=True, sort_keys=False))

    payload.select("pmcid", dump(F.to_json("payload")).alias("value")).write.mode("overwrite").partitionBy("pmcid").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
