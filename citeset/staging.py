"""Tables written to the folder that driver and executors share, and joins by size."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that may be broadcast.
BROADCAST = 16 << 20
#: Rows of a task where a row takes much longer than its bytes tell.
ROWS = 4000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder takes its place, in local mode only: there is one machine then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="citeset-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, rows: int | None = None, like: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """``df`` over as many tasks as it has ``ROWS`` rows, for work that grows with rows: splits and adaptive execution go by bytes.

    Call it on a table of few bytes a row that is cheap to count, before what makes it large; or name a table that is, and has about as many rows.
    Rows dealt ``by`` a column can be joined by it without another shuffle: there are at least as many tasks as a join would have.
    """
    n = max(1, -(-(df if like is None else like).count() // (rows or ROWS)))
    return df.repartition(n) if by is None else df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows were counted to hold at most ``BROADCAST`` bytes; otherwise it is joined by a shuffle.

    Call it on a table that is cheap to read twice, such as a staged one.
    """
    flat = lambda t: isinstance(t, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
    width = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        size = F.lit(16) if flat(f.dataType) else F.coalesce(F.octet_length(c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))), F.lit(0)) + 16
        width = width + size
    size = df.agg(F.sum(width).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST else df


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: list[bytes]) -> None:
    """Write a file under a name that appears only when it is whole. A repeated attempt replaces it."""
    draft = f"{uri}.{uuid.uuid4().hex}.tmp"
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(draft), "wb") as f:
            f.writelines(parts)
        os.replace(_local(draft), path)
        return
    system, name = _remote(uri)
    _, other = _remote(draft)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(other) as f:
        for part in parts:
            f.write(part)
    system.move(other, name)
