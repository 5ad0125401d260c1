"""Tables, batches, workers' memory and file access used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..staging import _local, _remote, bounded, discard, new_path, shared_dir, stage, write_file

__all__ = ["Memory", "RangeReader", "bounded", "discard", "lean", "new_path", "partitions", "shared_dir", "slices", "stage", "table", "trim", "trimmed", "write_file"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named text column holds about ``limit`` characters a piece; single rows stay whole."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


class Memory:
    """What a Python worker remembers between tasks. Using one memory clears all others of the process, so
    that a worker which serves several operators in turn holds one operator's memory at a time."""

    _all: ClassVar[list[Memory]] = []
    _active: ClassVar[Memory | None] = None

    def __init__(self) -> None:
        Memory._all.append(self)

    def use(self) -> None:
        if Memory._active is not self:
            Memory._clear_but(self)

    @classmethod
    def _clear_but(cls, one: Memory | None) -> None:
        for other in cls._all:
            if other is not one:
                other.clear()
        cls._active = one
        trim()

    def clear(self) -> None:
        raise NotImplementedError


def trim() -> None:
    """Return free memory of this process to the system; arrays come from the same place as everything else."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterable) -> Iterator:
    """The batches of a task; memory that one has freed is returned before the next comes."""
    for batch in batches:
        yield batch
        del batch
        trim()


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow`` that begins without what earlier operators remember in this worker, and leaves nothing behind."""

    def wrapped(batches):
        Memory._clear_but(None)
        try:
            yield from run(trimmed(batches))
        finally:
            trim()

    return wrapped


class RangeReader:
    """Reads byte ranges of a file."""

    def __init__(self, uri: str):
        path = _local(uri)
        if path is not None:
            self._file = open(path, "rb")  # noqa: SIM115
        else:
            system, name = _remote(uri)
            self._file = system.open_input_file(name)

    def read(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(length)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()
