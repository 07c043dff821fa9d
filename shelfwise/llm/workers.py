"""The package's own code on the executors."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_NAME = "shelfwise_code.zip"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Spark's file server hands the archive out, as with ``--py-files``.
    """
    context = spark.sparkContext
    if _NAME in context._python_includes:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="shelfwise-code-")) / _NAME
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


#: What operators remember between the tasks of one worker, by name: how to forget it.
CACHES: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """What Arrow and the C library hold in reserve goes back to the system (the latter where it is glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def forget_others(keeps: str | None = None) -> None:
    """Workers serve one stage after another: what others remember is dropped, all but ``keeps``."""
    for name, forget in CACHES.items():
        if name != keeps:
            forget()
    give_back()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few hundred at a time, so that few texts are Python objects at once.

    Before the first and after the last, memory that is not in use goes back to the system: an idle worker stays.
    """
    forget_others(keeps)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    batch = None
    give_back()
