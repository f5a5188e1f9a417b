"""What the operators share: Arrow batches in bounded slices, checkpoints, held-out rows."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SLICE_ROWS = 512


def crc32_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of an id's decimal text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(remainder: int, modulus: int, column: str = "doc_id") -> Column:
    """True for rows kept away from learning; rows without an id count as held out."""
    return F.coalesce(crc32_of_id(column) % modulus == remainder, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the cluster names in spark.checkpoint.dir.

    A session without one falls back to its checkpoint directory. Only a session on
    one machine (tests, a notebook) gets a folder of its own; elsewhere, where executors would not
    see it, a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None and context.getCheckpointDir() is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, not created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written in the shared folder.

    A written table also forgets the constraints that Spark collects along a
    plan, which a checkpoint keeps and which grow from round to round of a
    loop; and its small files are read by few tasks.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def without_cycle_search() -> Iterator[None]:
    """Work that makes very many strings and lists but no reference cycles.

    Python would search all of them for cycles again and again as their number grows.
    """
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def text_slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of at most SLICE_ROWS rows that hold about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = size = 0
        for row, length in enumerate(lengths):
            if row > start and (size + length > limit or row - start == SLICE_ROWS):
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if start < len(lengths):
            yield batch.slice(start)


def map_slices(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    text: str = "text",
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Apply ``function`` to slices of bounded text; ``setup`` runs once a task and its result is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for part in text_slices(batches, text):
            with without_cycle_search():
                out = function(part, state) if setup else function(part)
            yield out

    return df.mapInArrow(run, schema)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="package-"), f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
