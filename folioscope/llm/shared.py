"""What the corpus operators share: tables in the shared folder and Arrow passes that keep other columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from ..storage import nullable, shared_dir, stored

__all__ = ["add_columns", "bounded_batches", "documents", "first_by_hash", "fold", "lean", "ranked", "nullable", "shared_dir", "stored"]

#: Rows and bytes of an Arrow batch at most, so that a worker's memory doesn't grow with long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for long texts; a smaller setting of the session stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        try:
            now = int(spark.conf.get(name).rstrip("bB"))
        except ValueError:
            now = 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker that goes on living gives freed memory back."""

    @wraps(run)
    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return ran


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: Iterable[StructField], drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each Arrow batch.

    A column of ``df`` whose name an added one has is replaced by it; the columns in ``drop`` aren't kept.
    """
    bounded_batches(df.sparkSession)
    added = list(added)
    gone = {f.name.lower() for f in added} | {c.lower() for c in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = fn(batch)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [new[f.name] for f in added], names=names + [f.name for f in added])

    return df.mapInArrow(lean(run), nullable(StructType(keep + added)))


def fold(doc_id: Column, mod: int) -> Column:
    """``crc32(doc_id as text) mod m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def ranked(docs: DataFrame, doc_id: str, name: str, *ties: Column) -> DataFrame:
    """``docs`` with a column ``name``: a number of each row's own that rises with the id, null last, and then with ``ties``.

    Integer ids that are neither null nor repeated are these numbers; else rows are sorted, and written so that a row's number
    stays the same, and the column's metadata have ``own``.
    """
    if isinstance(docs.schema[doc_id].dataType, IntegralType):
        odd = docs.groupBy(doc_id).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(doc_id).isNull())
        if odd.isEmpty():
            return docs.withColumn(name, F.col(doc_id).cast("long"))
    out = stored(docs.orderBy(F.col(doc_id).asc_nulls_last(), *ties).withColumn(name, F.monotonically_increasing_id()))
    return out.withMetadata(name, {"own": True})


def first_by_hash(df: DataFrame, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of ``df`` whose doc_id is first by a hash.  Rows far beyond are dropped first, so that no task sends ``n``."""
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    total = df.count()
    if total > 2 * n:
        df = df.where(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") < 2.0**32 * 1.5 * n / total)
    return df.orderBy(key, *ties).limit(n)


def documents(spark: SparkSession, sf_dir: str, *columns: str, table: str = "documents") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
