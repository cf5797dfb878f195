"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset (tests on one machine) it is set to a new temporary folder.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("folioscope.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("folioscope.checkpoint.dir", place)
    return place


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/folioscope/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written with ``stored``; tables that still depend on it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: this cuts lineage and survives lost executors."""
    return _written(df)[0]


#: A shared folder named by file:// is written without checksum files and a success mark.  Without Hadoop's native library each file is
#: given its rights by a process of its own, and until that process has started, tools that add up processes count an executor twice.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def _written(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**_PLAIN, **options).parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path), path


def settled(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``stored`` for large tables, packed tighter; then what led to it goes: its shuffle files, and the tables ``spent``, made by this too.

    Spark drops shuffle files when the driver has collected the plans that made them, which may be long after.
    """
    out, path = _written(df, compression="zstd")
    out._settled_at = path
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for x in spent:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(x._settled_at), True)
    for _ in range(2):  # what has just ended is still held for a moment
        time.sleep(0.4)
        gc.collect()
        spark._jvm.System.gc()
    return out
