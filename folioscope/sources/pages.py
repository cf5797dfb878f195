"""Scan of extracted page text: ``<doc>_<version>/<page>.txt`` files, or PDF files where a reader is installed."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, version int, page int, raw string"


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("f"), F.col("value").alias("raw"))
    at = r"([^/]+)_(\d+)/(\d+)\.txt$"
    pick = lambda i: F.regexp_extract("f", at, i)
    return rows.select(pick(1).alias("doc_id"), pick(2).cast("int").alias("version"), pick(3).cast("int").alias("page"), "raw")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of ``<doc>_<version>.pdf`` files; needs pdfplumber on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                doc, _, version = file.rsplit("/", 1)[-1].removesuffix(".pdf").rpartition("_")
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    rows = [(doc, int(version), i, p.extract_text() or "") for i, p in enumerate(pdf.pages, 1)]
                yield pd.DataFrame(rows, columns=["doc_id", "version", "page", "raw"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(run, SCHEMA)
