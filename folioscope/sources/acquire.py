"""Fetching bill versions: lists of versions, which of them to fetch, and the files they are written to.

Lists are small and the service counts requests, so they are fetched one by one on the driver; files go to any store that
Spark writes to.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version_file
from ..operators import versions
from .http_json import api_key, fetch, items, page_url

#: The service, and the committees whose bills are fetched together.
SERVICE = "https://api.congress.gov/v3"
COMMITTEES = (("house", "hsap00"), ("senate", "ssap00"))
Get = Callable[[str], tuple[int, bytes]]
BILL = "congress int, type string, number string"


def text_versions(spark: SparkSession, congress: int, kind: str, number: int | str, get: Get | None = None) -> DataFrame:
    """Rows (congress, bill_type, number, type, date, url, version_no) of a bill's versions, the oldest first; url is null without XML."""
    body = fetch(f"{SERVICE}/bill/{congress}/{kind}/{number}/text?api_key={api_key()}&format=json", get)
    schema = "array<struct<type:string,date:string,formats:array<struct<type:string,url:string>>>>"
    one = spark.createDataFrame([(json.dumps(json.loads(body).get("textVersions", [])),)], "j string")
    rows = one.select(F.inline(F.from_json("j", schema))).select(
        F.lit(congress).alias("congress"), F.lit(kind).alias("bill_type"), F.lit(str(number)).alias("number"), F.coalesce("type", F.lit("unknown")).alias("type"), "date", versions.xml_url(F.col("formats")).alias("url"),
    )
    return versions.ordered(rows, ["congress", "bill_type", "number"])


def targets(rows: DataFrame, out_dir: str, version: int | None = None) -> DataFrame:
    """Adds ``file``; with ``version`` only that one, and a number beyond the versions raises.  Versions without XML are left out."""
    if version is not None:
        last = rows.agg(F.max("version_no")).first()[0] or 0
        if not 1 <= version <= last:
            raise ValueError(f"version {version} is out of range (1-{last})")
        rows = rows.where(F.col("version_no") == version)
    for r in rows.where(F.col("url").isNull()).orderBy("version_no").collect():
        warnings.warn(f"version {r['version_no']} ({r['type']}): no XML", stacklevel=2)
    name = version_file(F.col("congress"), F.col("bill_type"), F.col("number"), F.col("version_no"), F.col("type"))
    return rows.where(F.col("url").isNotNull()).withColumn("file", F.concat(F.lit(f"{out_dir.rstrip('/')}/"), name))


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_version(spark: SparkSession, content: bytes, path: str) -> str:
    """Writes a version's file, folders made as needed."""
    fs, p = _store(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def download(spark: SparkSession, rows: DataFrame, out_dir: str, version: int | None = None, get: Get | None = None) -> list[str]:
    """Fetches the versions of ``text_versions`` that aren't there yet; returns the files written."""
    written = []
    for r in targets(rows, out_dir, version).orderBy("version_no").collect():
        fs, p = _store(spark, r["file"])
        if not fs.exists(p):
            written.append(save_version(spark, fetch(r["url"], get), r["file"]))
    return written


def committee_bills(spark: SparkSession, chamber: str, code: str, get: Get | None = None, size: int = 250) -> DataFrame:
    """Rows (congress, type, number, place) of a committee's bills, page by page until its count is reached."""
    out, offset = [], 0
    while True:
        body = fetch(page_url(f"{SERVICE}/committee/{chamber}/{code}/bills", offset, size, api_key()), get)
        out += [(b.get("congress"), b.get("type"), str(b.get("number"))) for b in items(body, "committee-bills.bills")]
        offset += size
        if offset >= json.loads(body).get("pagination", {}).get("count", 0):
            rows = spark.createDataFrame([(*r, i) for i, r in enumerate(out)], f"{BILL}, place long")
            return rows


def download_all(spark: SparkSession, first_year: int, last_year: int, out_dir: str, get: Get | None = None) -> list[str]:
    """Fetches every version of the committees' bills of the congresses of those years that isn't there yet."""
    if first_year > last_year:
        raise ValueError("the first year is after the last")
    years = spark.range(first_year, last_year + 1).select(F.col("id").alias("year"))
    found = versions.bills_of(years, *[committee_bills(spark, chamber, code, get) for chamber, code in COMMITTEES])
    written = []
    for b in found.orderBy("list", "place").collect():
        written += download(spark, text_versions(spark, b["congress"], b["type"].lower(), b["number"], get), out_dir, None, get)
    return written
