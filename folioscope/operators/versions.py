"""Acquisition: version lists in order, bills of committees without repeats, what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import congress_of, iso_day, slug

BILL = ["congress", "type", "number"]


def ordered(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds version_no: by date, undated ones as of the latest, then by type."""
    day = F.coalesce(F.nullif("date", F.lit("")), F.max("date").over(Window.partitionBy(*keys)), F.lit(""))
    return versions.withColumn("version_no", F.row_number().over(Window.partitionBy(*keys).orderBy(day, "type")))


def adjacent(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, version_no, next_no): each version with the one after it."""
    nxt = F.lead("version_no").over(Window.partitionBy(*keys).orderBy("version_no"))
    return versions.withColumn("next_no", nxt).where("next_no IS NOT NULL").select(*keys, "version_no", "next_no")


def listing(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Per bill the printed list of its versions; a bill without any has an empty-list note."""
    one = F.when(F.col("type").isNotNull(), F.format_string("  %d. %s (%s)", "version_no", "type", iso_day(F.col("date"))))
    lines = F.array_sort(F.collect_list(F.struct("version_no", one.alias("text"))))
    text = F.array_join(F.transform(F.filter(lines, lambda x: x["text"].isNotNull()), lambda x: x["text"]), "\n")
    return versions.groupBy(*keys).agg(F.coalesce(F.nullif(text, F.lit("")), F.lit("No text versions available.")).alias("listing"))


def xml_url(formats: Column) -> Column:
    return F.get(F.filter(formats, lambda f: f["type"] == "Formatted XML"), F.lit(0))["url"]


def bills_of(years: DataFrame, *committees: DataFrame) -> DataFrame:
    """Bills of the committees in the congresses of ``years`` (year), the first of each (congress, type, number) kept."""
    rows = None
    for i, c in enumerate(committees):
        part = c.select(*BILL, F.lit(i).alias("list"), "place")
        rows = part if rows is None else rows.unionByName(part)
    wanted = years.select(congress_of(F.col("year")).alias("congress")).distinct()
    first = F.row_number().over(Window.partitionBy(*BILL).orderBy("list", "place"))
    return rows.join(wanted, "congress", "left_semi").withColumn("r", first).where("r = 1").drop("r")


def file_name(index: Column, kind: Column) -> Column:
    return F.concat_ws("_", index.cast("string"), F.concat(slug(kind), F.lit(".xml")))


def missing(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """What isn't there yet: fetching twice fetches nothing new."""
    return wanted.join(present, on, "left_anti")
