"""Compares two bill files: ``python -m folioscope.compare old.xml new.xml [-o FILE] [--format html|json] ...``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import classify
from .plans import canonical, contract
from .sources import bill_xml
from .storage import stored


def bill_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of one bill file as a version of pair 0; a file that can't be read raises."""
    rows = stored(bill_xml.scan(spark, path).withColumn("pair_id", F.lit(0)))
    broken = rows.where(F.col("error").isNotNull()).select("file", "error").first()
    if broken:
        raise ValueError(f"{broken['file']}: {broken['error']}")
    return rows


def head(old: DataFrame, new: DataFrame) -> DataFrame:
    """What the contract says of the two versions; their numbers come from the file names."""
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.xml$", "")

    def side(d: DataFrame, s: str) -> DataFrame:
        # Without an underscore the whole stem may be the number.
        number = F.coalesce(T.stem_number(stem), F.when(stem.rlike("^[0-9]+$"), stem.cast("int")))
        return d.limit(1).select("pair_id", *[F.col(c).alias(f"{c}_{s}") for c in ("bill_type", "bill_number", "congress")], F.col("version").alias(f"label_{s}"), number.alias(f"number_{s}"))

    both = side(old, "old").join(side(new, "new"), "pair_id", "full_outer")
    shared = [F.coalesce(f"{c}_old", f"{c}_new").alias(c) for c in ("bill_type", "bill_number", "congress")]
    return both.select("pair_id", *shared, "label_old", "label_new", "number_old", "number_new")


def compare(spark: SparkSession, old_xml: str, new_xml: str, include_unchanged: bool = False, filter_text: str = "", financial: bool = False, fmt: str = "html") -> str:
    """The diff of two bill files as an HTML page or as JSON.

    ``filter_text`` keeps changes whose path holds it; ``financial`` keeps those that change amounts, and adds amounts to JSON.
    """
    if fmt not in ("html", "json"):
        raise ValueError(f"format {fmt}")
    old, new = bill_nodes(spark, old_xml), bill_nodes(spark, new_xml)
    shown = stored(classify.filter_changes(classify.diff_versions(old, new), include_unchanged, filter_text, financial))
    names = head(old, new)
    if fmt == "json":
        out = canonical.json_diff(shown, names, financial).first()
        return out["json"] if out else "{}"
    title = names.select("pair_id", F.concat_ws(" ", T.type_label(F.col("bill_type")), F.col("bill_number").cast("string"), F.lit("·"), "label_old", F.lit("→"), "label_new").alias("title"))
    out = canonical.report(contract.xml_views(shown), title).first()
    return out["html"] if out else ""


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("old_xml")
    p.add_argument("new_xml")
    p.add_argument("-o", "--output", help="file to write; else the result is printed")
    p.add_argument("--include-unchanged", action="store_true")
    p.add_argument("--filter", default="", help="keep nodes whose path holds this")
    p.add_argument("--financial", action="store_true", help="keep sections whose amounts change, and add amounts")
    p.add_argument("--format", choices=["json", "html"], default="html")
    a = p.parse_args(args)
    spark = SparkSession.builder.config(map={"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()
    out = compare(spark, os.path.abspath(a.old_xml), os.path.abspath(a.new_xml), a.include_unchanged, a.filter, a.financial, a.format)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        sys.stdout.write(out + "\n")


if __name__ == "__main__":
    main()
