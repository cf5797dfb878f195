"""Change-case specifications in Markdown: ``## Case N — title`` followed by bold fields, text blocks and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How places, texts that aren't there, and the lists of expectations and notes are written.
_PLACE = r"p\.(\d+)\s+L(\d+)\s*[–-]\s*p\.(\d+)\s+L(\d+)"
_NO_TEXT = r"^\(none\s+[—-]\s+(added|removed) in v2\)$"
_BLOCK = r"(?s)\*\*{name}:\*\*\s*\n```\n(.*?)\n```"
_EXPECTED = r"(?s)\*\*Expected diff output:\*\*\s*\n(.*?)(?=\n\*\*Extraction notes:\*\*|\n---|\z)"
_NOTES = r"(?s)\*\*Extraction notes:\*\*\s*\n(.*?)(?=\n---|\z)"
_ENTRY = r"(?sm)^- {name}[^:\n]*:[ ]*(.*?)(?=\n- (?:Change type|Anchor|What changed|Net)[^:\n]*:|\z)"
_REQUIRED = {"change_type": "Type", "v1_given": "V1 location", "v2_given": "V2 location", "v1_text": "V1 text", "v2_text": "V2 text", "expected": "Expected diff output"}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Cases of the files at ``path``; one that lacks a required field, or whose place can't be read, raises."""
    text = spark.read.text(path, wholetext=True)
    part = text.select(F.explode(F.split("value", r"(?m)^## Case (?=\d)")).alias("c")).where(F.col("c").rlike(r"\A\d+ — "))
    rows = fields(part)
    bad = rows.select("number", missing().alias("lacks")).where(F.size("lacks") > 0).first()
    if bad:
        raise ValueError(f"case {bad['number']}: missing or unreadable {', '.join(bad['lacks'])}")
    return rows.drop("v1_given", "v2_given", "expected")


def missing() -> Column:
    """Names of the required fields that a row of ``fields`` lacks, and of places that can't be read."""
    lacks = [F.when(F.col(c).isNull(), F.lit(name)) for c, name in _REQUIRED.items()]
    lacks += [F.when(F.col(f"v{n}_given").isNotNull() & ~F.col(f"v{n}_given").startswith("N/A") & F.col(f"v{n}_location").isNull(), F.lit(f"V{n} location")) for n in (1, 2)]
    return F.array_compact(F.array(*lacks))


def _found(x: Column, pattern: str) -> Column:
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


def fields(part: DataFrame) -> DataFrame:
    """Of rows (c), a case's text: its number, title, type, places, texts, and what is expected; null where a field is missing."""
    c = F.col("c")
    line = lambda name: _found(c, rf"(?m)^\*\*{name}:\*\*[ \t]+(.+?)[ \t]*$")
    block = lambda name: F.trim(_found(c, _BLOCK.format(name=name)), F.lit(" \n\t"))
    text = lambda name: F.when(block(name).rlike(_NO_TEXT), F.lit("")).otherwise(block(name))
    expected = _found(c, _EXPECTED)
    entry = lambda name: F.trim(_found(expected, _ENTRY.format(name=name)), F.lit(" \n\t"))
    return part.select(
        F.regexp_extract(c, r"\A(\d+)", 1).cast("int").alias("number"), F.regexp_extract(c, r"\A\d+ — (.*)", 1).alias("title"), F.lower(_found(c, r"(?m)^\*\*Type:\*\*\s+(\w+)")).alias("change_type"),
        line("V1 location").alias("v1_given"), line("V2 location").alias("v2_given"), location(line("V1 location")).alias("v1_location"), location(line("V2 location")).alias("v2_location"),
        text("V1 text").alias("v1_text"), text("V2 text").alias("v2_text"), expected.alias("expected"),
        F.coalesce(entry("Anchor"), F.lit("")).alias("expected_anchor"), F.coalesce(entry("What changed"), F.lit("")).alias("expected_what_changed"), entry("Net").alias("expected_net"),
        F.coalesce(F.trim(_found(c, _NOTES), F.lit(" \n\t")), F.lit("")).alias("extraction_notes"),
    )


def location(x: Column) -> Column:
    """The range of ``p.A LB – p.C LD``; null where there is none."""
    get = lambda i: F.regexp_extract(x, _PLACE, i).cast("int")
    names = ("start_page", "start_line", "end_page", "end_line")
    return F.when(x.rlike(_PLACE), F.struct(*[get(i).alias(n) for i, n in enumerate(names, 1)]))
