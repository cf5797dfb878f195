"""Dollar amounts in text: extraction, bags, annotations, and the financial struct of a change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

#: An amount, and the annotation of an amended one.
AMOUNT = r"\$[0-9,]+"
ANNOTATION = r"\((?:increased|reduced|decreased) by\s+\$[0-9,]+\)"
PAIRS = "array<struct<old:bigint,new:bigint>>"


def _value(x: Column) -> Column:
    return F.regexp_replace(x, "[$,]", "").try_cast("bigint")


def amounts(x: Column) -> Column:
    """Amounts in document order, annotations aside; zero and unreadable ones don't count."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(x, F.lit("")), ANNOTATION, ""), F.lit(AMOUNT), F.lit(0))
    return F.filter(F.transform(found, _value), lambda v: v.isNotNull() & (v != 0))


def annotated(x: Column) -> Column:
    return F.coalesce(x.rlike(ANNOTATION), F.lit(False))


def word_amounts(x: Column) -> Column:
    """(word index, amount) of words that hold an amount; only a word's first counts."""
    ws = F.filter(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), ANNOTATION, ""), WS), lambda w: w != "")
    found = F.transform(ws, lambda w, i: F.struct(i.alias("at"), _value(F.regexp_extract(w, AMOUNT, 0)).alias("amount")))
    return F.filter(found, lambda v: v["amount"].isNotNull() & (v["amount"] != 0))


def bags_differ(a: Column, b: Column) -> Column:
    return F.array_sort(a) != F.array_sort(b)


def real_changes(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["old"].isNotNull() & p["new"].isNotNull() & (p["old"] != p["new"]))


def one_sided(old: Column, new: Column) -> Column:
    """Pairs of a text that stands on one side only."""
    gone = F.transform(old, lambda v: F.struct(v.alias("old"), F.lit(None).cast("bigint").alias("new")))
    come = F.transform(new, lambda v: F.struct(F.lit(None).cast("bigint").alias("old"), v.alias("new")))
    return F.concat(gone, come).cast(PAIRS)


def financial(old: Column, new: Column, pairs: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """The struct of a change's amounts; null where neither side has any.  ``a`` and ``b``: the sides' ``amounts``, if they are known."""
    a, b = amounts(old) if a is None else a, amounts(new) if b is None else b
    return F.when(
        (F.size(a) > 0) | (F.size(b) > 0),
        F.struct(a.alias("old_amounts"), b.alias("new_amounts"), bags_differ(a, b).alias("amounts_changed"), pairs.alias("paired_amounts"), (annotated(old) | annotated(new)).alias("has_amendment_annotations")),
    )
