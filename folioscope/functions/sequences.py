"""Sequence comparison: Arrow-batched calls of the standard library where no relational form exists."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .amounts import AMOUNT, ANNOTATION, amounts, one_sided
from .text import squeeze, words

_AMOUNT, _ANNOTATION = re.compile(AMOUNT), re.compile(ANNOTATION)


def _places(a: list[str], b: list[str]) -> list[int] | None:
    """Where each word of a stands in b, -1 where it doesn't, if no word repeats within a side and shared ones keep their order; else none.

    Then every shared word is matched, whichever block the library takes first: no block crosses another.
    """
    at = {w: i for i, w in enumerate(b)}
    if len(at) != len(b) or len(set(a)) != len(a):
        return None
    out, last = [], -1
    for w in a:
        j = at.get(w, -1)
        if j >= 0:
            if j < last:
                return None
            last = j
        out.append(j)
    return out


def ratio(a: str | None, b: str | None) -> float:
    if not (a or b):
        return 1.0
    x, y = (a or "").split(), (b or "").split()
    places = _places(x, y)
    if places is None or not x + y:
        return SequenceMatcher(None, x, y).ratio()
    return 2.0 * (len(x) - places.count(-1)) / (len(x) + len(y))


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Word similarity from 0 to 1; the order of the sides matters."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity_bound(a: Column, b: Column) -> Column:
    """What ``similarity`` can't exceed, from sizes alone."""
    n, m = F.size(words(a)), F.size(words(b))
    return F.when(n + m == 0, F.lit(1.0)).otherwise(2.0 * F.least(n, m) / (n + m))


def bag_overlap(a: Column, b: Column) -> Column:
    """2 * shared distinct words (with multiplicity bounded by the larger count) over all words: a bound for texts whose words are distinct."""
    n, m = F.size(words(a)), F.size(words(b))
    return F.when(n + m == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(words(a), words(b))) / (n + m))


def line_diff(old: Column, new: Column) -> Column:
    """Unified diff of two one-line texts, in closed form."""
    o, n = squeeze(F.coalesce(old, F.lit(""))), squeeze(F.coalesce(new, F.lit("")))
    head = [F.lit("--- old"), F.lit("+++ new")]
    gone, come = F.concat(F.lit("-"), o), F.concat(F.lit("+"), n)
    return (
        F.when(o == n, F.array().cast("array<string>"))
        .when(o == "", F.array(*head, F.lit("@@ -0,0 +1 @@"), come))
        .when(n == "", F.array(*head, F.lit("@@ -1 +0,0 @@"), gone))
        .otherwise(F.array(*head, F.lit("@@ -1 +1 @@"), gone, come))
    )


def _opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """The library's steps from a to b, without its junk; only whether a step is ``equal`` counts here."""
    places = _places(a, b)
    if places is None:
        return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    out, i, k, run = [], 0, 0, 0  # run: words that agree just before i and k
    for at, j in enumerate([*places, len(b)]):
        if j < 0:
            continue
        if run and (i < at or k < j):
            out.append(("equal", i - run, i, k - run, k))
            run = 0
        if i < at or k < j:
            out.append(("replace", i, at, k, j))
        i, k, run = at + 1, j + 1, run + 1
    # The end counts as a word on both sides.
    return [*out, ("equal", i - run, i - 1, k - run, k - 1)]


def _paired(a: str | None, b: str | None) -> list[dict]:
    sides = [_ANNOTATION.sub("", x or "").split() for x in (a, b)]
    values = [[_first_amount(w) if "$" in w else None for w in side] for side in sides]
    out: list[dict] = []
    for tag, i, j, k, m in _opcodes(*sides):
        old, new = ([v for v in part if v] for part in (values[0][i:j], values[1][k:m]))
        if tag == "equal":
            out += [{"old": x, "new": y} for x, y in zip(old, new)]  # noqa: B905
        else:
            size = max(len(old), len(new))
            out += [{"old": x, "new": y} for x, y in zip(old + [None] * (size - len(old)), new + [None] * (size - len(new)), strict=True)]
    return out


def _first_amount(word: str) -> int | None:
    m = _AMOUNT.search(word)
    digits = m[0].replace("$", "").replace(",", "") if m else ""
    return int(digits) if digits else None


@pandas_udf(ArrayType(StructType([StructField("old", LongType()), StructField("new", LongType())])))
def _amount_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_paired(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def amount_pairs(old: Column, new: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """Amounts of both sides paired along the alignment of their words; one side alone needs no alignment.

    ``a`` and ``b``: the sides' ``amounts``, if they are known.
    """
    a, b = amounts(old) if a is None else a, amounts(new) if b is None else b
    return F.when((F.size(a) == 0) | (F.size(b) == 0), one_sided(a, b)).otherwise(_amount_pairs(old, new))


@pandas_udf(StringType())
def word_diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Escaped words with ``<del>`` and ``<ins>`` around what changed; null where under 0.4 of the words agree."""
    for a, b in batches:
        yield pd.Series([marked(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=object)


def marked(old: str, new: str, least: float = 0.4) -> str | None:
    a, b = old.split(), new.split()
    m = SequenceMatcher(None, a, b)
    if m.ratio() < least:
        return None
    out = []
    for tag, i, j, k, n in m.get_opcodes():
        gone, come = html.escape(" ".join(a[i:j])), html.escape(" ".join(b[k:n]))
        if tag == "equal":
            out.append(gone)
        else:
            out += [f"<del>{gone}</del>"] * (i < j) + [f"<ins>{come}</ins>"] * (k < n)
    return " ".join(out)


def lcs_tokens(old: str, new: str) -> list[tuple[str, str]]:
    """(op, token) by longest common subsequence over words and white space; of equal choices a deletion goes first."""
    a, b = (re.findall(r"\s+|\S+", x) for x in (old, new))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("ins", b[j]))
            j += 1
    return out + [("del", x) for x in a[i:]] + [("ins", x) for x in b[j:]]


@pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("token", StringType())])))
def token_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "token": t} for o, t in lcs_tokens(x or "", y or "")] for x, y in zip(a, b, strict=True)], dtype=object)


@pandas_udf(StringType())
def percent(old: pd.Series, new: pd.Series) -> pd.Series:
    """Signed change in percent with one decimal, rounded half to even on the binary value; a dash for a base of 0."""
    return pd.Series(["—" if not o else f"{(n - o) / o * 100:+.1f}%" for o, n in zip(old, new, strict=True)], dtype=object)
