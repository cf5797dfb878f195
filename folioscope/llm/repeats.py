"""Substring dedup (operator 1): hashing of lines and of the pieces of long lines.

A line is a unit; a longer line is cut into pieces after words whose hash is the least among its ``REACH`` neighbours on
either side.  Such places depend on the words alone, so a passage that stands inside different lines is cut alike there
and its pieces meet.  Units are normalised (letters A-Z lower-cased, white space dropped), their digests grouped over
the whole corpus, and every occurrence but the earliest is removed; places in the original text are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from . import bytehash as B
from .shared import add_columns, bounded_batches, lean, ranked

#: Words on either side among which a cut has the least hash; no piece of a line has fewer than one more.
REACH = 5
#: Units of fewer words, lines as well as pieces, are left alone: headings and list marks repeat without being copies.
LEAST_WORDS = 5
_MUL2 = np.uint64(0x9FB21C651E98DF25)


def _cuts(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """For each word whether a piece ends with it."""
    n = len(h)
    least = np.ones(n, bool)
    for k in range(1, min(REACH, n) + 1):
        least[:k] = least[n - k :] = False
        for a, b in ((slice(k, n), slice(0, n - k)), (slice(0, n - k), slice(k, n))):
            least[a] &= (line[a] == line[b]) & (h[a] < h[b])  # with a whole reach on both sides within the line
    out = least
    out[:-1] |= line[1:] != line[:-1]
    if n:
        out[-1] = True
    return out


def units(texts: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """Columns row, start, end (code points), n_words, d1, d2 of the units of each block of texts."""
    for lo, buf, starts, _ in B.blocks(texts):
        low = B.LOWER[buf]
        s, e = B.spans(low)
        if not len(s):
            continue
        h = B.hashes(low, s, e)
        line = np.searchsorted(np.flatnonzero(buf == 10), s)
        last = np.flatnonzero(_cuts(h, line))
        first = np.append(0, last[:-1] + 1)
        n = last - first + 1
        with np.errstate(over="ignore"):
            # Order matters: each word's hash is mixed with its place in the unit before the sum.
            place = np.arange(len(h)) - np.repeat(first, n)
            w = B.mix(h + (place.astype(np.uint64) + np.uint64(1)) * _MUL2)
            d1 = B.mix(np.add.reduceat(w, first) + n.astype(np.uint64))
            d2 = B.mix(np.add.reduceat(B.mix(w * _MUL2 + np.uint64(0x632BE59BD9B4E019)), first))
        use = n >= LEAST_WORDS
        chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
        row = np.searchsorted(starts, s[first[use]], "right") - 1
        at = chars[starts[row]]
        yield {"row": lo + row, "start": chars[s[first[use]]] - at, "end": chars[e[last[use]]] - at, "n_words": n[use], "d1": d1[use].view(np.int64), "d2": d2[use].view(np.int64)}


def unit_table(rows: DataFrame) -> DataFrame:
    """Of (row, text): rows (row, start, end, n_words, d1, d2), one for each unit of ``LEAST_WORDS`` words or more."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in units(batch.column(1)):
                ids = batch.column(0).take(pa.array(u.pop("row")))
                yield pa.RecordBatch.from_arrays([ids, pa.array(u["start"], pa.int64()), pa.array(u["end"], pa.int64()), pa.array(u["n_words"], pa.int32()), pa.array(u["d1"]), pa.array(u["d2"])], names=["row", "start", "end", "n_words", "d1", "d2"])

    return rows.select("row", "text").mapInArrow(lean(run), "row long, start long, end long, n_words int, d1 long, d2 long")


def _later(rows: DataFrame) -> DataFrame:
    """Of (row, text), rows numbered apart: (row, start, end, n_words, kept, kept_start) of each occurrence of a unit but its earliest."""
    found = unit_table(rows)
    rank = F.struct("row", "start")
    first = found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("times")).where(F.col("times") > 1)
    out = found.withColumn("rank", rank).join(first, ["d1", "d2"]).where(F.col("rank") > F.col("first"))
    return out.select("row", "start", "end", "n_words", F.col("first.row").alias("kept"), F.col("first.start").alias("kept_start"))


def _numbered(docs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    return ranked(docs, doc_id, name, F.xxhash64(text), F.md5(F.col(text).cast("binary")))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, n_words, kept_doc_id, kept_start): one for each occurrence of a unit but its earliest.

    Each row is a document of its own; rows rank by doc_id, null last, those of one id by their text's hash, then units by
    place.  Places are code points of the original text.  Null and empty texts have no units, an empty table gives no rows.
    The earliest are found by partial minima in each task, so a unit that stands in a third of all documents is a few rows
    by then, and the join back is one whose large partitions Spark splits.
    """
    rows = _numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", "row")
    out = _later(rows)
    if not rows.schema["row"].metadata.get("own"):
        return out.withColumnsRenamed({"row": "doc_id", "kept": "kept_doc_id"}).select("doc_id", "start", "end", "n_words", "kept_doc_id", "kept_start")
    ids = rows.select("row", "doc_id")
    out = out.join(ids, "row").join(ids.withColumnsRenamed({"row": "kept", "doc_id": "kept_doc_id"}), "kept")
    return out.select("doc_id", "start", "end", "n_words", "kept_doc_id", "kept_start")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "removed") -> DataFrame:
    """``docs`` with the repeats cut out of ``text`` and ``removed``, an array of (start, end) in the original text.

    Neighbouring repeats are one span.  Each row is a document of its own, also if its id is null or repeated; documents without
    repeats keep their text, rows and other columns stay.  A column of the docs named like ``removed`` is refused, so that none
    is lost.  An empty table gives none.
    """
    if removed.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {removed}; give another name")
    rows = _numbered(docs, doc_id, text, "__row")
    spans = _later(rows.select(F.col("__row").alias("row"), F.col(text).alias("text")))
    spans = spans.groupBy(F.col("row").alias("__of")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(removed))
    both = rows.join(spans, F.col("__row") == F.col("__of"), "left").drop("__of", "__row")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out, at = [], batch.schema.get_field_index(removed)
        for t, r in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(at).to_pylist(), strict=True):
            if r:
                pieces, pos = [], 0
                for x in r:
                    gap = t[pos : x["start"]]
                    pieces.append(gap if pos == 0 or gap.strip() else "\n" if "\n" in gap else "")
                    pos = max(pos, x["end"])
                t = "".join([*pieces, t[pos:]])
            out.append(t)
        return {text: pa.array(out, pa.string())}

    return add_columns(both, run, [StructField(text, StringType())]).select(*docs.columns, removed)
