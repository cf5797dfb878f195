"""The page pipeline: lines of pages, soft hyphens, anchors, blocks, alignment of blocks, hunks.

Lines have doc_id, version, page, line_ord (place on the page), line_number (null if the line has none) and text.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.amounts import PAIRS, annotated
from ..functions.sequences import amount_pairs, similarity
from ..storage import stored
from .classify import MOVE, SPLIT, move_candidates
from .match import greedy

DOC = ["doc_id", "version"]


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of raw page text (doc_id, version, page, raw), page furniture gone and soft hyphens closed."""
    line = pages.select(*DOC, "page", F.posexplode(F.split(T.strip_chrome(F.col("raw")), "\n")).alias("line_ord", "line"))
    number = F.regexp_extract("line", r"^(\d{1,2}) (.*)$", 1)
    body = F.when(number != "", F.regexp_extract("line", r"^(\d{1,2}) (.*)$", 2)).otherwise(F.col("line"))
    line = line.where(F.col("line") != "").select(*DOC, "page", "line_ord", F.when(number != "", number.cast("int")).alias("line_number"), body.alias("text"))
    return merge_hyphens(line, [*DOC, "page"])


def merge_hyphens(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that end in a letter and a hyphen take in the next one if it begins in lower case."""
    order = Window.partitionBy(*keys).orderBy("line_ord")
    joins = F.lag("text").over(order).rlike(r"(?U)[^\W_]-$") & F.col("text").rlike(r"(?U)^\p{Ll}")
    island = lines.withColumn("island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("line_ord", "text", "line_number")))
    out = island.groupBy(*keys, "island").agg(parts.alias("p"))
    n = F.size("p")
    joined = F.array_join(F.transform("p", lambda x, i: F.when(i < n - 1, x["text"].substr(F.lit(1), F.length(x["text"]) - 1)).otherwise(x["text"])), "")
    return out.select(*keys, F.col("p")[0]["line_ord"].alias("line_ord"), F.col("p")[0]["line_number"].alias("line_number"), joined.alias("text"))


def page_range_text(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Per document the text of pages ``first`` to ``last``, hyphens closed across line and page ends."""
    some = lines.where(F.col("page").between(first, last)).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("page", "line_ord", "text"))).alias("p"))
    return some.select(*DOC, T.join_hyphens(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("text"))


def anchors(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, version, page, line_number, kind, text): titles, sections, and account headings.

    A title beats a section on one line.  A line that opens an account stands under its heading: the nearest of the three
    lines before it on the page that has a number and is in capitals.
    """
    page = Window.partitionBy(*DOC, "page").orderBy("line_ord")
    usable = F.when(F.col("line_number").isNotNull() & T.heading_like(F.col("text")), F.struct("line_number", "text"))
    seen = lines.withColumn("head", usable)
    seen = seen.withColumn("above", F.coalesce(*[F.lag("head", k).over(page) for k in (1, 2, 3)])).where("line_number IS NOT NULL")
    title, section = T.title_text(F.col("text")), T.section_text(F.col("text"))
    one = seen.select(*DOC, "page", "line_number", F.when(title.isNotNull(), "title").otherwise("section").alias("kind"), F.coalesce(title, section).alias("text")).where("text IS NOT NULL")
    account = seen.where(title.isNull() & section.isNull() & T.account_trigger(F.col("text")) & F.col("above").isNotNull())
    account = account.select(*DOC, "page", F.col("above.line_number").alias("line_number"), F.lit("account").alias("kind"), F.regexp_replace("above.text", rf"^{T.WS}|{T.WS}$", "").alias("text"))
    return one.unionByName(account).dropDuplicates([*DOC, "page", "line_number", "kind", "text"])


def breadcrumbs(found: DataFrame) -> DataFrame:
    """Adds crumb: the nearest title before an anchor and the anchor; a title alone."""
    before = Window.partitionBy(*DOC).orderBy("page", "line_number", "kind").rowsBetween(Window.unboundedPreceding, -1)
    title = F.last(F.when(F.col("kind") == "title", F.col("text")), ignorenulls=True).over(before)
    return found.withColumn("crumb", F.when(F.col("kind") == "title", F.array("text")).otherwise(F.array_compact(F.array(title, F.col("text")))))


def blocks(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, version, block_ord, anchor, crumb, text, start_page .. end_line, key): lines from one anchor to the next.

    Block 0 is what stands before the first anchor.  An anchor marks the first line at its place.
    """
    order = Window.partitionBy(*DOC).orderBy("page", "line_ord")
    first = Window.partitionBy(*DOC, "page", "line_number").orderBy("line_ord")
    rank = F.when(F.col("kind") == "title", 0).when(F.col("kind") == "section", 1).otherwise(2)
    one = breadcrumbs(found).groupBy(*DOC, "page", "line_number").agg(F.min_by(F.struct("text", "crumb"), rank).alias("a")).select(*DOC, "page", "line_number", F.col("a.text").alias("anchor"), F.col("a.crumb").alias("crumb"))
    seq = lines.withColumn("nth", F.row_number().over(first)).join(one.withColumn("nth", F.lit(1)), [*DOC, "page", "line_number", "nth"], "left")
    seq = seq.withColumn("block_ord", F.count("anchor").over(order)).withColumn("seq", F.row_number().over(order))
    rows = F.array_sort(F.collect_list(F.struct("seq", "text", "page", "line_number", "anchor", "crumb")))
    b = seq.groupBy(*DOC, "block_ord").agg(rows.alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["text"]), "\n")
    last = F.element_at("r", -1)
    anchor = F.when(F.col("block_ord") > 0, F.col("r")[0]["anchor"])
    b = b.select(*DOC, "block_ord", anchor.alias("anchor"), F.when(F.col("block_ord") > 0, F.col("r")[0]["crumb"]).alias("crumb"), body.alias("text"), F.col("r")[0]["page"].alias("start_page"), F.col("r")[0]["line_number"].alias("start_line"), last["page"].alias("end_page"), last["line_number"].alias("end_line"))
    return b.withColumn("key", block_key(F.col("anchor"), F.col("text")))


def block_key(anchor: Column, text: Column) -> Column:
    head = F.regexp_replace(F.substring(text, 1, 80), rf"^{T.WS}|{T.WS}$", "")
    return F.concat(F.coalesce(anchor, F.lit("(preamble)")), F.lit("::"), head)


def align(rows: DataFrame) -> DataFrame:
    """Of (doc_id, version, block_ord, key), versions 1 and 2: rows (doc_id, step, i, j), the alignment of the two key lists.

    One document's keys are one task's work; documents are spread.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["version"] == v].sort_values("block_ord") for v in (1, 2))
        out: list[tuple[int | None, int | None]] = []
        for tag, i, j, k, m in SequenceMatcher(None, a["key"].tolist(), b["key"].tolist(), autojunk=False).get_opcodes():
            old, new = a["block_ord"].tolist()[i:j], b["block_ord"].tolist()[k:m]
            if tag in ("equal", "replace"):
                size = min(len(old), len(new))
                out += list(zip(old, new))  # noqa: B905
                old, new = old[size:], new[size:]
            out += [(x, None) for x in old] + [(None, x) for x in new]
        frame = pd.DataFrame(out, columns=["i", "j"]).astype("Int64")
        frame.insert(0, "step", range(len(frame)))
        frame.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return frame

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "version", "block_ord", "key").groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, step long, i long, j long")


def hunks(found: DataFrame) -> DataFrame:
    """Hunks of documents whose ``blocks`` are given for versions 1 and 2: added, removed, modified, moved.

    Equal texts make no hunk; a pair under ``SPLIT`` alike is two.  Renumbered blocks and removed ones that come again
    elsewhere are moved; those keep the place of the removed one.
    """
    found = stored(found)
    side = lambda v, k, i: found.where(F.col("version") == v).select("doc_id", F.col("block_ord").alias(i), F.struct("anchor", "crumb", "text", "start_page", "start_line", "end_page", "end_line").alias(k))
    steps = align(found).join(side(1, "v1", "i"), ["doc_id", "i"], "left").join(side(2, "v2", "j"), ["doc_id", "j"], "left")
    steps = stored(steps.where(F.col("v1").isNull() | F.col("v2").isNull() | (F.col("v1.text") != F.col("v2.text"))))
    none = lambda c: F.lit(None).cast(steps.schema[c].dataType).alias(c)
    pick = lambda kind, at, old=True, new=True: (F.col("doc_id"), F.lit(kind).alias("change_type"), at.cast("double").alias("out_ord"), F.col("v1") if old else none("v1"), F.col("v2") if new else none("v2"))
    at = F.col("step")
    pair = stored(steps.where("v1 IS NOT NULL AND v2 IS NOT NULL").withColumn("sim", similarity("v1.text", "v2.text")))
    renamed = F.col("v1.anchor").isNotNull() & F.col("v2.anchor").isNotNull() & (F.col("v1.anchor") != F.col("v2.anchor")) & (F.col("sim") >= MOVE)
    far, near = pair.where(F.col("sim") < SPLIT), pair.where(F.col("sim") >= SPLIT)
    gone = steps.where("v2 IS NULL").select(*pick("removed", at, new=False)).unionByName(far.select(*pick("removed", at, new=False)))
    come = steps.where("v1 IS NULL").select(*pick("added", at, old=False)).unionByName(far.select(*pick("added", at + 0.5, old=False)))
    gone, come = stored(gone), stored(come)
    a = gone.select(F.col("doc_id").alias("pair_id"), F.col("out_ord").alias("oi"), F.col("v1.text").alias("a"))
    b = come.select(F.col("doc_id").alias("pair_id"), F.col("out_ord").alias("ni"), F.col("v2.text").alias("b"))
    moved = stored(greedy(move_candidates(a, b), ["pair_id"]).select(F.col("pair_id").alias("doc_id"), "oi", "ni"))
    both = moved.join(gone.select("doc_id", F.col("out_ord").alias("oi"), "v1"), ["doc_id", "oi"]).join(come.select("doc_id", F.col("out_ord").alias("ni"), "v2"), ["doc_id", "ni"])
    left = gone.join(moved.select("doc_id", F.col("oi").alias("out_ord")), ["doc_id", "out_ord"], "left_anti").unionByName(come.join(moved.select("doc_id", F.col("ni").alias("out_ord")), ["doc_id", "out_ord"], "left_anti"))
    pairs = near.where(renamed).select(*pick("moved", at)).unionByName(near.where(~renamed).select(*pick("modified", at))).unionByName(both.select(*pick("moved", F.col("oi"))))
    pairs = pairs.withColumn("amount_pairs", amount_pairs(F.col("v1.text"), F.col("v2.text")))
    out = pairs.unionByName(left.withColumn("amount_pairs", F.array().cast(PAIRS)))
    return out.withColumn("has_amendment_annotations", annotated(F.col("v1.text")) | annotated(F.col("v2.text")))


def hunk_summary(found: DataFrame) -> DataFrame:
    """Per document a map of the kinds it has to their counts."""
    n = found.groupBy("doc_id", "change_type").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("change_type", "n")))).alias("summary"))


def covering(found: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case (case_id, doc_id, side, page, line) the first hunk whose range on that side holds the place."""
    def holds(s: str) -> Column:
        at = F.struct(F.col("page"), F.col("line"))
        return F.col(s).isNotNull() & (at >= F.struct(F.col(f"{s}.start_page"), F.col(f"{s}.start_line"))) & (at <= F.struct(F.col(f"{s}.end_page"), F.col(f"{s}.end_line")))

    hit = cases.join(found, "doc_id").where(F.when(F.col("side") == 1, holds("v1")).otherwise(holds("v2")))
    return hit.groupBy("case_id").agg(F.min_by("change_type", "out_ord").alias("change_type"), F.min("out_ord").alias("out_ord"))
