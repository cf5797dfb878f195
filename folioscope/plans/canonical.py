"""The nested JSON contract of a diff, its plain text and its HTML report, as projections of the change tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.amounts import real_changes
from ..functions.places import found
from ..functions.sequences import percent, word_diff
from ..storage import nullable

VERSION = "1.2"
#: The order in which reports name the kinds.
SHOWN = ("modified", "added", "removed", "moved")
KINDS = ("added", "removed", "modified", "unchanged", "moved")


def change_id(order: Column, keys: list[str]) -> Column:
    return F.format_string("c-%04d", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


@pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _found(texts: pd.Series, full: pd.Series) -> pd.Series:
    """Places of texts in a full text; see ``found``."""
    out = []
    for ts, whole in zip(texts, full, strict=True):
        ts = list(ts)
        out.append([{"start": at, "end": at + len(t)} if at >= 0 else None for t, at in zip(ts, found(ts, whole), strict=True)])
    return pd.Series(out, dtype=object)


def search_spans(changes: DataFrame, full: DataFrame, side: str) -> DataFrame:
    """Rows (pair_id, out_ord, start, end): where each change's text stands in the full text (pair_id, full_text).

    The search goes on from the last hit and starts from the beginning again where it misses.  One pair's texts are one row.
    """
    own = f"{side}_text"
    rows = F.array_sort(F.collect_list(F.struct("out_ord", F.col(own).alias("t"))))
    some = changes.where(F.col(own).isNotNull() & (F.col(own) != "")).groupBy("pair_id").agg(rows.alias("r")).join(full, "pair_id")
    spans = some.select("pair_id", "r", _found(F.transform("r", lambda x: x["t"]), F.col("full_text")).alias("s"))
    one = spans.select("pair_id", F.explode(F.arrays_zip(F.transform("r", lambda x: x["out_ord"]).alias("out_ord"), F.col("s").alias("s"))).alias("x"))
    return one.where(F.col("x.s").isNotNull()).select("pair_id", "x.out_ord", "x.s.start", "x.s.end")


#: The contract's change but its move, whose fields depend on its kind.
CHANGE = (
    "struct<id:string,change_type:string,section_number:string,path:struct<v1:array<string>,v2:array<string>>,"
    "location:struct<v1:struct<start_page:int,start_line:int,end_page:int,end_line:int>,v2:struct<start_page:int,start_line:int,end_page:int,end_line:int>>,anchor_resolution:string,"
    "text:struct<old:string,new:string>,amounts:array<struct<old:bigint,new:bigint>>,full_text_span:struct<v1:struct<start:int,end:int>,v2:struct<start:int,end:int>>>"
)
#: A change as it is read back.
MOVED = f"{CHANGE[:-1]},move:struct<kind:string,old_label:string,new_label:string,body_unchanged:boolean>>"
NULLS = {"ignoreNullFields": "false"}


def extended(json: Column, name: str, value: Column) -> Column:
    """A JSON object with one more field, whose value is JSON."""
    return F.concat(F.substring(json, 1, F.length(json) - 1), F.lit(f',"{name}":'), value, F.lit("}"))


def _head(source: str) -> list[Column]:
    side = lambda s: F.struct(F.coalesce(f"label_{s}", F.lit("")).alias("label"), F.col(f"number_{s}").cast("int").alias("version_number"), F.lit(source).alias("source"))
    return [
        F.lit(VERSION).alias("schema_version"), F.struct(F.lit("folioscope").alias("name"), F.lit("1").alias("version")).alias("generator"),
        F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("bill_type", "type"), ("bill_number", "number"), ("congress", "congress"))]).alias("bill"),
        F.struct(side("old").alias("v1"), side("new").alias("v2")).alias("versions"),
    ]


def _change_json(change: Column, move: Column) -> Column:
    return extended(F.to_json(change.cast(CHANGE), NULLS), "move", F.coalesce(F.to_json(move), F.lit("null")))


def documents(one: DataFrame, heads: DataFrame, source: str, full_text: DataFrame | None = None) -> DataFrame:
    """Rows (pair_id, json) of changes (pair_id, out_ord, change, move), ``change`` as ``CHANGE`` without its id and ``move`` a struct or null.

    ``heads`` has pair_id, bill_type, congress, bill_number, label_old, label_new, number_old, number_new; ``full_text`` (pair_id, v1,
    v2) is what spans refer to.  A pair without changes has an empty list.
    """
    named = one.select("pair_id", "out_ord", F.col("change").withField("id", change_id(F.col("out_ord"), ["pair_id"])).alias("c"), "move")
    text = _change_json(F.col("c"), F.col("move"))
    lists = named.select("pair_id", F.struct("out_ord", text.alias("x")).alias("one"), F.col("c.change_type").alias("kind")).groupBy("pair_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["x"]), ",").alias("changes"),
        F.struct(*[F.count_if(F.col("kind") == k).cast("int").alias(k) for k in SHOWN]).alias("summary"),
    )
    none = F.struct(*[F.lit(0).alias(k) for k in SHOWN])
    whole = F.lit(None).cast("struct<v1:string,v2:string>")
    rows = heads.join(lists, "pair_id", "left")
    if full_text is not None:
        rows = rows.join(full_text.select("pair_id", F.struct(F.coalesce("v1", F.lit("")).alias("v1"), F.coalesce("v2", F.lit("")).alias("v2")).alias("whole")), "pair_id", "left")
        whole = F.col("whole")
    head = F.struct(*_head(source), F.coalesce("summary", none).alias("summary"), whole.alias("full_text"))
    return rows.select("pair_id", extended(F.to_json(head, NULLS), "changes", F.concat(F.lit("["), F.coalesce("changes", F.lit("")), F.lit("]"))).alias("json"))


def pairs_shown(pairs: Column) -> Column:
    return F.coalesce(real_changes(pairs), F.array().cast("array<struct<old:bigint,new:bigint>>"))


def _bill_change(name: Column, field: Callable[[str], Column], pairs: Column, span: Column) -> tuple[Column, Column]:
    """The contract's change of a bill, and its move; ``field`` gives the change's fields."""
    filled = lambda p: F.when(F.size(field(p)) > 0, field(p))
    same = F.coalesce(field("old_text"), F.lit("")) == F.coalesce(field("new_text"), F.lit(""))
    move = F.when(field("change_type") == "moved", F.struct(F.lit("relocated").alias("kind"), same.alias("body_unchanged")))
    one = F.struct(
        name.alias("id"), field("change_type").alias("change_type"), F.coalesce(field("section_number"), F.lit("")).alias("section_number"), F.struct(filled("display_path_old").alias("v1"), filled("display_path_new").alias("v2")).alias("path"),
        F.lit(None).alias("location"), F.lit("resolved").alias("anchor_resolution"), F.struct(field("old_text").alias("old"), field("new_text").alias("new")).alias("text"),
        pairs_shown(pairs).alias("amounts"), span.alias("full_text_span"),
    )
    return one, move


def canonical(changes: DataFrame, heads: DataFrame, full_text: DataFrame | None = None) -> DataFrame:
    """Rows (pair_id, json): the contract's document of each pair of bill versions, unchanged nodes left out; see ``documents``.

    With ``full_text`` each change has the places of its texts, sought in order.
    """
    c = changes.where("change_type <> 'unchanged'")
    span = F.lit(None).cast("struct<v1:struct<start:int,end:int>,v2:struct<start:int,end:int>>")
    if full_text is not None:
        for side, v in (("old", "v1"), ("new", "v2")):
            found = search_spans(c, full_text.select("pair_id", F.col(v).alias("full_text")), side)
            c = c.join(found.select("pair_id", "out_ord", F.struct("start", "end").alias(v)), ["pair_id", "out_ord"], "left")
        span = F.struct("v1", "v2")
    one, move = _bill_change(F.lit(""), F.col, F.col("financial.paired_amounts"), span)
    return documents(c.select("pair_id", "out_ord", one.alias("change"), move.alias("move")), heads, "xml", full_text)


def view_of(json: DataFrame) -> DataFrame:
    """Rows of changes read back from (pair_id, json): the fields of ``CHANGE``, move, source and place, the change's number from 0."""
    whole = f"struct<versions:struct<v1:struct<source:string>>,changes:array<{MOVED}>>"
    rows = json.select("pair_id", F.from_json("json", whole).alias("d"))
    return rows.select("pair_id", F.col("d.versions.v1.source").alias("source"), F.posexplode("d.changes").alias("place", "c")).select("pair_id", "source", "place", "c.*")


#: The parts of a document in lines: its head, what opens and parts the full texts, their pieces, what opens the changes, the changes, and the end.
HEAD, OPEN, OLD, BETWEEN, NEW, LIST, ONE, END = range(8)
FIXED = {OPEN: ',"full_text":{"v1":"', BETWEEN: '","v2":"', LIST: '"},"changes":[', END: "]}"}
FIELDS = ("change_type", "section_number", "display_path_old", "display_path_new", "old_text", "new_text")


def placed(changes: DataFrame, old: DataFrame, new: DataFrame, pieces: bool = True) -> DataFrame:
    """Rows (pair_id, part, place, piece, c, v1, v2): pieces of the full texts, if ``pieces``, and numbered changes with their spans.

    ``place`` counts a part's rows from 0, ``c`` has ``FIELDS`` and pairs, v1 and v2 are structs of start and end.  Both texts and the
    changes of a pair are dealt out once and meet in one task, which holds them, but no row holds more than a node or a change.
    """
    # Lists are empty rather than null, and no struct holds them: Spark sizes a batch at each row, and goes over all null lists again then.
    filled = lambda x: F.coalesce(x, F.array()).alias(x) if isinstance(x, str) else F.coalesce(x, F.array().cast("array<struct<old:bigint,new:bigint>>"))
    c = ["change_type", "section_number", filled("display_path_old"), filled("display_path_new"), "old_text", "new_text", filled(F.col("financial.paired_amounts")).alias("pairs")]
    shown = changes.where("change_type <> 'unchanged'").select("pair_id", F.lit(ONE).alias("part"), F.col("out_ord").cast("double").alias("ord"), *c)
    held = shown.columns[3:]
    none = lambda d: [(F.array() if kind.startswith("array") else F.lit(None)).cast(kind).alias(x) for x, kind in d]
    side = lambda d, part: d.select("pair_id", F.lit(part).alias("part"), F.col("ord").cast("double").alias("ord"), *none(shown.dtypes[3:]), *_written("display_path"))
    texts = side(old, OLD).unionByName(side(new, NEW)).withColumn("display_path", filled("display_path"))
    rows = texts.unionByName(shown.select("*", *none(texts.dtypes[3 + len(held) :])))
    rows = rows.repartition("pair_id").sortWithinPartitions("pair_id", "part", "ord").drop("ord")
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    kept = {f.name: f for f in rows.schema.fields}
    schema = nullable(StructType([kept["pair_id"], kept["part"], StructField("place", LongType()), StructField("piece", StringType()), *[kept[x] for x in held], StructField("v1", span), StructField("v2", span)]))
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def spans(batches: list[pa.RecordBatch], field: str, full: str) -> pa.Array:
        own = [t for b in batches for t in b.column(field).to_pylist()]
        spots = iter(found([t for t in own if t], full))
        at = [next(spots) if t else -1 for t in own]
        ends = [a + len(t) if a >= 0 else None for a, t in zip(at, own, strict=True)]
        lost = pa.array([a < 0 for a in at], pa.bool_())
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind), mask=lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, part, write = None, {}, None, _pieces()
        texts: dict[int, list[str]] = {}
        waiting: list[pa.RecordBatch] = []

        def out(b: pa.RecordBatch, piece: pa.Array, v1: pa.Array, v2: pa.Array) -> pa.RecordBatch:
            part, n = b.column("part")[0].as_py(), b.num_rows
            first = count.get(part, 0)
            count[part] = first + n
            cols = [b.column("pair_id"), b.column("part"), pa.array(np.arange(first, first + n)), piece, *[b.column(x) for x in held], v1, v2]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        def done() -> Iterator[pa.RecordBatch]:
            full = {part: "".join(texts.pop(part, [])) for part in (OLD, NEW)}
            v1, v2 = (spans(waiting, f"{s}_text", full.pop(part)) for s, part in (("old", OLD), ("new", NEW)))
            at = 0
            while waiting:
                b = waiting.pop(0)
                yield out(b, pa.nulls(b.num_rows, pa.string()), v1[at : at + b.num_rows], v2[at : at + b.num_rows])
                at += b.num_rows

        for batch in batches:
            ids, parts = batch.column("pair_id").to_pylist(), batch.column("part").to_pylist()
            nodes = [batch.column(c) for c in ("display_path", "number", "lone", "body_text")]
            at = 0
            for i in range(1, len(ids) + 1):
                if i < len(ids) and ids[i] == ids[at] and parts[i] == parts[at]:
                    continue
                b = batch.slice(at, i - at)
                if ids[at] != now:
                    yield from done()
                    now, count, part = ids[at], {}, None
                    texts.clear()
                if parts[at] == ONE:
                    waiting.append(b)
                else:
                    if parts[at] != part:
                        part, write = parts[at], _pieces()
                    own = [write(*row) for row in zip(*[c.slice(at, i - at).to_pylist() for c in nodes], strict=True)]
                    texts.setdefault(part, []).extend(own)
                    if pieces:
                        yield out(b, pa.array(own, pa.string()), *[pa.nulls(b.num_rows, kind)] * 2)
                at = i
        yield from done()

    out = rows.mapInArrow(run, schema)
    return out.select("pair_id", "part", "place", "piece", F.struct(*held).alias("c"), "v1", "v2")


def changes_of(rows: DataFrame) -> DataFrame:
    """The changes among ``placed`` rows, out_ord being their place."""
    fields = [F.col(f"c.{f}").alias(f) for f in FIELDS]
    return rows.where(f"part = {ONE}").select("pair_id", F.col("place").cast("double").alias("out_ord"), *fields, F.struct(F.col("c.pairs").alias("paired_amounts")).alias("financial"))


def change_lines(rows: DataFrame) -> DataFrame:
    """Lines (pair_id, part, place, text) of the changes among ``placed`` rows."""
    one, move = _bill_change(F.format_string("c-%04d", F.col("place") + 1), lambda f: F.col(f"c.{f}"), F.col("c.pairs"), F.struct("v1", "v2"))
    text = F.concat(F.when(F.col("place") > 0, ",").otherwise(""), _change_json(one, move))
    return rows.where(f"part = {ONE}").select("pair_id", "part", "place", text.alias("text"))


def lines(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (pair_id, part, place, text) of ``placed`` rows, which are read several times: put together by part and place, a pair's are the
    document that ``canonical`` makes, with full texts.  So a document of any length can be written, checked and read in pieces."""
    kind = F.col("c.change_type")
    counts = rows.where(f"part = {ONE}").groupBy("pair_id").agg(F.struct(*[F.count_if(kind == k).cast("int").alias(k) for k in SHOWN]).alias("summary"))
    none = F.struct(*[F.lit(0).alias(k) for k in SHOWN])
    head = F.to_json(F.struct(*_head("xml"), F.coalesce("summary", none).alias("summary")), NULLS)
    line = lambda part, text: F.struct(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("place"), text.alias("text"))
    frame = F.inline(F.array(line(HEAD, F.substring(head, 1, F.length(head) - 1)), *[line(p, F.lit(t)) for p, t in FIXED.items()]))
    rest = heads.join(counts, "pair_id", "left").select("pair_id", frame)
    quoted = F.to_json(F.struct(F.col("piece").alias("x")))
    pieces = rows.where(f"part <> {ONE}").select("pair_id", "part", "place", F.substring(quoted, 7, F.length(quoted) - 8).alias("text"))
    return rest.unionByName(pieces).unionByName(change_lines(rows))


def joined(lines: DataFrame) -> DataFrame:
    """Rows (pair_id, json) of lines."""
    return lines.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "text"))), lambda x: x["text"]), "").alias("json"))


def view_of_lines(lines: DataFrame, source: bool = True) -> DataFrame:
    """``view_of`` for lines; without ``source`` their heads aren't read."""
    text = F.when(F.startswith("text", F.lit(",")), F.substring("text", 2, 2147483647)).otherwise(F.col("text"))
    rows = lines.where(f"part = {ONE}").select("pair_id", F.col("place").cast("int").alias("place"), F.from_json(text, MOVED).alias("c"))
    if not source:
        return rows.select("pair_id", "place", "c.*")
    head = lines.where(f"part = {HEAD}").select("pair_id", F.from_json(F.concat("text", F.lit("}")), "struct<versions:struct<v1:struct<source:string>>>")["versions"]["v1"]["source"].alias("source"))
    return rows.join(F.broadcast(head), "pair_id").select("pair_id", "source", "place", "c.*")


def _diff_json(financial: bool) -> Column:
    """A change of the JSON diff."""
    fields = ["match_path", "change_type", "old_text", "new_text", "text_diff", "section_number", "element_id_old", "element_id_new"]
    filled = lambda p: F.when(F.size(p) > 0, F.col(p)).alias(p)
    one = F.to_json(F.struct(filled("display_path_old"), filled("display_path_new"), *fields), NULLS)
    f = F.col("financial")
    if financial:
        pairs = F.transform(f["paired_amounts"], lambda p: F.array(p["old"], p["new"]))
        shown = F.struct(f["old_amounts"].alias("old_amounts"), f["new_amounts"].alias("new_amounts"), f["amounts_changed"].alias("amounts_changed"), pairs.alias("paired_amounts"), f["has_amendment_annotations"].alias("has_amendment_annotations"))
        return F.when(f.isNotNull(), extended(one, "financial", F.to_json(shown, NULLS))).otherwise(one)
    return one


def _diff_head() -> Column:
    none = F.struct(*[F.lit(0).alias(k) for k in KINDS])
    return F.struct(F.col("label_old").alias("old_version"), F.col("label_new").alias("new_version"), "congress", "bill_type", "bill_number", F.coalesce("summary", none).alias("summary"))


def _diff_end(doc: Column, financial: bool) -> Column:
    """A document with what stands after its changes."""
    if financial:
        doc = extended(doc, "financial_summary", F.to_json(F.struct(F.coalesce("sections", F.lit(0)).alias("sections_with_financial_changes"))))
    for s in ("old", "new"):
        doc = F.when(F.col(f"number_{s}").isNotNull(), extended(doc, f"{s}_version_number", F.col(f"number_{s}").cast("string"))).otherwise(doc)
    return doc


def _diff_counts() -> list[Column]:
    counts = F.struct(*[F.count_if(F.col("change_type") == k).cast("int").alias(k) for k in KINDS])
    return [counts.alias("summary"), F.count_if(F.coalesce(F.col("financial.amounts_changed"), F.lit(False))).cast("int").alias("sections")]


def json_diff_lines(changes: DataFrame, heads: DataFrame, financial: bool = False) -> DataFrame:
    """Rows (pair_id, part, place, text) of ``json_diff``: put together by part and place, a pair's are its document but for the commas
    that part its changes.  ``changes`` are read twice; place is their out_ord."""
    rows = heads.join(changes.groupBy("pair_id").agg(*_diff_counts()), "pair_id", "left")
    head = F.to_json(_diff_head(), NULLS)
    whole = extended(head, "changes", F.lit("[]"))
    n = F.length(whole) - 2
    line = lambda part, text: F.struct(F.lit(part).alias("part"), F.lit(0.0).alias("place"), text.alias("text"))
    frame = F.inline(F.array(line(HEAD, F.substring(whole, F.lit(1), n)), line(END, F.substring(_diff_end(whole, financial), n + 1, F.lit(2147483647)))))
    return rows.select("pair_id", frame).unionByName(changes.select("pair_id", F.lit(ONE).alias("part"), F.col("out_ord").alias("place"), _diff_json(financial).alias("text")))


def json_diff(changes: DataFrame, heads: DataFrame, financial: bool = False) -> DataFrame:
    """Rows (pair_id, json): every change given, with its paths, texts and line diff, and a summary of all kinds.

    ``financial`` adds each change's amounts where it has any, and how many sections changed theirs.  ``heads`` is as in
    ``documents``; a null number is left out.
    """
    one = _diff_json(financial)
    lists = changes.withColumn("one", F.struct("out_ord", one.alias("x"))).groupBy("pair_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["x"]), ",").alias("changes"), *_diff_counts()
    )
    rows = heads.join(lists, "pair_id", "left")
    doc = extended(F.to_json(_diff_head(), NULLS), "changes", F.concat(F.lit("["), F.coalesce("changes", F.lit("")), F.lit("]")))
    return rows.select("pair_id", _diff_end(doc, financial).alias("json"))


def serialized(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, text): headings where they change, then bodies, blank lines between.

    A section's own label isn't a heading; it stands in capitals before its body.  The header of a node without a path stands
    as a line of its own, right below a heading that has no body.
    """
    rows = nodes.repartition(*keys).sortWithinPartitions(*keys, "ord").select(*keys, *_written("display_path"))
    n = len(keys)
    schema = nullable(StructType([*rows.schema.fields[:n], StructField("text", StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, parts, write = None, None, [], _pieces()

        def text() -> Iterator[pa.RecordBatch]:
            if first is not None:
                yield pa.RecordBatch.from_arrays([*first, pa.array(["".join(parts)], pa.string())], names=schema.names)

        for batch in batches:
            for i, row in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                if first is None or row[:n] != now:
                    yield from text()
                    now, first, parts, write = row[:n], [c.take(pa.array([i])) for c in batch.columns[:n]], [], _pieces()
                parts.append(write(*row[n:]))
        yield from text()

    return rows.mapInArrow(run, schema)


def _written(path: str) -> list[Column]:
    """What ``_pieces`` needs of a node."""
    return [F.col(path), F.when(F.col("section_number") != "", F.upper("section_number")).alias("number"), F.when(F.size(path) == 0, F.col("header_text")).alias("lone"), F.col("body_text")]


def _pieces() -> Callable[[list[str] | None, str | None, str | None, str | None], str]:
    """A function that gives what each node of a text adds to it, with the line ends before it, node after node."""
    before: list[str] = []
    last = ""

    def write(path: list[str] | None, number: str | None, lone: str | None, body: str | None) -> str:
        nonlocal before, last
        head = (path or [])[: -1 if number else None]
        same = 0
        while same < min(len(head), len(before)) and head[same] is not None and head[same] == before[same]:
            same += 1
        before = head
        parts = [("heading", h) for h in head[same:] if h]
        if lone:
            parts.append(("header", lone))
        if body:
            parts.append(("body", f"{number}.  {body}" if number else body))
        out = []
        for kind, text in parts:
            out.append("" if not last else "\n" if kind == "header" and last != "body" else "\n\n")
            out.append(text)
            last = kind
        return "".join(out)

    return write


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _amount_rows(change: str) -> Column:
    return F.array_join(F.transform(change, lambda p: F.concat(F.lit("<li>"), T.dollars(p["old"]), F.lit(" → "), T.dollars(p["new"]), F.lit(" ("), T.delta(p["new"] - p["old"]), F.lit(")</li>"))), "")


def cards(views: DataFrame) -> DataFrame:
    """Rows (pair_id, out_ord, change_type, card, nav, row): the HTML of each change of ``views``."""
    c = views.withColumn("id", change_id(F.col("out_ord"), ["pair_id"]))
    old, new = T.escape(F.col("old_text")), T.escape(F.col("new_text"))
    plain = F.concat(F.when(F.col("old_text") != "", F.concat(F.lit("<del>"), old, F.lit("</del>"))).otherwise(""), F.when(F.col("new_text") != "", F.concat(F.lit("<ins>"), new, F.lit("</ins>"))).otherwise(""))
    edited = c.where("change_type IN ('modified', 'moved')").withColumn("prose", F.coalesce(word_diff("old_text", "new_text"), plain))
    c = edited.unionByName(c.where("change_type NOT IN ('modified', 'moved')").withColumn("prose", plain))
    callout = F.when(F.size("amount_pairs") > 0, F.concat(F.lit("<ul class=amounts>"), _amount_rows("amount_pairs"), F.lit("</ul>"))).otherwise("")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name.split()[0]}>"))
    card = F.concat(F.lit("<article id='"), F.col("id"), F.lit("' class="), F.col("change_type"), F.lit(">"), tag("h3", "heading_html"), F.col("citation_html"), F.col("move_info_html"), callout, tag("p", F.col("prose")), F.lit("</article>"))
    nav = F.concat(F.lit("<li><a href='#"), F.col("id"), F.lit("'>"), F.col("nav_label_html"), F.lit("</a></li>"))
    rows = F.transform("amount_pairs", lambda p: F.concat(F.lit("<tr><td>"), F.col("heading_html"), F.lit("</td><td>"), T.dollars(p["old"]), F.lit("</td><td>"), T.dollars(p["new"]), F.lit("</td><td>"), T.delta(p["new"] - p["old"]), F.lit("</td></tr>")))
    return c.select("pair_id", "out_ord", "change_type", card.alias("card"), nav.alias("nav"), F.array_join(rows, "").alias("row"))


def report(views: DataFrame, title: DataFrame) -> DataFrame:
    """Rows (pair_id, html): one self-contained page for each pair of ``views``; ``title`` has (pair_id, title)."""
    parts = cards(views).groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.struct("out_ord", "card", "nav", "row"))).alias("p"),
        *[F.count_if(F.col("change_type") == k).alias(k) for k in SHOWN],
    )
    joined = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    pills = F.concat_ws(" ", *[F.when(F.col(k) > 0, F.concat(F.lit(f"<span class={k}>"), F.col(k).cast("string"), F.lit(f" {k}</span>"))) for k in SHOWN])
    style = "body{display:grid;grid-template-columns:16rem 1fr;font:16px serif}nav{position:sticky;top:0;height:100vh;overflow:auto}ins{background:#dfd}del{background:#fdd}"
    page = F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), T.escape(F.col("title")), F.lit(f"</title><style>{style}</style><nav><ul>"), joined("nav"), F.lit("</ul></nav><main><h1>"), T.escape(F.col("title")), F.lit("</h1><div class=summary>"), pills, F.lit("</div><table class=financial>"), joined("row"), F.lit("</table>"), joined("card"), F.lit("</main>"))
    return parts.join(title, "pair_id").select("pair_id", page.alias("html"))


def financial_table(changes: DataFrame) -> DataFrame:
    """Rows (pair_id, group_no, row_no, group_rows, old, new, delta, change): the report's table of amounts."""
    group = Window.partitionBy("pair_id", "out_ord")
    f = changes.select("pair_id", "out_ord", F.posexplode(real_changes(F.col("financial.paired_amounts"))).alias("at", "p"))
    f = f.withColumn("group_no", F.dense_rank().over(Window.partitionBy("pair_id").orderBy("out_ord"))).withColumn("group_rows", F.count("*").over(group))
    return f.select("pair_id", "group_no", (F.col("at") + 1).alias("row_no"), "group_rows", "p.old", "p.new", (F.col("p.new") - F.col("p.old")).alias("delta"), percent("p.old", "p.new").alias("change"))
