"""Matching the nodes of two versions: by key, then by division and by similarity where a key isn't unique.

Nodes have pair_id, ord (place in the document), match_path, division_label, body_text and whatever else they carry.  Many
pairs of versions are matched in one job: every join and window is keyed by pair_id too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.sequences import ratio
from ..functions.text import division_title
from ..storage import nullable

KEY = ["pair_id", "match_path"]


def duplicate_paths(nodes: DataFrame) -> DataFrame:
    """Rows (pair_id, match_path, extra): nodes beyond the first of each path."""
    return nodes.groupBy(*KEY).agg((F.count("*") - 1).alias("extra")).where(F.col("extra") > 0)


def greedy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one assignment of rows (keys, oi, ni, sim): the best pair first, equal ones by the larger oi, then ni.

    One pass over the candidates in that order claims both ends of a pair where neither is taken.  Groups of ``keys`` are
    spread; a group streams through its task, which keeps nothing but the ends that are taken.
    """
    n = len(keys)
    at = [pairs.columns.index(c) for c in (*keys, "oi", "ni")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, olds, news = None, set(), set()
        for batch in batches:
            claimed = []
            for row in zip(*[batch.column(i).to_pylist() for i in at], strict=True):
                if row[:n] != group:
                    group, olds, news = row[:n], set(), set()
                free = row[n] not in olds and row[n + 1] not in news
                claimed.append(free)
                if free:
                    olds.add(row[n])
                    news.add(row[n + 1])
            yield batch.filter(pa.array(claimed, pa.bool_()))

    return pairs.repartition(*keys).sortWithinPartitions(*keys, F.desc("sim"), F.desc("oi"), F.desc("ni")).mapInArrow(run, nullable(pairs.schema))


Node = tuple[int, str, str]  # place, division title, text
Match = tuple[int | None, int | None, int]  # places of both sides, stage


def _claimed(olds: list[Node], news: list[Node]) -> list[tuple[int, int]]:
    """Indices of nodes paired one to one: two lone ones as they are, else the most alike first, equal ones by the later old, then new."""
    if len(olds) == len(news) == 1:
        return [(0, 0)]
    scored = sorted(((ratio(o[2], n[2]), i, j) for i, o in enumerate(olds) for j, n in enumerate(news)), reverse=True)
    out, used = [], set()
    for _, i, j in scored:
        if ("o", i) not in used and ("n", j) not in used:
            used |= {("o", i), ("n", j)}
            out.append((i, j))
    return out


def resolve(olds: list[Node], news: list[Node]) -> list[Match]:
    """The nodes of one path, paired, in the order of their matches.

    stage 0: at most one on each side; 1: paired within a division title, titles by first appearance, old ones first; 2: what
    is left, paired across titles; 3 and 4: old and new nodes without a partner.
    """
    if len(olds) <= 1 and len(news) <= 1:
        return [(olds[0][0] if olds else None, news[0][0] if news else None, 0)]
    titles = dict.fromkeys(n[1] for n in [*olds, *news])
    out: list[Match] = []
    left: tuple[list[Node], list[Node]] = ([], [])
    for title in titles:
        parts = [[n for n in side if n[1] == title] for side in (olds, news)]
        pairs = _claimed(*parts) if all(parts) else []
        out += [(parts[0][i][0], parts[1][j][0], 1) for i, j in pairs]
        for k, part in enumerate(parts):
            taken = {p[k] for p in pairs}
            left[k].extend(n for i, n in enumerate(part) if i not in taken)
    pairs = _claimed(*left) if all(left) else []
    out += [(left[0][i][0], left[1][j][0], 2) for i, j in pairs]
    out += [(n[0], None, 3) for i, n in enumerate(left[0]) if i not in {p[0] for p in pairs}]
    return out + [(None, n[0], 4) for j, n in enumerate(left[1]) if j not in {p[1] for p in pairs}]


def match_nodes(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows (pair_id, match_path, oi, ni, stage, place, first_old, first_new): places of matched nodes, null where a side has none.

    ``stage`` is as in ``resolve``, ``place`` the row's within its path, and the last two are the path's first places.  Each of
    ``fields`` comes too, of both sides (``_old``, ``_new``).  Both versions are dealt out by path once; only nodes whose path
    repeats within a version are looked at one by one, at the cost of the square of how often it does.
    """
    def side(d: DataFrame, i: int) -> DataFrame:
        title = division_title(F.coalesce("division_label", F.lit(""))).alias("title")
        return d.select(*KEY, F.lit(i).alias("side"), F.col("ord").cast("int").alias("ord"), title, *dict.fromkeys(["body_text", *fields]))

    key = Window.partitionBy(*KEY)
    rows = side(old, 0).unionByName(side(new, 1)).withColumn("at", F.row_number().over(key.orderBy("side", "ord")))
    rows = rows.withColumn("n_old", F.count_if(F.col("side") == 0).over(key).cast("int")).withColumn("n", F.count("*").over(key).cast("int")).sortWithinPartitions(*KEY, "side", "ord")
    crowded = F.greatest(F.col("n_old"), F.col("n") - F.col("n_old")) > 1
    rows = rows.select(*KEY, *fields, "at", "n_old", "n", "ord", F.when(crowded, F.col("title")).alias("title"), F.when(crowded, F.coalesce("body_text", F.lit(""))).alias("__body"))
    carried = [StructField(f"{c}_{s}", rows.schema[c].dataType) for s in ("old", "new") for c in fields]
    places = [StructField(c, IntegerType()) for c in ("oi", "ni", "stage", "place", "first_old", "first_new")]
    schema = nullable(StructType([*rows.select(*KEY).schema.fields, *places, *carried]))
    columns = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            at, n = (batch.column(c).to_numpy() for c in ("at", "n"))
            ends = np.flatnonzero(at == n)
            if not len(ends):
                rest.append(batch)
                continue
            whole = pa.Table.from_batches([*rest, batch.slice(0, ends[-1] + 1)]).combine_chunks()
            yield from _resolved(whole, columns, schema.names)
            rest = [batch.slice(ends[-1] + 1)]

    return rows.mapInArrow(run, schema)


def _resolved(rows: pa.Table, fields: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Matches of whole paths, whose rows stand together, old ones first."""
    at, n_old, n, places = (rows[c].to_numpy() for c in ("at", "n_old", "n", "ord"))
    first = np.flatnonzero(at == 1)
    n_old, n = n_old[first], n[first]
    n_new = n - n_old
    lone = np.maximum(n_old, n_new) <= 1
    begun = first[lone]
    # Row numbers of both sides, -1 where there is none, and the path's first row.
    old = [np.where(n_old[lone] == 1, begun, -1)]
    new = [np.where(n_new[lone] == 1, begun + n_old[lone], -1)]
    stage, place, start = [np.zeros(len(begun), np.int32)], [np.ones(len(begun), np.int32)], [np.flatnonzero(lone)]
    hard = np.flatnonzero(~lone)
    if len(hard):
        picked = np.concatenate([np.arange(first[g], first[g] + n[g]) for g in hard])
        some = rows.select(["ord", "title", "__body"]).take(pa.array(picked))
        nodes = list(zip(picked.tolist(), some["title"].to_pylist(), some["__body"].to_pylist(), strict=True))
        out, upto = [], 0
        for g in hard.tolist():
            mine = nodes[upto : upto + n[g]]
            upto += n[g]
            out += [(-1 if o is None else o, -1 if w is None else w, s, i, g) for i, (o, w, s) in enumerate(resolve(mine[: n_old[g]], mine[n_old[g] :]), 1)]
        for part, values in zip((old, new, stage, place, start), zip(*out, strict=True), strict=True):
            part.append(np.array(values, np.int64))
    old, new, stage, place, start = (np.concatenate(x) for x in (old, new, stage, place, start))
    index = lambda x: pa.array(x, pa.int64(), mask=x < 0)
    number = lambda x: rows["ord"].take(index(x))
    one = rows.take(pa.array(np.where(old >= 0, old, new)))
    first_old, first_new = np.where(n_old > 0, first, -1), np.where(n_new > 0, first + n_old, -1)
    cols = [one["pair_id"], one["match_path"], number(old), number(new), pa.array(stage, pa.int32()), pa.array(place, pa.int32()), number(first_old[start]), number(first_new[start])]
    cols += [rows[c].take(index(x)) for x in (old, new) for c in fields]
    yield from pa.table(cols, names=names).to_batches(10_000)


def in_order(matched: DataFrame) -> DataFrame:
    """Adds out_ord: keys of the old version by first appearance, then new ones; within a key by place."""
    order = Window.partitionBy("pair_id").orderBy(F.col("first_old").isNull(), F.coalesce("first_old", "first_new"), "place")
    return matched.withColumn("out_ord", F.row_number().over(order)).drop("first_old", "first_new", "place")


def cross_division_mismatches(changes: DataFrame) -> DataFrame:
    """Per pair the matched changes whose old and new paths both begin with a division, of different titles."""
    old, new = F.get("display_path_old", F.lit(0)), F.get("display_path_new", F.lit(0))
    a, b = division_title(old), division_title(new)
    apart = old.startswith("Division") & new.startswith("Division") & (a != "") & (b != "") & (a != b)
    return changes.groupBy("pair_id").agg(F.count_if(apart).alias("mismatches"))
