"""Classifying matched nodes, moving what was removed and added alike, filtering and counting changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.amounts import amounts, financial
from ..functions.sequences import amount_pairs, line_diff, similarity
from ..functions.text import squeeze, words
from ..storage import nullable, settled
from .match import greedy, in_order, match_nodes
from .overlap import alike

KINDS = ("added", "removed", "modified", "unchanged", "moved")
SPLIT, MOVE = 0.4, 0.6
#: Words of a side that meet in one task.
TILE = 1 << 19
_FIELDS = ["display_path", "body_text", "section_number", "element_id"]


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of each pair of versions: added, removed, unchanged, modified; a pair under ``SPLIT`` alike is two changes."""
    matched = settled(match_nodes(old, new, tuple(_FIELDS)))
    a, b = squeeze(F.coalesce("body_text_old", F.lit(""))), squeeze(F.coalesce("body_text_new", F.lit("")))
    differ = F.col("oi").isNotNull() & F.col("ni").isNotNull() & (a != b)
    # Only texts that differ are compared.
    one, other = (F.when(differ, F.col(f"body_text_{s}")) for s in ("old", "new"))
    whole = F.when(F.col("oi").isNull(), "added").when(F.col("ni").isNull(), "removed").when(differ, "modified").otherwise("unchanged")
    kinds = F.when(differ & (F.col("sim") < SPLIT), F.array(F.lit("removed"), F.lit("added"))).otherwise(F.array(whole))
    rows = in_order(matched.withColumn("sim", similarity(one, other))).withColumn("change_type", F.explode(kinds))
    gone, come = F.col("change_type") != "added", F.col("change_type") != "removed"
    half = F.when((F.col("change_type") == "added") & F.col("oi").isNotNull(), 0.5).otherwise(0.0)
    number = F.coalesce(F.nullif(F.when(come, F.col("section_number_new")), F.lit("")), F.when(gone, F.col("section_number_old")))
    out = rows.select(
        "pair_id", "change_type", "match_path", *[F.when(gone if s == "old" else come, F.col(f"display_path_{s}")).alias(f"display_path_{s}") for s in ("old", "new")],
        F.when(gone, F.col("body_text_old")).alias("old_text"), F.when(come, F.col("body_text_new")).alias("new_text"), F.coalesce(number, F.lit("")).alias("section_number"),
        F.coalesce(F.when(gone, F.col("element_id_old")), F.lit("")).alias("element_id_old"), F.coalesce(F.when(come, F.col("element_id_new")), F.lit("")).alias("element_id_new"),
        (F.col("out_ord") + half).cast("double").alias("out_ord"),
    )
    # Line diffs follow from the texts, so the table does without.
    return _with_diff(settled(out, matched), F.col("change_type") == "modified")


def _with_diff(changes: DataFrame, some: Column) -> DataFrame:
    at = changes.columns.index("new_text") + 1
    return changes.select(*changes.columns[:at], F.when(some, line_diff(F.col("old_text"), F.col("new_text"))).alias("text_diff"), *changes.columns[at:])


def move_candidates(gone: DataFrame, come: DataFrame, least: float = MOVE, tile: int = TILE) -> DataFrame:
    """Scored pairs of removed (pair_id, oi, a) and added (pair_id, ni, b) that are ``least`` alike or more.

    The texts of a pair of versions meet in one task; a pair with more than ``tile`` words on a side is cut into tiles, each of so many
    removed and added words, and every tile finds its own pairs: see ``overlap.alike``.
    """
    sides = [d.select("pair_id", F.lit(i).alias("side"), F.col(k).cast("double").alias("i"), F.coalesce(F.col(t), F.lit("")).alias("t")) for i, (d, k, t) in enumerate(((gone, "oi", "a"), (come, "ni", "b")))]
    texts = sides[0].unionByName(sides[1]).withColumn("n", F.size(words(F.col("t"))))
    cuts = [F.ceil(F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)) / tile).cast("int").alias(f"cut{i}") for i in (0, 1)]
    large = texts.groupBy("pair_id").agg(*cuts).where("cut0 > 1 OR cut1 > 1")
    dealt = texts.where("n > 0").join(F.broadcast(large), "pair_id", "left").na.fill(1, ["cut0", "cut1"])
    own, every = (F.when(F.col("side") == i, F.col("cut0")).otherwise(F.col("cut1")) for i in (0, 1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("i"), F.greatest(own, F.lit(1))).cast("int")).withColumn("each", F.explode(F.sequence(F.lit(0), F.greatest(every, F.lit(1)) - 1)))
    spot = [F.when(F.col("side") == i, F.col("own")).otherwise(F.col("each")).cast("int").alias(f"tile{i}") for i in (0, 1)]
    key = ["pair_id", "tile0", "tile1"]
    dealt = dealt.select("pair_id", *spot, "side", "i", "t").repartition(*key).sortWithinPartitions(*key, "side")
    schema = nullable(StructType([dealt.schema["pair_id"], *[StructField(c, DoubleType()) for c in ("oi", "ni", "sim")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now = to_arrow_type(schema["pair_id"].dataType), None
        ids: tuple[list, list] = ([], [])
        held: tuple[list, list] = ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            out = [(ids[0][i], ids[1][j], sim) for i, j, sim in alike(*held, least)] if all(held) else []
            for k in range(0, len(out), 10_000):
                part = out[k : k + 10_000]
                cols = [pa.array([now[0]] * len(part), kind), *[pa.array(c, pa.float64()) for c in zip(*part, strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        for batch in batches:
            for *at, side, i, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != now:
                    if now is not None:
                        yield from done()
                    now, ids, held = at, ([], []), ([], [])
                ids[side].append(i)
                held[side].append(text)
        if now is not None:
            yield from done()

    def empty(side: int, i: str) -> DataFrame:
        """Texts without words are alike, and claimed from the last on: only pairs of one rank can be taken."""
        last = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("i")))
        return texts.where((F.col("side") == side) & (F.col("n") == 0)).select("pair_id", F.col("i").alias(i), last.alias("rank"))

    blank = empty(0, "oi").join(empty(1, "ni"), ["pair_id", "rank"]).select("pair_id", "oi", "ni", F.lit(1.0).alias("sim"))
    return dealt.mapInArrow(run, schema).unionByName(blank)


def _marks(used: DataFrame, block: int = 1024) -> DataFrame:
    """Rows (pair_id, block, bits) of (pair_id, cid): one bit for each number that is there."""
    at = F.pmod(F.col("cid"), F.lit(block))
    words = [F.bit_or(F.when(F.floor(at / 64) == i, F.expr("shiftleft(1L, CAST(cid % 64 AS INT))")).otherwise(F.lit(0).cast("long"))) for i in range(block // 64)]
    return used.groupBy("pair_id", F.expr(f"cid div {block}").alias("block")).agg(F.array(*words).alias("bits"))


def reconcile_moves(changes: DataFrame, least: float = MOVE) -> DataFrame:
    """Removed and added changes that are ``least`` alike become moved ones, best first, at the end of the order.

    ``changes`` are read several times; their out_ord are whole or half numbers and differ within a pair.
    """
    c = changes.withColumn("cid", (F.col("out_ord") * 2).cast("long"))
    gone, come = c.where("change_type = 'removed'"), c.where("change_type = 'added'")
    pairs = move_candidates(gone.select("pair_id", F.col("cid").alias("oi"), F.col("old_text").alias("a")), come.select("pair_id", F.col("cid").alias("ni"), F.col("new_text").alias("b")), least)
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("sim"), F.desc("oi"), F.desc("ni")))
    whole = [F.col(k).cast("long").alias(k) for k in ("oi", "ni")]
    moved = settled(greedy(pairs, ["pair_id"]).select("pair_id", *whole, rank.alias("rank")))
    # What has moved is known by a bit for each change, small enough to go to every task; the changes themselves stay where they are.
    used = moved.select("pair_id", F.col("oi").alias("cid")).unionByName(moved.select("pair_id", F.col("ni").alias("cid")))
    c = c.withColumn("block", F.expr("cid div 1024")).join(F.broadcast(_marks(used)), ["pair_id", "block"], "left")
    hit = F.coalesce(F.expr("shiftright(bits[CAST(cid % 1024 div 64 AS INT)], CAST(cid % 64 AS INT)) & 1"), F.lit(0).cast("long")) == 1
    taken = c.where(hit)
    o = taken.where("change_type = 'removed'").select("pair_id", F.col("cid").alias("oi"), "match_path", "display_path_old", "old_text", F.col("section_number").alias("so"), "element_id_old")
    n = taken.where("change_type = 'added'").select("pair_id", F.col("cid").alias("ni"), "display_path_new", "new_text", F.col("section_number").alias("sn"), "element_id_new")
    last = changes.groupBy("pair_id").agg(F.max("out_ord").alias("last"))
    m = moved.join(last, "pair_id").join(o, ["pair_id", "oi"]).join(n, ["pair_id", "ni"])
    m = m.select(
        "pair_id", F.lit("moved").alias("change_type"), "match_path", "display_path_old", "display_path_new", "old_text", "new_text",
        F.coalesce(F.nullif("sn", F.lit("")), "so").alias("section_number"), "element_id_old", "element_id_new", (F.col("last") + F.col("rank")).cast("double").alias("out_ord"),
    )
    same = squeeze(F.coalesce("old_text", F.lit(""))) == squeeze(F.coalesce("new_text", F.lit("")))
    return c.where(~hit).select(*changes.columns).unionByName(_with_diff(m, ~same))


def diff_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of each pair of versions, moves reconciled, with the financial struct."""
    return with_financial(reconcile_moves(classify(old, new)))


def with_financial(changes: DataFrame) -> DataFrame:
    sides = F.col("old_text"), F.col("new_text")
    # Amounts are columns first: each use of an expression would read the text again.
    known = changes.withColumns({f"__{i}": amounts(x) for i, x in enumerate(sides)})
    both = F.col("__0"), F.col("__1")
    return known.withColumn("financial", financial(*sides, amount_pairs(*sides, *both), *both)).drop("__0", "__1")


def filter_changes(changes: DataFrame, include_unchanged: bool = False, path: str = "", amounts_only: bool = False) -> DataFrame:
    out = changes if include_unchanged else changes.where("change_type <> 'unchanged'")
    if path:
        out = out.where(F.contains(F.array_join("match_path", " "), F.lit(path.lower())))
    return out.where("financial.amounts_changed") if amounts_only else out


def summary(changes: DataFrame) -> DataFrame:
    """Per pair a count of each kind, zero where there is none."""
    return changes.groupBy("pair_id").agg(*[F.count_if(F.col("change_type") == k).alias(k) for k in KINDS])


def unsure(changes: DataFrame, least: float = SPLIT, most: float = MOVE) -> DataFrame:
    """Modified changes whose texts are at least ``least`` and less than ``most`` alike: kept as pairs, though a move would need more."""
    return changes.where("change_type = 'modified'").withColumn("sim", similarity("old_text", "new_text")).where((F.col("sim") >= least) & (F.col("sim") < most))


def broken(changes: DataFrame) -> DataFrame:
    """Rows (pair_id, rule, n) of rules that changes must keep: no pair less alike than its kind asks for, no two with the same nodes."""
    pairs = changes.where("change_type IN ('modified', 'moved')").withColumn("sim", similarity("old_text", "new_text"))
    low = pairs.where(F.col("sim") < F.when(F.col("change_type") == "moved", MOVE).otherwise(SPLIT)).select("pair_id", F.concat(F.col("change_type"), F.lit(" but unlike")).alias("rule"))
    same = changes.groupBy("pair_id", "element_id_old", "element_id_new").agg(F.count("*").alias("k")).where(F.col("k") > 1).select("pair_id", F.lit("same nodes").alias("rule"))
    return low.unionByName(same).groupBy("pair_id", "rule").agg(F.count("*").alias("n"))


def curated(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of (pair_id, match_path, amount): with ``ord``, the first node of the path, and ``found``, whether its text holds the amount."""
    first = nodes.groupBy("pair_id", "match_path").agg(F.min_by(F.struct("ord", "body_text"), "ord").alias("n"))
    rows = expected.join(first, ["pair_id", "match_path"], "left")
    return rows.select(*expected.columns, F.col("n.ord").alias("ord"), F.coalesce(F.array_contains(amounts(F.col("n.body_text")), F.col("amount")), F.lit(False)).alias("found"))


def by_division(nodes: DataFrame) -> DataFrame:
    """Nodes of each version by division."""
    return nodes.groupBy("pair_id", "division_label").agg(F.count("*").alias("nodes"))
