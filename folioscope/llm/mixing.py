"""Mixing sources to target weights (operator 3): weighted fair queueing in DataFrame operations only.

Each source's documents stand in a shuffled order that a hash of the id fixes.  A document's virtual finish time is the
number of its source's words up to and including it, divided by the source's target; a document may come again in up to
``times`` passes over its source.  All documents in order of finish time, cut where the total reaches the budget, are
the mix, so that every source ends within about a document of its target.

Nothing is ordered in one task.  Sums run first over ranges of the shuffled order of each source, more for more documents, or over
ranges of finish time, then within a range, so a source that holds a third of all rows is spread over its ranges.
Because the mix of a source is a beginning of its order, one row for each source says what is taken: texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Fixed value: what a word is.
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows up to which a counted table is broadcast.
SMALL = 20_000
#: Buckets of each source's order, at least and at most, and about how many rows of the largest source one has.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET = 256, 1 << 20, 1 << 18
#: Ranges of finish time in a unit of it.
RANGES = 4096


def words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Never null, and in code-point order with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(per: DataFrame, times: int = 3, period: int = 3) -> DataFrame:
    """Of one row (k, source_size) for each source: its weight 1, 2 .. ``period`` and again by rank, and its target.

    The targets share the sum of all sizes by weight; one stops at ``times`` its source's size, and what is over is shared
    again by weight until none is above.  That is ``least(times * size, level * weight)`` for the one level that makes
    the targets add up: in order of ``times * size / weight``, the first source that its level doesn't fill sets it.
    The rows here are sources, already summed; these windows see no documents.
    """
    ranked = per.withColumn("weight", ((F.row_number().over(Window.orderBy("k")) - 1) % period + 1).cast("long"))
    cap = F.col("source_size") * times
    order = Window.orderBy(cap / F.col("weight"), "k")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left / share)
    level = level.withColumn("level", F.max(F.when(cap / F.col("weight") > F.col("level"), F.col("level"))).over(everything))
    target = F.coalesce(F.least(cap.cast("double"), F.col("level") * F.col("weight")), cap.cast("double"))
    return level.select("k", "source_size", target.alias("target"))


def _beside(left: DataFrame, right: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join with a table of at most ``rows`` rows, counted before: broadcast if that is few."""
    return left.join(F.broadcast(right) if rows <= SMALL else right, on, how)


def _order(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> dict[str, Column]:
    hashed = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return {"k": _key(F.col(source)), "size": words(F.col(text)), "ordinal": hashed}


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", times: int = 3, buckets: int | None = None, seed: str = "mix") -> tuple[DataFrame, DataFrame, int]:
    """(one row for each document, one row for each source, number of sources).

    Documents: doc_id, k, size, ordinal.  Sources: k, source_size, target and the last place taken (turn, ordinal, size), null
    where nothing is taken.  Rows that agree in id, source and size are taken alike, all or none in a turn.
    """
    base = stored(docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in _order(docs, doc_id, text, source, seed).items()]))
    buckets = buckets or min(max(LEAST_BUCKETS, base.count() // BUCKET), MOST_BUCKETS)
    # The hash's first 24 bits deal a source's order out to its buckets.
    bucket = F.floor(F.conv(F.substring("ordinal", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int")
    base = base.withColumn("bucket", bucket)
    sums = stored(base.groupBy("k", "bucket").agg(F.sum("size").alias("words")))
    targets = stored(source_targets(sums.groupBy("k").agg(F.sum("words").alias("source_size")), times))
    n, budget = targets.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    ahead = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = _beside(sums.select("k", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")), targets, ["k"], n)
    upto = F.sum("size").over(Window.partitionBy("k", "bucket").orderBy("ordinal", "size"))  # rows that tie share one sum
    placed = _beside(base.select("k", "bucket", "ordinal", "size", upto.alias("upto")), starts, ["k", "bucket"], n * buckets)
    turns = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("upto", F.col("turn") * F.col("source_size") + F.col("ahead") + F.col("upto"))
    turns = turns.withColumn("finish", F.when(F.col("target") > 0, F.col("upto") / F.col("target")).otherwise(F.lit(0.0)))
    late = 2 * RANGES + F.floor(F.log2("finish") * 64)
    turns = turns.select("k", "turn", "ordinal", "size", "finish", F.when(F.col("finish") < 2, F.floor(F.col("finish") * RANGES)).otherwise(late).cast("long").alias("range"))
    turns = stored(turns)
    spans = turns.groupBy("range").agg(F.sum("size").alias("words"))  # as many rows as there are ranges, at most
    spans = spans.withColumn("upto", F.sum("words").over(Window.orderBy("range")))
    edge = spans.where(F.col("upto") > budget).orderBy("range").select("range", (F.col("upto") - F.col("words")).alias("before")).first()
    place = F.struct("turn", "ordinal", "size")
    if edge is None:
        taken = turns
    else:
        queue = Window.partitionBy("range").orderBy("finish", "k", "turn", "ordinal", "size")
        inside = turns.where(F.col("range") == edge["range"]).withColumn("upto", F.sum("size").over(queue)).where(F.col("upto") + edge["before"] <= budget)
        taken = turns.where(F.col("range") < edge["range"]).unionByName(inside.drop("upto"))
    last = taken.groupBy("k").agg(F.max(place).alias("last"))
    return base.drop("bucket"), stored(_beside(targets, last, ["k"], n, "left")), n


def _passes() -> Column:
    reached = F.struct("ordinal", "size") <= F.struct(F.col("last.ordinal").alias("ordinal"), F.col("last.size").alias("size"))
    return F.when(F.col("last").isNull(), F.lit(0)).otherwise(F.col("last.turn") + F.when(reached, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", times: int = 3, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, passes), one for each row of ``docs``.

    ``passes`` is how often the mix takes the document, ``taken`` its words with repeats counted.  A null text has size 0; a
    null source is a source of its own; documents of size 0 are passed like others.  An empty table gives no rows.  Equal
    input gives equal output, however it is partitioned.
    """
    base, sources, n = plan(docs, doc_id, text, source, times, seed=seed)
    out = _beside(base.withColumnRenamed("size", "own"), sources, ["k"], n).withColumn("size", F.col("own")).withColumn("passes", _passes())
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"), "passes")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", times: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, with its columns, that the mix takes, each as often as it takes it."""
    _, sources, n = plan(docs, doc_id, text, source, times, seed=seed)
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[c.alias(k) for k, c in _order(docs, doc_id, text, source, seed).items()])
    out = _beside(whole, sources, ["k"], n).withColumn("passes", _passes()).where(F.col("passes") > 0)
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*")


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS ordinal FROM {docs}),
per AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
ranked AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS weight, CAST(3 * source_size AS BIGINT) AS cap FROM per),
lv AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS BIGINT) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS level0
       FROM ranked WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv2 AS (SELECT *, max(CASE WHEN cap / weight > level0 THEN level0 END) OVER () AS level FROM lv),
targets AS (SELECT k, source_size, coalesce(least(CAST(cap AS DOUBLE), level * weight), CAST(cap AS DOUBLE)) AS target FROM lv2),
placed AS (SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.k ORDER BY ordinal, size) AS BIGINT) AS upto FROM d JOIN targets USING (k)),
turns AS (SELECT *, CASE WHEN target > 0 THEN (turn * source_size + upto) / target ELSE 0 END AS finish FROM placed, (SELECT unnest([0, 1, 2]) AS turn)),
queue AS (SELECT *, sum(size) OVER (ORDER BY finish, k, turn, ordinal, size) AS total FROM turns)
"""
ORACLE_ROWS = ORACLE + r"""
SELECT doc_id, size, source_size, target, CAST(size * passes AS BIGINT) AS taken, passes
FROM (SELECT doc_id, k, ordinal, size, any_value(source_size) AS source_size, any_value(target) AS target,
             CAST(count(*) FILTER (WHERE total <= (SELECT sum(size) FROM d)) / (count(*) / 3) AS BIGINT) AS passes, CAST(count(*) / 3 AS BIGINT) AS copies
      FROM queue GROUP BY doc_id, k, ordinal, size), LATERAL (SELECT unnest(range(copies)))
"""
