"""Exact top-k search (operator 10) over an impact-ordered index of integer vectors.

Candidates are dealt to groups; a group's index is built once, and all queries stream past it in batches, so a task holds one
group and one batch whatever the table's size.  The index has, for each component, posting segments: the candidates whose
absolute value falls into one quantised level, with their values.  A query takes segments in descending order of impact
(its own weight times the segment's largest value) and adds to accumulators.  What a candidate's untaken segments can still
add is known for each candidate, so once few can still reach the k-th best of the lower bounds, the rest is proven out and
the possible members are scored exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, lean, stored

#: Candidates of a group, at least and at most, and levels of a component.
LEAST_GROUP, MOST_GROUP, LEVELS = 1 << 13, 1 << 16, 8
#: Tasks that groups are dealt to, at most; small groups of rows are costly, so they are not put together.
MOST_TASKS = 1 << 15
#: Integers up to which sums of products are exact in doubles; the largest score.
_EXACT, _MOST = 2.0**53, 2**63 - 1


class ImpactIndex:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.whole = rows[order], ids[order], vectors[order]
        self.v = self.whole.astype(np.float64)
        size = np.abs(self.v)
        top = size.max(0, initial=0)
        level = np.minimum(size * levels // np.maximum(top + 1, 1), levels - 1).astype(np.int64)
        #: Each candidate's values rounded up to the largest of their segments.
        self.upper = np.zeros_like(size)
        self.postings: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        dim, most = [], []
        for d in range(vectors.shape[1]):
            by = np.argsort(level[:, d], kind="stable")
            cut = np.searchsorted(level[by, d], np.arange(levels + 1))
            for k in range(levels):
                if cut[k] < cut[k + 1]:
                    at = np.sort(by[cut[k] : cut[k + 1]])
                    self.postings.append(at)
                    self.values.append(self.v[at, d])
                    dim.append(d)
                    most.append(size[at, d].max())
                    self.upper[at, d] = most[-1]
        self.dim, self.most = np.array(dim, np.int64), np.array(most, np.float64)
        self.reach = np.sqrt((self.v**2).sum(1))

    def search(self, query: np.ndarray, own: int, k: int, every: int = 32) -> tuple[np.ndarray, list[int], int]:
        """(ids, scores, segments taken) of the ``k`` best, equal scores by id; the candidate whose row is ``own`` takes no part."""
        n, q = len(self.rows), query.astype(np.float64)
        impact = np.abs(q)[self.dim] * self.most
        order = np.argsort(-impact, kind="stable")
        acc, left = np.zeros(n), self.upper @ np.abs(q)
        # What rounding can move a sum by: nothing while all of it is whole in doubles
        slack = 4 * len(q) * 2.0**-53 * np.sqrt((q**2).sum()) * self.reach
        slack[slack * 2.0**53 < _EXACT] = 0
        out = np.flatnonzero(self.rows == own)
        acc[out] = -np.inf
        possible, taken = np.flatnonzero(acc > -np.inf), 0
        while taken < len(order) and len(possible) > max(4 * k, n // 50):
            for seg in order[taken : taken + every]:
                at = self.postings[seg]
                acc[at] += q[self.dim[seg]] * self.values[seg]
                left[at] -= impact[seg]
            taken += every
            rest = np.maximum(left, 0) + slack
            low = acc - rest
            floor = np.partition(low, n - k)[n - k] if n >= k else -np.inf
            floor = -np.inf if floor <= -(2.0**63) else min(floor, 2.0**63)  # scores beyond a long are alike
            possible = np.flatnonzero(acc + rest >= floor)
        possible = possible[self.rows[possible] != own]
        score = self._scores(possible, query)
        best = np.lexsort((self.ids[possible], ~score))[:k]  # ~score falls as the score rises, and has its range
        return self.ids[possible[best]], score[best].tolist(), min(taken, len(order))

    def _scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products in whole numbers: in doubles where these are exact, else in Python's, kept to the range of a long."""
        if len(at) and float(np.abs(self.v[at]).max(initial=0)) * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(len(query), 1) >= _EXACT:
            q = [int(x) for x in query]
            return np.array([max(-_MOST - 1, min(_MOST, sum(a * b for a, b in zip(map(int, row), q, strict=True)))) for row in self.whole[at]], np.int64)
        return (self.v[at] @ query.astype(np.float64)).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    offsets = np.asarray(column.offsets)
    lens = np.diff(offsets)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", group: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose id ``every`` divides, the ``k`` best other rows.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller id.  Vectors that
    are null or hold null or non-finite components take no part, nor do rows without an id.  Each row is a query or a candidate
    of its own, also if its id is repeated; a shorter vector counts as filled up with zeros.  Components and scores beyond a
    long are its least or largest value.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col(embedding)
    fine = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    edge = float(2**63)
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(edge)), F.lit(-edge))))
    ints = stored(vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), whole.alias("v")))
    rows, dims = ints.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    group = group or min(max(rows // (4 * spark.sparkContext.defaultParallelism), LEAST_GROUP), MOST_GROUP)
    groups = max(1, -(-rows // group))
    found = ints.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("asks", F.lit(0))
    asked = ints.where(F.col("id") % every == 0).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asks", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = -1, [], None
        for batch in batches:
            g, asks = (np.asarray(batch.column(i)) for i in (0, 1))
            cut = np.flatnonzero((np.diff(g) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(g)], strict=True):
                part = batch.slice(a, b - a)
                if a == b:
                    continue
                row, ids, v = np.asarray(part.column(2)), np.asarray(part.column(3)), _matrix(part.column(4), dims)
                if g[a] != now:
                    now, held, index = g[a], [], None
                if not asks[a]:
                    held.append((row, ids, v))
                    continue
                if index is None and held:
                    index = ImpactIndex(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                if index is not None:
                    got = [(r, i, *index.search(q, r, k)[:2]) for r, i, q in zip(row, ids, v, strict=True)]
                    n = [len(x[2]) for x in got]
                    cols = [np.repeat(row, n), np.repeat(ids, n), np.concatenate([x[2] for x in got]).astype(np.int64), np.array([s for x in got for s in x[3]], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "query_id", "vec_id", "score"])

    names = ["g", "asks", "row", "id", "v"]
    both = found.select(*names).unionByName(asked.select(*names)).repartition(min(groups, MOST_TASKS), "g").sortWithinPartitions("g", "asks")
    part = both.mapInArrow(lean(run), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB.
ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""
