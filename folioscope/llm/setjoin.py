"""Pieces of exact set-similarity joins at a Jaccard similarity of 3/4 that the near-duplicate operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Entries that a bucket of the shuffled incidence lists holds on average.
BUCKET = 1 << 16
#: Rows of one key from which on it is joined apart, and how many such keys there can be.
HOT, HOT_KEYS = 10_000, 20_000
#: Bits of a bitmap by the number of its keys: least, most, and bits for each key.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 24, 1 << 27, 16


def least_overlap(n):
    """The least overlap of a set of ``n`` with any partner: ceil(3/4 n)."""
    return (3 * n + 3) // 4


def reaches(bound, n, m):
    """Whether an overlap of at most ``bound`` can make sets of ``n`` and ``m`` similar: overlap >= 3/4 union."""
    return 7 * bound >= 3 * (n + m)


def buckets(entries: int) -> int:
    return int(min(max(-(-entries // BUCKET), 256), 1 << 20))


def taken(entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``entries[at]`` of a structured array, moved as plain bytes, which is several times faster."""
    return np.take(np.ascontiguousarray(entries).view(np.uint8).reshape(-1, entries.dtype.itemsize), at, axis=0).view(entries.dtype).ravel()


def dealt(bucket: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed entries) of a structured array, bucket by bucket."""
    small = len(bucket) and bucket.max() < 1 << 16  # 16-bit keys are sorted by radix
    order = np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")
    bucket, entries = bucket[order], taken(entries, order)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(bucket)), strict=True):
        if a < b:
            yield int(bucket[a]), entries[a:b].tobytes()


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def by_bucket(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """The entries of one bucket after the other, of rows that are sorted by bucket."""
    held: list[bytes] = []
    now = None
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != now and held:
                yield np.frombuffer(b"".join(held), dtype)
                held = []
            now = b
            held.append(blob)
    if held:
        yield np.frombuffer(b"".join(held), dtype)


def routed(blobs: DataFrame) -> DataFrame:
    """Rows (bucket, blob) with each bucket's rows together."""
    return blobs.repartition("bucket").sortWithinPartitions("bucket")


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each value of ``key`` modulo the bitmap's size: 2 to 16 MB however many there are, so a set bit is only a hint."""
    keys = stored(keys.select(key))
    size = LEAST_BITS
    while size < MOST_BITS and size < BITS_A_KEY * keys.count():
        size *= 2
    b = F.pmod(F.col(key), F.lit(size)) + 1
    pages = keys.select(b.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in pages:
        at = (r["page"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def beside(left: DataFrame, right: DataFrame, key: str, times: str, how: str = "inner") -> DataFrame:
    """Inner or left join with a written table that has each key once, and in ``times`` how many rows of ``left`` have it, or more.

    Keys of more than ``HOT`` rows and a 20,000th of all rows, which are ``HOT_KEYS`` at most, are broadcast, so no task gets more
    of one key; rows without a key aren't shuffled.
    """
    rest = [c for c in right.columns if c not in (key, times)]
    total = right.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
    most = max(HOT, total // HOT_KEYS)
    hot = right.where(F.col(times) > most).select(key, F.struct(F.lit(1).alias("one"), *rest).alias("__hot"))
    some = left.where(F.col(key).isNotNull())
    if hot.isEmpty():
        out = some.join(right.drop(times), key, how)
    else:
        told = some.join(F.broadcast(hot), key, "left")
        cold = told.where(F.col("__hot").isNull()).drop("__hot").join(right.where(F.col(times) <= most).drop(times), key, how)
        out = cold.unionByName(told.where(F.col("__hot").isNotNull()).select(*left.columns, *[f"__hot.{c}" for c in rest]))
    if how == "left":
        none = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rest]
        out = out.unionByName(left.where(F.col(key).isNull()).select(*left.columns, *none))
    return out


def components(links: DataFrame) -> DataFrame:
    """Rows (k, g) for each end of the links (a, b): g is the smallest end that links reach.

    Every round takes the least label among neighbours, then the label of that label, so labels travel twice as far each
    round; rounds are written to the shared folder.  Nothing is collected but the number of labels that changed.
    """
    ends = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = stored(ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("g"), F.count("*").alias("degree")))
    while True:
        near = beside(ends, label.select(F.col("x").alias("y"), "g", "degree"), "y", "degree").groupBy("x").agg(F.min("g").alias("m"))
        step = stored(label.join(near, "x").select("x", "degree", F.col("g").alias("was"), F.least("g", "m").alias("g")))
        sizes = stored(step.groupBy("g").agg(F.count("*").alias("times")))
        of = stored(step.select(F.col("x").alias("g"), F.col("g").alias("gg")).join(sizes, "g"))
        new = stored(beside(step, of, "g", "times", "left").select("x", "degree", "was", F.least(F.col("g"), F.coalesce("gg", "g")).alias("g")))
        if new.where(F.col("was") != F.col("g")).isEmpty():
            return new.select(F.col("x").alias("k"), "g")
        label = new.select("x", "degree", "g")
