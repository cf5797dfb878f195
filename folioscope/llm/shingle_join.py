"""N-gram Jaccard join (operator 4): blocked sparse product of the document by shingle incidence with its transpose.

Documents with equal shingle sets are one class, a row of the incidence.  Size-derived bounds keep rows and pairs out:

* A class can only link if enough of its shingles are shared.  That is tested first on the part of each set that comes
  first by hash, long enough that a linked pair must share a known number of shingles in it, then on whole sets.
* With shingles in order of rarity, linked classes meet within the first n - ceil(3n/4) + 1 of each set.  Classes joined by
  such meetings are one block of rows; no link leaves it.  A block of many entries is cut into tiles, by set size and then by
  hash, and only tiles of sizes that can link are multiplied.

Each tile's product accumulates the overlap counts of all its pairs, over blocks of columns; pairs under 3/7 of both
sizes together are discarded.  What leaves a tile is one row for each class: how many documents it links with and the
least class it reaches, so a group of thousands of texts, all alike but different, costs its product and no list of pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from . import bytehash as B
from . import setjoin as J
from .shared import add_columns, bounded_batches, lean, ranked, stored

WIDTH = 5
#: Part of each set, first by hash, that the first test of shared shingles looks at.
PART = 0.4
#: Documents whose entries a task looks at together.
CHUNK = 4000
#: Weight of a tile: its entries, a row counting as ``ROW`` at least, so that a tile's counts are bounded too.
TILE, ROW = 1 << 19, 256
#: Columns that are multiplied together.
COLUMNS = 2048
_ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("k", "<i8")])
_COUNT = np.dtype([("n", "<u4"), ("none", "<u2"), ("k", "<i8")])


def key_of(v: np.ndarray) -> int:
    """A set's 64-bit key, never 0."""
    return int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


def _part(n, part: float):
    """(length of the part, shingles that linked sets share in it at least) of sets of ``n``."""
    need = J.least_overlap(n)
    size = np.minimum(n, np.maximum(n - need + 1, np.ceil(part * n).astype(np.int64)))
    return size, np.maximum(1, size - (n - need))


def _partner_share(part: float) -> float:
    """What the part of any partner leaves to share, for each shingle of a set.

    A partner of m shares ceil(3/7 (n + m)) at least, of which its part of part * m or more misses at most the m - overlap that
    come before.  That is linear in m, so it is least for the largest partner, 4/3 n, or the smallest, 3/4 n.
    """
    return min((4 * part - 1) / 3, 3 * part / 4)


def least_shared(n, part: float):
    """Shingles of its part that a set of ``n`` must share: no more than the parts of both sides of any link leave."""
    other = np.ceil(np.asarray(n) * _partner_share(part) - 1e-9).astype(np.int64)
    return np.maximum(1, np.minimum(_part(n, part)[1], other))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, k): k is the key of the shingle set, null if it is empty."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = B.shingle_sets(batch.column(batch.schema.get_field_index("text")), WIDTH)
        got = [(len(v), key_of(v) if len(v) else None) for v in sets]
        return {"n_shingles": pa.array([g[0] for g in got], pa.int64()), "k": pa.array([g[1] for g in got], pa.int64())}

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return add_columns(narrow, run, [StructField("n_shingles", LongType()), StructField("k", LongType())], ("text",))


def _set_batches(batches: Iterator[pa.RecordBatch], ready: bool) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Lists of about ``CHUNK`` distinct (key, set)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        if ready:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            off = np.asarray(batch.column(1).offsets) - batch.column(1).offsets[0].as_py()
            got = ((k, flat[a:b]) for k, a, b in zip(batch.column(0).to_pylist(), off[:-1], off[1:], strict=True))
        else:
            got = ((key_of(v), v) for v in B.shingle_sets(batch.column(0), WIDTH) if len(v))
        for k, v in got:
            held[k] = v
            if len(held) >= CHUNK:
                yield list(held.items())
                held = {}
    if held:
        yield list(held.items())


def shared_counts(source: DataFrame, part: float, n_buckets: int) -> DataFrame:
    """Rows (k, shared): shingles in the part of each class that another class's part has too, or more than that.

    ``source`` has a column of texts, or columns k and v of sets.  Entries (shingle, class) go to buckets of shingles as
    packed arrays.  A shingle that several classes of one task's chunk hold goes as one entry that stands for all, so a
    shingle that a third of all documents hold comes to a bucket as a few entries.
    """
    ready = len(source.columns) == 2
    bounded_batches(source.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _set_batches(batches, ready):
            keys = np.array([k for k, _ in chunk], np.int64)
            size = _part(np.array([len(v) for _, v in chunk]), part)[0]
            h = np.concatenate([v[:n] for (_, v), n in zip(chunk, size, strict=True)])
            owner = np.repeat(np.arange(len(keys)), size)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.append(True, h[1:] != h[:-1])
            at = np.cumsum(new) - 1
            many = np.bincount(at)[at] > 1
            send = ~many | new
            entries = np.zeros(int(send.sum()), _ENTRY)
            entries["low"], entries["high"] = h[send] & np.uint64(0xFFFFFFFF), (h[send] >> np.uint64(32)) & np.uint64(0xFFFF)
            entries["k"] = np.where(many[send], 0, keys[owner[send]])
            rows = list(J.dealt(((h[send] >> np.uint64(44)) % np.uint64(n_buckets)).astype(np.int32), entries))
            here = np.bincount(owner[many], minlength=len(keys))
            counts = np.zeros(int((here > 0).sum()), _COUNT)
            counts["n"], counts["k"] = here[here > 0], keys[here > 0]
            # Counts already known travel with some bucket of this chunk, told apart by a sign.
            rows += [(-1 - int(b), blob) for b, blob in J.dealt((counts["k"] % n_buckets).astype(np.int32), counts)]
            if rows:
                yield J.blob_batch(rows)

    def summed(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, at = np.unique(k, return_inverse=True)
        return known, np.bincount(at, weights=n, minlength=len(known)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> pa.RecordBatch:
            k, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            counts = np.zeros(len(k), _COUNT)
            counts["k"], counts["n"] = k, n
            return J.blob_batch(list(J.dealt((k.view(np.uint64) % np.uint64(n_buckets)).astype(np.int32), counts)))

        def kinds() -> Iterator[tuple[bool, np.ndarray]]:
            known: list[bytes] = []

            def rest() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    sign = np.asarray(batch.column(0)) < 0
                    known.extend(batch.column(1).filter(pa.array(sign)).to_pylist())
                    yield batch.filter(pa.array(~sign))

            for e in J.by_bucket(rest(), _ENTRY):
                yield False, e
                if known:
                    yield True, np.frombuffer(b"".join(known), _COUNT)
                    known.clear()
            if known:
                yield True, np.frombuffer(b"".join(known), _COUNT)

        size = 0
        for ready_, e in kinds():
            if ready_:
                held.append((e["k"].astype(np.int64), e["n"].astype(np.int64)))
            else:
                h = e["high"].astype(np.uint64) << np.uint64(32) | e["low"].astype(np.uint64)
                order = np.lexsort((e["k"], h))
                h, k = h[order], e["k"][order]
                one = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))  # a class in several tasks counts once
                h, k = h[one], k[one]
                new = np.append(True, h[1:] != h[:-1])
                at = np.cumsum(new) - 1
                many = (np.bincount(at) > 1) | (np.bincount(at, weights=k == 0) > 0)
                k = k[many[at] & (k != 0)]
                held.append((k, np.ones(len(k), np.int64)))
            size += len(held[-1][0])
            if size > 1 << 20:
                yield added()
                held.clear()
                size = 0
        if held:
            yield added()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in J.by_bucket(batches, _COUNT):
            k, n = summed(e["k"].astype(np.int64), e["n"].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["k", "shared"])

    blobs = source.mapInArrow(lean(deal), "bucket int, blob binary")
    placed = blobs.repartition(F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    return J.routed(placed.mapInArrow(lean(count), "bucket int, blob binary")).mapInArrow(lean(add), "k long, shared long")


def _enough(part: float):
    """Column test: ``shared`` is ``least_shared`` of a set of ``n``, or more."""
    n = F.col("n")
    need = F.floor((3 * n + 3) / 4)
    own = F.least(n, F.greatest(n - need + 1, F.ceil(n * part))) - (n - need)
    return F.col("shared") >= F.greatest(F.lit(1), F.least(own, F.ceil(n * _partner_share(part) - 1e-9)))


def sets_of(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """Rows (k, v) for the classes in ``wanted``, made again from the texts rather than kept for all."""
    bits = J.bitmap(wanted, "k")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _set_batches(batches, False):
            hit = J.marked(bits, np.array([k for k, _ in chunk], np.int64))
            got = [kv for kv, x in zip(chunk, hit, strict=True) if x]
            for i in range(0, len(got), 500):
                part = got[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([v.view(np.int64) for _, v in part], pa.list_(pa.int64()))], names=["k", "v"])

    made = docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "k long, v array<long>")
    return made.join(wanted.select("k"), "k").groupBy("k").agg(F.first("v").alias("v"))


def prefixes(sets: DataFrame) -> DataFrame:
    """Rows (h, k): the shingles, rarest first, within which each class of (k, v) must meet its partners.

    A class's shingles that no other has come first in its order.  Classes that share too few have no rows.
    """
    entries = sets.select("k", F.size("v").alias("n"), F.explode("v").alias("h"))
    shared = stored(entries.groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") > 1).withColumn("df", F.col("times")))
    both = J.beside(entries, shared, "h", "times")
    order = Window.partitionBy("k").orderBy("df", "h")
    both = both.withColumn("r", F.row_number().over(order)).withColumn("c", F.count("*").over(Window.partitionBy("k")))
    need = F.floor((3 * F.col("n") + 3) / 4)
    return both.where((F.col("c") >= need) & (F.col("r") <= F.col("c") - need + 1)).select("h", "k")


def row_blocks(entries: DataFrame) -> DataFrame:
    """Rows (k, g): classes that a chain of common prefix shingles joins have one g; classes that meet none have no row."""
    first = stored(entries.groupBy("h").agg(F.min("k").alias("p"), F.count("*").alias("times")).where(F.col("times") > 1))
    met = J.beside(entries, first, "h", "times").where(F.col("k") != F.col("p"))
    return J.components(stored(met.select(F.col("p").alias("a"), F.col("k").alias("b")).distinct()))


def tiles(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (tile, whole, side, k, v, copies): the members of each tile, tile by tile within a partition.

    A block of at most ``TILE`` is one tile.  Else its classes are cut by size, a factor of 4/3 each, and by hash into parts of
    about ``TILE``; each part is a tile, and each two parts of one size or neighbouring ones are one whose sides are 0 and 1.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3) + 1e-9).cast("int")
    rows = stored(sets.join(blocks, "k").withColumn("n", F.size("v")).withColumn("c", size))
    parts = rows.groupBy("g", "c").agg(F.sum(F.greatest("n", F.lit(ROW))).alias("weight"), F.count("*").alias("times"))
    cut = F.map_from_entries(F.collect_list(F.struct("c", F.ceil(F.col("weight") / TILE).cast("int"))))  # some 75 sizes at most
    per = stored(parts.groupBy("g").agg(F.sum("times").alias("times"), (F.sum("weight") <= TILE).alias("whole"), cut.alias("parts")))
    rows = J.beside(rows, per, "g", "times")
    own = F.pmod(F.xxhash64("k"), F.try_element_at("parts", F.col("c")).cast("long")).cast("int")

    def name(c: Column, p: Column, d: Column, q: Column) -> Column:
        return F.concat_ws(",", F.col("g").cast("string"), c.cast("string"), p.cast("string"), d.cast("string"), q.cast("string"))

    def others(c: Column) -> Column:
        n = F.coalesce(F.try_element_at("parts", c), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    c = F.col("c")
    tile = lambda t, side: F.struct(t.alias("tile"), side.cast("int").alias("side"))
    all_ = F.concat(
        F.transform(others(c), lambda q: tile(name(c, F.least(own, q), c, F.greatest(own, q)), F.when(own < q, 0).when(own > q, 1))),
        F.transform(others(c + 1), lambda q: tile(name(c, own, c + 1, q), F.lit(0))),
        F.transform(others(c - 1), lambda q: tile(name(c - 1, q, c, own), F.lit(1))),
    )
    all_ = F.when(F.col("whole"), F.array(tile(F.col("g").cast("string"), F.lit(None)))).otherwise(all_)
    return rows.select("whole", "k", "v", "copies", F.inline(all_)).repartition("tile").sortWithinPartitions("tile").select("tile", "whole", "side", "k", "v", "copies")


def overlaps(sets: list[np.ndarray], left: int = 0) -> np.ndarray:
    """Numbers of shingles that each two of the sets share: the rows' incidence times its transpose, summed over columns.

    With ``left``, of the first ``left`` sets with each of the others.  Columns that few rows have add to the counts pair by
    pair; blocks of other columns are multiplied as matrices.
    """
    n, sizes = len(sets), np.array([len(v) for v in sets], np.int64)
    h, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    col = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
    df = np.bincount(col)
    out = np.zeros((left, n - left) if left else (n, n), np.float32)
    few = max(2, n // 64)
    use = (df[col] > 1) & (df[col] <= few)
    r, c, d = row[use], col[use], 1
    while len(r) > d:
        i = np.flatnonzero(c[d:] == c[:-d])
        if not len(i):
            break
        a, b = r[i], r[i + d]  # rows ascend within a column
        d += 1
        if left:
            a, b = a[(a < left) & (b >= left)], b[(a < left) & (b >= left)] - left
        np.add.at(out, (a, b), 1)
        if not left:
            np.add.at(out, (b, a), 1)
    use = df[col] > few
    r, c = row[use], col[use]
    if len(c):
        c = np.cumsum(np.append(0, c[1:] != c[:-1]))
        for at in range(0, int(c[-1]) + 1, COLUMNS):
            i, j = np.searchsorted(c, (at, at + COLUMNS))
            block = np.zeros((n, COLUMNS), np.float32)
            block[r[i:j], c[i:j] - at] = 1
            out += block[:left] @ block[left:].T if left else block @ block.T
    return out


def linked(sets: list[np.ndarray], left: int = 0) -> np.ndarray:
    """Whether each two sets link: 100 * overlap >= 75 * union.  With ``left``, only the first ``left`` with the others."""
    n, sizes, counts = len(sets), np.array([len(v) for v in sets]), overlaps(sets, left)
    out = np.zeros((n, n), bool)
    for a in range(0, len(counts), 256):  # rows together
        part = slice(a, min(a + 256, len(counts)))
        out[part, left:] = J.reaches(counts[part].astype(np.int64), sizes[part, None], sizes[None, left:])
    if left:
        out[left:, :left] = out[:left, left:].T
    np.fill_diagonal(out, False)
    return out


def _reached(links: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row the least key among the rows that links reach."""
    out, open_ = key.copy(), np.ones(len(key), bool)
    for i in np.argsort(key):
        if open_[i]:
            now = np.array([i])
            while len(now):
                open_[now] = False
                out[now] = key[i]
                now = np.flatnonzero(links[now].any(0) & open_)
    return out


def products(tiled: DataFrame) -> DataFrame:
    """Rows (k, whole, least, links): of each class that links within a tile the least class it reaches there, and its links' documents."""
    bounded_batches(tiled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            _, whole, side, key, sets, copies = zip(*sorted(held, key=lambda x: x[2] or 0), strict=True)
            key, copies = np.array(key, np.int64), np.array(copies, np.int64)
            left = side.count(0)
            links = linked(list(sets), left) if side[0] is None or 0 < left < len(side) else np.zeros((len(side), len(side)), bool)
            some = links.any(1)
            n = np.array([copies[x].sum() for x in links[some]], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(np.array(whole)[some]), pa.array(_reached(links, key)[some]), pa.array(n)], names=["k", "whole", "least", "links"])

        for batch in batches:
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            off = np.asarray(batch.column(4).offsets) - batch.column(4).offsets[0].as_py()
            cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)]
            for i, (t, whole, side, k, copies) in enumerate(zip(*cols, strict=True)):
                if held and held[0][0] != t:
                    if len(held) > 1:
                        yield done()
                    held.clear()
                held.append((t, whole, side, k, flat[off[i] : off[i + 1]].copy(), copies))
        if len(held) > 1:
            yield done()

    return tiled.mapInArrow(lean(run), "k long, whole boolean, least long, links long")


def class_links(sets: DataFrame) -> DataFrame:
    """Of (k, v, copies): rows (k, g, links) of classes that link; g is the least class that links reach, links the documents of linked classes."""
    found = stored(products(tiles(sets, row_blocks(stored(prefixes(sets))))))
    out = found.where("whole").select("k", F.col("least").alias("g"), "links")
    cut = found.where("NOT whole")
    if cut.isEmpty():
        return out
    label = J.components(cut.where(F.col("k") != F.col("least")).select(F.col("least").alias("a"), F.col("k").alias("b")))
    return out.unionByName(cut.groupBy("k").agg(F.sum("links").alias("links")).join(label, "k").select("k", "g", "links"))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links), one for each row of ``docs``.

    component_id is the smallest doc_id that links reach, the document's own included; n_links counts the other documents
    that the document itself links with, copies too.  A text without words, or null, has 0 shingles, its own id and no links.
    Rows that share an id are documents of their own here; a null id counts only where no member of the component has one.
    An empty table gives no rows.
    """
    named = stored(classes(docs, doc_id, text))
    kinds = stored(named.where(F.col("k").isNotNull()).groupBy("k").agg(F.first("n_shingles").alias("n"), F.count("*").alias("copies")))
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = docs.select(F.col(text).alias("text"))
    shared = shared_counts(texts, PART, J.buckets(int(total * PART)))
    alive = stored(kinds.join(shared, "k").where(_enough(PART)).select("k", "n"))
    sets = stored(sets_of(texts, alive))
    size = alive.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = shared_counts(sets.select("k", "v"), 1.0, J.buckets(size))
    alive = stored(alive.join(shared, "k").where(F.col("shared") >= F.floor((3 * F.col("n") + 3) / 4)).select("k"))
    label = class_links(stored(sets.join(alive, "k").join(kinds.select("k", "copies"), "k")))
    # Of each class its component and links, and how many documents ask for them
    of = stored(kinds.join(label, "k", "left").select("k", F.coalesce("g", "k").alias("g"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("times")))
    grouped = stored(J.beside(named, of, "k", "times", "left").drop("k"))
    least = stored(grouped.where(F.col("g").isNotNull()).groupBy("g").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    out = J.beside(grouped, least, "g", "times", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.  All columns stay.

    Each row is a document of its own, also if its id is null or repeated: unrelated texts stay.  Ids only rank, null last;
    of a component's rows with the same smallest id any one stays.
    """
    rows = ranked(docs, doc_id, "__row")
    linked = link_documents(rows, "__row", text).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept"))
    return rows.join(linked, F.col("__row") == F.col("__kept"), "left_semi").select(*docs.columns)
