"""Line dedup (operator 9): an exact set-similarity join of lines.

A line is the set of its lower-cased words.  Words stand in order of rarity; two lines of Jaccard similarity 3/4 must meet
within the first n - ceil(3n/4) + 1 words of each (prefix filter).  Where they meet, what is left of either bounds
their overlap (positional filter), their sizes must agree (length filter), and a 128-bit parity sketch of each set bounds
their difference from below (bitmap filter).  Pairs that pass are verified on whole sets, and the later line of a pair
goes.

Texts are read three times: for word counts, for lines, and for the sets of candidates.  Lines travel as packed arrays:
first to their set's bucket, where all but the earliest of equal sets go, then, once for each prefix word of a set, to the
word's bucket, where pairs are made.  A task sends one line for each of its sets, so a line that a third of all documents
hold reaches its bucket as one entry from each task.

Rarity comes from word counts over all lines in a table of fixed size, hashed, so it is broadcast whatever the corpus; any
order of words gives the same result.  Lists of frequent words are cut into blocks that meet each other in separate tasks.
Sets are equal if a 64-bit key, the sketch and the size are; words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField

from . import bytehash as B
from . import setjoin as J
from .shared import add_columns, bounded_batches, lean, ranked, stored

#: Sets of so many words are similar to equal sets only, so they take no part in the join.
ALONE = 2
#: Slots of the table of word counts, and of one of its pages.
SLOTS, PAGE = 1 << 20, 4096
#: Entries of a list from which on it is cut into blocks; lines and entries that a task sends together.
SPLIT, LINES_SENT, CHUNK = 1 << 19, 100_000, 400_000
#: Earlier partners that pass the filters, or that are clearly near, after which a line looks for no more in a list, unless
#: none of them holds; and how many a line with clearly near ones offers from each bucket.
ENOUGH, ENOUGH_NEAR, OFFERED, FULL = 64, 4, 1, 1 << 30
#: Rounds after which a list is looked at in tiles of so many later and earlier entries.
ROUNDS, TILE_ROWS, TILE = 48, 1024, 128
#: Documents up to which those that hold candidates are broadcast to filter the texts that are read again.
FEW = 200_000
#: Lines looked at together, at most 2**16: a sort key has 16 bits for the line, 8 for rarity and 40 of the word's hash.
LINES, WORD_BITS = 1 << 13, 40
_LINE = np.dtype([("k", "<u8"), ("s", "<u8"), ("t", "<u8"), ("doc", "<i8"), ("line", "<u4"), ("start", "<u4"), ("end", "<u4"), ("n", "<u4"), ("m", "<u4")])
_SAME = np.dtype([("doc", "<i8"), ("line", "<u4"), ("start", "<u4"), ("end", "<u4")])
_ENTRY = np.dtype([("w", "<u8"), ("doc", "<i8"), ("line", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("s", "<u8"), ("t", "<u8")])


def line_words(texts: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """Lines that have a word, up to ``LINES`` at once: row, line_no, start and end (code points), and of each of their words
    the hash ``h`` and the line ``of``."""
    for lo, buf, starts, _ in B.blocks(texts):
        low = B.LOWER[buf]
        s, e = B.spans(low)
        if not len(s):
            continue
        feed = np.flatnonzero(buf == 10)
        head = np.append(0, feed[:-1] + 1)
        first = np.searchsorted(s, head)
        count = np.diff(np.append(first, len(s)))
        h = B.hashes(low, s, e)
        use = np.flatnonzero(count)
        row = np.searchsorted(starts, head[use], "right") - 1
        line_no = use - np.searchsorted(head, starts)[row]
        later = np.flatnonzero((buf & 0xC0) == 0x80)  # bytes that begin no character
        chars = lambda at: at - np.searchsorted(later, at)  # noqa: B023, E731
        base = chars(starts[row])
        for i in range(0, len(use), LINES):
            part = slice(i, i + LINES)
            on = use[part]
            n = count[on]
            at = slice(first[on[0]], first[on[-1]] + n[-1])  # lines between these have no words
            yield {"row": lo + row[part], "line_no": line_no[part], "start": chars(head[on]) - base[part], "end": chars(feed[on]) - base[part], "h": h[at], "of": np.repeat(np.arange(len(on)), n)}


def _distinct(w: dict[str, np.ndarray], rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, word, words of each line) of the distinct words of each line, rarest first."""
    h = w["h"]
    key = w["of"].astype(np.uint64) << np.uint64(48) | rare[_slot(h)].astype(np.uint64) << np.uint64(WORD_BITS) | h >> np.uint64(64 - WORD_BITS)
    order = np.argsort(key)
    key, h = key[order], h[order]
    alike, again = key[1:] == key[:-1], h[1:] == h[:-1]
    if (alike & ~again).any():  # words that agree in all the key holds of them
        order = np.lexsort((h, key))
        key, h = key[order], h[order]
        alike, again = key[1:] == key[:-1], h[1:] == h[:-1]
    one = np.append(True, ~(alike & again))[: len(h)]
    of = (key[one] >> np.uint64(48)).astype(np.int64)
    return of, h[one], np.bincount(of, minlength=len(w["row"]))


def _slot(word: np.ndarray) -> np.ndarray:
    return (word & np.uint64(SLOTS - 1)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """Of (row, text): rows (page, counts) of the table of word counts; page -1 has the number of lines and of words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lines, words = np.zeros(SLOTS, np.int64), 0, 0
        for batch in batches:
            for _, buf, _, _ in B.blocks(batch.column(1)):
                low = B.LOWER[buf]
                s, e = B.spans(low)
                np.add.at(table, _slot(B.hashes(low, s, e)), 1)
                lines, words = lines + int((buf == 10).sum()), words + len(s)
        pages = [p for p in range(SLOTS // PAGE) if table[p * PAGE : (p + 1) * PAGE].any()]
        blobs = [np.minimum(table[p * PAGE : (p + 1) * PAGE], 2**32 - 1).astype("<u4").tobytes() for p in pages]
        yield pa.RecordBatch.from_arrays([pa.array([*pages, -1], pa.int32()), pa.array([*blobs, np.array([lines, words], "<i8").tobytes()], pa.binary())], names=["page", "counts"])

    return docs.mapInArrow(lean(run), "page int, counts binary")


def rarity(counts: DataFrame) -> tuple[np.ndarray, int, int]:
    """(for each slot eight times the binary logarithm of its words' count, lines, words): a megabyte, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[p] = total.get(p, 0) + np.frombuffer(blob, "<u4" if p >= 0 else "<i8").astype(np.int64)
        logs = [np.minimum(np.round(8 * np.log2(1 + v)), 255).astype(np.uint8).tobytes() if p >= 0 else v.tobytes() for p, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(logs, pa.binary())], names=["page", "logs"])

    out, size = np.zeros(SLOTS, np.uint8), np.zeros(2, np.int64)
    for r in counts.repartition("page").mapInArrow(lean(add), "page int, logs binary").collect():
        if r["page"] < 0:
            size = np.frombuffer(bytes(r["logs"]), np.int64)
        else:
            out[r["page"] * PAGE : (r["page"] + 1) * PAGE] = np.frombuffer(bytes(r["logs"]), np.uint8)
    return out, int(size[0]), int(size[1])


def _ragged(m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the items of the groups ``at`` of sizes ``m``, one group after the other."""
    n = m[at].astype(np.int64)
    first = np.cumsum(m, dtype=np.int64) - m
    return np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)


def prefixes(w: dict[str, np.ndarray], ids: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``_LINE`` rows, their prefix words one line after the other) of lines."""
    of, word, n = _distinct(w, rare)
    mixed = B.mix(word)
    first = np.cumsum(n) - n
    sums = np.bincount(of * 128 + (mixed & np.uint64(127)).astype(np.int64), minlength=len(n) * 128).reshape(len(n), 128)
    sketch = np.packbits((sums & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    out = np.zeros(len(n), _LINE)
    with np.errstate(over="ignore"):
        out["k"] = B.mix(np.add.reduceat(mixed, first) + n.astype(np.uint64))
    out["s"], out["t"], out["doc"], out["line"], out["start"], out["end"], out["n"] = sketch[:, 0], sketch[:, 1], ids[w["row"]], w["line_no"], w["start"], w["end"], n
    out["m"] = np.where(n > ALONE, n - J.least_overlap(n) + 1, 0)
    return out, word[np.arange(len(of)) - first[of] < out["m"][of]]


def earliest(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the earliest of the rows of each set, their words, the others)."""
    order = np.lexsort((rows["line"], rows["doc"], rows["t"], rows["s"], rows["k"]))
    kept = J.taken(rows, order)
    new = np.append(True, (kept["k"][1:] != kept["k"][:-1]) | (kept["s"][1:] != kept["s"][:-1]) | (kept["t"][1:] != kept["t"][:-1]) | (kept["n"][1:] != kept["n"][:-1]))[: len(kept)]
    later = kept[~new]
    others = np.zeros(len(later), _SAME)
    for c in _SAME.names:
        others[c] = later[c]
    return kept[new], words[_ragged(rows["m"], order[new])], others


def entries_of(rows: np.ndarray, words: np.ndarray, rare: np.ndarray, split: int) -> np.ndarray:
    """One entry for each prefix word of each line."""
    m = rows["m"].astype(np.int64)
    at = np.repeat(np.arange(len(rows)), m)
    out = np.zeros(len(words), _ENTRY)
    out["w"], out["pos"] = words, np.arange(len(words)) - np.repeat(np.cumsum(m) - m, m)
    for c in ("doc", "line", "n", "s", "t"):
        out[c] = rows[c][at]
    return split_lists(out, rare, split)


def split_lists(entries: np.ndarray, rare: np.ndarray, split: int) -> np.ndarray:
    """``entries`` with the list of each frequent word cut into blocks; each pair of blocks is a list of its own."""
    parts = 1 + (np.exp2(rare[_slot(entries["w"])] / 8) / split).astype(np.int64)
    many = np.flatnonzero(parts > 1)
    if not len(many):
        return entries
    mine = (line_key(entries["doc"][many], entries["line"][many]).view(np.uint64) % parts[many].astype(np.uint64)).astype(np.int64)
    copies = [np.delete(entries, many)]
    for j in range(int(parts[many].max())):
        on = j < parts[many]
        a, b = np.minimum(mine[on], j), np.maximum(mine[on], j)
        one = entries[many[on]]
        with np.errstate(over="ignore"):
            one["w"] = B.mix(one["w"] + ((a << 32) + b + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        copies.append(one)
    return np.concatenate(copies)


def met(e: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of an earlier line, of a later one, distance of their sketches, indices of lines that stopped looking).

    ``e`` is the bucket's entries, by list and then by rank.  Round d looks at the pairs that stand d apart in a list; what stands
    further apart than ``ROUNDS`` is looked at in tiles of one list.
    """
    h = e["w"].copy()
    new = np.append(True, h[1:] != h[:-1])
    place = (np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]).astype(np.int32)
    n = e["n"].astype(np.int32)
    # 7 * min(left) >= 3 * (sum of sizes), as what each side allows against the other's size
    allow, size = 7 * (n - e["pos"].astype(np.int32)) - 3 * n, 3 * n
    s, t, doc, line = (e[c].copy() for c in ("s", "t", "doc", "line"))
    found, close = np.zeros(len(e), np.int32), np.zeros(len(e), np.int32)
    early, late, apart, stopped = ([np.zeros(0, np.int64)] for _ in range(4))
    active, d = None, 1
    while True:
        if active is None:  # most lists are short: whole arrays against themselves moved by d
            j = np.flatnonzero((place[d:] >= d) & (allow[:-d] >= size[d:]) & (allow[d:] >= size[:-d])) + d if d < len(e) else np.zeros(0, np.int64)
        else:
            x = active - d
            j = active[(allow[x] >= size[active]) & (allow[active] >= size[x])]
        i = j - d
        both = n[i].astype(np.int64) + n[j]
        ham = np.bitwise_count(s[i] ^ s[j]).astype(np.int64) + np.bitwise_count(t[i] ^ t[j])
        ok = (ham <= both - 2 * -(-3 * both // 7)) & ((doc[i] != doc[j]) | (line[i] != line[j]))
        early.append(i[ok])
        late.append(j[ok])
        apart.append(ham[ok])
        found[j[ok]] += 1
        close[j[ok]] += _near(ham[ok], both[ok])
        d += 1
        if active is None and d <= 4:
            if not (place >= d).any():
                break
            continue
        active = np.flatnonzero(place >= d) if active is None else active[place[active] >= d]
        full = (found[active] >= enough) | ((close[active] >= ENOUGH_NEAR) & (enough < FULL))
        stopped.append(active[full])
        active = active[~full]
        if not len(active):
            break
        if d > ROUNDS:
            heads = np.flatnonzero(new)
            at = np.searchsorted(heads, active, "right")
            for a, b in zip(*(lambda c: (np.append(0, c), np.append(c, len(active))))(np.flatnonzero(np.diff(at)) + 1), strict=True):
                for c in range(a, b, TILE_ROWS):
                    _tiles(active[c : min(c + TILE_ROWS, b)], heads[at[a] - 1], d, enough, (allow, size, n, s, t, doc, line, found, close), (early, late, apart, stopped))
            break
    return tuple(np.concatenate(x) for x in (early, late, apart, stopped))


def _tiles(rows: np.ndarray, lo: int, d: int, enough: int, of: tuple[np.ndarray, ...], out: tuple[list, ...]) -> None:
    """What ``met`` finds of lines ``rows`` of the list from ``lo`` on, ``d`` and more before each, nearest tile first."""
    allow, size, n, s, t, doc, line, found, close = of
    early, late, apart, stopped = out
    hi = int(rows[-1]) - d + 1
    while hi > lo and len(rows):
        low = max(lo, hi - TILE)
        cols = slice(low, hi)
        pass_ = (allow[cols] >= size[rows][:, None]) & (allow[rows][:, None] >= size[cols])
        if hi - 1 > rows[0] - d:
            pass_ &= np.arange(low, hi) <= (rows - d)[:, None]
        if 8 * np.count_nonzero(pass_) > pass_.size:  # counting all of a tile is cheaper than picking out so many
            both = n[rows][:, None] + n[cols]
            pass_ &= np.bitwise_count(s[rows][:, None] ^ s[cols]).astype(np.int32) + np.bitwise_count(t[rows][:, None] ^ t[cols]) <= both - 2 * -(-3 * both // 7)
        # From the right, so that the nearest of a line come first
        r, back = np.divmod(np.flatnonzero(pass_[:, ::-1]), hi - low)
        j, i = rows[r], hi - 1 - back
        both = n[i].astype(np.int64) + n[j]
        ham = np.bitwise_count(s[i] ^ s[j]).astype(np.int64) + np.bitwise_count(t[i] ^ t[j])
        ok = (ham <= both - 2 * -(-3 * both // 7)) & ((doc[i] != doc[j]) | (line[i] != line[j]))
        r, j, i, ham, both = r[ok], j[ok], i[ok], ham[ok], both[ok]
        # A line keeps no more than ``enough``; one with more has stopped.
        use = np.arange(len(r)) - np.searchsorted(r, r) + found[j] < enough
        early.append(i[use])
        late.append(j[use])
        apart.append(ham[use])
        found[rows] += np.bincount(r, minlength=len(rows)).astype(np.int32)
        close[rows] += np.bincount(r[_near(ham, both)], minlength=len(rows)).astype(np.int32)
        full = (found[rows] >= enough) | ((close[rows] >= ENOUGH_NEAR) & (enough < FULL))
        stopped.append(rows[full])
        rows, hi = rows[~full], low


def met_by(e: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of an earlier line, of a later one, distance of their sketches) of all pairs whose later line is in ``want``.

    ``e`` is as in ``met``; each wanted entry is held against all before it in its list at once.
    """
    h = e["w"].copy()
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    n = e["n"].astype(np.int64)
    allow = 7 * (n - e["pos"].astype(np.int64)) - 3 * n
    s, t, doc, line = (e[c].copy() for c in ("s", "t", "doc", "line"))
    early, late, apart = ([np.zeros(0, np.int64)] for _ in range(3))
    for j in np.flatnonzero(want):
        lo = starts[np.searchsorted(starts, j, "right") - 1]
        i = lo + np.flatnonzero((allow[lo:j] >= 3 * n[j]) & (allow[j] >= 3 * n[lo:j]) & ((doc[lo:j] != doc[j]) | (line[lo:j] != line[j])))
        both = n[i] + n[j]
        ham = np.bitwise_count(s[i] ^ s[j]).astype(np.int64) + np.bitwise_count(t[i] ^ t[j])
        ok = ham <= both - 2 * -(-3 * both // 7)
        early.append(i[ok])
        late.append(np.full(ok.sum(), j))
        apart.append(ham[ok])
    return tuple(np.concatenate(x) for x in (early, late, apart))


_FOUND = "doc_a long, line_a int, doc_b long, line_b int, apart int, more boolean, start long, end long"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())


def _found(cols: list) -> pa.RecordBatch:
    size = next(len(c) for c in cols if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])


def _offered(e: np.ndarray, enough: int, only: np.ndarray | None) -> list[pa.RecordBatch]:
    """Pairs to verify of one bucket: a later line with clearly near partners offers the nearest of them, another all.

    more says that a line has partners which it doesn't offer; doc_a is null where it stopped looking.
    """
    h = e["w"].copy()
    order = np.argsort(h)
    h = h[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    twice = ~new
    twice[:-1] |= twice[1:]
    order, lists = order[twice], (np.cumsum(new) - 1)[twice].astype(np.uint64)
    # By list, then by rank: ranks are made dense so that both fit one key.
    doc, line = e["doc"][order], e["line"][order].astype(np.int64)
    small = len(doc) and doc.min() >= 0 and doc.max() < 1 << 42 and line.max() < 1 << 20
    by = np.argsort(doc << 20 | line) if small else np.lexsort((line, doc))
    rank = np.empty(len(by), np.uint64)
    rank[by] = np.arange(len(by), dtype=np.uint64)
    e = J.taken(e, order[np.argsort(lists << np.uint64(32) | rank)])
    if only is None:
        early, late, apart, stopped = met(e, enough)
    else:
        early, late, apart = met_by(e, J.marked(only, line_key(e["doc"], e["line"])))
        stopped = late[:0]
    doc, line = e["doc"], e["line"]
    order = np.lexsort((line[early], doc[early], apart, line[late], doc[late]))
    early, late, apart = early[order], late[order], apart[order]
    differs = lambda c: c[1:] != c[:-1]
    head = np.append(True, differs(doc[late]) | differs(line[late]))[: len(late)]
    fresh = np.append(True, differs(doc[early]) | differs(line[early]))[: len(late)] | head
    early, late, apart, head = early[fresh], late[fresh], apart[fresh], head[fresh]
    first = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    near = _near(apart, e["n"][early].astype(np.int64) + e["n"][late])[first][group] if only is None else np.zeros(len(late), bool)
    place = np.arange(len(late)) - first[group]
    take = ~near | (place < OFFERED)
    more = near & (np.bincount(group, minlength=len(first))[group] > OFFERED)
    pairs = _found([doc[early][take], line[early][take], doc[late][take], line[late][take], apart[take], more[take], None, None])
    ended = _found([None, None, doc[stopped], line[stopped], None, np.ones(len(stopped), bool), None, None])
    return pa.Table.from_batches([pairs, ended]).combine_chunks().to_batches()


def _near(apart: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sketches are so near that their sets are most likely similar, for sets of ``both`` words together."""
    return apart <= np.minimum((both - 2 * -(-3 * both // 7)) // 3, 14)


def _packed(bucket: np.ndarray, rows: np.ndarray, words: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, number of rows, rows and their words end to end), bucket by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, words, rows = bucket[order], words[_ragged(rows["m"], order)], J.taken(rows, order)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    ends = np.append(0, np.cumsum(rows["m"], dtype=np.int64))
    return [(int(bucket[a]), np.int64(b - a).tobytes() + rows[a:b].tobytes() + words[ends[a] : ends[b]].tobytes()) for a, b in zip(np.append(0, cut), np.append(cut, len(rows)), strict=True) if a < b]


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows, words = [], []
    for x in blobs:
        n = int(np.frombuffer(x, np.int64, 1)[0])
        rows.append(np.frombuffer(x, _LINE, n, 8))
        words.append(np.frombuffer(x, np.uint64, -1, 8 + n * _LINE.itemsize))
    return np.concatenate(rows), np.concatenate(words)


def _bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return (B.mix(key) % np.uint64(n_buckets)).astype(np.int32)


def _entries_sent(held: list[np.ndarray], n_buckets: int) -> list[tuple[int, bytes]]:
    e = np.concatenate(held)
    return list(J.dealt(_bucket(e["w"].copy(), n_buckets), e))


def _same_sent(others: np.ndarray, n_buckets: int) -> list[tuple[int, bytes]]:
    """Lines that go for an equal one's sake travel under negative bucket numbers."""
    return [(-1 - b, x) for b, x in J.dealt(_bucket(others["doc"].astype(np.uint64), n_buckets), others)] if len(others) else []


def _routed(blobs: DataFrame) -> DataFrame:
    return blobs.repartition(F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each bucket, of rows that are sorted by bucket."""
    held: list[bytes] = []
    now = None
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(blob)
    if held:
        yield now, held


def found(docs: DataFrame, rare: np.ndarray, lines: int, words: int, enough: int, split: int) -> DataFrame:
    """Rows of ``_FOUND`` over the lines of (row, text).

    A row with ``start`` is a line whose set an earlier line has; others are pairs that pass all filters, a before b, of the
    earliest lines of their sets.  doc_a is null where b stopped looking.
    """
    line_buckets, word_buckets = J.buckets(lines), J.buckets(words // 4 + lines)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            rows, words, others = earliest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return J.blob_batch(_packed(_bucket(rows["k"].copy(), line_buckets), rows, words) + _same_sent(others, line_buckets))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in line_words(batch.column(1)):
                held.append(prefixes(w, ids, rare))
                if sum(len(r) + len(x) // 8 for r, x in held) >= LINES_SENT:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b, blobs in _grouped(batches):
            if b < 0:
                yield J.blob_batch([(b, x) for x in blobs])
                continue
            rows, words, others = earliest(*_unpacked(blobs))
            if len(others):
                yield J.blob_batch(_same_sent(others, word_buckets))
            held.append(entries_of(rows, words, rare, split))
            size += len(held[-1])
            if size >= CHUNK:
                yield J.blob_batch(_entries_sent(held, word_buckets))
                held.clear()
                size = 0
        if size:
            yield J.blob_batch(_entries_sent(held, word_buckets))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in _grouped(batches):
            if b < 0:
                x = np.frombuffer(b"".join(blobs), _SAME)
                yield _found([None, None, x["doc"], x["line"], None, None, x["start"], x["end"]])
            else:
                yield from _offered(np.frombuffer(b"".join(blobs), _ENTRY), enough, None)

    bounded_batches(docs.sparkSession)
    sets = _routed(docs.mapInArrow(lean(deal), "bucket int, blob binary"))
    return _routed(sets.mapInArrow(lean(spread), "bucket int, blob binary")).mapInArrow(lean(join), _FOUND)


def candidates(docs: DataFrame, rare: np.ndarray, words_: int, only: np.ndarray, words: np.ndarray, split: int) -> DataFrame:
    """Rows of ``_FOUND``: all partners that pass the filters of the later lines in ``only``, a bitmap, from the lists of ``words`` alone, a bitmap too."""
    n_buckets = J.buckets(words_ // 4)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in line_words(batch.column(1)):
                use = np.bincount(w["of"][J.marked(words, w["h"])], minlength=len(w["row"])) > 0
                if not use.any():
                    continue
                on, at = use[w["of"]], np.cumsum(use) - 1
                w = {k: v[on] if k in ("h", "of") else v[use] for k, v in w.items()}
                w["of"] = at[w["of"]]
                rows, x, _ = earliest(*prefixes(w, ids, rare))
                e = entries_of(rows, x, rare, 1 << 62)
                e = e[J.marked(words, e["w"].copy())]
                held.append(split_lists(e, rare, split))
                if sum(map(len, held)) >= CHUNK:
                    yield J.blob_batch(_entries_sent(held, n_buckets))
                    held.clear()
        if sum(map(len, held)):
            yield J.blob_batch(_entries_sent(held, n_buckets))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _grouped(batches):
            yield from _offered(np.frombuffer(b"".join(blobs), _ENTRY), FULL, only)

    bounded_batches(docs.sparkSession)
    return _routed(docs.mapInArrow(lean(deal), "bucket int, blob binary")).mapInArrow(lean(join), _FOUND)


def line_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return B.mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)).view(np.int64)


def _bits(rows: DataFrame, doc: str, line: str | None = None) -> np.ndarray:
    """Bitmap of documents, or of lines, of ``rows``."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(line_key(d, np.asarray(b.column(1)) if line else np.zeros(len(d), np.int64)))], names=["q"])

    return J.bitmap(rows.select(doc, *([line] if line else [])).mapInArrow(lean(keyed), "q long"), "q")


def line_sets(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (doc, line_no, start, end, v) for the lines (doc, line_no) wanted and maybe others, made again from the texts."""
    doc_bits, bits = _bits(lines, "doc"), _bits(lines, "doc", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(J.marked(doc_bits, line_key(ids, np.zeros(len(ids), np.int64))))
            ids = ids[rows]
            for w in line_words(batch.column(1).take(pa.array(rows))):
                doc = ids[w["row"]]
                hit = np.flatnonzero(J.marked(bits, line_key(doc, w["line_no"])))
                if len(hit):
                    n = np.bincount(w["of"], minlength=len(doc))
                    last = np.cumsum(n)
                    v = [np.unique(w["h"][last[i] - n[i] : last[i]]).view(np.int64) for i in hit]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[hit]), pa.array(w["line_no"][hit], pa.int32()), pa.array(w["start"][hit], pa.int64()), pa.array(w["end"][hit], pa.int64()), pa.array(v, pa.list_(pa.int64()))],
                        names=["doc", "line_no", "start", "end", "v"],
                    )

    return _documents_of(docs, lines).mapInArrow(lean(run), "doc long, line_no int, start long, end long, v array<long>")


def _documents_of(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The texts that hold the lines (doc, line_no), or more: few ids are broadcast, for many all texts are looked at."""
    of = lines.select("doc").distinct()
    return docs.join(F.broadcast(of), docs["row"] == of["doc"], "left_semi") if of.limit(FEW + 1).count() <= FEW else docs


def prefix_words(docs: DataFrame, lines: DataFrame, rare: np.ndarray) -> DataFrame:
    """Rows (word): the words of the prefixes of the lines (doc, line_no), and maybe of others."""
    bits = _bits(lines, "doc", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in line_words(batch.column(1)):
                rows, words = prefixes(w, ids, rare)
                use = J.marked(bits, line_key(rows["doc"], rows["line"]))
                yield pa.RecordBatch.from_arrays([pa.array(words[np.repeat(use, rows["m"])].view(np.int64))], names=["word"])

    return _documents_of(docs, lines).mapInArrow(lean(run), "word long").distinct()


def _held(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct (doc, line_no, start, end) of the later lines of pairs that are similar."""
    ends = pairs.select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line_no")).unionByName(pairs.select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line_no"))).distinct()
    sets = stored(line_sets(docs, stored(ends)))
    a, b = (sets.select(F.col("doc").alias(f"doc_{x}"), F.col("line_no").alias(f"line_{x}"), F.col("v").alias(f"v{x}"), "start", "end") for x in "ab")
    both = pairs.select("doc_a", "line_a", "doc_b", "line_b").join(a.drop("start", "end"), ["doc_a", "line_a"]).join(b, ["doc_b", "line_b"])
    overlap: Column = F.size(F.array_intersect("va", "vb"))
    return both.where(J.reaches(overlap, F.size("va"), F.size("vb"))).select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line_no"), "start", "end").distinct()


def _later(rows: DataFrame, enough: int, split: int) -> DataFrame:
    """Of (row, text), rows numbered apart: (doc, line_no, start, end, reason) of each line that an earlier one matches."""
    rare, lines, words = rarity(word_counts(rows))
    all_ = stored(found(rows, rare, lines, words, enough, split))
    same = all_.where(F.col("start").isNotNull()).select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line_no"), "start", "end", F.lit("same").alias("reason"))
    pairs = all_.where(F.col("start").isNull())
    later = [F.col("doc_b").alias("doc"), F.col("line_b").alias("line_no")]
    # First the nearest partner of each line, then the others of lines whose nearest doesn't hold.
    # One long orders them, by distance and then by a hash, so that buffers have fixed widths and nothing is sorted.
    rank = F.shiftleft(F.col("apart").cast("long"), 55) + F.shiftrightunsigned(F.xxhash64("doc_a", "line_a"), 9)
    best = pairs.where(F.col("doc_a").isNotNull()).groupBy("doc_b", "line_b").agg(F.min_by("doc_a", rank).alias("doc_a"), F.min_by("line_a", rank).alias("line_a"))
    best = stored(best.select("doc_a", "line_a", "doc_b", "line_b"))
    gone = stored(_held(rows, best))
    open_ = stored(best.select(*later).join(gone, ["doc", "line_no"], "left_anti"))
    left = stored(pairs.join(open_.select(F.col("doc").alias("doc_b"), F.col("line_no").alias("line_b")), ["doc_b", "line_b"], "left_semi"))
    others = stored(left.where(F.col("doc_a").isNotNull()).select("doc_a", "line_a", "doc_b", "line_b").distinct())
    if not others.isEmpty():
        gone = stored(gone.unionByName(_held(rows, others)).distinct())
    # Lines that didn't offer all their partners, and of which none holds so far, are looked at in full: the lists of
    # their own prefixes alone are made again.
    rest = stored(left.where("more").select(*later).distinct().join(gone, ["doc", "line_no"], "left_anti"))
    if not rest.isEmpty():
        bits = J.bitmap(prefix_words(rows, rest, rare), "word")
        full = candidates(rows, rare, words, _bits(rest, "doc", "line_no"), bits, split)
        full = full.join(rest.select(F.col("doc").alias("doc_b"), F.col("line_no").alias("line_b")), ["doc_b", "line_b"])
        gone = gone.unionByName(_held(rows, stored(full.select("doc_a", "line_a", "doc_b", "line_b").distinct())))
    return same.unionByName(gone.withColumn("reason", F.lit("similar")))


def later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", enough: int = ENOUGH, split: int = SPLIT) -> DataFrame:
    """Rows (doc_id, line_no, start, end, reason): each line that an earlier one matches.

    Lines are parts between line feeds with a word or more, numbered from 0, with their code points.  Each row is a document
    of its own; rows rank by doc_id, null last, those of one id by their text's hash, then lines by number.  A line goes if any
    earlier line's word set has a Jaccard similarity of 3/4 or more with its own, whether that one goes or not.  reason is
    ``same`` if an earlier line has the same set, else ``similar``.  Null and empty texts have no lines, an empty table gives no rows.
    """
    rows, numbered = _rows(docs, doc_id, text)
    out = _later(rows.select("row", "text"), enough, split)
    if not numbered:
        return out.withColumnRenamed("doc", "doc_id")
    return out.join(rows.select(F.col("row").alias("doc"), "doc_id"), "doc").select("doc_id", "line_no", "start", "end", "reason")


def _rows(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """(rows (row, doc_id, text), whether their numbers aren't the ids themselves)."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = ranked(narrow, "doc_id", "row", F.xxhash64("text"), F.md5(F.col("text").cast("binary")))
    return rows, rows.schema["row"].metadata.get("own", False)


def without_later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the later lines taken out of ``text``, each with its line feed; other rows and columns stay.

    Each row is a document of its own, also if its id is null or repeated; the id only ranks it.  ``drop_emptied``: rows that
    lost all their words go.  An empty table gives none.
    """
    rows = ranked(docs, doc_id, "__row", F.xxhash64(text), F.md5(F.col(text).cast("binary")))
    gone = _later(rows.select(F.col("__row").alias("row"), F.col(text).alias("text")), ENOUGH, SPLIT)
    gone = gone.groupBy(F.col("doc").alias("__of")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__gone"))
    both = rows.join(gone, F.col("__row") == F.col("__of"), "left").drop("__of", "__row")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out, left = [], []
        for t, spans in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index("__gone")).to_pylist(), strict=True):
            if spans:
                pieces, pos = [], 0
                for x in spans:
                    pieces.append(t[pos : x["start"]])
                    pos = x["end"] + 1
                rest = t[pos:]
                t = "".join([*pieces, rest]) if rest or not pieces else "".join(pieces).removesuffix("\n")
            out.append(t)
            left.append(not spans or bool(t.strip(" \t\n\v\f\r")))
        return {text: pa.array(out, pa.string()), "__left": pa.array(left, pa.bool_())}

    done = add_columns(both, run, [StructField(text, StringType()), StructField("__left", BooleanType())], ("__gone",))
    return (done.where("__left") if drop_emptied else done).select(*docs.columns)
