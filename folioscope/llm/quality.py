"""Quality rules (operator 5): a decision list learned from labelled statistics, applied as Spark conditional expressions.

Statistics of a text are counted from its bytes in one Arrow pass.  The list is learned by sequential covering: a rule is
a conjunction of thresholds on statistics, grown on one part of the labelled rows by information gain, pruned on the
rest, and kept if it is precise there; the rows it covers are set aside and the next one is grown.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from . import bytehash as B
from .shared import add_columns, first_by_hash, stored

#: What is counted of each text; the first five are the contract's.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines")
_SYMBOLS, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS[list(b"!?")] = True
#: Labelled rows a list is learned from, at most: those first by a hash of their id.
SAMPLE = 20_000


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """For each text the numbers named in ``COUNTS``; null texts count as empty."""
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    for lo, buf, starts, ends in B.blocks(texts):
        rows = slice(lo, lo + len(starts))
        s, e = B.spans(buf)
        at = B.rows_of(s, starts)
        out["n_words"][rows] = np.diff(at)

        def summed(flag: np.ndarray, starts=starts, ends=ends) -> np.ndarray:
            total = np.zeros(len(flag) + 1, np.int64)
            np.cumsum(flag, out=total[1:])
            return total[ends] - total[starts]

        out["word_chars"][rows] = summed(((buf & 0xC0) != 0x80) & B.WORD[buf])
        out["n_symbols"][rows] = summed(_SYMBOLS[buf])
        out["n_marks"][rows] = summed(_MARKS[buf])
        out["n_upper"][rows] = summed((buf >= 0x41) & (buf <= 0x5A))
        out["n_digits"][rows] = summed((buf >= 0x30) & (buf <= 0x39))
        # Lines: every row ends with one line feed of the block's own.
        feed = np.flatnonzero(buf == 10)
        head = np.append(0, feed[:-1] + 1)
        has_word = np.diff(np.append(np.searchsorted(s, head), len(s))) > 0
        head, feed = head[has_word], feed[has_word]
        row = np.searchsorted(starts, head, "right") - 1
        h = B.hashes(buf, head, feed)
        order = np.lexsort((h, row))
        same = (np.diff(row[order]) == 0) & (h[order][1:] == h[order][:-1])
        out["n_lines"][rows] = np.bincount(row, minlength=len(starts))
        out["n_dup_lines"][rows] = np.bincount(row[order][1:][same], minlength=len(starts))
        # Windows of five words that come again within the row; a word counts once however many of them hold it.
        word = B.hashes(buf, s, e)
        wide = B.windows(word, 5)
        if len(wide):
            owner = np.repeat(np.arange(len(starts)), np.diff(at))
            inside = owner[: len(wide)] == owner[4 : 4 + len(wide)]
            with np.errstate(over="ignore"):
                key = np.where(inside, B.mix(wide + owner[: len(wide)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.arange(len(wide), dtype=np.uint64))
            order = np.argsort(key)
            equal = key[order][1:] == key[order][:-1]
            again = np.zeros(len(wide), bool)
            again[order[1:][equal]] = True
            again[order[:-1][equal]] = True
            again &= inside
            step = np.zeros(len(word) + 1, np.int64)
            step[: len(wide)] += again
            step[5 : 5 + len(wide)] -= again
            out["n_repeat_words"][rows] = np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=len(starts))
    return out


def text_statistics(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds the columns of ``COUNTS`` (long); columns of the same name are replaced.  A null text counts as empty."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {k: pa.array(v) for k, v in count_texts(batch.column(batch.schema.get_field_index(text))).items()}

    return add_columns(docs, run, [StructField(c, LongType()) for c in COUNTS], () if keep_text else (text,))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Statistic of a rule: numerator, denominator (None: the number itself).
RATIOS: dict[str, tuple[str, str | None]] = {
    "symbols_a_word": ("n_symbols", "n_words"),
    "marks_a_word": ("n_marks", "n_words"),
    "chars_a_word": ("word_chars", "n_words"),
    "upper_a_char": ("n_upper", "word_chars"),
    "digits_a_char": ("n_digits", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
    "words": ("n_words", None),
}


def _matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([counts[a] / np.maximum(counts[b], 1) if b else counts[a].astype(float) for a, b in RATIOS.values()], 1)


def _ratio(name: str) -> Column:
    a, b = RATIOS[name]
    return F.col(a) / F.greatest(F.col(b), F.lit(1)) if b else F.col(a).cast("double")


Rule = list[tuple[str, str, float]]


def _covers(x: np.ndarray, rule: Rule) -> np.ndarray:
    names, hit = list(RATIOS), np.ones(len(x), bool)
    for name, op, t in rule:
        v = x[:, names.index(name)]
        hit &= v > t if op == ">" else v <= t
    return hit


def learn_rules(counts: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 12, most_terms: int = 4) -> list[Rule]:
    """Ordered rules that reject; rows that none covers are kept.

    Thresholds are midpoints between neighbouring quantiles of a statistic.  A rule must cover ``least`` bad rows, and at
    least ``precision`` of what it covers, in the growing and in the pruning part, must be bad.  No bad rows: no rules.
    """
    x, names = _matrix(counts), list(RATIOS)
    bad = bad.astype(bool)
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    cuts = []
    for j in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 129))) if len(x) else np.zeros(0)
        cuts.append((v[1:] + v[:-1]) / 2)
    while len(rules) < most_rules:
        grow, test = left & ~prune, left & prune
        if (bad & grow).sum() < least:
            break
        rule: Rule = []
        hit = grow.copy()
        while len(rule) < most_terms and (hit & ~bad).any():
            p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
            best, best_gain = None, 1e-9
            for j, name in enumerate(names):
                v, y = x[hit, j], bad[hit]
                order = np.argsort(v, kind="stable")
                pos = np.append(0, np.cumsum(y[order]))
                k = np.searchsorted(v[order], cuts[j], "right")  # rows at most the cut
                for op, p, n in (("<=", pos[k], k - pos[k]), (">", p0 - pos[k], n0 - (k - pos[k]))):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= least, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 0.0)
                    if len(gain) and gain.max() > best_gain:
                        i = int(gain.argmax())
                        best, best_gain = (name, op, float(cuts[j][i])), float(gain[i])
            if best is None:
                break
            rule.append(best)
            hit &= _covers(x, [best])

        def worth(r: Rule, test=test) -> float:
            c = _covers(x, r) & test
            return ((c & bad).sum() - (c & ~bad).sum()) / max(1, c.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covers(x, rule) & left if rule else np.zeros(len(x), bool)
        exact = [(covered & part & bad).sum() >= precision * max(1, (covered & part).sum()) for part in (~prune, prune)]
        if not rule or not all(exact) or (covered & bad).sum() < least:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression over the columns of ``COUNTS``: true keeps a row."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for name, op, t in rule:
            cond = cond & (_ratio(name) > t if op == ">" else _ratio(name) <= t)
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_from(stats: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str | None = None) -> list[Rule]:
    """Rules from rows of ``stats`` that ``labels`` marks 0 (bad) or 1; null labels and ids take no part.

    Of the labels ``sample`` ids at most, the first by a hash, are chosen and broadcast; their rows of numbers come to the
    driver, twice as many at most where ids repeat.  Of several labels of one id the least counts.  With ``text``, rows are
    documents, and only the texts of chosen ids are counted.
    """
    marked = labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    chosen = first_by_hash(marked.groupBy("doc_id").agg(F.min("label").alias("label")), sample, "doc_id")
    if text:
        stats = text_statistics(stats.select("doc_id", text).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), text, False)
    rows = stats.select("doc_id", *COUNTS).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *COUNTS).limit(2 * sample).toPandas()
    # In the order of a hash, so that growing and pruning parts are alike whatever order ids stand in
    rows = rows.assign(h=[hashlib.md5(str(i).encode()).hexdigest() for i in rows["doc_id"]]).sort_values(["h", *COUNTS], kind="stable")  # noqa: S324
    counts = {c: rows[c].to_numpy(np.int64) for c in COUNTS}
    failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
    return learn_rules({c: v[~failed] for c, v in counts.items()}, (rows["label"] == 0).to_numpy()[~failed])


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of ``COUNTS``, base_failed and kept.

    kept is false where base_failed, else the verdict of a list learned from ``labels`` over the documents given; without
    labelled rows only base_failed rejects.  A null or empty text has no words and fails.
    """
    stats = text_statistics(docs, text, keep_text)
    if not keep_text:
        stats = stored(stats)  # numbers only; counted once for learning and for the result
    rules = learn_from(stats if not keep_text else docs, labels, text=text if keep_text else None)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))
