"""Toxicity (operator 7): multiple-instance learning from document labels.

A document is a bag of sentences.  A sentence's probability is logistic in the weighed words it holds, and 0 if it holds
none; the document's is their noisy-or with a leak: one offending sentence is enough, and the leak takes up labels that
no sentence explains, so that a long clean text scores no more than a short one.  Only documents are labelled; the
gradient of the noisy-or likelihood puts the blame on sentences.  The worst sentence of a text is given with its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from . import bytehash as B
from .shared import add_columns, first_by_hash, fold

#: Labelled documents of each class that a model is fitted on, at most, and the most bytes of one of them.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 14
#: Words that a model may weigh, at most.
FEATURES = 2000
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def _bags(texts: pa.Array):
    """Blocks of (first row, bytes, row starts, row ends, sentence starts, row of each sentence, word hashes, sentence of each word)."""
    for lo, buf, starts, ends in B.blocks(texts):
        s, e = B.spans(buf, B.LETTERS)
        words = B.hashes(B.LOWER[buf], s, e)
        end = np.flatnonzero(_END[buf])  # the line feed after each row is one of them
        head = np.append(0, end[:-1] + 1)
        of = np.searchsorted(end, s)
        yield lo, buf, starts, ends, head, end, np.searchsorted(starts, head, "right") - 1, words, of


def _logit(miss: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(np.expm1(np.clip(miss, 0, 30)), 1e-12))


class Model:
    """Words and weights, the bias of a sentence, the leak, and the line that takes a noisy-or's logit to the score's."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float, leak: float, line: tuple[float, float] = (1.0, 0.0)):
        order = np.argsort(words)
        self.words, self.weights, self.bias, self.leak, self.line = words[order], weights[order], bias, leak, line

    def calibrated(self, miss: np.ndarray) -> np.ndarray:
        """Score of a document whose log(1 - p) is ``-miss``; a document without words has 0."""
        return np.where(miss > 0, 1 / (1 + np.exp(-np.clip(self.line[0] * _logit(miss) + self.line[1], -30, 30))), 0.0)

    def weigh(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``words`` the model knows, and their weights."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == words)
        return hit, self.weights[at[hit]]

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        n = len(texts)
        out = {"score": np.zeros(n), "n_sentences": np.zeros(n, np.int64), "worst_start": np.zeros(n, np.int64), "worst_end": np.zeros(n, np.int64), "worst_score": np.zeros(n)}
        for lo, buf, starts, ends, head, end, row, words, of in _bags(texts):
            hit, w = self.weigh(words)
            z = self.bias + np.bincount(of[hit], weights=w, minlength=len(head))
            has_word = np.bincount(of, minlength=len(head)) > 0
            z = np.where(np.bincount(of[hit], minlength=len(head)) > 0, z, -np.inf)
            # log(1 - p) is log(1 - leak) minus the sum of softplus over sentences
            miss = np.bincount(row, weights=np.logaddexp(0, z), minlength=len(starts)) - np.log1p(-self.leak) * (np.bincount(row, weights=has_word, minlength=len(starts)) > 0)
            rows = slice(lo, lo + len(starts))
            out["score"][rows] = self.calibrated(miss)
            out["n_sentences"][rows] = np.bincount(row[has_word], minlength=len(starts))
            worst = np.lexsort((-np.arange(len(z)), z, row))  # the last of each row has its largest z, the earliest of equals
            last = worst[np.append(np.flatnonzero(np.diff(row[worst])), len(worst) - 1)]
            last = last[has_word[last]]
            chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
            r = lo + row[last]
            out["worst_start"][r] = chars[head[last]] - chars[starts[row[last]]]
            out["worst_end"][r] = chars[np.minimum(end[last], ends[row[last]])] - chars[starts[row[last]]]
            out["worst_score"][r] = 1 / (1 + np.exp(-z[last]))
        return out


def fit(texts: list[str], labels: np.ndarray, rounds: int = 300, rate: float = 0.3, ridge: float = 1e-3) -> Model:
    """Noisy-or maximum likelihood over words whose document frequency depends on the label.  Needs both classes."""
    y = np.asarray(labels).astype(bool)
    doc_of, sent_of, words, n_sent, base = [], [], [], 0, 0
    sent_doc = []
    for lo, _, starts, _, head, _, row, w, of in _bags(pa.array(texts, pa.large_string())):
        words.append(w)
        sent_of.append(of + n_sent)
        doc_of.append(lo + row[of] if len(of) else np.zeros(0, np.int64))
        sent_doc.append(lo + row)
        n_sent += len(head)
        base += len(starts)
    words, sent_of, doc_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, sent_of, doc_of))
    sent_doc = np.concatenate(sent_doc) if sent_doc else np.zeros(0, np.int64)
    if not len(words) or y.all() or not y.any():
        rate_ = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(min(rate_, 0.4)))
    known, index = np.unique(words, return_inverse=True)
    pairs = np.unique(index.astype(np.int64) * len(y) + doc_of)
    feature, doc = pairs // len(y), pairs % len(y)
    pos = np.bincount(feature, weights=y[doc], minlength=len(known))
    neg = np.bincount(feature, minlength=len(known)) - pos
    # Chi-square of document frequency against the label
    n1, n0 = y.sum(), (~y).sum()
    expect = (pos + neg) * n1 / (n1 + n0)
    chi = np.where(pos >= np.maximum(4, 0.01 * n1), (pos - expect) ** 2 / np.maximum(expect * (1 - (pos + neg) / (n1 + n0)) * n0 / (n1 + n0), 1e-9), 0)
    chi[pos <= expect] = 0  # only words that speak for the label can make a sentence offend
    pick = np.argsort(-chi, kind="stable")[:FEATURES]
    pick = np.sort(pick[chi[pick] > 40])  # far beyond what the rarest of some 100,000 words reach by chance
    slot = np.full(len(known), -1, np.int64)
    slot[pick] = np.arange(len(pick))
    use = slot[index] >= 0
    f, s = slot[index][use], sent_of[use]
    held = np.bincount(s, minlength=n_sent) > 0
    odds = np.log((pos[pick] + 0.5) / (n1 + 1)) - np.log((neg[pick] + 0.5) / (n0 + 1))
    w, b, leak = odds, -2.0, -2.0  # the leak as a logit
    m1, m2 = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for t in range(1, rounds + 1):
        z = b + np.bincount(s, weights=w[f], minlength=n_sent)
        p = np.where(held, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0)
        miss = np.logaddexp(0, leak) + np.bincount(sent_doc, weights=np.where(held, np.logaddexp(0, z), 0), minlength=len(y))
        pull = np.where(y, np.exp(-miss) / np.maximum(-np.expm1(-miss), 1e-9), -1.0)  # (1 - p) / p of a document, or -1
        g = pull[sent_doc] * p
        grad = np.concatenate([np.bincount(f, weights=g[s], minlength=len(w)) / len(y) - ridge * w, [g.sum() / len(y), pull.mean() / (1 + np.exp(-leak))]])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8) / np.sqrt(t)
        w, b, leak = np.maximum(w + step[:-2], 0), min(b + step[-2], 0.0), min(leak + step[-1], -0.5)
    model = Model(known[pick], w, float(b), float(1 / (1 + np.exp(-leak))))
    # 0.5 goes to the logit that parts the labels with the fewest errors, halfway between its neighbours.
    z = b + np.bincount(s, weights=w[f], minlength=n_sent)
    x = _logit(np.logaddexp(0, leak) + np.bincount(sent_doc, weights=np.where(held, np.logaddexp(0, z), 0), minlength=len(y)))
    order = np.argsort(x, kind="stable")
    x, right = x[order], np.append(0, np.cumsum(~y[order])) + y.sum() - np.append(0, np.cumsum(y[order]))
    cuts = np.flatnonzero(np.diff(x) > 1e-9) + 1
    if len(cuts):
        at = cuts[right[cuts].argmax()]
        model.line = (1.0, float(-(x[at - 1] + x[at]) / 2))
    return model


def sample_texts(docs: DataFrame, labels: DataFrame, keep: object, label: str, values: tuple, each: int = SAMPLE, text: str = "text") -> tuple[list[str], np.ndarray]:
    """Whole texts of at most ``SAMPLE_BYTES`` bytes and their labels: of each value ``each`` labelled ids, the first by a hash.

    The labels' ids are cut first, so what is broadcast and what reaches the driver have a fixed bound.
    """
    chosen = None
    for v in values:
        one = labels.where(F.col("doc_id").isNotNull() & (F.col(label) == v) & keep).groupBy("doc_id").agg(F.max(label).alias("label"))
        one = first_by_hash(one, each, "doc_id")
        chosen = one if chosen is None else chosen.unionByName(one)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen.groupBy("doc_id").agg(F.max("label").alias("label"))), "doc_id")
    got = rows.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text", "label").orderBy("doc_id", "text").limit(4 * each * len(values)).toPandas()
    return got["text"].tolist(), got["label"].to_numpy()


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds score, n_sentences, worst_start, worst_end (code points) and worst_score; same-named columns are replaced.

    A null, empty or wordless text has score 0 and no sentence.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {k: pa.array(v) for k, v in model.score(batch.column(batch.schema.get_field_index(text))).items()}

    kinds = {"score": DoubleType(), "n_sentences": LongType(), "worst_start": LongType(), "worst_end": LongType(), "worst_score": DoubleType()}
    return add_columns(docs, run, [StructField(k, t) for k, t in kinds.items()], () if keep_text else (text,))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of ``score_documents``, held_out and predicted (1 where score is 0.5 or more).

    The model is fitted on labelled documents whose crc32(doc_id) mod ``folds`` isn't ``held``; rows whose label or id is null
    take no part.
    """
    texts, y = sample_texts(docs, labels, fold(F.col("doc_id"), folds) != held, label, (0, 1), text=text)
    out = score_documents(docs, fit(texts, y), text, keep_text)
    return out.withColumn("held_out", fold(F.col("doc_id"), folds) == held).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
