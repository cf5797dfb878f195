"""Language identification (operator 8): interpolated Kneser-Ney models of letters, one for each language.

All training documents are counted on the executors; the counts of all distinct trigrams of each language, rare ones too,
come to the driver and as models to the workers, so their memory grows with the number of these.  Models of order
3 with absolute discounts and interpolated lower orders are stored as ascending arrays of packed code points beside log
probabilities.  A text goes to the language of the lowest cross-entropy for each letter; it is marked as rejected where
that is further above the language's own entropy than the calibrated number of standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from .shared import add_columns, bounded_batches, fold, lean, stored

UNKNOWN = "und"
#: Log probabilities that the common table has at most; beyond it each model is asked, which gives the same.
TABLE = 1 << 24
#: Characters of texts looked at together.
CHUNK = 1 << 19
_BITS = 21
_MASK = (1 << _BITS) - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    lo, held, size = 0, [], 0
    for i, x in enumerate(texts):
        t = x.as_py() or ""
        if held and size + len(t) > CHUNK:
            yield lo, held
            lo, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield lo, held


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of the lower-cased letters of each text and the text each belongs to.

    A run of other characters counts as one space; a text begins after two spaces.  Its last letter's trigram is followed by
    one that ends in a space, if the text goes on after it.
    """
    joined = "\x00\x00".join(t.lower().replace("\x00", " ") for t in texts)
    cp = np.frombuffer(f"\x00\x00{joined}".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    seam = cp == 0
    letter = _letters()[cp]
    keep = letter | seam
    keep[1:] |= letter[:-1]  # the first of a run of other characters stands for it
    cp, seam, letter = cp[keep], seam[keep], letter[keep]
    owner = (np.cumsum(seam) + 1) // 2 - 1
    c = np.where(letter, cp, 0x20)
    gram = c[:-2] << (2 * _BITS) | c[1:-1] << _BITS | c[2:]
    inside = ~seam[2:]
    return gram[inside], owner[2:][inside]


def count_trigrams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows (lang, gram, n) over all of ``docs``; counts are added up in each worker before they are shuffled."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
            g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            known, index = np.unique(g, return_inverse=True)
            return known, np.bincount(index, weights=n, minlength=len(known)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                g, n = merge(parts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(g), pa.string()), "gram": g, "n": n})
            held.clear()

        size = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, texts in _chunks(batch.column(1)):
                gram, owner = trigrams(texts)
                ids = {k: i for i, k in enumerate(dict.fromkeys(names[lo : lo + len(texts)]))}
                of = np.array([ids[k] for k in names[lo : lo + len(texts)]])[owner]
                for k, i in ids.items():
                    parts = held.setdefault(k, [])
                    parts.append(np.unique(gram[of == i], return_counts=True))
                    size += len(parts[-1][0])
            if size > 1 << 20:
                held.update({k: [merge(v)] for k, v in held.items()})
                size = sum(len(v[0][0]) for v in held.values())
                if size > 1 << 19:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.col(lang).cast("string").alias("lang"), text).mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _discount(n: np.ndarray) -> float:
    one, two = (n == 1).sum(), (n == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.5


class Model:
    """Interpolated Kneser-Ney of order 3 for one language, from its trigram counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        order = np.argsort(grams)
        self.g3, n = grams[order], n[order].astype(float)
        d3 = _discount(n)
        context, back = self.g3 >> _BITS, self.g3 & (1 << 2 * _BITS) - 1
        self.c2, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, weights=n)
        self.l3 = np.log(d3 * np.bincount(at) / total)  # weight of the lower order after each context
        # Lower orders count in how many contexts a gram occurs, not how often.
        self.g2, n2 = np.unique(back, return_counts=True)
        d2 = _discount(n2)
        self.c1, at1 = np.unique(self.g2 >> _BITS, return_inverse=True)
        total1 = np.bincount(at1, weights=n2)
        self.l2 = np.log(d2 * np.bincount(at1) / total1)
        self.g1, n1 = np.unique(self.g2 & _MASK, return_counts=True)
        d1 = _discount(n1)
        self.unseen = np.log((d1 * len(n1) / n1.sum()) / (len(n1) + 1))
        self.p1 = np.log(np.maximum(n1 - d1, 0) / n1.sum() + np.exp(self.unseen))
        p2 = np.maximum(n2 - d2, 0) / total1[at1] + np.exp(self.l2[at1] + self._one(self.g2 & _MASK))
        self.p2 = np.log(p2)
        self.p3 = np.log(np.maximum(n - d3, 0) / total[at] + np.exp(self.l3[at] + self._two(self.g3 & (1 << 2 * _BITS) - 1)))
        p = n / n.sum()
        self.entropy = float(-(p * self.p3).sum())
        self.spread = float(np.sqrt(max((p * self.p3**2).sum() - self.entropy**2, 1e-9)))

    def _one(self, c: np.ndarray) -> np.ndarray:
        at, hit = _find(self.g1, c)
        return np.where(hit, self.p1[at], self.unseen)

    def _two(self, bc: np.ndarray) -> np.ndarray:
        at, hit = _find(self.g2, bc)
        of, known = _find(self.c1, bc >> _BITS)
        return np.where(hit, self.p2[at], np.where(known, self.l2[of], 0.0) + self._one(bc & _MASK))

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        at, hit = _find(self.g3, grams)
        out = self.p3[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            g = grams[miss]
            of, known = _find(self.c2, g >> _BITS)
            out[miss] = np.where(known, self.l3[of], 0.0) + self._two(g & (1 << 2 * _BITS) - 1)
        return out


class Identifier:
    """Models by language, and while it is small one table of all their trigrams so that a text's are looked up once."""

    def __init__(self, models: dict[str, Model], limit: float = 6.0):
        self.names, self.models, self.limit = sorted(models), models, limit
        small = 0 < len(models) * sum(len(m.g3) for m in models.values()) <= TABLE
        self.keys = np.unique(np.concatenate([m.g3 for m in models.values()])) if small else np.zeros(0, np.int64)
        self.table = np.stack([models[k].log_p(self.keys).astype(np.float32) for k in self.names], 1) if small else np.zeros((0, 0), np.float32)
        self.entropy = np.array([models[k].entropy for k in self.names])
        self.spread = np.array([models[k].spread for k in self.names])

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters looked at, cross-entropy by language) of each text."""
        gram, owner = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        at, hit = _find(self.keys, gram)
        miss = np.flatnonzero(~hit)
        other, of = np.unique(gram[miss], return_inverse=True)
        out = np.zeros((len(texts), len(self.names)))
        for j, k in enumerate(self.names):
            p = self.table[at, j].astype(float) if len(self.keys) else np.zeros(len(gram))
            if len(miss):
                p[miss] = self.models[k].log_p(other).astype(np.float32)[of]
            out[:, j] = -np.bincount(owner, weights=p, minlength=len(texts)) / np.maximum(n, 1)
        return n, out

    def distance(self, n: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Standard errors by which each text is above its best language's own entropy."""
        best = h.argmin(1)
        return (h[np.arange(len(h)), best] - self.entropy[best]) * np.sqrt(np.maximum(n, 1)) / self.spread[best]

    def identify(self, texts: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {"lang_pred": [], "score": [], "cross_entropy": [], "rejected": []}
        for _, held in _chunks(texts):
            n, h = self.cross_entropies(held)
            some = np.array([bool(t) and any(map(str.isalpha, t)) for t in held]) & bool(self.names)
            best = h.argmin(1) if self.names else np.zeros(len(held), np.int64)
            low = h[np.arange(len(held)), best] if self.names else np.zeros(len(held))
            # The posterior of the best under equal priors, a text's letters counting as 20 independent ones at most
            weight = np.minimum(n, 20)[:, None]
            score = 1 / np.exp(-(h - low[:, None]) * weight).sum(1) if self.names else np.zeros(len(held))
            far = self.distance(n, h) > self.limit if self.names else np.zeros(len(held), bool)
            out["lang_pred"] += [self.names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            out["score"] += np.where(some, score, 0.0).tolist()
            out["cross_entropy"] += [x if s else None for x, s in zip(low.tolist(), some, strict=True)]
            out["rejected"] += (~some | far).tolist()
        return out


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, Model]:
    """Models from every row of ``docs`` that has a language and letters."""
    counts = stored(count_trigrams(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), lang, text))
    rows = counts.select("lang", "gram", "n").toArrow()
    names = rows["lang"].combine_chunks().dictionary_encode()
    of, gram, n = np.asarray(names.indices), rows["gram"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(of, kind="stable")
    at = np.searchsorted(of[order], np.arange(len(names.dictionary) + 1))
    return {k: Model(gram[order[a:b]], n[order[a:b]]) for k, a, b in zip(names.dictionary.to_pylist(), at[:-1], at[1:], strict=True)}


def calibrate(models: dict[str, Model], docs: DataFrame, share: float = 0.999, text: str = "text") -> Identifier:
    """Sets the limit to the ``share`` quantile of the distance that the texts of ``docs`` have from their best language.

    All texts are looked at whole; the quantile is Spark's approximate one.
    """
    out = Identifier(models)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held in _chunks(batch.column(0)):
                n, h = out.cross_entropies(held)
                yield pa.RecordBatch.from_arrays([pa.array(out.distance(n, h)[n > 0])], names=["far"])

    if models:
        far = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(lean(run), "far double").agg(F.percentile_approx("far", share, 10_000)).first()[0]
        out.limit = max(out.limit, far) if far is not None else out.limit
    return out


def identify_documents(docs: DataFrame, identifier: Identifier, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred, score (0 to 1), cross_entropy (nats a letter) and rejected; same-named columns are replaced.

    A text that is null or has no letter is ``und`` with score 0 and rejected; equal cross-entropies go to the first name.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        got = identifier.identify(batch.column(batch.schema.get_field_index(text)))
        return {k: pa.array(got[k], t) for k, t in (("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_()))}

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("cross_entropy", DoubleType()), StructField("rejected", BooleanType())]
    return add_columns(docs, run, added, () if keep_text else (text,))


def language(docs: DataFrame, text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of ``identify_documents`` and held_out; learned where crc32(doc_id) mod ``folds`` isn't ``held``."""
    out = fold(F.col("doc_id"), folds) == held
    train = docs.where(~out)
    identifier = calibrate(fit(train, lang, text), train.where(F.col(lang).isNotNull()), text=text)
    return identify_documents(docs, identifier, text, keep_text).withColumn("held_out", out)
