"""BPE encoding and decoding (operator 2) and token counts (operator 6).

Encoding is exact BPE in time linear in the text.  Text is cut by the vocabulary's pre-token pattern; within a pre-token
an Aho-Corasick automaton over all tokens gives the longest token at each place, and a backtracking search keeps the
sequence whose neighbours are all compatible: a pair (a, b) is compatible when merging the joined bytes by rank would
never join across the seam before a and b are complete.  Exactly one sequence of tokens has only compatible pairs, and
it is the one that merging by rank makes.  Decoding looks up each id's bytes by an offset table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from .shared import add_columns

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.  Words stand before the contractions, which begin otherwise.
PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose encoding a worker remembers, newly seen and seen before that, and pairs it has compared, which start anew when they are full.
REMEMBERED = 1 << 18
#: Bytes of a piece of a long text, and of a batch handed to the library.
PIECE, BATCH = 1 << 16, 1 << 19
#: Places where a pre-token always ends, whatever stands around them: before the one space after another character than white
#: space, and between a letter, a digit and another character, save where an apostrophe may stand before letters.
_SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}\p{N}'])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{N})(?=[^\s\p{L}\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def checked(path: str) -> dict:
    """The vocabulary file's contents; one that asks for more than byte-level BPE as it is done here is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    odd += [k for k in ("byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
    odd += ["model.type"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(spec.get("normalizer"))
    odd += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True))
    odd += ["added_tokens"] * any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    if odd:
        raise ValueError(f"{path}: not plain byte-level BPE: {', '.join(odd)}")
    return spec | {"added_tokens": spec.get("added_tokens", [])}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters


class _Memory(dict):
    """Pre-token to its ids as little-endian 32-bit integers.

    A full memory becomes the older one, from which what is seen again comes back; so frequent pre-tokens are encoded once.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            found = self.encode(word.encode("utf-8", "surrogatepass"))
            ids = pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """A byte-level BPE vocabulary in the ``tokenizers`` library's JSON form."""

    def __init__(self, path: str):
        spec = checked(path)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda t: bytes(byte_of[c] for c in t)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            if t not in self.special:
                self.bytes_of[i] = raw(t)
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at, self.halves = [-1] * size, [(i, i) for i in range(size)]
        merged = {}
        for r, (a, b) in enumerate(pairs):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            merged[pair] = whole
            if self.made_at[whole] < 0:
                self.made_at[whole], self.halves[whole] = r, pair
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b) - 1, i))
        self.automaton.make_automaton()
        self.shorter = [self._shorter(b) for b in self.bytes_of]
        self.compatible: dict[int, bool] = {}
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pre = regex.compile(PATTERN)
        self.memory = _Memory(self.encode_bytes)

    def _shorter(self, b: bytes) -> int:
        """The longest token that is a proper prefix of ``b``; -1 if none is."""
        return next((self.id_of[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.id_of), -1)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` then ``b`` by rank ends with exactly these two tokens."""
        key = a << 32 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(a, b, len(self.rank))
        return known

    def _fits(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank under ``before`` joins across the seam of ``a`` and ``b`` before both are complete."""
        # Undo the newest merges on either side of the seam.  Before the step at which a side's token is made, its half
        # stands at the seam; a seam merge that comes earlier than the later of both would have gone first.
        until_a = until_b = before
        while True:
            seam = self.rank.get((a, b))
            # The left of two equal ranks goes first: a merge that completes ``a`` beats one at the seam, one that completes ``b`` doesn't.
            if seam is not None and seam < until_a and seam <= until_b:
                return False
            made_a, made_b = self.made_at[a], self.made_at[b]
            if made_a < 0 and made_b < 0:
                return True
            # Of the two, the merge that happened last is undone; of equal ranks the right one is.
            if made_a > made_b:
                until_a, a = made_a, self.halves[a][1]
            else:
                until_b, b = made_b, self.halves[b][0]

    def encode_bytes(self, raw: bytes) -> list[int]:
        whole = self.id_of.get(raw)
        if whole is not None and self._whole(whole):
            return [whole]
        n = len(raw)
        longest = [-1] * n
        bytes_of, fits, shorter, known = self.bytes_of, self.fits, self.shorter, self.compatible
        for end, (back, token) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - back] = token  # ends ascend, so the last is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(bytes_of[token])
                if not dead[end]:
                    fit = last < 0 or known.get(last << 32 | token)
                    if fit is None:
                        fit = fits(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary doesn't hold every byte")
                token = out.pop()
                at -= len(bytes_of[token])
                token = shorter[token]
        return out

    @lru_cache(maxsize=1 << 17)  # noqa: B019
    def _whole(self, token: int) -> bool:
        """Whether the bytes of ``token`` alone encode as it: its halves do, and they meet only by its own merge."""
        if self.made_at[token] < 0:
            return True
        a, b = self.halves[token]
        return self._whole(a) and self._whole(b) and self._fits(a, b, self.made_at[token])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; a special token's string stands for that token."""
        out, at = [], 0
        for m in self.cut_special.finditer(text) if self.cut_special else ():
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        look = self.memory.__getitem__
        return b"".join([b"".join(map(look, self.pre.findall(p))) for p in pieces(text)])


class Decoder:
    """The bytes of all tokens end to end, and where each begins."""

    def __init__(self, path: str):
        spec = checked(path)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        of = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        of |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        tokens = [of.get(i, b"") for i in range(max(of) + 1)]
        self.offset = np.array([0, *accumulate(map(len, tokens))], np.int64)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lens = self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(lens)
        index = np.arange(ends[-1]) + np.repeat(self.offset[ids] - (ends - lens), lens)
        return self.blob[index].tobytes()


def pieces(text: str, size: int = PIECE, whole: regex.Pattern | None = None) -> list[str]:
    """``text`` cut at safe places into pieces of about ``size`` bytes; what ``whole`` finds isn't cut.

    Without a safe place, as in a very long run of letters, a piece stays longer: the library's own rule takes such a run as one.
    """
    if len(text) * 4 <= size or len(text.encode("utf-8", "surrogatepass")) <= size:
        return [text]
    held = [m.span() for m in whole.finditer(text)] if whole else []
    out, at, used = [], 0, 0
    while at < len(text):
        # As many characters as have ``size`` bytes at most
        step = len(text[at : at + size].encode("utf-8", "surrogatepass")[:size].decode("utf-8", "ignore")) or 1
        end = at + step
        while end < len(text):
            m = _SAFE.search(text, end)
            end = m.start() if m else len(text)
            while used < len(held) and held[used][1] <= end:
                used += 1
            if used == len(held) or held[used][0] >= end:
                break
            end = held[used][1]  # inside a special token's string
        out.append(text[at:end])
        at = end
    return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    added = sorted((x["content"] for x in checked(path)["added_tokens"]), key=len, reverse=True)
    return t, regex.compile("|".join(map(regex.escape, added))) if added else None


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit ids) and ``count``, and if named ``decoded``, the text decoded from the ids.

    A null or empty text has no ids.  Columns named like an added one are replaced.  ``path`` is the vocabulary file, which
    every executor must be able to read; ids are those of the library with its special tokens' strings recognised.  Decoding in
    the same pass spares workers of its own.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        v = vocabulary(path)
        out = [v.encode(t) if (t := x.as_py()) else b"" for x in batch.column(batch.schema.get_field_index(text))]
        new = {ids: pa.array(out, pa.binary()), count: pa.array([len(x) // 4 for x in out], pa.int64())}
        return new | ({decoded: _texts(path, out)} if decoded else {})

    added = [StructField(ids, BinaryType()), StructField(count, LongType()), *([StructField(decoded, StringType())] if decoded else [])]
    return add_columns(docs, run, added, () if keep_text else (text,))


def _texts(path: str, coded: Iterable[bytes]) -> pa.Array:
    d = decoder(path)
    return pa.array([d.decode(np.frombuffer(x, "<u4").astype(np.int64)).decode("utf-8", "replace") for x in coded], pa.string())


def decode_documents(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``, decoded from ``ids`` with special tokens kept; null ids decode to empty text.

    Bytes that aren't UTF-8 are replaced as the library does.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {text: _texts(path, (x.as_py() or b"" for x in batch.column(batch.schema.get_field_index(ids))))}

    return add_columns(docs, run, [StructField(text, StringType())])


def count_tokens(docs: DataFrame, path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Adds ``count``, the number of tokens the library makes of each whole text; null and empty texts have none.

    Only lengths leave the library.  Each call gets about the same number of bytes, and texts beyond ``PIECE`` bytes
    are cut where no pre-token goes on; special tokens' strings stay whole.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        t, special = _library(path)
        total = np.zeros(batch.num_rows, np.int64)
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            if held:
                np.add.at(total, owner, [len(e) for e in t.encode_batch_fast(held, add_special_tokens=False)])
                held.clear()
                owner.clear()

        for i, x in enumerate(batch.column(batch.schema.get_field_index(text))):
            for p in pieces(x.as_py() or "", PIECE, special):
                if p:
                    held.append(p)
                    owner.append(i)
                    size += len(p.encode("utf-8", "surrogatepass"))
                if size >= BATCH:
                    flush()
                    size = 0
        flush()
        return {count: pa.array(total, pa.int64())}

    return add_columns(docs, run, [StructField(count, LongType())])


def n_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
