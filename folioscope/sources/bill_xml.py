"""Scan of bill XML: one row for each text-bearing element, with its path of headings.

Mixed content has no relational form, so the tree is walked by the standard library inside an Arrow pass over whole
files; a file that can't be read gives one row with ``error`` rather than a failed job.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "file string, congress int, bill_type string, bill_number int, version string, ord int, match_path array<string>, display_path array<string>, "
    "tag string, element_id string, header_text string, body_text string, section_number string, division_label string, error string"
)
#: Containers and account levels by name, what a parenthetical heading looks like, and list markers.
CONTAINERS = ("subtitle", "part", "chapter", "subchapter")
LEVELS = {"appropriations-major": 0, "appropriations-intermediate": 1, "appropriations-small": 2}
_PAREN = re.compile(r"\(.*\)", re.S)
_MARKER = re.compile(r" (?=\((?:[0-9]{1,2}|[a-z]{1,4}|[A-Z])\))")
_TYPES = (("h.j.res", "hjres"), ("s.j.res", "sjres"), ("h.con.res", "hconres"), ("s.con.res", "sconres"), ("h.res", "hres"), ("s.res", "sres"), ("h.r", "hr"), ("s", "s"))


def flat(el: ET.Element | None) -> str:
    return "" if el is None else _MARKER.sub("", " ".join("".join(el.itertext()).split()))


def _join(el: ET.Element, sep: str, skip: tuple[str, ...] = ("enum", "header")) -> str:
    return sep.join(t for c in el if c.tag not in skip and (t := flat(c)))


@dataclass(frozen=True)
class Scope:
    """Headings in force; None where none has been seen.  ``named`` is the last one that isn't in parentheses."""

    title: str = ""
    division: str = ""
    major: str | None = None
    middle: str | None = None
    named: str | None = None

    def path(self, middle: str | None, leaf: str | None) -> list[str]:
        parts = [self.title, self.major, middle, None if leaf in (self.major, middle) else leaf]
        return [p for p in parts if p]


@dataclass
class Walk:
    """Nodes in document order.  What an element does to the headings is returned, so a scope ends where its loop does."""

    rows: list[dict] = field(default_factory=list)

    def emit(self, el: ET.Element, scope: Scope, path: list[str], header: str, body: str, number: str = "", shown: list[str] | None = None) -> None:
        self.rows.append({
            "match_path": [" ".join(p.lower().split()) for p in path], "display_path": [scope.division] * bool(scope.division) + (path if shown is None else shown),
            "tag": el.tag, "element_id": el.get("id", ""), "header_text": header, "body_text": body, "section_number": number, "division_label": scope.division,
        })

    def children(self, el: ET.Element, scope: Scope, contained: bool = False) -> None:
        for c in el:
            if c.tag.startswith("appropriations-"):
                scope = self.account(c, scope)
            elif c.tag == "section":
                self.section(c, scope)
            elif c.tag in CONTAINERS:
                self.children(c, self._inside(flat(c.find("header")), scope, contained), True)

    @staticmethod
    def _inside(header: str, scope: Scope, contained: bool) -> Scope:
        """A container's header is its children's major heading; in a container it is their middle one, added to one in force."""
        if not contained or scope.major is None:
            return replace(scope, major=header, middle=None, named=None)
        middle = header if scope.middle is None else " - ".join([scope.middle, header] if header else [scope.middle])
        return replace(scope, middle=middle, named=None)

    def account(self, el: ET.Element, scope: Scope) -> Scope:
        level, header = LEVELS.get(el.tag), flat(el.find("header"))
        if level is None:
            return scope
        aside = bool(_PAREN.fullmatch(header))
        effective = scope.named if level and aside else header
        named = header if not level or (header and not aside) else scope.named
        scope = replace(scope, named=named, **({"major": header, "middle": None} if level == 0 else {"middle": header} if level == 1 else {}))
        if body := _join(el, " "):
            # A middle heading's own node stands under the effective one, a small heading's under both.
            path = scope.path(None, None) if level == 0 else scope.path(effective, None) if level == 1 else scope.path(scope.middle, effective)
            self.emit(el, scope, path, header, body)
        return scope

    def section(self, el: ET.Element, scope: Scope) -> None:
        number, header = section_number(el), flat(el.find("header"))
        path = scope.path(scope.middle, number.lower())
        accounts = [c for c in el if c.tag.startswith("appropriations-")]
        if not accounts:
            if body := section_text(el):
                self.emit(el, scope, path, header, body, number)
            return
        text = el.find("text")
        if text is not None:  # also where it is empty
            self.emit(el, scope, path, header, flat(text), number)
        for c in accounts:
            scope = self.account(c, scope)

    def bare(self, body: ET.Element) -> None:
        for el in body.findall("section"):
            if text := section_text(el):
                number = section_number(el)
                self.emit(el, Scope(), [number.lower()] * bool(number), flat(el.find("header")), text, number, [number] * bool(number))


def section_number(el: ET.Element) -> str:
    """``Sec. N``, or nothing; only the number's own text counts."""
    enum = el.find("enum")
    return f"Sec. {enum.text.strip().rstrip('.')}" if enum is not None and enum.text else ""


def section_text(el: ET.Element) -> str:
    text = el.find("text")
    return flat(text) if text is not None and el.find("subsection") is None else _join(el, "").strip()


def body_of(root: ET.Element) -> ET.Element:
    body = root.find("legis-body")
    if body is None:
        block = root.find(".//engrossed-amendment-body/amendment/amendment-block")
        body = block if block is None or block.find("legis-body") is None else block.find("legis-body")
    if body is None:
        raise ValueError("no body")
    return body


def walk(root: ET.Element) -> list[dict]:
    body, w = body_of(root), Walk()
    w.bare(body)
    divisions = body.findall("division")
    for d in divisions:
        enum, header = d.find("enum"), flat(d.find("header"))
        label = f"Division {(enum.text or '').strip() if enum is not None else ''}" + (f": {header}" if header else "")
        for t in d.findall("title"):
            w.children(t, Scope(flat(t.find("header")), label))
    for t in () if divisions else body.findall("title"):
        w.children(t, Scope(flat(t.find("header"))))
    return w.rows


def bill_number(text: str) -> tuple[str, int | None]:
    low = re.sub(r"\s+", "", text.lower())
    for mark, code in _TYPES:
        if m := re.match(re.escape(mark) + r"\.?(\d+)", low):
            return code, int(m[1])
    return "", None


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` for each of (path, content): one for each text-bearing element, or one with ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                stem = file.rsplit("/", 1)[-1].removesuffix(".xml")
                base = {"file": file, "version": stem.partition("_")[2], "error": None}
                try:
                    root = ET.fromstring(content)
                    kind, number = bill_number(flat(root.find(".//legis-num")))
                    base |= {"bill_type": kind, "bill_number": number, "congress_text": flat(root.find(".//congress"))}
                    rows = [base | r | {"ord": i} for i, r in enumerate(walk(root))]
                except (ET.ParseError, ValueError) as e:
                    rows = [base | {"error": str(e)}]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")] + ["congress_text"], dtype=object)
                yield out.where(out.notna(), None).drop(columns="congress")

    from ..functions.text import congress_number

    columns = [c for c in SCHEMA.split(", ") if not c.startswith("congress ")] + ["congress_text string"]
    rows = files.select("path", "content").mapInPandas(run, ", ".join(columns))
    return rows.withColumn("congress", congress_number(F.col("congress_text"))).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def raw_texts(files: DataFrame, skip: tuple[str, ...] = ("quote", "header")) -> DataFrame:
    """Rows (file, text): the body's whole text of each of (path, content), without what stands in the elements ``skip``."""

    def inside(el: ET.Element) -> Iterator[str]:
        if el.tag not in skip:
            yield el.text or ""
            for c in el:
                yield from inside(c)
                yield c.tail or ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out.append((file, " ".join("".join(inside(body_of(ET.fromstring(content)))).split())))
                except (ET.ParseError, ValueError):
                    out.append((file, None))
            yield pd.DataFrame(out, columns=["file", "text"], dtype=object)

    return files.select("path", "content").mapInPandas(run, "file string, text string")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``parse`` of every XML file under ``path``."""
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path))
