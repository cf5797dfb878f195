"""Scalar text rules as Spark columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split`` has it, list markers that take no space before them, page furniture.
WS = r"(?U)[\s\x1c-\x1f]+"
MARKER = r" (?=\((?:[0-9]{1,2}|[a-z]{1,4}|[A-Z])\))"
#: Bill types by code.
BILL_TYPES = {
    "hr": "H.R.", "s": "S.", "hjres": "H.J.Res.", "sjres": "S.J.Res.",
    "hconres": "H.Con.Res.", "sconres": "S.Con.Res.", "hres": "H.Res.", "sres": "S.Res.",
}
#: Ordinals in words.
UNITS = "first second third fourth fifth sixth seventh eighth ninth".split()
TEENS = "tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENS = {"twent": 20, "thirt": 30, "fort": 40, "fift": 50, "sixt": 60, "sevent": 70, "eight": 80, "ninet": 90}


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, WS, " "))


def words(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), WS), lambda w: w != "")


def header_key(x: Column) -> Column:
    return squeeze(F.lower(x))


def division_title(label: Column) -> Column:
    """What follows the first colon, as a key; empty without a colon."""
    at = F.locate(":", label)
    return F.when(at == 0, F.lit("")).otherwise(header_key(label.substr(at + 1, F.length(label))))


def tighten_markers(x: Column) -> Column:
    return F.regexp_replace(squeeze(x), MARKER, "")


def path_of(*parts: Column) -> Column:
    """Non-empty parts in order; the last is left out where it repeats an earlier one."""
    if len(parts) > 1:
        *head, leaf = parts
        again = F.lit(False)
        for p in head:
            again = again | p.eqNullSafe(leaf)
        parts = (*head, F.when(~again, leaf))
    return F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))


def path_key(path: Column) -> Column:
    return F.transform(path, header_key)


#: A page's leading number line and its footer; a hyphen at a line's end.
PAGE_NUMBER, FOOTER, SOFT_HYPHEN = r"\A\d+\n", r"(?s)\n?•HR\b.*", r"(?U)(\w)-\n([a-z])"


def strip_chrome(page: Column) -> Column:
    """A page's text without its leading number line and the footer from its bullet on."""
    return F.regexp_replace(F.regexp_replace(page, PAGE_NUMBER, ""), FOOTER, "")


def join_hyphens(x: Column) -> Column:
    return F.regexp_replace(x, SOFT_HYPHEN, "$1$2")


def plain_glyphs(x: Column) -> Column:
    x = F.regexp_replace(x, "[–—]", " - ")
    return F.replace(F.translate(x, "‘’“”", "''\"\""), F.lit("''"), F.lit('"'))


def recall_key(x: Column) -> Column:
    """Text as the recall checks compare it: plain glyphs, single spaces, hyphens closed up."""
    return F.regexp_replace(squeeze(plain_glyphs(x)), r"(?U)(\w)- (\w)", "$1-$2")


#: Title, section and account lines of a page.
TITLE_LINE, SECTION_LINE, ACCOUNT_LINE = r"(?U)^TITLE\s+([IVXLC]+)\b", r"(?U)^(SEC(?:TION)?\.?\s+\d+)\b", r"(?i)^For necessary expenses of\b"


def heading_like(x: Column) -> Column:
    """Has a letter, no lower-case one, and isn't a title or section line."""
    return x.rlike(r"\p{L}") & ~x.rlike(r"\p{Ll}") & ~x.rlike(TITLE_LINE) & ~x.rlike(SECTION_LINE)


def title_text(x: Column) -> Column:
    m = F.regexp_extract(x, TITLE_LINE, 1)
    return F.when(m != "", F.concat(F.lit("TITLE "), m))


def section_text(x: Column) -> Column:
    m = F.regexp_extract(x, SECTION_LINE, 1)
    return F.when(m != "", F.regexp_replace(m, WS, " "))


def account_trigger(x: Column) -> Column:
    return x.rlike(ACCOUNT_LINE)


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def congress_of(year: Column) -> Column:
    return (F.floor((year - 1789) / 2) + 1).cast("int")


def version_file(congress: Column, kind: Column, number: Column, index: Column, label: Column) -> Column:
    return F.format_string("%s-%s-%s/%s_%s.xml", congress.cast("string"), F.lower(kind), number.cast("string"), index.cast("string"), slug(label))


def stem_number(stem: Column) -> Column:
    """The number before the first underscore, if all of it is digits."""
    head = F.split_part(stem, F.lit("_"), F.lit(1))
    return F.when(stem.contains("_") & head.rlike("^[0-9]+$"), head.cast("int"))


def stem_label(stem: Column, whole: bool = False) -> Column:
    """What follows the first underscore; without one the whole stem, or nothing."""
    at = F.locate("_", stem)
    return F.when(at > 0, stem.substr(at + 1, F.length(stem))).otherwise(stem if whole else F.lit(""))


def type_label(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in BILL_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(code)), F.upper(code))


def ordinal_number(text: Column) -> Column:
    """Number of the ordinal words in a text, hundreds counted; null without any."""
    low = F.lower(text)
    tens = F.lit(None).cast("int")
    for stem, n in TENS.items():
        tens = F.when(low.rlike(rf"\b{stem}y(-|\b)"), n).when(low.rlike(rf"\b{stem}ieth\b"), n).otherwise(tens)
    unit = F.lit(None).cast("int")
    for i, w in [*enumerate(UNITS, 1), *enumerate(TEENS, 10)]:
        unit = F.when(low.rlike(rf"\b{w}\b"), i).otherwise(unit)
    some = F.coalesce(tens, F.lit(0)) + F.coalesce(unit, F.lit(0)) + F.when(low.contains("hundred"), 100).otherwise(0)
    return F.when(some > 0, some)


def congress_number(text: Column) -> Column:
    digits = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(ordinal_number(text))


def section_label(enum: Column) -> Column:
    return F.concat(F.lit("Sec. "), F.regexp_replace(F.trim(enum), r"\.+$", ""))


def escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def path_html(path: Column) -> Column:
    return F.array_join(F.transform(path, escape), " &gt; ")


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def viewer_dollars(x: Column) -> Column:
    """As the viewer prints amounts: the sign stands behind the dollar sign."""
    return F.concat(F.lit("$"), F.when(x < 0, "-").otherwise(""), F.format_number(F.abs(x), 0))


def known_type(code: Column) -> Column:
    """Whether a bill type is one of the eight."""
    return F.coalesce(code.isin(list(BILL_TYPES)), F.lit(False))


def delta(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise("+"), dollars(F.abs(x)))


def place(page: Column, line: Column) -> Column:
    return F.concat(F.lit("p."), page.cast("string"), F.coalesce(F.concat(F.lit(" L"), line.cast("string")), F.lit("")))


def range_label(page: Column, line: Column, end_page: Column, end_line: Column) -> Column:
    """``p.X Ly – p.X Ly``; one place if both are the same; a dash without any."""
    a, b = place(page, line), place(end_page, end_line)
    return F.when(page.isNull(), F.lit("—")).when(a == b, a).otherwise(F.concat(a, F.lit(" – "), b))


def tokens(x: Column) -> Column:
    """Runs of white space and of other characters, both kept."""
    return F.regexp_extract_all(x, F.lit(r"(?U)(\s+|\S+)"), F.lit(1))


def iso_day(x: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(x, 1, 10), F.lit("")), F.lit("no date"))
