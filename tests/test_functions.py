from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioscope.functions import amounts as A
from folioscope.functions import sequences as S
from folioscope.functions import text as T


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema or "x int").select(col).first()[0]


@pytest.mark.parametrize(
    "col,value,want",
    [
        (T.header_key, "  A  B\x1cc ", "a b c"),
        (T.division_title, "Division A: Military  Things", "military things"),
        (T.division_title, "Division A", ""),
        (T.tighten_markers, "and (2) x (RHS) (2008)", "and(2) x (RHS) (2008)"),
        (T.strip_chrome, "12\n1 text\n•HR 5 RH\nrest", "1 text"),
        (T.join_hyphens, "appro-\npriation and X-\nRay", "appropriation and X-\nRay"),
        (T.plain_glyphs, "a—b ‘‘c’’ “d”", 'a - b "c" "d"'),
        (T.slug, "Reported in Senate!", "reported-in-senate"),
        (T.slug, "??", "unknown"),
        (T.congress_number, "118th CONGRESS", 118),
        (T.congress_number, "One Hundred Twenty-First Congress", 121),
        (T.congress_number, "One Hundred Nineteenth Congress", 119),
        (T.section_label, " 12. ", "Sec. 12"),
        (T.escape, "<a b=\"c\">&'", "&lt;a b=&quot;c&quot;&gt;&amp;&#x27;"),
        (T.title_text, "TITLE IV of it", "TITLE IV"),
        (T.section_text, "SEC.  12. Words", "SEC. 12"),
        (T.heading_like, "COAST GUARD", True),
        (T.heading_like, "SEC. 5", False),
        (T.stem_number, "3_engrossed", 3),
        (T.stem_label, "3_engrossed_more", "engrossed_more"),
        (T.type_label, "hjres", "H.J.Res."),
        (T.type_label, "zz", "ZZ"),
    ],
)
def test_text_rules(spark, col, value, want):
    assert one(spark, col(F.col("x")), x=value) == want


def test_path_and_labels(spark):
    assert one(spark, T.path_of(F.lit("A"), F.lit(None).cast("string"), F.lit("")), x="") == ["A"]
    assert one(spark, T.path_of(F.lit("A"), F.lit("B"), F.lit("A")), x="") == ["A", "B"]
    assert one(spark, T.range_label(F.lit(2), F.lit(14), F.lit(3), F.lit(1)), x="") == "p.2 L14 – p.3 L1"
    assert one(spark, T.range_label(F.lit(2), F.lit(14), F.lit(2), F.lit(14)), x="") == "p.2 L14"
    assert one(spark, T.delta(F.lit(-1234)), x="") == "-$1,234"
    assert one(spark, T.congress_of(F.lit(2024)), x="") == 118


@pytest.mark.parametrize(
    "text,want",
    [("$5 and $1,000", [5, 1000]), ("none", []), (None, []), ("$0, $3", [3]), ("$7 (increased by $9)", [7]), ("$, broken", []), ("(less $4)", [4])],
)
def test_amounts(spark, text, want):
    assert one(spark, A.amounts(F.col("x")), x=text) == want


def test_bags_and_pairs(spark):
    pairs = lambda a, b: [tuple(p) for p in one(spark, S.amount_pairs(F.col("a"), F.col("b")), a=a, b=b)]
    assert pairs("give $5 to x", "give $7 to x") == [(5, 7)]
    assert pairs("give $5 to x", "give nothing to x") == [(5, None)]
    assert pairs("none", "give $7") == [(None, 7)]
    assert pairs("a $1 b $2 c", "a $1 b c $3") == [(1, 1), (2, None), (None, 3)]
    assert pairs(None, None) == []
    assert one(spark, A.bags_differ(A.amounts(F.col("a")), A.amounts(F.col("b"))), a="$1 $2", b="$2 $1") is False


def test_similarity_is_difflib(spark):
    import random

    rng = random.Random(3)
    rows = [(" ".join(rng.choices("abcdef", k=rng.randint(0, 12))), " ".join(rng.choices("abcdef", k=rng.randint(0, 12)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.similarity("a", "b").alias("r"), S.similarity_bound(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        assert r.r == SequenceMatcher(None, r.a.split(), r.b.split()).ratio()
        assert r.r <= r.m + 1e-12


def test_diffs(spark):
    assert one(spark, S.line_diff(F.col("a"), F.col("b")), a="x", b="y") == ["--- old", "+++ new", "@@ -1 +1 @@", "-x", "+y"]
    assert one(spark, S.line_diff(F.col("a"), F.col("b")), a="x ", b="x") == []
    assert one(spark, S.word_diff("a", "b"), a="keep <this> word now", b="keep that word now") == "keep <del>&lt;this&gt;</del> <ins>that</ins> word now"
    assert one(spark, S.word_diff("a", "b"), a="a b", b="c d") is None
    assert S.lcs_tokens("a b", "a c") == [("same", "a"), ("same", " "), ("del", "b"), ("ins", "c")]
    assert one(spark, S.percent("a", "b"), a=1000, b=1123) == "+12.3%"
    assert one(spark, S.percent("a", "b"), a=0, b=5) == "—"
