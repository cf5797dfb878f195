import random

from pyspark.sql import functions as F

from folioscope.operators import classify, match, pages, versions
from folioscope.plans import canonical as C
from folioscope.plans import contract

NODE = "pair_id string, ord int, match_path array<string>, display_path array<string>, tag string, element_id string, header_text string, body_text string, section_number string, division_label string"


def nodes(spark, side, rows):
    return spark.createDataFrame([("p", i, list(path), list(path), "t", f"{side}{i}", "", text, "", division) for i, (path, text, division) in enumerate(rows)], NODE)


def test_greedy_is_the_sequential_claim(spark):
    rng = random.Random(1)
    rows = [(g, i, j, rng.choice([0.1, 0.5, 0.5, 0.9])) for g in range(30) for i in range(rng.randint(1, 6)) for j in range(rng.randint(1, 6))]
    rows = list({(g, i, j): (g, i, j, s) for g, i, j, s in rows}.values())
    got = {(r.g, r.oi, r.ni) for r in match.greedy(spark.createDataFrame(rows, "g int, oi int, ni int, sim double"), ["g"]).collect()}
    want, used = set(), set()
    for g, i, j, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if (g, "o", i) not in used and (g, "n", j) not in used:
            used |= {(g, "o", i), (g, "n", j)}
            want.add((g, i, j))
    assert got == want


def test_diff_of_two_versions(spark):
    old = nodes(spark, "o", [
        (["a"], "the same text", ""), (["b"], "one two three four five", ""), (["c"], "entirely gone words here", ""),
        (["d"], "alpha beta gamma delta epsilon zeta", ""), (["x"], "first twin pays $5 for boats", "Division A: Sea"), (["x"], "second twin pays $9 for trains", "Division B: Land"),
    ])
    new = nodes(spark, "n", [
        (["a"], "the  same text", ""), (["b"], "one two three four six", ""), (["e"], "alpha beta gamma delta epsilon eta", ""), (["f"], "brand new", ""),
        (["x"], "second twin pays $9 for trains", "Division C: Land"), (["x"], "first twin pays $7 for boats", "Division A: Sea"),
    ])
    d = classify.diff_versions(old, new).orderBy("out_ord").collect()
    kinds = [(r.change_type, r.match_path[0]) for r in d]
    assert sorted(kinds) == sorted([("unchanged", "a"), ("modified", "b"), ("removed", "c"), ("moved", "d"), ("added", "f"), ("modified", "x"), ("unchanged", "x")])
    assert kinds[-1] == ("moved", "d")
    twin = next(r for r in d if r.match_path == ["x"] and r.change_type == "modified")
    assert [tuple(p) for p in twin.financial.paired_amounts] == [(5, 7)] and twin.financial.amounts_changed
    df = classify.diff_versions(old, new)
    s = classify.summary(df).first()
    assert (s.added, s.removed, s.modified, s.unchanged, s.moved) == (1, 1, 2, 2, 1)
    assert classify.filter_changes(df, amounts_only=True).count() == 1
    assert classify.filter_changes(df, path="X").count() == 1
    names = spark.createDataFrame([("p", "hr", 118, 5, "a", "b", 1, 2)], "pair_id string, bill_type string, congress int, bill_number int, label_old string, label_new string, number_old int, number_new int")
    back = C.view_of(C.canonical(df, names)).collect()
    assert len(back) == 5 and {r.change_type for r in back} == {"added", "removed", "modified", "moved"}
    page = C.report(contract.xml_views(df), spark.createDataFrame([("p", "A & B")], "pair_id string, title string")).first().html
    assert "<h1>A &amp; B</h1>" in page and "<del>five</del> <ins>six</ins>" in page and "$5 → $7 (+$2)" in page
    assert C.financial_table(df).first().change == "+40.0%"


def test_a_pair_that_differs_too_much_is_two_changes(spark):
    d = classify.classify(nodes(spark, "o", [(["a"], "one two three", "")]), nodes(spark, "n", [(["a"], "four five six", "")])).orderBy("out_ord").collect()
    assert [r.change_type for r in d] == ["removed", "added"]


def test_empty_versions(spark):
    none, some = nodes(spark, "o", []), nodes(spark, "n", [(["a"], "x", "")])
    assert [r.change_type for r in classify.diff_versions(none, some).collect()] == ["added"]
    assert classify.diff_versions(none, none).count() == 0


def test_page_pipeline(spark):
    first = "3\n1 TITLE I\n2 COAST GUARD\n3 For necessary expenses of ships, $5, appro-\n4 priated.\n5 SEC. 101. Words stay here as ever they were.\n•HR 5 RH"
    second = "3\n1 TITLE I\n2 COAST GUARD\n3 For necessary expenses of ships, $8, appro-\n4 priated.\n5 SEC. 102. Words stay here as ever they were.\n6 SEC. 103. Quite another thing.\n•HR 5 RH"
    lines = pages.page_lines(spark.createDataFrame([("d", 1, 2, first), ("d", 2, 2, second)], "doc_id string, version int, page int, raw string"))
    assert [r.text for r in lines.where("version = 1").orderBy("line_ord").collect()][2] == "For necessary expenses of ships, $5, appropriated."
    found = pages.anchors(lines)
    assert {(r.kind, r.text) for r in found.where("version = 1").collect()} == {("title", "TITLE I"), ("account", "COAST GUARD"), ("section", "SEC. 101")}
    assert pages.breadcrumbs(found.where("version = 1")).where("kind = 'section'").first().crumb == ["TITLE I", "SEC. 101"]
    h = pages.hunks(pages.blocks(lines, found)).orderBy("out_ord").collect()
    assert [(r.change_type) for r in h] == ["modified", "moved", "added"]
    assert [tuple(p) for p in h[0].amount_pairs] == [(5, 8)]
    assert pages.hunk_summary(pages.hunks(pages.blocks(lines, found))).first().summary == {"modified": 1, "moved": 1, "added": 1}


def test_versions(spark):
    v = spark.createDataFrame([("b", "Introduced", "2023-01-02"), ("b", "Enrolled", None), ("b", "Engrossed", "2023-05-06")], "bill string, type string, date string")
    o = versions.ordered(v, ["bill"])
    # An undated version stands with the latest; of these "Engrossed" comes first by name.
    assert [r.type for r in o.orderBy("version_no").collect()] == ["Introduced", "Engrossed", "Enrolled"]
    assert [(r.version_no, r.next_no) for r in versions.adjacent(o, ["bill"]).orderBy("version_no").collect()] == [(1, 2), (2, 3)]
    assert "Introduced (2023-01-02)" in versions.listing(o, ["bill"]).first().listing
    formats = F.array(F.struct(F.lit("PDF").alias("type"), F.lit("p").alias("url")))
    assert spark.range(1).select(versions.xml_url(formats)).first()[0] is None


def test_order_within_a_repeated_path():
    olds = [(1, "b", "one two three four"), (3, "a", "five six seven eight"), (5, "b", "nine ten eleven twelve"), (7, "c", "red green blue")]
    news = [(2, "a", "five six seven"), (4, "b", "nine ten eleven"), (6, "d", "red green blue"), (8, "d", "quite new")]
    # Title b first, as it comes first: its only new node goes to the old one most like it; across titles the best pair is claimed.
    assert match.resolve(olds, news) == [(5, 4, 1), (3, 2, 1), (7, 6, 2), (1, 8, 2)]
    assert match.resolve(olds[:1], []) == [(1, None, 0)] and match.resolve(olds[:2], []) == [(1, None, 3), (3, None, 3)]
    assert match.resolve([], news[2:]) == [(None, 6, 4), (None, 8, 4)]
    same = [(i, "a", "x y") for i in range(3)]
    assert match.resolve(same, same) == [(2, 2, 1), (1, 1, 1), (0, 0, 1)]


def test_empty_texts_move_to_the_last(spark):
    old = nodes(spark, "o", [(["a"], "", ""), (["b"], "", ""), (["c"], "w", "")])
    new = nodes(spark, "n", [(["d"], "", ""), (["e"], "", ""), (["f"], "", "")])
    d = classify.diff_versions(old, new).orderBy("out_ord").collect()
    assert [(r.change_type, r.element_id_old, r.element_id_new) for r in d] == [("removed", "o2", ""), ("added", "", "n0"), ("moved", "o1", "n2"), ("moved", "o0", "n1")]


def test_contract_of_bills(spark):
    import json

    old = nodes(spark, "o", [(["a"], "Pays $5 for boats.", ""), (["b"], "entirely gone words", ""), (["s"], "the same", "")])
    new = nodes(spark, "n", [(["a"], "Pays $9 for boats.", ""), (["c"], "brand new text", ""), (["s"], "the same", "")])
    d = classify.diff_versions(old, new)
    names = spark.createDataFrame([("p", "hr", 118, 5, "a", "b", 1, 2), ("q", "s", 118, 6, "a", "b", 1, 2)], "pair_id string, bill_type string, congress int, bill_number int, label_old string, label_new string, number_old int, number_new int")
    full = spark.createDataFrame([("p", "x Pays $5 for boats. entirely gone words", "Pays $9 for boats. y brand new text")], "pair_id string, v1 string, v2 string")
    docs = C.canonical(d, names, full)
    assert contract.contract_errors(docs).count() == 0
    got = {r.pair_id: json.loads(r.json) for r in docs.collect()}
    one = got["p"]["changes"]
    assert [c["change_type"] for c in one] == ["modified", "removed", "added"] and one[0]["id"] == "c-0001" and one[0]["move"] is None
    assert one[0]["full_text_span"] == {"v1": {"start": 2, "end": 20}, "v2": {"start": 0, "end": 18}} and one[1]["full_text_span"]["v2"] is None
    assert one[0]["amounts"] == [{"old": 5, "new": 9}] and got["q"]["changes"] == [] and got["q"]["full_text"] is None
    bad = [got["p"] | {"summary": {"added": "1"}}, {k: v for k, v in got["p"].items() if k != "bill"}, got["p"] | {"changes": [one[0] | {"change_type": "odd", "extra": 1}]}]
    wrong = spark.createDataFrame([(str(i), json.dumps(b)) for i, b in enumerate(bad)] + [("3", "{"), ("4", json.dumps(got["p"] | {"changes": [one[0] | {"move": {"kind": "renumbered", "body_unchanged": True}}]}))], "pair_id string, json string")
    found = {}
    for r in contract.contract_errors(wrong).collect():
        found.setdefault(r.pair_id, []).append(r.error)
    assert found["0"] == ["$.summary.added: '1'"] and found["1"] == ["$.bill: missing"] and sorted(found["2"]) == ["$.changes[0].change_type: 'odd'", "$.changes[0].extra: not known"]
    assert len(found) == 5 and len(found["4"]) >= 1


def test_page_views_and_their_contract(spark):
    first = "2\n1 Preamble words here.\n2 TITLE I\n3 SEC. 5. Alpha beta gamma delta epsilon.\nloose line\n•HR 1 RH"
    second = "2\n1 Other start.\n2 TITLE I\n3 SEC. 6. Alpha beta gamma delta epsilon.\nloose line\n•HR 1 RH"
    lines = pages.page_lines(spark.createDataFrame([("d", 1, 2, first), ("d", 2, 2, second)], "doc_id string, version int, page int, raw string"))
    h = pages.hunks(pages.blocks(lines, pages.anchors(lines)))
    views = contract.page_views(h).orderBy("out_ord").collect()
    assert [(v.change_type, v.heading_html, v.degraded) for v in views] == [("removed", "anchor unresolved · see PDF for context", True), ("added", "anchor unresolved · see PDF for context", True), ("moved", "TITLE I &gt; SEC. 6", False)]
    assert views[0].nav_label_html == "(uncategorized) — p.2 L1" and "(removed in v2)" in views[0].citation_html and "p.2 L3 – p.2" in views[2].citation_html
    assert views[2].move_info_html == '<div class="move-info">Renumbered: <code>SEC. 5</code> &rarr; <code>SEC. 6</code></div>'
    texts, places = contract.full_text(lines)
    assert texts.where("version = 1").first().text == "    1  Preamble words here.\n    2  TITLE I\n    3  SEC. 5. Alpha beta gamma delta epsilon.\n       loose line"
    assert tuple(places.where("version = 1 AND line_number = 2").first())[4:] == (28, 42)


def test_contract_files_and_viewer(spark, tmp_path):
    import json

    import pytest

    from folioscope.functions import text as T

    old = nodes(spark, "o", [(["a"], "Pays $5 for boats.", ""), (["b"], "gone", "")])
    new = nodes(spark, "n", [(["a"], "Pays $9 for boats.", ""), (["c"], "boats.", "")])
    d = classify.diff_versions(old, new)
    names = spark.createDataFrame([("p", "hr", 118, 5, "a", "b", 1, 2)], "pair_id string, bill_type string, congress int, bill_number int, label_old string, label_new string, number_old int, number_new int")
    docs = C.canonical(d, names, spark.createDataFrame([("p", "Pays $5 for boats. gone", "Pays $9 for boats.")], "pair_id string, v1 string, v2 string"))
    contract.save(docs, str(tmp_path / "out"))
    (tmp_path / "p.json").write_text(docs.first().json)
    back = contract.load(spark, str(tmp_path / "p.json"))
    assert back.first().pair_id == "p" and json.loads(back.first().json) == json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    with pytest.raises(ValueError, match="p: "):
        contract.save(docs.withColumn("json", F.replace("json", F.lit('"modified"'), F.lit('"odd"'))), str(tmp_path / "no"))
    views = contract.xml_views(d)
    assert {k: contract.shown(views, k).count() for k in ("all", "financial", "structural")} == {"all": 3, "financial": 1, "structural": 2}
    # "boats." stands within the text marked before it.
    assert [(r.id, r.start, r.end) for r in contract.marked_spans(docs).collect()] == [("c-0001", 0, 18)]
    one = spark.range(1).select(T.viewer_dollars(F.lit(-1500)).alias("a"), T.viewer_dollars(F.lit(20)).alias("b"), T.known_type(F.lit("hjres")).alias("c"), T.known_type(F.lit("x")).alias("d")).first()
    assert tuple(one) == ("$-1,500", "$20", True, False)
