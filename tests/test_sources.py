import json

import pytest

from folioscope.plans.canonical import serialized
from folioscope.sources import bill_xml, cases, http_json, pages

XML = """<bill><form><congress>118th CONGRESS</congress><legis-num>H. R. 4366</legis-num></form><legis-body>
<section id="s0"><enum>1.</enum><header>Short title</header><text>This Act may be <i>cited</i>.</text></section>
<division><enum>A</enum><header>Military</header><title><enum>I</enum><header>Army</header>
<appropriations-major id="m"><header>Operations</header></appropriations-major>
<appropriations-intermediate id="i1"><header>Fuel</header><text>For fuel, $5.</text></appropriations-intermediate>
<appropriations-intermediate id="i2"><header>(including transfers)</header><text>For more, $6.</text></appropriations-intermediate>
<subtitle><header>Other</header><section id="s1"><enum>101.</enum><text>Words (1) here.</text></section></subtitle>
</title></division></legis-body></bill>"""


def test_xml_scan(spark, tmp_path):
    d = tmp_path / "118-hr-4366"
    d.mkdir()
    (d / "1_reported.xml").write_text(XML)
    (d / "2_broken.xml").write_text("<bill>")
    got = bill_xml.scan(spark, str(tmp_path))
    assert got.where("error IS NOT NULL").count() == 1
    rows = got.where("error IS NULL").orderBy("ord").collect()
    assert [r.element_id for r in rows] == ["s0", "i1", "i2", "s1"]
    assert rows[0].display_path == ["Sec. 1"] and rows[0].body_text == "This Act may be cited."
    assert rows[1].match_path == ["army", "operations", "fuel"] and rows[1].display_path[0] == "Division A: Military"
    assert rows[2].match_path[-1] == "fuel" and rows[2].header_text == "(including transfers)"
    assert rows[3].match_path == ["army", "other", "sec. 101"] and rows[3].body_text == "Words(1) here."
    assert (rows[0].congress, rows[0].bill_type, rows[0].bill_number, rows[0].version) == (118, "hr", 4366, "reported")
    text = serialized(got.where("error IS NULL"), ["file"]).first().text
    assert text.startswith("SEC. 1.  This Act") and "Operations" in text


def test_paged_json(spark, tmp_path):
    for o in (0, 2):
        (tmp_path / f"{o}.json").write_text(json.dumps({"bills": {"x": [{"n": o}, {"n": o + 1}]}, "pagination": {"count": 4}}))
    http_json.register(spark)
    rows = spark.read.format("paged_json").option("url", "u").option("list", "bills.x").option("size", 2).option("replay", str(tmp_path)).load().orderBy("place").collect()
    assert [json.loads(r.item)["n"] for r in rows] == [0, 1, 2, 3]


def test_retry():
    waits, answers = [], iter([(429, b""), (500, b""), (200, b"ok")])
    assert http_json.fetch("u", lambda _: next(answers), waits.append) == b"ok" and waits == [60, 2]
    with pytest.raises(RuntimeError):
        http_json.fetch("u", lambda _: (404, b""), waits.append)


CASE = """# Changes

## Case 1 — First

**Type:** Modified — a note

**V1 location:** p.2 L14 – p.3 L2

**V1 text:**
```
Old words
of two lines
```

**V2 location:** p.2 L12 – p.2 L25

**V2 text:**
```
New words
```

**Expected diff output:**
- Change type: modified
- Anchor: OFFICE — Operations
- What changed: one thing,
  and another
- Net: −$5

**Extraction notes:**
- a note

---

## Case 2 — Second

**Type:** added

**V1 location:** N/A

**V1 text:**
```
(none — added in v2)
```

**V2 location:** p.9 L1 – p.9 L1

**V2 text:**
```
x
```

**Expected diff output:**
- Anchor: SEC. 5
"""


def test_cases(spark, tmp_path):
    (tmp_path / "c.md").write_text(CASE)
    one, two = cases.load(spark, str(tmp_path / "c.md")).orderBy("number").collect()
    assert (one.title, one.change_type, one.v1_text, one.v2_text) == ("First", "modified", "Old words\nof two lines", "New words")
    assert tuple(one.v1_location) == (2, 14, 3, 2) and tuple(one.v2_location) == (2, 12, 2, 25)
    assert (one.expected_anchor, one.expected_what_changed, one.expected_net, one.extraction_notes) == ("OFFICE — Operations", "one thing,\n  and another", "−$5", "- a note")
    assert (two.change_type, two.v1_location, two.v1_text, two.expected_net, two.extraction_notes) == ("added", None, "", None, "")
    for broken in (CASE.replace("**Type:** added\n", ""), CASE.replace("p.9 L1 – p.9 L1", "page nine"), CASE.replace("**Expected diff output:**\n- Anchor", "- Anchor")):
        (tmp_path / "d.md").write_text(broken)
        with pytest.raises(ValueError, match="case 2"):
            cases.load(spark, str(tmp_path / "d.md"))


def test_text_pages(spark, tmp_path):
    (tmp_path / "hr5_2").mkdir()
    (tmp_path / "hr5_2" / "7.txt").write_text("1 text")
    assert tuple(pages.text_pages(spark, str(tmp_path / "hr5_2")).first()) == ("hr5", 2, 7, "1 text")


SHAPES = """<bill><legis-body><title><header>Agency</header>
<appropriations-small id="a"><header>(lone)</header><text>First.</text></appropriations-small>
<appropriations-major id="b"><header>Big</header><text>Big words.</text></appropriations-major>
<appropriations-intermediate id="c"><header>Big</header><text>Same name.</text></appropriations-intermediate>
<appropriations-small id="d"><header>BIG</header><text>Other case.</text></appropriations-small>
<section id="e"><enum>5.</enum><header>None</header><appropriations-small id="f"><header>Sub</header><text>In.</text></appropriations-small><section id="no"><text>Not walked.</text></section></section>
<section id="g"><header>No number</header><subsection><text>One.</text></subsection><subsection><text>Two.</text></subsection></section>
<part><section id="h"><enum>6.</enum><text>Under no name.</text></section><chapter><header>Deep</header><subchapter><header>Deeper</header><section id="i"><enum>7.</enum><text>Down.</text></section></subchapter></chapter></part>
</title><section id="j"><header>Bare</header><text>No number here.</text></section></legis-body></bill>"""


def test_shapes_of_headings(spark, tmp_path):
    (tmp_path / "x.xml").write_text(SHAPES)
    rows = {r.element_id: r for r in bill_xml.scan(spark, str(tmp_path)).collect()}
    path = {k: r.match_path for k, r in rows.items()}
    assert path == {
        "j": [], "a": ["agency"], "b": ["agency", "big"], "c": ["agency", "big", "big"], "d": ["agency", "big", "big", "big"], "f": ["agency", "big", "big", "sub"],
        "g": ["agency", "big", "big"], "h": ["agency", "sec. 6"], "i": ["agency", "deep - deeper", "sec. 7"],
    }
    assert rows["g"].body_text == "One.Two." and rows["g"].section_number == "" and rows["j"].header_text == "Bare"
    text = serialized(bill_xml.scan(spark, str(tmp_path)), ["file"]).first().text
    assert text.startswith("Bare\n\nNo number here.\n\nAgency\n\nFirst.")


def test_compare_two_files(spark, tmp_path):
    from folioscope.compare import compare

    old, new = tmp_path / "1_first.xml", tmp_path / "2_second.xml"
    old.write_text(XML)
    new.write_text(XML.replace("$5", "$9").replace("101.", "102."))
    d = json.loads(compare(spark, str(old), str(new), financial=True, fmt="json"))
    assert [c["change_type"] for c in d["changes"]] == ["modified"] and d["changes"][0]["financial"]["paired_amounts"] == [[5, 9]]
    assert d["financial_summary"] == {"sections_with_financial_changes": 1} and (d["old_version_number"], d["new_version_number"], d["old_version"]) == (1, 2, "first")
    d = json.loads(compare(spark, str(old), str(new), include_unchanged=True, fmt="json"))
    assert d["summary"] == {"added": 0, "removed": 0, "modified": 1, "unchanged": 2, "moved": 1} and "financial" not in d["changes"][0] and "financial_summary" not in d
    page = compare(spark, str(old), str(new), filter_text="FUEL")
    assert "H.R. 4366" in page and "$5 → $9 (+$4)" in page and "sec. 10" not in page
    (tmp_path / "3.xml").write_text("<bill>")
    with pytest.raises(ValueError, match="3.xml"):
        compare(spark, str(old), str(tmp_path / "3.xml"))


def test_versions_are_fetched_once(spark, tmp_path, monkeypatch):
    from folioscope.sources import acquire

    monkeypatch.setenv("CONGRESS_API_KEY", "secret")
    listed = {"textVersions": [
        {"type": "Enrolled Bill", "date": None, "formats": [{"type": "Formatted XML", "url": "u/2"}]}, {"type": "Introduced in House", "date": "2023-01-01T00:00:00Z", "formats": [{"type": "PDF", "url": "p"}, {"type": "Formatted XML", "url": "u/1"}]},
        {"type": "Public Law", "date": "2023-05-01T00:00:00Z", "formats": []},
    ]}
    bills = [{"congress": 118, "type": "HR", "number": "5"}, {"congress": 117, "type": "HR", "number": "6"}, {"congress": 118, "type": "HR", "number": "5"}]
    asked = []

    def get(url):
        asked.append(url)
        if url.startswith("u/"):
            return 200, b"<bill/>"
        if "/committee/" in url:
            offset = int(url.split("offset=")[1].split("&")[0])
            return 200, json.dumps({"committee-bills": {"bills": bills[offset : offset + 250]}, "pagination": {"count": 3}}).encode()
        return 200, json.dumps(listed).encode()

    rows = acquire.text_versions(spark, 118, "hr", 5, get)
    assert [r.type for r in rows.orderBy("version_no").collect()] == ["Introduced in House", "Enrolled Bill", "Public Law"]
    with pytest.raises(ValueError, match="1-3"):
        acquire.targets(rows, "o", 4)
    with pytest.warns(UserWarning, match="no XML"):
        first = acquire.download_all(spark, 2023, 2023, str(tmp_path), get)
    assert [f.removeprefix(str(tmp_path)) for f in first] == ["/118-hr-5/1_introduced-in-house.xml", "/118-hr-5/2_enrolled-bill.xml"]
    assert (tmp_path / "118-hr-5" / "2_enrolled-bill.xml").read_bytes() == b"<bill/>"
    assert acquire.download(spark, rows, str(tmp_path), 2, get) == []
    with pytest.raises(RuntimeError) as e:
        acquire.text_versions(spark, 1, "hr", 1, lambda _: (404, b""))
    assert "secret" not in str(e.value)
