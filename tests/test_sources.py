"""Readers and writers on generated files."""

import io
import json
import zipfile

import pytest

from stavelake.sources import scores

SCORE = """<?xml version="1.0"?><!DOCTYPE score-partwise PUBLIC "x" "y"><score-partwise><part id="P1">
<measure number="1"><note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>4</duration><voice>1</voice><type>quarter</type><dot/><lyric><text>la</text></lyric></note>
<backup><duration>4</duration></backup><note><chord/><rest/><duration>x</duration><voice>2</voice><staff>2</staff></note></measure>
<measure number="X1"><forward><duration>2</duration></forward></measure></part></score-partwise>"""


def archive(xml=SCORE, member="score.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", f'<rootfile full-path="{member}"/>')
        z.writestr(member, xml)
    return out.getvalue()


def rows(df):
    return [tuple(r) for r in df.select("part_id", "measure_pos", "number", "seq", "kind", "voice", "staff", "duration", "is_rest", "is_chord", "step", "alter", "octave", "lyric").orderBy("measure_pos", "seq").collect()]


WANT = [
    ("P1", 1, "1", 1, "note", "1", "1", 4, False, False, "C", 1, 4, "la"),
    ("P1", 1, "1", 2, "backup", "1", "1", 4, False, False, None, 0, None, None),
    ("P1", 1, "1", 3, "note", "2", "2", 0, True, True, None, 0, None, None),
    ("P1", 2, "X1", 1, "forward", "1", "1", 2, False, False, None, 0, None, None),
]


def test_archives_and_bad_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.mxl").write_bytes(archive())
    (tmp_path / "b.mxl").write_bytes(b"no archive")
    (tmp_path / "c.musicxml").write_text(SCORE)
    (tmp_path / "d.txt").write_text("x")
    found = scores.scan_archives(spark, str(tmp_path)).cache()
    assert rows(found.filter("error is null")) == WANT and found.filter("error is not null").count() == 1
    assert rows(scores.scan_xml(spark, str(tmp_path))) == WANT
    assert [r["path"].rsplit("/", 1)[1] for r in scores.discover(spark, str(tmp_path)).collect()] == ["b.mxl", "c.musicxml", "a.mxl"]
    packed = scores.archives_of(found).collect()
    assert len(packed) == 1
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "e.mxl").write_bytes(packed[0]["content"])
    assert rows(scores.scan_archives(spark, str(tmp_path / "again"))) == WANT
    scores.write_elements(found.filter("error is null"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


RICH = """<score-partwise><part id="P1"><measure number="0" implicit="yes"><print new-page="yes" new-system="no"/><attributes><divisions>8</divisions>
<key><cancel>2</cancel><fifths>-3</fifths></key><time><beats>3</beats><beat-type>4</beat-type></time><clef number="1"><sign>G</sign><line>2</line></clef><clef number="2"><sign>F</sign><line>4</line></clef></attributes>
<note default-x="12.5" data-hitl-play-order="2"><pitch><step>C</step><octave>4</octave></pitch><duration>4</duration><tie type="stop"/><tie type="start"/><voice>1</voice><type>eighth</type>
<time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes></time-modification><stem>up</stem><staff>1</staff><beam number="1">begin</beam><beam number="2">begin</beam>
<notations><slur type="start" number="1" placement="above"/><tuplet type="start"/><articulations><staccato placement="below"/><accent/></articulations></notations>
<lyric number="1"><syllabic>begin</syllabic><text>la</text></lyric><lyric number="2"><text>lo</text></lyric></note></measure><measure number="1"/></part></score-partwise>"""


def test_archives_keep_marks_and_measure_attributes(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one" / "a.mxl").write_bytes(archive(RICH))
    read = lambda x: [[r.asDict(True) | {"path": ""} for r in f(spark, str(tmp_path / x)).orderBy("measure_pos").collect()] for f in (scores.scan_archives, scores.scan_measures)]
    (note,), (first, second) = want = read("one")
    assert (note["stem"], note["default_x"], note["play_order"], note["ties"], note["tuplet"]) == ("up", 12.5, 2, ["stop", "start"], {"actual": 3, "normal": 2, "type": "start"})
    assert note["beams"] == [{"number": 1, "value": "begin"}, {"number": 2, "value": "begin"}] and note["slurs"] == [{"type": "start", "number": "1", "placement": "above"}]
    assert note["artic"] == [{"tag": "staccato", "placement": "below"}, {"tag": "accent", "placement": None}]
    assert [(x["verse"], x["syllabic"], x["text"]) for x in note["lyrics"]] == [(1, "begin", "la"), (2, None, "lo")]
    assert [first[x] for x in ("implicit", "divisions", "beats", "beat_type", "fifths", "cancel", "new_page", "new_system")] == [True, 8, 3, 4, -3, True, True, False]
    assert [(c["staff"], c["sign"], c["line"]) for c in first["clefs"]] == [(1, "G", 2), (2, "F", 4)] and second["divisions"] is None and second["number"] == "1"
    folder = str(tmp_path / "one")
    packed = scores.archives_of(scores.scan_archives(spark, folder), scores.scan_measures(spark, folder)).collect()
    (tmp_path / "two" / "a.mxl").write_bytes(packed[0]["content"])
    assert read("two") == want


def test_bundle_prefers_raw(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("baseline.mxl", archive(SCORE.replace(">la<", ">baseline<")))
        z.writestr("audiveris_raw.mxl", archive())
    assert rows(scores.scan_bundles(spark, str(tmp_path))) == WANT


def test_layout_fixes_symbols(spark, tmp_path):
    for name in ("layout", "fixes", "symbols"):
        (tmp_path / name).mkdir()
    glyph = {"raw_text": "a", "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0, "fontname": "F", "size": 9.0}
    (tmp_path / "layout" / "p.json").write_text(json.dumps([{"page_number": 1, "width": 595, "height": 842, "text_elements": [glyph, glyph]}]))
    assert scores.scan_layout(spark, str(tmp_path / "layout")).select("page", "raw_text", "size").collect() == [(1, "a", 9.0)] * 2
    fix = {"id": "1", "kind": "removeNote", "partId": "P1", "measureMxl": "3", "noteIndex": 0}
    (tmp_path / "fixes" / "a.json").write_text(json.dumps({"version": 1, "fixes": [fix, fix]}))
    (tmp_path / "fixes" / "b.json").write_text(json.dumps([fix]))
    (tmp_path / "fixes" / "c.json").write_text("broken")
    found = scores.scan_fixes(spark, str(tmp_path / "fixes"))
    assert found.count() == 3 and {r["kind"] for r in found.collect()} == {"removeNote"}
    scores.write_fixes(found, str(tmp_path / "out"), "2024-01-01T00:00:00Z")
    assert sorted(r["version"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 1]
    (tmp_path / "symbols" / "s.json").write_text(json.dumps({"metadata": {"a": "b"}, "nodes": [{"measure": 1, "staff": 2, "pitch": "C4", "kind": "note"}]}))
    assert scores.scan_symbols(spark, str(tmp_path / "symbols")).select("measure", "pitch").collect() == [(1, "C4")]


def test_symbols_read_back_equal(spark, tmp_path):
    (tmp_path / "in").mkdir()
    node = {"measure": 1, "staff": 2, "pitch": "C4", "kind": "note", "x": 2.5, "y": 1.0, "lyric": "la", "confidence_pitch": 0.5, "clef_line": 2}
    graphs = {"a": [node, node | {"x": 1.0}, {"kind": "rest", "measure": 2, "rest": True}], "b": [node]}
    for name, listed in graphs.items():
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"metadata": {"title": name}, "nodes": listed}))
    read = lambda folder: sorted(str(r.asDict(True)) for r in scores.scan_symbols(spark, str(tmp_path / folder)).collect())
    scores.write_symbols(scores.scan_symbols(spark, str(tmp_path / "in")).coalesce(1), str(tmp_path / "out"))
    assert read("out") == read("in") and len(read("in")) == 4
    written = [r["nodes"] for r in spark.read.json(str(tmp_path / "out")).collect()]
    assert sorted([n["x"] for n in nodes] for nodes in written) == [[1.0, 2.5, None], [2.5]]


def test_report_is_sorted(spark, tmp_path):
    issues = spark.createDataFrame([(1, m, c) for m, c in ((3, "x"), (1, "z"), (1, "a"), (2, "y"))], "score_id long, measure_no long, code string")
    scores.write_report(issues.repartition(4), str(tmp_path / "r"))
    (row,) = spark.read.json(str(tmp_path / "r")).collect()
    assert [(x["measure_no"], x["code"]) for x in row["issues"]] == [(1, "a"), (1, "z"), (2, "y"), (3, "x")]


def test_fixes_read_back_equal(spark, tmp_path):
    (tmp_path / "fixes").mkdir()
    pitch = {"id": "1", "kind": "setPitch", "partId": "P1", "measureMxl": "3", "noteIndex": 0, "args": {"step": "C", "octave": 5}}
    bare = {"id": "2", "kind": "removeNote", "partId": "P1", "measureMxl": "3", "noteIndex": 1}
    for name, listed in (("a", [pitch, bare]), ("b", [bare]), ("c", [pitch | {"args": {"type": "half"}}])):
        (tmp_path / "fixes" / f"{name}.json").write_text(json.dumps({"version": 1, "fixes": listed}))
    read = lambda folder: [tuple(r) for r in scores.scan_fixes(spark, str(folder)).orderBy("path", "ord").collect()]
    scores.write_fixes(scores.scan_fixes(spark, str(tmp_path / "fixes")).coalesce(1), str(tmp_path / "out"), "2024-01-01T00:00:00Z")
    want = read(tmp_path / "fixes")
    assert read(tmp_path / "out") == want and [r[-1] for r in want] == [{"step": "C", "octave": "5"}, None, None, {"type": "half"}]


def test_report(spark, tmp_path):
    issues = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x")], "score_id long, measure_no long, code string")
    scores.write_report(issues, str(tmp_path / "r"))
    assert {(r["score_id"], r["total"]) for r in spark.read.json(str(tmp_path / "r")).collect()} == {(1, 2), (2, 1)}


def test_document_types_go_with_their_entities():
    from xml.etree.ElementTree import ParseError

    subset = b'<!DOCTYPE a [<!ENTITY x "]>"> <!ENTITY y \'&x;&x;\'> <!ELEMENT a (#PCDATA)>]>'
    assert scores._root(b'<?xml version="1.0"?>' + subset + b"<a>ok</a>").text == "ok"
    assert scores._root(b'<!DOCTYPE a PUBLIC "-//x>//" "y"><a>ok</a>').text == "ok"
    with pytest.raises(ParseError):
        scores._root(subset + b"<a>&y;</a>")
