"""Packages, folders, fonts and configurations written by the tests."""

import hashlib
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from sheaf.sources.files import build_inputs, build_record, failure_records, font_faces, font_index, listed, load_configuration, only_document, outline_of_files, read_json, single_documents, write_failure, write_records
from sheaf.sources.packages import Limits, effective_bindings, inventory, marked_headings, package_records, read_packages, typed

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
STYLES = f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:rPr><w:sz w:val="32"/><w:b/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Sub"><w:name w:val="sub"/><w:basedOn w:val="H1"/></w:style><w:style w:type="paragraph" w:styleId="Loop"><w:name w:val="loop"/><w:basedOn w:val="Loop"/></w:style></w:styles>'
FIELD = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGEREF  mark \\\\h</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>12</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
BODY = f"""<w:document {NS}><w:body>
<w:p><w:pPr><w:pStyle w:val="Sub"/></w:pPr><w:bookmarkStart w:id="1" w:name="mark"/><w:r><w:rPr><w:b w:val="0"/><w:sz w:val="28"/></w:rPr><w:t>Head</w:t></w:r><w:r><w:tab/><w:t>ing</w:t></w:r></w:p>
<w:p><w:r><w:t>See page </w:t></w:r>{FIELD}<w:r><w:t>.</w:t></w:r><w:hyperlink w:anchor="mark"><w:r><w:t>link</w:t></w:r></w:hyperlink><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath></w:p>
<w:tbl><w:tblGrid><w:gridCol w:w="100"/><w:gridCol w:w="200"/></w:tblGrid><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:drawing><a:blip r:embed="rId2"/></w:drawing></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="rId1"/><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:pPr></w:p>
<w:p><w:pPr><w:outlineLvl w:val="2"/></w:pPr><w:fldSimple w:instr="SEQ Figure"><w:r><w:t>1</w:t></w:r></w:fldSimple></w:p>
<w:p><w:pPr><w:shd w:val="clear" w:fill="FFFF00"/></w:pPr><w:r><w:t> 三、 Marked </w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:highlight w:val="Yellow"/></w:rPr><w:t>12. Lit</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:shd w:fill="ff0"/></w:rPr><w:t>No rule</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:highlight w:val="green"/></w:rPr><w:t>3. Green</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:highlight w:val="yellow"/></w:rPr><w:t> </w:t></w:r></w:p>
<w:sectPr><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/><w:titlePg/></w:sectPr></w:body></w:document>"""
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="header1.xml"/><Relationship Id="rId2" Target="media/i.png"/><Relationship Id="rId3" Target="gone.xml"/><Relationship Id="rId4" Target="http://x" TargetMode="External"/></Relationships>'
PARTS = {
    "word/document.xml": BODY,
    "word/styles.xml": STYLES,
    "word/_rels/document.xml.rels": RELS,
    "word/header1.xml": f"<w:hdr {NS}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>",
    "word/media/i.png": "image",
    "word/footnotes.xml": f'<w:footnotes {NS}><w:footnote w:id="0"/><w:footnote w:id="x1"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    "word/numbering.xml": f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="upperLetter"/><w:lvlText w:val="%1)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
    "word/theme/theme1.xml": '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:majorFont><a:latin typeface="Major"/></a:majorFont></a:theme>',
    "word/glossary.xml": f"<w:x {NS}><w:object/><w:object/></w:x>",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packages")
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        for name, text in PARTS.items():
            z.writestr(name, text)
    (folder / "broken.docx").write_bytes(b"nothing")
    (folder / "~$a.docx").write_bytes(b"lock")
    with zipfile.ZipFile(folder / "bare.docx", "w") as z:
        z.writestr("word/document.xml", BODY)
    with zipfile.ZipFile(folder / "escape.docx", "w") as z:
        z.writestr("../x", "x")
    with zipfile.ZipFile(folder / "bomb.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", " " * 5_000_000)
    with zipfile.ZipFile(folder / "dots.docx", "w") as z:  # dots in a name lead nowhere
        for name, text in PARTS.items():
            z.writestr(name.replace("glossary", "a..b"), text)
    whole = (folder / "a.docx").read_bytes()
    at = whole.index(b"word/numbering.xml") + 60
    (folder / "crc.docx").write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
    with zipfile.ZipFile(folder / "xml.docx", "w") as z:
        for name, text in PARTS.items():
            z.writestr(name, text[:-5] if name == "word/footnotes.xml" else text)
    with zipfile.ZipFile(folder / "number.docx", "w") as z:
        for name, text in PARTS.items():
            z.writestr(name, text.replace('w:outlineLvl w:val="2"', 'w:outlineLvl w:val="²"'))
    return read_packages(spark, str(folder)).cache()


@pytest.fixture(scope="module")
def one(found):
    return found.where("path like '%/a.docx'")


def test_faults(found):
    faults = {r.path.rsplit("/", 1)[1]: r.data["fault"] for r in found.where("kind = 'fault'").collect()}
    assert faults == {"broken.docx": "no_package", "bare.docx": "missing word/styles.xml", "escape.docx": "path_escape", "bomb.docx": "compression_ratio", "crc.docx": "unreadable part", "xml.docx": "unreadable xml"}
    assert found.where("path like '%crc.docx' or path like '%xml.docx'").count() == 2  # nothing but the fault
    assert found.where("path like '%dots.docx' and kind = 'block'").count() == found.where("path like '%number.docx' and kind = 'block'").count() > 0


def test_marked_headings(one):
    got = [(r.level, r.title) for r in marked_headings(one).orderBy("ord").collect()]
    assert got == [(1, "三、Marked"), (2, "12.Lit"), (1, "No rule")]
    got = {(r.level, r.title) for r in marked_headings(one, ((r"^(No) (.*)", 4, "-"),), ("green", "ff0"), {"3. Green": "No more"}).collect()}
    assert got == {(4, "No-rule"), (4, "No-more")}


def test_limits(spark):
    content = [("p", bytearray(b"x"))]
    assert package_records(spark.createDataFrame(content, "path string, content binary"), Limits(parts=0)).first().data["fault"] == "no_package"


def test_blocks(one):
    found = one
    blocks = {r.element_path: r for r in typed(found, "block").collect()}
    body = "/w:document/w:body"
    head = blocks[f"{body}/w:p[1]"]
    assert (head.visible_text, head.outline_level, head.outline_source, head.p_style_name, head.runs_count, head.bold, head.size_pt) == ("Head\ting", 1, "style", "sub", 2, False, 14.0)
    second = blocks[f"{body}/w:p[2]"]
    assert second.text_hash == hashlib.sha256(b"See page .link").hexdigest() and set(second.protected_objects) == {"field", "formula", "hyperlink"}
    assert blocks[f"{body}/w:tbl[1]/w:tr[1]/w:tc[1]/w:p[1]"].visible_text == "A"
    assert blocks[f"{body}/w:p[3]"].structure_type == "section_break"
    assert (blocks[f"{body}/w:p[4]"].outline_level, blocks[f"{body}/w:p[4]"].outline_source) == (3, "direct")
    assert blocks["/w:hdr/w:p[1]"].story_type == "header"


def test_facts(one):
    found = one
    assert [(r.command, r.target, r.cached_value, r.instruction) for r in typed(found, "field").orderBy("ord").collect()] == [("PAGEREF", "mark", "12", "PAGEREF  mark \\h"), ("SEQ", None, "1", "SEQ Figure")]
    assert [(r.width_mm, r.orientation, r.different_first_page) for r in typed(found, "section").orderBy("ord").collect()] == [(210.0, "portrait", False), (297.0, "landscape", True)]
    assert [(r.ord, r.part_uri) for r in typed(found, "section_ref").collect()] == [(0, "word/header1.xml")]
    assert sorted((r.section_index, r.part_uri, r.linked_to_previous) for r in effective_bindings(found).collect()) == [(0, "word/header1.xml", False), (1, "word/header1.xml", True)]
    assert typed(found, "media").first().fingerprint == hashlib.sha256(b"image").hexdigest()
    assert typed(found, "note").first()[3:] == ("x1", "footnote", "anote") and typed(found, "numbering").first()[3:] == ("1", "upperLetter", "%1)", 3)
    assert [(r.feature, r["count"]) for r in typed(found, "unsupported").collect()] == [("ole_object", 2)]
    assert {r.id: r.resolves for r in typed(found, "relationship").collect()} == {"rId1": True, "rId2": True, "rId3": False, "rId4": True}
    assert typed(found, "table").first().grid_widths == [100, 200] and typed(found, "table").first().cell_texts == ["A", ""]
    assert typed(found, "theme_font").where("font = 'Major'").count() == 1 and typed(found, "style").count() == 3
    assert [(r.span_start, r.span_end, r.direct_bold) for r in typed(found, "run").where("element_path like '%body/w:p[1]'").orderBy("span_start").collect()] == [(0, 4, False), (4, 8, None)]
    assert {r.kind for r in inventory(found).collect()} == {"paragraph", "formula", "media", "hyperlink", "field", "note"}


def test_outline_of_files(spark, tmp_path):
    for name in ("10 last.docx", "2 second.docx", "2 second.doc", "slides.pptx", "slides.pdf", ".hidden.docx", "~$2.docx", "x.bak", "notes.txt", "1. first.png"):
        (tmp_path / name).write_bytes(b"x")
    got = [(r.name, r.type, r.seq, r.title) for r in outline_of_files(listed(spark, str(tmp_path))).orderBy("seq").collect()]
    assert got == [("1. first.png", "image", 1, "1. first"), ("2 second.docx", "docx", 2, "2. second"), ("10 last.docx", "docx", 3, "3. last"), ("slides.pptx", "pptx", 4, "4. slides")]
    assert only_document(listed(spark, str(tmp_path)), "10 last.docx").count() == 1
    with pytest.raises(Exception, match="documents found"):
        only_document(listed(spark, str(tmp_path))).collect()


def font(*names, version=b"\0\1\0\0"):
    raw = [n.encode("utf-16-be") for _, n in names]
    at, table = 12 + 16, b""
    for (kind, _), text, start in zip(names, raw, [sum(map(len, raw[:i])) for i in range(len(raw))]):
        table += struct.pack(">HHHHHH", 3, 1, 0x409, kind, len(text), start)
    header = struct.pack(">HHH", 0, len(names), 6 + len(table))
    return struct.pack(">4sHHHH", version, 1, 0, 0, 0) + struct.pack(">4sIII", b"name", 0, at, 0) + header + table + b"".join(raw)


def test_fonts(spark):
    assert list(font_faces(font((1, "Serif A"), (4, "Serif A Bold"), (99, "other")))) == [(0, "family", "Serif A", "ok"), (0, "full", "Serif A Bold", "ok")]
    assert [f[3] for f in font_faces(b"MZ....")] == ["unsupported"] and [f[3] for f in font_faces(b"")] == ["error"] and [f[3] for f in font_faces(font((1, "x"), version=b"abcd"))] == ["error"]
    rows = spark.createDataFrame([("a", bytearray(font((1, "S")))), ("b", bytearray(b"zz"))], "path string, content binary")
    assert sorted((r.path, r.name, r.status) for r in font_index(rows).collect()) == [("a", "S", "ok"), ("b", None, "error")]


def test_configurations(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": 1, "c": [1, 2]}, "d": 1}')
    (tmp_path / "b.json").write_text('{"a": {"c": [3], "e": null}, "d": {"f": 0}}')
    (tmp_path / "bad.json").write_text("{")
    assert load_configuration([str(tmp_path / n) for n in ("a.json", "none.json", "b.json")]) == {"a": {"b": 1, "c": [3], "e": None}, "d": {"f": 0}}
    with pytest.raises(ValueError):
        load_configuration([str(tmp_path / "bad.json")])
    values = {r.path.rsplit("/", 1)[1]: r.v for r in read_json(spark, str(tmp_path)).select("path", F.to_json("value").alias("v")).collect()}
    assert values["bad.json"] is None and json.loads(values["a.json"])["d"] == 1


def test_sinks(spark, tmp_path):
    rows = spark.range(3)
    write_records(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        write_records(rows, str(tmp_path / "out"))
    write_records(rows, str(tmp_path / "out"), overwrite=True)
    write_failure(str(tmp_path / "failure.json"), ValueError("x"))
    with pytest.raises(FileExistsError):
        write_failure(str(tmp_path / "failure.json"), ValueError("y"))
    inputs = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "source_sha256 string")
    checks = spark.createDataFrame([("passed",), ("passed",), ("failed",)], "status string")
    record = build_record(inputs, checks).first()
    listed_ = hashlib.sha256("\n".join(hashlib.sha256(x).hexdigest() for x in (b"a", b"b")).encode()).hexdigest()
    assert (record.inputs, record.digest, json.loads(record.checks)) == (2, listed_, {"failed": 1, "passed": 2})
    assert build_record(inputs.limit(0), checks.limit(0)).first()[:] == (0, hashlib.sha256(b"").hexdigest(), "{}")
    assert sorted(tuple(r) for r in build_inputs(inputs).collect()) == [("a", 2), ("b", 1)]
    failed = spark.createDataFrame([(1, "E", "m"), (2, None, "m")], "id int, error string, message string")
    assert [tuple(r) for r in failure_records(failed, "id", "error", "message").collect()] == [(1, '{"error":"E","message":"m"}')]
    files = spark.createDataFrame([("f", "a.docx"), ("f", "~$a.docx"), ("g", "a.DOCX"), ("g", "b.docx"), ("h", "x.pdf")], "folder string, name string")
    assert sorted(tuple(r) for r in single_documents(files).collect()) == [("f", "a.docx", None), ("g", None, "several"), ("h", None, "none")]


def test_stream(spark, tmp_path):
    from sheaf.streaming.inventory import streamed_paragraphs

    spark.createDataFrame([("a b\nab\nlonger", "2025-01-01 10:00:00"), (None, "2025-01-01 11:00:00"), ("ab", "2025-01-02 09:00:00")], "text string, at string").select("text", F.to_timestamp("at").alias("captured_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, captured_at timestamp").parquet(str(tmp_path / "in"))
    query = streamed_paragraphs(stream).writeStream.outputMode("complete").format("memory").queryName("bags").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.day.day, r.norm, r.n) for r in spark.table("bags").collect()) == [(1, "ab", 2), (1, "longer", 1), (2, "ab", 1)]


def test_build_outline(spark, tmp_path, one):
    from sheaf.sources.files import build_outline

    folder = one.select("path").first().path.removeprefix("file:").rsplit("/", 1)[0]
    assert [(r.level, r.title) for r in build_outline(spark, "docx_document", folder).orderBy("ord").collect()][0] == (1, "Head\ting")
    assert {r.level for r in build_outline(spark, "highlighted_docx", folder, [("^(No) (.*)", 5, " ")]).collect()} == {1, 5}
    assert build_outline(spark, "directory_tree", folder).where("name = 'a.docx'").count() == 1
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "m.json").write_text('{"source": {"tree": [{"title": "x", "level": 1}]}}')
    assert build_outline(spark, "explicit_tree", str(tmp_path / "m.json")).first().title == "x"
    with pytest.raises(ValueError, match="empty"):
        build_outline(spark, "explicit_tree", str(tmp_path / "none.json"))
    with pytest.raises(ValueError, match="strategy"):
        build_outline(spark, "other", folder)


def test_every_page_reference_has_a_status(spark, tmp_path):
    from sheaf.plans.registry import queries

    labels = [(1, "body", "7"), (2, "body", None), (3, "footer:0", None), (4, "body", "iv"), (5, "body", "1234"), (6, "header:0", "1234"), (7, "body", "0"), (8, "body", "007"), (9, None, "999")]
    spark.createDataFrame([(*x, "PAGEREF") for x in labels] + [(10, "body", "1", "REF")], "obs_id long, story string, cached_value string, command string").write.parquet(f"{tmp_path}/field_observations.parquet")
    got = {r.obs_id: (r.expected, r.status) for r in queries()["w12_page_labels"](spark, str(tmp_path)).collect()}
    none = (None, "unverified")
    assert got == {1: ("7", "verified"), 2: none, 3: none, 4: none, 5: ("1234", "verified"), 6: ("mccxxxiv", "mismatch"), 7: none, 8: ("7", "mismatch"), 9: ("cmxcix", "mismatch")}


def test_heading_pages(spark):
    from sheaf.operators.pages import heading_pages

    heads = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "a"), ("d", 4, "none"), ("e", 1, "a")], "doc string, n long, k string")
    lines = spark.createDataFrame([("d", "a", 2), ("d", "a", 5), ("d", "b", 1), ("d", "b", 4), ("d", "a", 2)], "doc string, k string, page int")
    assert sorted(tuple(r) for r in heading_pages(heads, lines, "doc", "n", "k", "page").collect()) == [("d", 1, 2), ("d", 2, 4), ("d", 3, 5), ("d", 4, 5), ("e", 1, 1)]
