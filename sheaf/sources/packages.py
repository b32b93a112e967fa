"""Word-processor packages as tables: each file is opened once, where it lies, and gives rows of several kinds.

`package_records` has one row per fact: source_sha256, part_uri, kind, ord and a map of the fact's fields. The functions
below it are typed views of one kind each. Only the standard zip and XML readers are used; a file that breaks a safety
limit, is no package or has a part that cannot be read gives one row of kind `fault` and nothing else, never an exception.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
# Protected objects by tag, and raw tokens of features that are only counted.
PROTECTED = {W + "drawing": "drawing", W + "pict": "drawing", M + "oMath": "formula", W + "fldChar": "field", W + "fldSimple": "field", W + "footnoteReference": "footnote_ref", W + "endnoteReference": "endnote_ref", W + "hyperlink": "hyperlink", W + "bookmarkStart": "bookmark", W + "sdt": "sdt"}
UNSUPPORTED = {b"<w:altChunk": "alt_chunk", b"<w:object": "ole_object", b"<w:txbxContent": "text_box", b"<w:customXml": "custom_xml"}
OFF = {"0", "false", "off", "none"}
RECORD = "source_sha256 string, path string, part_uri string, kind string, ord int, data map<string,string>"


@dataclass(frozen=True)
class Limits:
    """What a package may hold."""

    total: int = 256 << 20
    part: int = 32 << 20
    parts: int = 10_000
    ratio: float = 200.0
    ratio_from: int = 1024


def package_fault(infos: list[zipfile.ZipInfo], limits: Limits) -> str | None:
    """The first limit that a package breaks."""
    if len(infos) > limits.parts:
        return "too_many_parts"
    for info in infos:
        steps = info.filename.replace("\\", "/").split("/")
        if ".." in steps or steps[0] in ("", ".") or ":" in steps[0]:
            return "path_escape"
        if info.file_size > limits.part:
            return "part_too_large"
        if info.compress_size and info.file_size > limits.ratio_from and info.file_size / info.compress_size > limits.ratio:
            return "compression_ratio"
    return "package_too_large" if sum(i.file_size for i in infos) > limits.total else None


def value(element: ET.Element | None, tag: str, attribute: str = "val") -> str | None:
    found = element.find(W + tag) if element is not None else None
    return found.get(W + attribute) if found is not None else None


def toggled(element: ET.Element | None, tag: str) -> str | None:
    """true, false, or null where the property is not set."""
    found = element.find(W + tag) if element is not None else None
    return None if found is None else str((found.get(W + "val") or "true").lower() not in OFF).lower()


def run_text(run: ET.Element) -> str:
    """Text of a run with its tabs and breaks."""
    return "".join(x.text or "" if x.tag == W + "t" else "\t" if x.tag == W + "tab" else "\n" if x.tag in (W + "br", W + "cr") else "" for x in run)


def visible_text(element: ET.Element) -> str:
    """the text outside field results: simple fields and what lies between a field's begin and end are skipped."""
    out, depth = [], 0

    def walk(node: ET.Element) -> None:
        nonlocal depth
        for x in node:
            if x.tag == W + "fldChar":
                kind = x.get(W + "fldCharType")
                depth += (kind == "begin") - (kind == "end" and depth > 0)
            elif x.tag == W + "t" and not depth:
                out.append(x.text or "")
            elif x.tag != W + "fldSimple":
                walk(x)

    walk(element)
    return "".join(out)


def formula_hash(element: ET.Element) -> str:
    """of the canonical form of a formula."""
    return hashlib.sha256(ET.canonicalize(ET.tostring(element, encoding="unicode"), strip_text=True).encode()).hexdigest()


def text_hash(text: str) -> str:
    return hashlib.sha256(re.sub(r"\s+", " ", text).strip().encode()).hexdigest()


def field_rows(paragraph: ET.Element) -> Iterator[tuple[str, str]]:
    """Instruction and shown text of each field of a paragraph, inner fields before the ones around them."""
    for simple in paragraph.findall(W + "fldSimple"):
        yield simple.get(W + "instr") or "", "".join(t.text or "" for t in simple.iter(W + "t"))
    open_: list[dict] = []
    for run in paragraph.findall(W + "r"):
        marks = [x.get(W + "fldCharType") for x in run.findall(W + "fldChar")]
        for mark in marks:
            if mark == "begin":
                open_.append({"instruction": [], "shown": [], "result": False})
            elif mark == "separate" and open_:
                open_[-1]["result"] = True
            elif mark == "end" and open_:
                field = open_.pop()
                yield "".join(field["instruction"]), "".join(field["shown"])
        instruction = [x.text or "" for x in run.findall(W + "instrText")]
        if open_ and instruction and not open_[-1]["result"]:
            open_[-1]["instruction"] += instruction
        elif open_ and not instruction and not {"begin", "separate"} & set(marks):
            for field in open_:
                if field["result"]:
                    field["shown"] += [t.text or "" for t in run.iter(W + "t")]


def marks_of(p: ET.Element) -> set[str]:
    """The colours with which a paragraph is shaded or any of its runs is highlighted or shaded, in small letters."""
    shades = [p.find(f"{W}pPr/{W}shd"), *p.findall(f"{W}r/{W}rPr/{W}shd")]
    lights = p.findall(f"{W}r/{W}rPr/{W}highlight")
    found = {s.get(W + "fill") for s in shades if s is not None} | {h.get(W + "val") for h in lights}
    return {colour.lower() for colour in found if colour}


def paragraph_fields(p: ET.Element, names: dict[str, str], levels: dict[str, str]) -> dict[str, str | None]:
    """A paragraph's text, styles, outline level and its source, runs and protected objects."""
    properties = p.find(W + "pPr")
    style, direct = value(properties, "pStyle"), value(properties, "outlineLvl")
    runs = list(p.iter(W + "r"))
    first = runs[0].find(W + "rPr") if runs else None
    level = str(int(direct) + 1) if direct and direct.isdecimal() else levels.get(style or "")
    fonts = first.find(W + "rFonts") if first is not None else None
    return {
        "structure_type": "paragraph",
        "visible_text": "".join(map(run_text, runs)),
        "text_hash": text_hash(visible_text(p)),
        "p_style_id": style,
        "p_style_name": names.get(style or ""),
        "outline_level": level,
        "outline_source": "direct" if direct and direct.isdecimal() else "style" if level else None,
        "runs_count": str(len(runs)),
        "protected_objects": ",".join(sorted({PROTECTED[x.tag] for x in p.iter() if x.tag in PROTECTED})),
        "marks": ",".join(sorted(marks_of(p))),
        "alignment": value(properties, "jc"),
        "size_pt": str(float(size) / 2) if (size := value(first, "sz")) and size.isdecimal() else None,
        "bold": toggled(first, "b"),
        "italic": toggled(first, "i"),
        "latin": fonts.get(W + "ascii") if fonts is not None else None,
        "east_asia": fonts.get(W + "eastAsia") if fonts is not None else None,
    }


def block_elements(parent: ET.Element, path: str) -> Iterator[tuple[str, ET.Element, bool]]:
    """Path, paragraph and whether it is the last of a section, through tables, rows and cells."""
    count: Counter[str] = Counter()
    for child in parent:
        name = child.tag.rpartition("}")[2]
        count[name] += 1
        at = f"{path}/w:{name}[{count[name]}]"
        if child.tag == W + "p":
            yield at, child, child.find(f"{W}pPr/{W}sectPr") is not None
        elif child.tag in (W + "tbl", W + "tr", W + "tc", W + "sdt", W + "sdtContent"):
            yield from block_elements(child, at)


def section_fields(section: ET.Element) -> dict[str, str | None]:
    """A section's page in millimetres, with the defaults of A4."""
    size, margin, number = section.find(W + "pgSz"), section.find(W + "pgMar"), section.find(W + "pgNumType")

    def mm(element: ET.Element | None, attribute: str, default: float) -> str:
        try:
            return str(round(float(element.get(W + attribute)) / 20 * 25.4 / 72, 1))
        except (AttributeError, TypeError, ValueError):
            return str(default)

    return {
        "section_type": value(section, "type") or "nextPage",
        "width_mm": mm(size, "w", 210.0),
        "height_mm": mm(size, "h", 297.0),
        "orientation": "landscape" if size is not None and size.get(W + "orient") == "landscape" else "portrait",
        **{f"margin_{k}_mm": mm(margin, k, d) for k, d in (("top", 25.4), ("bottom", 25.4), ("left", 31.8), ("right", 31.8))},
        "header_distance_mm": mm(margin, "header", 15.0),
        "footer_distance_mm": mm(margin, "footer", 15.0),
        "page_start": number.get(W + "start") if number is not None else None,
        "page_format": number.get(W + "fmt") if number is not None else None,
        "different_first_page": str(section.find(W + "titlePg") is not None).lower(),
    }


#: What unreadable parts raise: broken archives and XML, encrypted parts, methods that are not known, numbers that are none.
UNREADABLE = (zipfile.BadZipFile, zlib.error, ET.ParseError, OSError, EOFError, RuntimeError, NotImplementedError, ValueError, KeyError, OverflowError)


def records(content: bytes, limits: Limits) -> list[tuple[str, str, int, dict[str, str | None]]]:
    """part_uri, kind, ord and fields of everything in one package; of one that cannot be read in whole, only its fault."""
    try:
        return list(contents(content, limits))
    except UNREADABLE as error:
        return [("", "fault", 0, {"fault": "unreadable xml" if isinstance(error, ET.ParseError) else "unreadable part"})]


def contents(content: bytes, limits: Limits) -> Iterator[tuple[str, str, int, dict[str, str | None]]]:
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError):
        yield "", "fault", 0, {"fault": "no_package"}
        return
    with package:
        infos = package.infolist()
        fault = package_fault(infos, limits)
        missing = [n for n in ("word/document.xml", "word/styles.xml") if n not in package.namelist()]
        if fault or missing:
            yield "", "fault", 0, {"fault": fault or f"missing {missing[0]}"}
            return
        parts = {i.filename: package.read(i) for i in infos if not i.is_dir()}
    for n, info in enumerate(infos):
        yield info.filename, "part", n, {"size": str(info.file_size), "compressed": str(info.compress_size)}
    trees = {name: ET.fromstring(raw) for name, raw in parts.items() if name.endswith((".xml", ".rels"))}
    # relationships of the main part
    targets: dict[str, str] = {}
    for n, relation in enumerate(trees.get("word/_rels/document.xml.rels", ET.Element("none")).iter(RELATION)):
        target, external = relation.get("Target") or "", relation.get("TargetMode") == "External"
        at = target if external else posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join("word", target))
        targets[relation.get("Id") or ""] = at
        yield "word/document.xml", "relationship", n, {"id": relation.get("Id"), "target": at, "external": str(external).lower(), "resolves": str(external or at in parts).lower()}
    # theme fonts and styles
    theme = trees.get("word/theme/theme1.xml")
    if theme is not None:
        for n, (slot, tag) in enumerate((s, t) for s in ("majorFont", "minorFont") for t in ("latin", "ea")):
            found = theme.find(f".//{A}{slot}/{A}{tag}")
            yield "word/theme/theme1.xml", "theme_font", n, {"slot": slot, "script": tag, "font": found.get("typeface") if found is not None else None}
    names, own, based = {}, {}, {}
    for n, style in enumerate(trees["word/styles.xml"].iter(W + "style")):
        key, properties, run = style.get(W + "styleId") or "", style.find(W + "pPr"), style.find(W + "rPr")
        names[key], based[key] = value(style, "name"), value(style, "basedOn")
        level = value(properties, "outlineLvl")
        own[key] = str(int(level) + 1) if level and level.isdecimal() else None
        size, fonts = value(run, "sz"), run.find(W + "rFonts") if run is not None else None
        yield "word/styles.xml", "style", n, {"style_id": key, "style_type": style.get(W + "type"), "name": names[key], "based_on": based[key], "next_style": value(style, "next"), "outline_level": own[key], "size_pt": str(float(size) / 2) if size and size.isdecimal() else None, "bold": toggled(run, "b"), "italic": toggled(run, "i"), "alignment": value(properties, "jc"), "latin": fonts.get(W + "ascii") if fonts is not None else None}
    levels: dict[str, str] = {}
    for key in own:
        at, seen = key, set()
        while at and at not in seen and own.get(at) is None:
            seen.add(at)
            at = based.get(at) or ""
        if own.get(at):
            levels[key] = own[at]
    # blocks, sections, fields, formulas, bookmarks and links of the main part and its stories
    stories = [("word/document.xml", "body", trees["word/document.xml"].find(W + "body"), "/w:document/w:body")]
    stories += [(n, k, trees[n], f"/w:{'hdr' if k == 'header' else 'ftr'}") for k in ("header", "footer") for n in sorted(trees) if re.fullmatch(rf"word/{k}\d*\.xml", n)]
    for part, story, root, base in stories:
        count: Counter[str] = Counter()
        for path, p, ends in block_elements(root, base) if root is not None else ():
            fields = paragraph_fields(p, names, levels) | {"element_path": path, "story_type": story}
            yield part, "block", count["block"], fields | ({"structure_type": "section_break"} if ends and not fields["visible_text"] else {})
            count["block"] += 1
            offset = 0
            for run in p.iter(W + "r"):
                text, properties = run_text(run), run.find(W + "rPr")
                if text:
                    yield part, "run", count["run"], {"element_path": path, "span_start": str(offset), "span_end": str(offset + len(text)), "direct_bold": toggled(properties, "b"), "direct_italic": toggled(properties, "i"), "r_style_id": value(properties, "rStyle")}
                    count["run"] += 1
                    offset += len(text)
            for instruction, shown in field_rows(p):
                tokens = re.sub(r"\\{2,}", r"\\", instruction).split()
                command = tokens[0].upper() if tokens else ""
                yield part, "field", count["field"], {"story": story, "element_path": path, "instruction": re.sub(r"\\{2,}", r"\\", instruction).strip(), "command": command, "target": tokens[1] if len(tokens) > 1 and command in ("REF", "PAGEREF") else None, "cached_value": shown}
                count["field"] += 1
            for x in p.iter():
                if x.tag == M + "oMath":
                    yield part, "formula", count["formula"], {"element_path": path, "fingerprint": formula_hash(x)}
                    count["formula"] += 1
                elif x.tag == W + "bookmarkStart":
                    yield part, "bookmark", count["bookmark"], {"element_path": path, "name": x.get(W + "name")}
                    count["bookmark"] += 1
                elif x.tag == W + "hyperlink":
                    anchor, rid = x.get(W + "anchor"), x.get(R + "id")
                    yield part, "hyperlink", count["hyperlink"], {"element_path": path, "target": f"#{anchor}" if anchor else targets.get(rid or "", rid)}
                    count["hyperlink"] += 1
                elif x.tag == A + "blip" and (target := targets.get(x.get(R + "embed") or "")) in parts:
                    yield part, "media", count["media"], {"element_path": path, "fingerprint": hashlib.sha256(parts[target]).hexdigest(), "local_index": str(count["media " + path]), "host_text": fields["visible_text"]}
                    count["media"] += 1
                    count["media " + path] += 1
        if part == "word/document.xml" and root is not None:
            for n, section in enumerate(root.iter(W + "sectPr")):
                yield part, "section", n, section_fields(section)
                for kind in ("header", "footer"):
                    for reference in section.findall(f"{W}{kind}Reference"):
                        yield part, "section_ref", n, {"story_type": kind, "variant": reference.get(W + "type") or "default", "part_uri": targets.get(reference.get(R + "id") or "")}
            for n, table in enumerate(root.iter(W + "tbl")):
                rows = table.findall(W + "tr")
                cells = [["".join(t.text or "" for t in cell.iter(W + "t")) for cell in row.findall(W + "tc")] for row in rows]
                widths = [g.get(W + "w") or "0" for g in table.findall(f"{W}tblGrid/{W}gridCol")]
                yield part, "table", n, {"row_count": str(len(rows)), "col_count": str(max(map(len, cells), default=0)), "grid_widths": ",".join(widths), "cell_texts": "\x1f".join(t for row in cells for t in row)}
    # notes (S16), numbering (S18), features that are only counted
    for kind in ("footnote", "endnote"):
        for n, note in enumerate(trees.get(f"word/{kind}s.xml", ET.Element("none")).iter(W + kind)):
            if (number := note.get(W + "id")) not in (None, "-1", "0"):
                yield f"word/{kind}s.xml", "note", n, {"note_id": number, "story_type": kind, "text": re.sub(r"\s+", "", "".join(t.text or "" for t in note.iter(W + "t")))}
    numbering = trees.get("word/numbering.xml")
    if numbering is not None:
        abstract = {x.get(W + "abstractNumId"): x.find(W + "lvl") for x in numbering.findall(W + "abstractNum")}
        for n, num in enumerate(numbering.findall(W + "num")):
            level = abstract.get(value(num, "abstractNumId"))
            if level is not None:
                yield "word/numbering.xml", "numbering", n, {"num_id": num.get(W + "numId"), "format": value(level, "numFmt") or "decimal", "level_text": value(level, "lvlText") or "%1.", "start": value(level, "start") or "1"}
    for name, raw in parts.items():
        if name.startswith("word/") and name.endswith(".xml"):
            for token, feature in UNSUPPORTED.items():
                if token in raw:
                    yield name, "unsupported", 0, {"feature": feature, "count": str(raw.count(token))}


def package_records(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Everything in the packages of a table of path and content, as `spark.read.format('binaryFile')` gives it."""
    schema = pa.schema([("source_sha256", pa.string()), ("path", pa.string()), ("part_uri", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("data", pa.map_(pa.string(), pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                raw = content.as_py() or b""
                own = {"source_sha256": hashlib.sha256(raw).hexdigest(), "path": path.as_py()}
                rows = [own | {"part_uri": p, "kind": k, "ord": n, "data": list(d.items())} for p, k, n, d in records(raw, limits)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(read, RECORD)


def read_packages(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """package_records of the .docx files below a folder; lock files are no packages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return package_records(files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")), limits)


#: Columns of each kind that are not strings.
TYPES = {
    "block": {"outline_level": "int", "runs_count": "int", "size_pt": "double", "bold": "boolean", "italic": "boolean"},
    "run": {"span_start": "int", "span_end": "int", "direct_bold": "boolean", "direct_italic": "boolean"},
    "style": {"outline_level": "int", "size_pt": "double", "bold": "boolean", "italic": "boolean"},
    "section": {k: "double" for k in ("width_mm", "height_mm", "margin_top_mm", "margin_bottom_mm", "margin_left_mm", "margin_right_mm", "header_distance_mm", "footer_distance_mm")} | {"page_start": "int", "different_first_page": "boolean"},
    "part": {"size": "long", "compressed": "long"},
    "relationship": {"external": "boolean", "resolves": "boolean"},
    "table": {"row_count": "int", "col_count": "int"},
    "numbering": {"start": "int"},
    "unsupported": {"count": "int"},
    "media": {"local_index": "int"},
}
FIELDS = {
    "block": ("element_path", "structure_type", "story_type", "visible_text", "text_hash", "p_style_id", "p_style_name", "outline_level", "outline_source", "runs_count", "protected_objects", "marks", "alignment", "size_pt", "bold", "italic", "latin", "east_asia"),
    "run": ("element_path", "span_start", "span_end", "direct_bold", "direct_italic", "r_style_id"),
    "style": ("style_id", "style_type", "name", "based_on", "next_style", "outline_level", "size_pt", "bold", "italic", "alignment", "latin"),
    "section": ("section_type", "width_mm", "height_mm", "orientation", "margin_top_mm", "margin_bottom_mm", "margin_left_mm", "margin_right_mm", "header_distance_mm", "footer_distance_mm", "page_start", "page_format", "different_first_page"),
    "section_ref": ("story_type", "variant", "part_uri"),
    "theme_font": ("slot", "script", "font"),
    "field": ("story", "element_path", "instruction", "command", "target", "cached_value"),
    "formula": ("element_path", "fingerprint"),
    "bookmark": ("element_path", "name"),
    "hyperlink": ("element_path", "target"),
    "media": ("element_path", "fingerprint", "local_index", "host_text"),
    "table": ("row_count", "col_count", "grid_widths", "cell_texts"),
    "note": ("note_id", "story_type", "text"),
    "numbering": ("num_id", "format", "level_text", "start"),
    "unsupported": ("feature", "count"),
    "relationship": ("id", "target", "external", "resolves"),
    "part": ("size", "compressed"),
    "fault": ("fault",),
}


def typed(found: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind with typed columns, lists as arrays."""
    def column(name: str) -> F.Column:
        text = F.col("data")[name]
        if name in ("protected_objects", "marks", "grid_widths"):
            items = F.filter(F.split(text, ","), lambda x: x != "")
            return (items.cast("array<int>") if name == "grid_widths" else items).alias(name)
        if name == "cell_texts":
            return F.split(text, "\x1f").alias(name)
        return text.cast(TYPES.get(kind, {}).get(name, "string")).alias(name)

    own = [column(n) for n in FIELDS[kind] if n != "part_uri"]
    part = F.col("data")["part_uri"].alias("part_uri") if kind == "section_ref" else F.col("part_uri")
    return found.where(F.col("kind") == kind).select("source_sha256", part, "ord", *own)


#: Colours that mark a heading, and the rules by which its level and title are told: pattern of two groups, level, what joins the groups.
MARKS = ("yellow", "ffff00", "ff0")
MARK_RULES = ((r"^([一二三四五六七八九十]+)[、.\s\p{Z}]*(.*)", 1, "、"), (r"^(\p{Nd}+)[、.\s\p{Z}]*(.*)", 2, "."))


def marked_headings(found: DataFrame, rules: tuple[tuple[str, int, str], ...] = MARK_RULES, colours: tuple[str, ...] = MARKS, replacements: dict[str, str] | None = None) -> DataFrame:
    """source_sha256, ord, level and title of the paragraphs of a body that are shaded or highlighted in one of the colours.

    The first rule whose pattern a text matches gives the level and joins the two groups to the title; without one a
    heading is of level 1 and keeps its text. Paragraphs in tables, headers and footers, and without text, are none.
    """
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    body = typed(found, "block").where((F.col("story_type") == "body") & F.col("element_path").rlike(r"^/w:document/w:body/w:p\[\d+\]$"))
    rows = body.where(F.arrays_overlap("marks", F.array(*map(F.lit, colours)))).select("source_sha256", "ord", trim("visible_text").alias("text")).where("text <> ''")
    text = F.col("text")
    for old, new in (replacements or {}).items():
        text = F.when(F.col("text") == old, new).otherwise(text)
    made = F.struct(F.lit(1).alias("level"), F.col("text").alias("title"))
    for pattern, level, between in reversed(rules):
        title = F.concat(F.regexp_extract("text", pattern, 1), F.lit(between), trim(F.regexp_extract("text", pattern, 2)))
        made = F.when(F.col("text").rlike(pattern), F.struct(F.lit(level).alias("level"), title.alias("title"))).otherwise(made)
    return rows.withColumn("text", text).select("source_sha256", "ord", made.alias("h")).select("source_sha256", "ord", "h.level", "h.title")


def effective_bindings(found: DataFrame) -> DataFrame:
    """The header and footer part of every section: its own, else that of the section before."""
    from sheaf.operators.windows import running

    sections = typed(found, "section").select("source_sha256", "ord")
    references = typed(found, "section_ref").withColumnRenamed("part_uri", "own")
    slots = references.select("source_sha256", "story_type", "variant").distinct()
    dense = sections.join(slots, "source_sha256").join(references.select("source_sha256", "ord", "story_type", "variant", "own"), ["source_sha256", "ord", "story_type", "variant"], "left")
    carried = running(dense, ["source_sha256", "story_type", "variant"], ["ord"], lasts={"part_uri": F.col("own")}, position="ord")
    return carried.where("part_uri is not null").select("source_sha256", F.col("ord").alias("section_index"), "story_type", "variant", "part_uri", F.col("own").isNull().alias("linked_to_previous"))


def inventory(found: DataFrame) -> DataFrame:
    """Source, kind, content, fingerprint and item_ord of what a document must keep."""
    space = F.lit(r"(?U)\s+")
    paragraphs = typed(found, "block").where("length(visible_text) > 0").select("source_sha256", F.lit("paragraph").alias("kind"), F.regexp_replace("visible_text", space, F.lit("")).alias("content"), F.col("text_hash").alias("fingerprint"), F.col("ord").alias("item_ord"))
    own = lambda kind, content, print_: typed(found, kind).select("source_sha256", F.lit(kind).alias("kind"), content.alias("content"), print_.alias("fingerprint"), F.col("ord").alias("item_ord"))
    rest = [own("formula", F.lit(None).cast("string"), F.col("fingerprint")), own("media", F.col("host_text"), F.col("fingerprint")), own("hyperlink", F.col("target"), F.sha2("target", 256)), own("field", F.col("instruction"), F.sha2("instruction", 256)), own("note", F.col("text"), F.sha2("text", 256))]
    for x in rest:
        paragraphs = paragraphs.unionByName(x)
    return paragraphs
