"""Queries of what packages hold: blocks are written as packages with every kind of part, a bounded slice each, and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from sheaf.functions.jsontree import NotJson, parse
from sheaf.operators.layers import json_leaves
from sheaf.operators.nesting import MANIFEST, flat_objects
from sheaf.operators.windows import latest
from sheaf.plans.carriers import CURRENT, current_blocks
from sheaf.plans.problems import _OBJECTS_SQL
from sheaf.plans.registry import query
from sheaf.plans.scalars import SP
from sheaf.plans.windows import ORDERED, ordered
from sheaf.session import table
from sheaf.sources.files import failure_records, single_documents
from sheaf.sources.packages import MARK_RULES, Limits, inventory, marked_headings, package_records, typed

c = F.col
SLICE = 200
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
MATH = "http://schemas.openxmlformats.org/officeDocument/2006/math"
RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
MARK = '<w:r><w:fldChar w:fldCharType="{}"/></w:r>'
#: By place in its document, every so many blocks: a highlighted run, a page field, a shaded paragraph, a formula, a picture, a note, and the end of a section.
LIT, FIELD, SHADED, FORMULA, PICTURE, NOTE, SECTION = 3, 4, 5, 7, 11, 13, 50
PICTURES = 3
NUMBERINGS = (("decimal", "%1.", 1), ("upperLetter", "%1)", 3), ("chineseCounting", "第%1章", 1))


def _paragraph(n: int, text: str, style: str | None, level: int | None) -> str:
    properties = (f"<w:pStyle w:val={quoteattr(style)}/>" if style else "") + ('<w:shd w:val="clear" w:fill="FFFF00"/>' if n % SHADED == 0 else "") + (f'<w:outlineLvl w:val="{level - 1}"/>' if level else "")
    if n % SECTION == 0:
        wide = n % (2 * SECTION) == 0
        size = '<w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/>' if wide else '<w:pgSz w:w="11906" w:h="16838"/>'
        properties += f'<w:sectPr><w:headerReference w:type="{"first" if wide else "default"}" r:id="rHead"/>{size}<w:pgMar w:top="{n + 1000}" w:left="none"/><w:pgNumType w:start="{n}"/>{"<w:titlePg/>" if wide else ""}</w:sectPr>'
    out = f'<w:p><w:pPr>{properties}</w:pPr><w:r>{"<w:rPr><w:highlight w:val=" + quoteattr("yellow" if n % 2 else "green") + "/></w:rPr>" if n % LIT == 0 else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
    if n % FIELD == 1:
        out += f'{MARK.format("begin")}<w:r><w:instrText>PAGEREF _Toc_{n} \\h</w:instrText></w:r>{MARK.format("separate")}<w:r><w:t>{n}</w:t></w:r>{MARK.format("end")}'
    if n % FORMULA == 0:
        out += f"<m:oMath>\n <m:r  ><m:t>x+{n}</m:t></m:r ></m:oMath>"
    if n % PICTURE == 0:
        out += f'<w:r><w:drawing><a:blip r:embed="rImage{n % PICTURES}"/></w:drawing></w:r>'
    if n % NOTE == 0:
        out += f'<w:r><w:footnoteReference w:id="{n}"/></w:r>'
    return out + "</w:p>"


@F.arrow_udf(BinaryType())
def written_contents(blocks: pa.Array) -> pa.Array:
    """A package of paragraphs with sections, fields, formulas, pictures and notes, and all parts that these refer to."""
    made = []
    for one in blocks.to_pylist():
        body = "".join(_paragraph(b["n"], b["text"] or "", b["style"], b["level"]) for b in one)
        styles = {b["style"]: (b["name"], b["size"]) for b in one if b["style"]}
        notes = "".join(f'<w:footnote w:id="{b["n"]}"><w:p><w:r><w:t>Note {b["n"]} </w:t></w:r><w:r><w:t>end</w:t></w:r></w:p></w:footnote>' for b in one if b["n"] % NOTE == 0)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
            write = lambda name, text, package=package: package.writestr(zipfile.ZipInfo(name), text)
            write("word/document.xml", f"<w:document {NS}><w:body>{body}<w:sectPr/></w:body></w:document>")
            write("word/styles.xml", f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base"/></w:style>' + "".join(f'<w:style w:type="paragraph" w:styleId={quoteattr(k)}><w:name w:val={quoteattr(name or k)}/><w:basedOn w:val="Base"/><w:rPr><w:sz w:val="{round(2 * size)}"/>{"<w:b/>" if size > 13 else ""}</w:rPr></w:style>' for k, (name, size) in sorted(styles.items())) + "</w:styles>")
            write("word/_rels/document.xml.rels", RELATIONS.format('<Relationship Id="rHead" Target="header1.xml"/>' + "".join(f'<Relationship Id="rImage{i}" Target="media/{i}.png"/>' for i in range(PICTURES))))
            write("word/header1.xml", f"<w:hdr {NS}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>")
            for i in range(PICTURES):
                write(f"word/media/{i}.png", f"picture {i}")
            write("word/footnotes.xml", f'<w:footnotes {NS}><w:footnote w:id="-1"/><w:footnote w:id="0"/>{notes}</w:footnotes>')
            write("word/numbering.xml", f"<w:numbering {NS}>" + "".join(f'<w:abstractNum w:abstractNumId="{10 + i}"><w:lvl w:ilvl="0"><w:start w:val="{start}"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text}"/></w:lvl></w:abstractNum>' for i, (kind, text, start) in enumerate(NUMBERINGS)) + "".join(f'<w:num w:numId="{i + 1}"><w:abstractNumId w:val="{10 + i}"/></w:num>' for i in range(len(NUMBERINGS))) + "</w:numbering>")
            write("word/theme/theme1.xml", f'<a:theme {NS}><a:majorFont><a:latin typeface="Serif {one[0]["n"] // SLICE}"/><a:ea typeface=""/></a:majorFont><a:minorFont><a:latin typeface="Grotesk"/></a:minorFont></a:theme>')
        made.append(out.getvalue())
    return pa.array(made, pa.binary())


def content_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of those packages, told apart by path."""
    own = F.struct("n", c("visible_text").alias("text"), c("p_style_id").alias("style"), c("p_style_name").alias("name"), c("outline_level").alias("level"), c("size_pt").alias("size"))
    sliced = ordered(spark, sf_dir).select(F.concat("source_sha256", F.lit("/"), F.floor(c("n") / SLICE).cast("string")).alias("path"), own.alias("b"))
    files = sliced.groupBy("path").agg(F.array_sort(F.collect_list("b")).alias("b")).select("path", written_contents("b").alias("content"))
    return package_records(files).withColumn("source_sha256", c("path"))


_S = f"""{ORDERED}, s as (select source_sha256 || '/' || (n // {SLICE}) package, (row_number() over (partition by source_sha256, n // {SLICE} order by n) - 1)::int ord, n, coalesce(visible_text, '') visible_text, p_style_id, p_style_name, outline_level, size_pt from ordered),
  t as (select *, visible_text || case when n % {FIELD} = 1 then n::varchar else '' end shown from s)"""
_TRIMMED = f"regexp_replace(shown, '^{SP}+|{SP}+$', '', 'g')"


def contents_query(name: str, sql: str) -> Callable:
    return query(name, f"with {_S} {sql}")


def _placed(of: str) -> str:
    """The place of a block among those of its package that have something of their own."""
    return f"(row_number() over (partition by package order by n) - 1)::int ord from t where {of}"


@contents_query("s10_package_styles", "select distinct package, p_style_id style_id, coalesce(p_style_name, p_style_id) as name, 'Base' based_on, size_pt, size_pt > 13 or null bold from (select package, p_style_id, arg_max({'a': p_style_name}, n).a p_style_name, arg_max({'a': size_pt}, n).a size_pt from t where p_style_id <> '' group by 1, 2) union all select distinct package, 'Base', 'Base', null, null, null from t")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of packages with what they are based on."""
    return typed(content_packages(spark, sf_dir), "style").select(c("source_sha256").alias("package"), "style_id", "name", "based_on", "size_pt", "bold")


@contents_query("s11_theme_fonts", f"select package, unnest(['majorFont', 'majorFont', 'minorFont', 'minorFont']) slot, unnest(['latin', 'ea', 'latin', 'ea']) script, unnest(['Serif ' || (min(n) // {SLICE}), '', 'Grotesk', null]) font from t group by package")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme fonts of packages by slot and script."""
    return typed(content_packages(spark, sf_dir), "theme_font").select(c("source_sha256").alias("package"), "slot", "script", "font")


_SECTIONS = f"""select package, ord, case when wide then 297e0 else 210e0 end width_mm, case when wide then 210e0 else 297e0 end height_mm, case when wide then 'landscape' else 'portrait' end orientation, coalesce(round((n + 1000) / 20 * 25.4 / 72, 1), 25.4)::double margin_top_mm, 31.8::double margin_left_mm, n::int page_start, wide different_first_page
  from (select package, n, n % {2 * SECTION} = 0 wide, {_placed(f"n % {SECTION} = 0")} union all select package, null, false, count(*) filter (n % {SECTION} = 0)::int from t group by package)"""


@contents_query("s12_sections", _SECTIONS.replace("::int from t", "::int ord from t"))
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their page in millimetres; what is not set, or no number, has the default."""
    return typed(content_packages(spark, sf_dir), "section").select(c("source_sha256").alias("package"), "ord", "width_mm", "height_mm", "orientation", "margin_top_mm", "margin_left_mm", "page_start", "different_first_page")


@contents_query("s15_media", f"select package, n % {PICTURES} picture, sha256('picture ' || (n % {PICTURES})) fingerprint, 0 local_index, shown host_text, {_placed(f'n % {PICTURE} = 0')}".replace(f"n % {PICTURES} picture, ", "", 1))
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence of a picture: the hash of its part and the text around it."""
    return typed(content_packages(spark, sf_dir), "media").select(c("source_sha256").alias("package"), "fingerprint", "local_index", "host_text", "ord")


@contents_query("s16_notes", f"select package, n::varchar note_id, 'footnote' story_type, 'Note' || n || 'end' as text from t where n % {NOTE} = 0")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes without gaps; separators are none."""
    return typed(content_packages(spark, sf_dir), "note").select(c("source_sha256").alias("package"), "note_id", "story_type", "text")


@contents_query("s18_numberings", "select package, " + ", ".join(f"unnest([{', '.join(repr(str(x)) for x in column)}]) {name}" for name, column in zip(("num_id", "format", "level_text", "start_"), (range(1, 1 + len(NUMBERINGS)), *zip(*NUMBERINGS)))) + " from (select distinct package from t)")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level of each numbering."""
    return typed(content_packages(spark, sf_dir), "numbering").select(c("source_sha256").alias("package"), "num_id", "format", "level_text", c("start").cast("string").alias("start_"))


_OBJECTS = f"list_filter([case when n % {PICTURE} = 0 then 'drawing' end, case when n % {FIELD} = 1 then 'field' end, case when n % {NOTE} = 0 then 'footnote_ref' end, case when n % {FORMULA} = 0 then 'formula' end], lambda x: x is not null)"
_MARKS = f"list_filter([case when n % {SHADED} = 0 then 'ffff00' end, case when n % {LIT} = 0 and n % 2 = 0 then 'green' end, case when n % {LIT} = 0 and n % 2 = 1 then 'yellow' end], lambda x: x is not null)"


@contents_query(
    "s27_paragraphs",
    f"select package, 'word/document.xml' part_uri, ord, '/w:document/w:body/w:p[' || (ord + 1) || ']' element_path, case when n % {SECTION} = 0 and shown = '' then 'section_break' else 'paragraph' end structure_type, 'body' story_type, shown visible_text, nullif(p_style_id, '') p_style_id, (1 + case when n % {FIELD} = 1 then 5 else 0 end + (n % {PICTURE} = 0)::int + (n % {NOTE} = 0)::int)::int runs_count, {_OBJECTS} protected_objects, {_MARKS} marks from t union all select distinct package, 'word/header1.xml', 0, '/w:hdr/w:p[1]', 'paragraph', 'header', 'Top', null, 1, [], [] from t",
)
def s27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all stories with their place, runs, protected objects and marks."""
    return typed(content_packages(spark, sf_dir), "block").select(c("source_sha256").alias("package"), "part_uri", "ord", "element_path", "structure_type", "story_type", "visible_text", "p_style_id", "runs_count", "protected_objects", "marks")


def _heading_sql() -> str:
    level, title = "1", _TRIMMED
    for pattern, number, between in reversed(MARK_RULES):
        level = f"case when regexp_matches({_TRIMMED}, '{pattern}') then {number} else {level} end"
        title = f"case when regexp_matches({_TRIMMED}, '{pattern}') then regexp_extract({_TRIMMED}, '{pattern}', 1) || '{between}' || regexp_replace(regexp_extract({_TRIMMED}, '{pattern}', 2), '^{SP}+|{SP}+$', '', 'g') else {title} end"
    return f"select package, ord, {level} as level, {title} title from t where (n % {SHADED} = 0 or n % {LIT} = 0 and n % 2 = 1) and {_TRIMMED} <> ''"


@contents_query("s07_marked_headings", _heading_sql())
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by their highlight or shading, level and title by rules; green is no mark."""
    return marked_headings(content_packages(spark, sf_dir)).withColumnRenamed("source_sha256", "package")


_UNCACHED = f"sha256(trim(regexp_replace(visible_text, '{SP}+', ' ', 'g')))"


@contents_query("f25_uncached_texts", f"select package, ord, {_UNCACHED} text_hash from t")
def f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each paragraph's text without what its fields show."""
    return typed(content_packages(spark, sf_dir), "block").where("story_type = 'body'").select(c("source_sha256").alias("package"), "ord", "text_hash")


_FORMULA = f"sha256('<ns0:oMath xmlns:ns0=\"{MATH}\"><ns0:r><ns0:t>x+' || n || '</ns0:t></ns0:r></ns0:oMath>')"


@contents_query("f26_formula_prints", f"select package, {_FORMULA} fingerprint, {_placed(f'n % {FORMULA} = 0')}")
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each formula's canonical form, whatever its gaps."""
    return typed(content_packages(spark, sf_dir), "formula").select(c("source_sha256").alias("package"), "fingerprint", "ord")


@contents_query(
    "s14_package_inventory",
    f"""select package, 'paragraph' kind, regexp_replace(shown, '{SP}+', '', 'g') content, {_UNCACHED} fingerprint from t where shown <> '' union all select distinct package, 'paragraph', 'Top', sha256('Top') from t
    union all select package, 'formula', null, {_FORMULA} from t where n % {FORMULA} = 0 union all select package, 'media', shown, sha256('picture ' || (n % {PICTURES})) from t where n % {PICTURE} = 0
    union all select package, 'field', 'PAGEREF _Toc_' || n || ' \\h', sha256('PAGEREF _Toc_' || n || ' \\h') from t where n % {FIELD} = 1 union all select package, 'note', 'Note' || n || 'end', sha256('Note' || n || 'end') from t where n % {NOTE} = 0""",
)
def s14_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a package must keep, with content and fingerprint."""
    return inventory(content_packages(spark, sf_dir)).select(c("source_sha256").alias("package"), "kind", "content", "fingerprint")


#: What is wrong with the packages of `s09_package_faults`, by the manifest's number.
FAULTS = ("ok", "path_escape", "part_too_large", "compression_ratio", "missing word/styles.xml", "no_package", "unreadable part", "unreadable xml", "too_many_parts")
TIGHT = Limits(part=200_000, parts=20)


@F.arrow_udf(BinaryType())
def written_faults(numbers: pa.Array, texts: pa.Array) -> pa.Array:
    """A package with a file's text in a part, and one fault or none."""
    made = []
    for number, text in zip(numbers.to_pylist(), texts.to_pylist()):
        fault, out = FAULTS[number % len(FAULTS)], io.BytesIO()
        if fault == "no_package":
            made.append((text or "")[:100].encode())
            continue
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
            package.writestr("word/document.xml", f"<w:document {NS}><w:body/></w:document>" if fault != "unreadable xml" else "<w:document>")
            if not fault.startswith("missing"):
                package.writestr("word/styles.xml", f"<w:styles {NS}/>")
            package.writestr("customXml/a..b.json", text or "")
            if fault == "path_escape":
                package.writestr("word/../../x", "x")
            elif fault == "part_too_large":
                package.writestr(zipfile.ZipInfo("word/big.bin"), b"x" * 200_001)
            elif fault == "compression_ratio":
                package.writestr("word/zeros.bin", b"\0" * 200_000)
            elif fault == "too_many_parts":
                for i in range(20):
                    package.writestr(f"word/{i}.bin", "x")
        raw = bytearray(out.getvalue())
        if fault == "unreadable part":
            raw[raw.index(b"word/styles.xml") + 20] ^= 255  # the content no longer fits its checksum
        made.append(bytes(raw))
    return pa.array(made, pa.binary())


@query("s09_package_faults", f"select distinct manifest_id::varchar package, [{', '.join(map(repr, FAULTS))}][manifest_id % {len(FAULTS)} + 1] fault from manifest_files where manifest_id % {len(FAULTS)} > 0")
def s09_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that break a limit or cannot be read: one fault each and nothing else."""
    files = table(spark, sf_dir, "manifest_files").groupBy("manifest_id").agg(F.max("raw_json").alias("raw_json")).select(c("manifest_id").cast("string").alias("path"), written_faults("manifest_id", "raw_json").alias("content"))
    found = package_records(files, TIGHT)
    return found.groupBy("path").agg(F.max(F.when(c("kind") == "fault", c("data")["fault"])).alias("fault"), F.count(F.lit(1)).alias("n")).where("fault is not null and n = 1").select(c("path").alias("package"), "fault")


def _folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of projects by number: documents, lock files and others."""
    rows = table(spark, sf_dir, "manifest_files").where("project_key is not null").select("project_key", "manifest_id").distinct()
    suffix = F.element_at(F.array(*map(F.lit, (".docx", ".pdf", ".DOCX"))), (c("manifest_id") % 3 + 1).cast("int"))
    lock = F.when(c("manifest_id") % 5 == 0, "~$").otherwise("")
    return rows.select(c("project_key").alias("folder"), F.concat(lock, c("manifest_id").cast("string"), suffix).alias("name"))


_FILES = "f as (select distinct project_key folder, case when manifest_id % 5 = 0 then '~$' else '' end || manifest_id || ['.docx', '.pdf', '.DOCX'][manifest_id % 3 + 1] as name from manifest_files where project_key is not null)"


@query("s03_single_documents", f"with {_FILES}, d as (select folder, count(*) filter (lower(name) like '%.docx' and name not like '~$%') n, min(name) filter (lower(name) like '%.docx' and name not like '~$%') m from f group by 1) select folder, case when n = 1 then m end as name, case when n = 0 then 'none' when n > 1 then 'several' end fault from d")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only document of each folder, or why there is none."""
    return single_documents(_folder_files(spark, sf_dir))


@query("s13_source_files", f"with {_FILES} select folder, name, row_number() over (partition by folder order by name) place from f where name not like '~$%'")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each folder, each once and in order, without lock files."""
    from sheaf.operators.windows import numbered

    return numbered(_folder_files(spark, sf_dir).where(~c("name").startswith("~$")).distinct(), ["folder"], ["name"], "place")


#: The strategies of sources that read a manifest's own tree, or files beside it.
STRATEGIES = ("explicit_tree", "directory_tree", "docx_document", "highlighted_docx")


@query(
    "s04_source_strategies",
    _OBJECTS_SQL.split("--")[0].rstrip() + f", k as (select manifest_id, count(*) n from nodes group by 1) select distinct manifest_id, s strategy, coalesce(n, 0) n_nodes, case when s is null or s not in {STRATEGIES} then 'unknown_strategy' when s = 'explicit_tree' and n is null then 'empty_outline' end fault from (select distinct manifest_id, json_extract_string(raw_json, '$.source.strategy') s from manifest_files where json_valid(raw_json)) left join k using (manifest_id)",
)
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy by which each manifest's outline is built; an unknown one, or a tree without nodes, is a fault."""
    files = table(spark, sf_dir, "manifest_files").select("manifest_id", "raw_json").distinct()
    nodes = flat_objects(files, "manifest_id", "raw_json", MANIFEST, members=False).groupBy(c("file_id").alias("manifest_id")).agg(F.count(F.lit(1)).alias("n"))
    valid = F.try_parse_json("raw_json").cast("string")
    rows = files.select("manifest_id", valid.alias("j")).where("j is not null").select("manifest_id", F.get_json_object("j", "$.source.strategy").alias("strategy")).distinct().join(nodes, "manifest_id", "left")
    fault = F.when(~F.coalesce(c("strategy").isin(*STRATEGIES), F.lit(False)), "unknown_strategy").when((c("strategy") == "explicit_tree") & c("n").isNull(), "empty_outline")
    return rows.select("manifest_id", "strategy", F.coalesce("n", F.lit(0)).alias("n_nodes"), fault.alias("fault"))


@query("s21_chosen_configurations", "select project_key, manifest_id, batch_no from (select distinct project_key, manifest_id, batch_no, raw_json from manifest_files where project_key is not null and json_valid(raw_json)) qualify row_number() over (partition by project_key order by json_type(raw_json, '$.format') is null, batch_no desc nulls last, manifest_id desc) = 1")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration that holds for each project: one that names its format before others, then the last batch's; broken ones never."""
    rows = table(spark, sf_dir, "manifest_files").where("project_key is not null").select("project_key", "manifest_id", "batch_no", F.try_parse_json("raw_json").cast("string").alias("j")).where("j is not null")
    named = F.get_json_object("j", "$.format").isNotNull()
    return latest(rows.select("project_key", "manifest_id", "batch_no", named.alias("named")), ["project_key"], [c("named"), c("batch_no"), c("manifest_id")]).select("project_key", "manifest_id", "batch_no")


@query(
    "s22_package_references",
    """with r as (select distinct manifest_id, case when manifest_id % 4 = 1 then 'https://x/' || coalesce(json_extract_string(raw_json, '$.project_name'), '') else coalesce(json_extract_string(raw_json, '$.format.ref'), 'preset:' || (select min(format_id || '@' || format_version) from format_files) || case when manifest_id % 2 = 0 then '' else 'x' end) end ref from manifest_files where json_valid(raw_json) and json_type(raw_json) = 'OBJECT'),
    p as (select distinct format_id || '@' || format_version k from format_files where json_valid(raw_json))
    select manifest_id, ref, case when ref like 'https://%' then 'url' when not starts_with(ref, 'preset:') then 'file' else 'preset' end kind, case when ref like 'https://%' then 'refused' when not starts_with(ref, 'preset:') then 'local' when p.k is null then 'missing' else 'found' end status from r left join p on ref = 'preset:' || p.k""",
)
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to format packages: presets found or missing by name and version, files left to their folder, addresses refused."""
    formats, manifests = table(spark, sf_dir, "format_files"), table(spark, sf_dir, "manifest_files")
    packages = formats.where(F.try_parse_json("raw_json").isNotNull()).select(F.concat_ws("@", "format_id", "format_version").alias("k")).where("k like '%@%'").distinct()
    first = formats.agg(F.min(F.concat("format_id", F.lit("@"), "format_version")).alias("first"))
    rows = manifests.select("manifest_id", F.try_parse_json("raw_json").cast("string").alias("j")).where("j like '{%'").withColumn("_j", F.lit(1))
    rows = rows.join(F.broadcast(first.withColumn("_j", F.lit(1))), "_j")  # one row
    other = F.concat(F.lit("preset:"), "first", F.when(c("manifest_id") % 2 == 0, "").otherwise("x"))
    ref = F.when(c("manifest_id") % 4 == 1, F.concat(F.lit("https://x/"), F.coalesce(F.get_json_object("j", "$.project_name"), F.lit("")))).otherwise(F.coalesce(F.get_json_object("j", "$.format.ref"), other))
    rows = rows.select("manifest_id", ref.alias("ref")).distinct().withColumn("k", F.regexp_extract("ref", "(?s)^preset:(.*)$", 1))
    met = rows.join(packages.withColumn("known", F.lit(True)), "k", "left")
    kind = F.when(c("ref").rlike("^https?://"), "url").when(c("ref").startswith("preset:"), "preset").otherwise("file")
    return met.select("manifest_id", "ref", kind.alias("kind"), F.when(kind == "url", "refused").when(kind == "file", "local").when(c("known").isNull(), "missing").otherwise("found").alias("status"))


@query("k01_decision_rows", f"with {CURRENT}, d as (select source_sha256, coalesce(p_style_id, '') as style, count(*) n from current_blocks where source_sha256 is not null group by all) select source_sha256, '{{\"decisions\":[' || string_agg('{{\"style\":' || to_json(style)::varchar || ',\"decision\":\"' || case when n > 1 then 'pending' else 'skip' end || '\"}}', ',' order by style) || ']}}' record from d group by 1")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starting decisions of each document as the JSON that is written for it."""
    rows = current_blocks(spark, sf_dir).where("source_sha256 is not null").groupBy("source_sha256", F.coalesce("p_style_id", F.lit("")).alias("style")).agg(F.when(F.count(F.lit(1)) > 1, "pending").otherwise("skip").alias("decision"))
    return rows.groupBy("source_sha256").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("style", "decision"))).alias("decisions"))).alias("record"))


@F.arrow_udf(StringType())
def _error_of(texts: pa.Array) -> pa.Array:
    made = []
    for text in texts:
        try:
            parse(text.as_py())
            made.append(None)
        except NotJson:
            made.append("NotJson")
    return pa.array(made, pa.string())


@query("k06_failure_records", "select distinct manifest_id, '{\"error\":\"NotJson\",\"message\":' || to_json(file_name)::varchar || '}' record from manifest_files where raw_json is not null and not json_valid(raw_json)")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went wrong with each file that could not be read, as the JSON that is written for it."""
    rows = table(spark, sf_dir, "manifest_files").where("raw_json is not null").select("manifest_id", "file_name", _error_of("raw_json").alias("error")).distinct()
    return failure_records(rows, "manifest_id", "error", "file_name")


LEAVES_SQL = """walk(id, pointer, value) as (
  select {0}, '', raw_json::json from (select distinct {0}, raw_json from {1} where json_valid(raw_json))
  union all select id, pointer || '/' || replace(replace(k, '~', '~0'), '/', '~1'), json_extract(value, '$."' || k || '"') from (select id, pointer, value, unnest(json_keys(value)) k from walk where json_type(value) = 'OBJECT')),
  leaf as (select id, pointer, value, json_type(value) t from walk where json_type(value) <> 'OBJECT' or len(json_keys(value)) = 0)"""


@query("f19_leaf_pointers", f"with recursive {LEAVES_SQL.format('manifest_id', 'manifest_files')} select distinct id manifest_id, pointer, case t when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end kind from leaf")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON pointer of every leaf of each manifest, slashes and tildes in keys escaped."""
    return json_leaves(table(spark, sf_dir, "manifest_files"), ["manifest_id"], "raw_json").select("manifest_id", "pointer", "kind").distinct()


@query(
    "m02_refused_nulls",
    f"with recursive {LEAVES_SQL.format('file_id', 'format_files')}, f as (select distinct file_id, split_part(format_id, '-', 2) family from format_files where format_id is not null), l as (select family, pointer, id file_id from leaf join f on f.file_id = leaf.id where t = 'NULL'), first as (select family, min(file_id) a from f where file_id in (select id from leaf) group by 1) select distinct family, pointer, file_id from l join first using (family) where file_id > a",
)
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of one family laid over each other: the nulls of later ones, each of which is refused."""
    from sheaf.operators.layers import later_nulls

    rows = table(spark, sf_dir, "format_files").where("format_id is not null").select(F.split_part(c("format_id"), F.lit("-"), F.lit(2)).alias("family"), "file_id", "raw_json")
    leaves = later_nulls(json_leaves(rows, ["family", "file_id"], "raw_json"), ["family"], "file_id")
    return leaves.where("refused").select("family", "pointer", "file_id").distinct()
