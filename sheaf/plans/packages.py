"""Queries of the package, field and font readers: tables are written as files, a bounded slice each, and read back."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sheaf.operators.pages import heading_pages
from sheaf.functions import scalars as S
from sheaf.plans.carriers import CURRENT
from sheaf.plans.aggregates import FONTS, style_fonts
from sheaf.plans.registry import query
from sheaf.plans.scalars import SP
from sheaf.plans.windows import ORDERED, ordered
from sheaf.sources.files import font_index, outline_of_files
from sheaf.sources.packages import package_records, typed
from sheaf.session import table

c = F.col
SLICE = 200
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _package(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        package.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="Normal"><w:name w:val="Normal"/></w:style></w:styles>')
    return out.getvalue()


@F.arrow_udf(BinaryType())
def written_blocks(blocks: pa.Array) -> pa.Array:
    """A package of paragraphs."""
    made = []
    for one in blocks.to_pylist():
        body = []
        for b in one:
            style = f"<w:pStyle w:val={quoteattr(b['style'])}/>" if b["style"] else ""
            level = f'<w:outlineLvl w:val="{b["level"] - 1}"/>' if b["level"] else ""
            body.append(f'<w:p><w:pPr>{style}{level}</w:pPr><w:r><w:t xml:space="preserve">{escape(b["text"] or "")}</w:t></w:r></w:p>')
        made.append(_package("".join(body)))
    return pa.array(made, pa.binary())


@F.arrow_udf(BinaryType())
def written_fields(fields: pa.Array) -> pa.Array:
    """A package of one complex field a paragraph."""
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    made = []
    for one in fields.to_pylist():
        made.append(_package("".join(f"<w:p>{mark('begin')}<w:r><w:instrText>{escape(f['instruction'] or '')}</w:instrText></w:r>{mark('separate')}<w:r><w:t>{escape(f['shown'] or '')}</w:t></w:r>{mark('end')}</w:p>" for f in one)))
    return pa.array(made, pa.binary())


#: How the font files of `s20` are made, by the first digit of their path's hash.
FONT_FILES = ("plain", "open", "collection", "roman", "broken", "nameless", "executable", "foreign")


def _face(names: list[tuple[int, int, bytes]], at: int, version: bytes) -> bytes:
    """One face that begins at a place of its file: records of platform, kind and name."""
    offsets, place = [], 0
    for *_, raw in names:
        offsets.append(place)
        place += len(raw)
    records = b"".join(struct.pack(">HHHHHH", platform, 0, 0x409 if platform == 3 else 0, kind, len(raw), where) for (platform, kind, raw), where in zip(names, offsets))
    body = struct.pack(">HHH", 0, len(names), 6 + len(records)) + records + b"".join(raw for *_, raw in names)
    return struct.pack(">4sHHHH", version, 1, 0, 0, 0) + struct.pack(">4sIII", b"name" if names else b"post", 0, at + 28, len(body)) + body


@F.arrow_udf(BinaryType())
def written_font(kinds: pa.Array, names: pa.Array) -> pa.Array:
    """A font file of one of FONT_FILES with a family and a full name."""
    made = []
    for kind, name in zip(kinds.to_pylist(), names.to_pylist()):
        own = [(3, 1, name.encode("utf-16-be")), (3, 4, f"{name} Bold".encode("utf-16-be")), (3, 1, name.encode("utf-16-be")), (3, 9, b"\0x")]
        if kind == "collection":
            first = _face(own, 20, b"\0\1\0\0")
            made.append(b"ttcf" + struct.pack(">III", 1 << 16, 2, 20) + struct.pack(">I", 20 + len(first)) + first + _face([(3, 16, "Second".encode("utf-16-be"))], 20 + len(first), b"OTTO"))
        elif kind == "broken":
            made.append(_face(own, 0, b"\0\1\0\0")[:30])
        elif kind == "executable":
            made.append(b"MZ" + name.encode())
        else:
            parts = [(1, 1, name.encode("mac_roman", "replace"))] if kind == "roman" else [] if kind == "nameless" else own
            made.append(_face(parts, 0, {"open": b"OTTO", "foreign": b"wOFF"}.get(kind, b"\0\1\0\0")))
    return pa.array(made, pa.binary())


_SLICED = f"{ORDERED}, s as (select source_sha256 || '/' || (n // {SLICE}) package, row_number() over (partition by source_sha256, n // {SLICE} order by n) - 1 ord, visible_text, p_style_id, outline_level from ordered)"


def block_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = ordered(spark, sf_dir).select(F.concat("source_sha256", F.lit("/"), F.floor(c("n") / SLICE).cast("string")).alias("path"), F.struct("n", c("visible_text").alias("text"), c("p_style_id").alias("style"), c("outline_level").alias("level")).alias("b"))
    return sliced.groupBy("path").agg(F.array_sort(F.collect_list("b")).alias("b")).select("path", written_blocks("b").alias("content"))


@query("s08_package_blocks", f"with {_SLICED} select package, ord::int ord, coalesce(visible_text, '') visible_text, nullif(p_style_id, '') p_style_id, outline_level from s")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as packages of 200 and read back: text, style, outline level and place."""
    found = package_records(block_packages(spark, sf_dir)).where("kind = 'block'")
    get = lambda k: c("data")[k]
    return found.select(c("path").alias("package"), "ord", get("visible_text").alias("visible_text"), get("p_style_id").alias("p_style_id"), get("outline_level").cast("int").alias("outline_level"))


@query("s09_package_parts", f"with {_SLICED} select package, unnest(['word/document.xml', 'word/styles.xml']) part_uri from (select distinct package from s)")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of those packages; one that broke a limit would have none."""
    return package_records(block_packages(spark, sf_dir)).where("kind = 'part'").select(c("path").alias("package"), "part_uri")


@query(
    "w18_package_fields",
    f"with f as (select distinct obs_id, source_sha256, instruction, cached_value, command, target from field_observations where instruction is not null and source_sha256 is not null) select source_sha256 || '/' || (obs_id // {SLICE}) package, (row_number() over (partition by source_sha256, obs_id // {SLICE} order by obs_id) - 1)::int ord, trim(instruction) instruction, upper(string_split(trim(instruction), ' ')[1]) command, case when upper(string_split(trim(instruction), ' ')[1]) in ('REF', 'PAGEREF') then nullif(regexp_extract(trim(instruction), '^\\S+\\s+(\\S+)', 1), '') end target, coalesce(cached_value, '') cached_value from f",
)
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields written as begin, instruction, separator, result and end, and read back by the state machine."""
    fields = table(spark, sf_dir, "field_observations").where("instruction is not null and source_sha256 is not null").select("obs_id", "source_sha256", "instruction", c("cached_value").alias("shown")).distinct()
    sliced = fields.select(F.concat("source_sha256", F.lit("/"), F.floor(c("obs_id") / SLICE).cast("string")).alias("path"), F.struct("obs_id", "instruction", "shown").alias("f"))
    files = sliced.groupBy("path").agg(F.array_sort(F.collect_list("f")).alias("f")).select("path", written_fields("f").alias("content"))
    found = package_records(files).where("kind = 'field'")
    return found.select(c("path").alias("package"), "ord", *[c("data")[k].alias(k) for k in ("instruction", "command", "target", "cached_value")])


@query(
    "s20_font_names",
    f"""with {FONTS}, p as (select distinct file_id || '/' || font path, font from fonts), k as (select *, {list(FONT_FILES)}[('0x' || md5(path)[1:2])::int % {len(FONT_FILES)} + 1] kind from p),
    x as (select path, unnest(case when kind in ('plain', 'open') then [{{'f': 0, 'k': 'family', 'n': font, 's': 'ok'}}, {{'f': 0, 'k': 'full', 'n': font || ' Bold', 's': 'ok'}}]
      when kind = 'collection' then [{{'f': 0, 'k': 'family', 'n': font, 's': 'ok'}}, {{'f': 0, 'k': 'full', 'n': font || ' Bold', 's': 'ok'}}, {{'f': 1, 'k': 'typographic_family', 'n': 'Second', 's': 'ok'}}]
      when kind = 'roman' then [{{'f': 0, 'k': 'family', 'n': font, 's': 'ok'}}] when kind = 'executable' then [{{'f': 0, 'k': null, 'n': null, 's': 'unsupported'}}] else [{{'f': 0, 'k': null, 'n': null, 's': 'error'}}] end) r from k)
    select path, r.f face, r.k name_kind, r.n as name, r.s status from x""",
)
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts written as font files of several formats, collections and broken ones among them, and read back by face."""
    names = style_fonts(spark, sf_dir).select(F.concat(c("file_id").cast("string"), F.lit("/"), "font").alias("path"), "font").distinct()
    kind = F.array(*map(F.lit, FONT_FILES))[(F.conv(F.substring(F.md5("path"), 1, 2), 16, 10).cast("int") % len(FONT_FILES))]
    return font_index(names.select("path", written_font(kind, "font").alias("content")))


@query(
    "s01_file_outlines",
    "with f as (select distinct project_key folder, batch_no b, manifest_id m, batch_no || '.' || manifest_id || ' part.docx' as name from manifest_files where project_key is not null and batch_no is not null) select folder, name, 'docx' as type, k seq, k || '. part' title from (select *, row_number() over (partition by folder order by b, m) k from f)",
)
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a project's folder in natural order, numbered; older formats hidden by newer ones of their name."""
    rows = table(spark, sf_dir, "manifest_files").where("project_key is not null and batch_no is not null").select(c("project_key").alias("folder"), "batch_no", "manifest_id").distinct()
    stem = F.concat(c("batch_no").cast("string"), F.lit("."), c("manifest_id").cast("string"), F.lit(" part"))
    files = rows.select("folder", F.explode(F.array(*[F.concat(stem, F.lit(x)) for x in (".docx", ".doc", ".bak")])).alias("name"))
    return outline_of_files(files.withColumn("path", F.concat("folder", F.lit("/"), "name")))


@query("k02_role_map_rows", "select distinct assignment_id, to_json({'part_uri': part_uri, 'element_path': element_path, 'role': role, 'level': level, 'confirmed': confirmed})::varchar as row_json from role_assignments")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments as the rows of a role map file."""
    row = F.to_json(F.struct("part_uri", "element_path", "role", "level", "confirmed"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "role_assignments").select("assignment_id", row.alias("row_json")).distinct()


@query("f05_content_hashes", "select distinct manifest_id, sha256(raw_json) as hash, length(raw_json)::int n from manifest_files")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each file's bytes."""
    return table(spark, sf_dir, "manifest_files").select("manifest_id", F.sha2("raw_json", 256).alias("hash"), F.length("raw_json").alias("n")).distinct()


@query(
    "f27_page_faults",
    "with p as (select distinct file_id, try_cast(json_extract_string(raw_json, '$.page.height_mm') as double) h, try_cast(json_extract_string(raw_json, '$.page.margin_top_mm') as double) t from format_files where json_valid(raw_json)) select file_id, case when h is null then 'no_height' when t is null then 'no_margin' when h - t <= 10 then 'no_room' when t > 25 then 'wide_margin' else 'ok' end fault from p",
)
def f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without height or margin, without room to print on, or with a wide margin."""
    rows = table(spark, sf_dir, "format_files").select("file_id", F.try_parse_json("raw_json").cast("string").alias("j")).where("j is not null")
    height, top = (F.get_json_object("j", p).try_cast("double") for p in ("$.page.height_mm", "$.page.margin_top_mm"))
    fault = F.when(height.isNull(), "no_height").when(top.isNull(), "no_margin").when(height - top <= 10, "no_room").when(top > 25, "wide_margin").otherwise("ok")
    return rows.select("file_id", fault.alias("fault")).distinct()


@query("f28_soft_breaks", f"select doc_id, ord::int ord, line from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 ord from documents) where regexp_replace(line, '{SP}+', '', 'g') <> ''")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at their line breaks, empty lines left out."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).where(S.delete_space(c("line")) != "")


@query(
    "f29_heading_pages",
    f"""with recursive {ORDERED.removeprefix('with ')}, b as (select source_sha256, n, outline_level, regexp_replace(visible_text, '{S.MATCH_NOISE}', '', 'g')[1:12] prefix, ((n - 1) // 10 + 1)::int page from ordered),
    h as (select source_sha256, n, prefix, row_number() over (partition by source_sha256 order by n) i from b where outline_level is not null and length(prefix) > 0), p as (select distinct source_sha256, prefix, page from b),
    walk(source_sha256, i, n, page) as (select distinct source_sha256, 0::bigint, null::bigint, 1 from h
      union all select w.source_sha256, h.i, h.n, coalesce(min(p.page), w.page) from walk w join h on h.source_sha256 = w.source_sha256 and h.i = w.i + 1 left join p on p.source_sha256 = h.source_sha256 and p.prefix = h.prefix and p.page >= w.page group by w.source_sha256, h.i, h.n, w.page)
    select source_sha256, n, page from walk where i > 0""",
)
def f29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten blocks on which headings are found again, in order, by their first twelve characters."""
    prefix = F.substring(S.clean_match_key(c("visible_text")), 1, 12)
    blocks = ordered(spark, sf_dir).select("source_sha256", "n", "outline_level", prefix.alias("prefix"), (F.floor((c("n") - 1) / 10) + 1).cast("int").alias("page")).where("length(prefix) > 0")
    return heading_pages(blocks.where("outline_level is not null"), blocks, "source_sha256", "n", "prefix", "page")


@query("f32_font_entries", "with j as (select distinct manifest_id, raw_json from manifest_files where json_valid(raw_json) and json_type(raw_json, '$.fonts') = 'OBJECT') select manifest_id, k slot, trim(json_extract_string(raw_json, '$.fonts.\"' || k || '\"')) font from (select *, unnest(json_keys(raw_json, '$.fonts')) k from j) where not starts_with(k, '_comment')")
def f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of font maps, comments left out, trimmed."""
    rows = table(spark, sf_dir, "manifest_files").select("manifest_id", "raw_json").distinct()
    entries = rows.select("manifest_id", F.explode(F.from_json(F.get_json_object(F.try_parse_json("raw_json").cast("string"), "$.fonts"), "map<string, string>")).alias("slot", "font"))
    return entries.where(~c("slot").startswith("_comment")).select("manifest_id", "slot", F.trim("font").alias("font"))


def _page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "field_observations").where("command = 'PAGEREF'").withColumn("p", c("cached_value").try_cast("int"))


def _labelled(rows: DataFrame) -> DataFrame:
    """obs_id, expected, status of page references with page p."""
    style = F.when(c("story") == "body", "decimal").otherwise("lowerRoman")
    expected = F.when(c("p") >= 1, S.page_number(c("p"), style))
    return rows.select("obs_id", expected.alias("expected"), S.record_status(F.lit(None).cast("string"), c("cached_value"), expected).alias("status")).distinct()


_ROMAN = "repeat('m', (p // 1000)::int) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][(p % 1000 // 100)::int + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][(p % 100 // 10)::int + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(p % 10)::int + 1]"


@query(
    "w12_page_labels",
    f"select distinct obs_id, expected, case when cached_value is null or expected is null then 'unverified' when cached_value = expected then 'verified' else 'mismatch' end status from (select *, case when p >= 1 then case when story = 'body' then p::varchar else {_ROMAN} end end expected from (select *, try_cast(cached_value as int) p from field_observations where command = 'PAGEREF'))",
)
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page reference labelled in the style of its part - decimal in bodies, small Roman elsewhere - against what is shown; without a page of 1 or more nothing is verified."""
    return _labelled(_page_references(spark, sf_dir))


@query("w21_draft_fields", "select source_sha256, count(*) n_references, count_if(coalesce(cached_value, '') <> '?')::bigint n_not_draft from (select distinct * from field_observations) where command = 'PAGEREF' group by all")
def w21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page references of each document, and those that a draft must not show."""
    rows = table(spark, sf_dir, "field_observations").where("command = 'PAGEREF'").distinct()
    return rows.groupBy("source_sha256").agg(F.count(F.lit(1)).alias("n_references"), F.count_if(F.coalesce("cached_value", F.lit("")) != "?").alias("n_not_draft"))


@query(
    "a21_expected_inventory",
    f"with {CURRENT} select source_sha256, kind, norm, count(*) n from (select source source_sha256, 'source' kind, regexp_replace(content, '{SP}+', '', 'g') norm from (select distinct * from inventory_items) where kind = 'paragraph' union all select source_sha256, 'generated', regexp_replace(visible_text, '{SP}+', '', 'g') from current_blocks where outline_level is not null) where length(norm) > 1 group by all",
)
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delivery must hold: the source's paragraphs with their multiplicity, and the titles made for its headings."""
    items = table(spark, sf_dir, "inventory_items").distinct().where("kind = 'paragraph'").select(c("source").alias("source_sha256"), F.lit("source").alias("kind"), S.delete_space(c("content")).alias("norm"))
    heads = ordered(spark, sf_dir).where("outline_level is not null").select("source_sha256", F.lit("generated").alias("kind"), S.delete_space(c("visible_text")).alias("norm"))
    return items.unionByName(heads).where(F.length("norm") > 1).groupBy("source_sha256", "kind", "norm").agg(F.count(F.lit(1)).alias("n"))
