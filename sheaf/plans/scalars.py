"""Queries of the scalar functions, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import scalars as S
from sheaf.functions.names import collision_key, font_key
from sheaf.plans.registry import query
from sheaf.session import table

_NUMERALS = "[" + ",".join(f"'{n}'" for n in S.CHINESE_NUMERALS) + "]"
SP = r"[\s\p{Z}]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_strip(rf"regexp_replace({x}, '{SP}+', ' ', 'g')")


def scalar(name: str, source: str, columns: str, made: Callable[[], dict[str, Column]], sql: str, derived: str = "") -> None:
    """One query: distinct values of some columns of a table, each with what the functions make of them."""
    keys = columns.split(", ")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*keys).distinct().withColumns(made())

    query(name, f"select {columns}, {sql} from (select *{', ' + derived if derived else ''} from (select distinct {columns} from {source}))")(run)


c = F.col
scalar("s02_file_types", "manifest_files", "file_name", lambda: {"as_written": S.file_type(c("file_name")), "as_docx": S.file_type(F.regexp_replace("file_name", "json$", "DOCX"))}, "null::varchar as as_written, 'docx' as as_docx")
scalar(
    "f01_name_parts",
    "blocks",
    "visible_text",
    lambda: {k: S.name_parts(c("visible_text"))[k] for k in ("parts", "numeral", "title")},
    rf"""case when regexp_matches(s, '^[一二三四五六七八九十]+(?:{SP}|[、.：:])') then [coalesce(list_position({_NUMERALS}, regexp_extract(s, '^([一二三四五六七八九十]+)', 1)), 99)]
         when regexp_matches(s, '^[(（]\d+[)）]') then [try_cast(regexp_extract(s, '^[(（](\d+)[)）]', 1) as int)]
         when regexp_matches(s, '^\d+(?:\.\d+)*') then list_transform(string_split(regexp_extract(s, '^(\d+(?:\.\d+)*)', 1), '.'), lambda x: try_cast(x as int))
         when s is not null then [999] end as parts,
       case when regexp_matches(s, '^[一二三四五六七八九十]+(?:{SP}|[、.：:])') then regexp_extract(s, '^([一二三四五六七八九十]+)', 1) end as numeral,
       case when regexp_matches(s, '^[一二三四五六七八九十]+(?:{SP}|[、.：:])') then {sql_strip(rf"regexp_replace(s, '^[一二三四五六七八九十]+(?:{SP}|[、.：:])', '')")}
         when regexp_matches(s, '^[(（]\d+[)）]') then {sql_strip(r"regexp_replace(s, '^[(（]\d+[)）]', '')")}
         when regexp_matches(s, '^\d+(?:\.\d+)*') then {sql_strip(rf"coalesce(nullif(regexp_replace(s, '^\d+(?:\.\d+)*(?:{SP}|[.、_\-])*', ''), ''), s)")}
         else s end as title""",
    sql_strip(r"regexp_replace(visible_text, '(?i)\.(docx?|pdf|pptx?|jpe?g|png)$', '')") + " s",
)
scalar("f02_match_keys", "inventory_items", "content", lambda: {"match_key": S.clean_match_key(c("content"))}, rf"regexp_replace(content, '{S.MATCH_NOISE}', '', 'g') as match_key")
scalar("f03_deleted_space", "inventory_items", "content", lambda: {"text": S.delete_space(c("content"))}, rf"regexp_replace(content, '{SP}+', '', 'g') as text")
scalar("f04_text_hashes", "blocks", "visible_text", lambda: {"hash": S.text_hash(c("visible_text"))}, f"sha256({sql_collapse("coalesce(visible_text, '')")}) as hash")
scalar(
    "f06_roman",
    "part",
    "p_partkey",
    lambda: {"roman": S.to_roman((c("p_partkey") % 4000).cast("int")), "back": S.from_roman(S.to_roman((c("p_partkey") % 4000).cast("int")))},
    "case when p_partkey % 4000 = 0 then '0' else repeat('M', (p_partkey % 4000 // 1000)::int) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(p_partkey % 1000 // 100)::int + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(p_partkey % 100 // 10)::int + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][(p_partkey % 10)::int + 1] end as roman, nullif((p_partkey % 4000)::int, 0) as back",
)
scalar(
    "f07_roman_words",
    "part",
    "p_name",
    lambda: {"value": S.from_roman(F.regexp_replace("p_name", "[^IVXLCDMivxlcdm]", ""))},
    "nullif(raw, 0) as value",
    "list_reduce(list_prepend([0, 0], list_transform(list_reverse(string_split(upper(regexp_replace(p_name, '[^IVXLCDMivxlcdm]', '', 'g')), '')), lambda x: [coalesce(map {'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}[x], 0), 0])), lambda a, v: case when v[1] < a[2] then [a[1] - v[1], a[2]] else [a[1] + v[1], v[1]] end)[1] raw",
)
scalar(
    "f08_letters",
    "part",
    "p_partkey",
    lambda: {"small": S.to_letters(c("p_partkey").cast("int")), "capital": S.to_letters(c("p_partkey").cast("int"), True)},
    "case when p_partkey <= 0 then p_partkey::varchar when p_partkey <= 26 then chr((96 + p_partkey)::int) when p_partkey <= 702 then chr((96 + (p_partkey - 1) // 26)::int) || chr((97 + (p_partkey - 1) % 26)::int) else chr((96 + (p_partkey - 27) // 676 )::int) || chr((97 + (p_partkey - 27) // 26 % 26)::int) || chr((97 + (p_partkey - 1) % 26)::int) end as small, upper(small) as capital",
)
scalar(
    "f09_page_numbers",
    "lineitem",
    "l_linenumber",
    lambda: {k: S.page_number(c("l_linenumber"), F.lit(k)) for k in ("decimal", "lowerRoman", "upperRoman", "lowerLetter", "upperLetter")},
    "l_linenumber::varchar as decimal, ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii'][l_linenumber] as lowerRoman, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'][l_linenumber] as upperRoman, chr(96 + l_linenumber) as lowerLetter, chr(64 + l_linenumber) as upperLetter",
)
scalar("f10_page_labels", "field_observations", "cached_value", lambda: {"label": S.page_label(F.concat(F.lit(" - "), c("cached_value"), F.lit(" | ")))}, rf"regexp_replace(regexp_replace(cached_value, '^{S.LABEL_NOISE}', ''), '{S.LABEL_NOISE}$', '') as label")
scalar(
    "f11_numbering",
    "blocks",
    "visible_text",
    lambda: {k: S.numbering(c("visible_text"))[k] for k in ("kind", "parts", "depth", "confidence")},
    rf"""case when regexp_matches(s, '^(?:19\d\d|20\d\d|2100)\.\d{{1,2}}\.\d{{1,2}}(?:[.)、]{SP}+|{SP}+)') then 'date_or_version'
           when regexp_matches(s, '^\d+(?:\.\d+)+(?:[.)、]{SP}+|{SP}+)') then 'hierarchical_arabic'
           when regexp_matches(s, '^第([一二三四五六七八九十百]+|\d+)(?:章|节|篇|部分|级|条)') then 'section_label'
           when regexp_matches(s, '^\d+[.)、]') and not regexp_matches(s, '^\d+\.\d+(?:\.\d+)*(?:[^\p{{L}}\p{{N}}_.]|\.(?:[^0-9]|$)|$)') or regexp_matches(s, '^\d+[.)、]') then 'simple_arabic' end as kind,
         case kind when 'section_label' then [regexp_extract(s, '^第([一二三四五六七八九十百]+|\d+)', 1)] when 'simple_arabic' then [regexp_extract(s, '^(\d+)', 1)] else coalesce(string_split(nullif(case when kind is not null then regexp_extract(s, '^(\d+(?:\.\d+)+)', 1) end, ''), '.'), []::varchar[]) end as parts,
         (case kind when 'hierarchical_arabic' then len(string_split(regexp_extract(s, '^(\d+(?:\.\d+)+)', 1), '.')) when 'section_label' then 1 when 'simple_arabic' then 1 end)::int as depth,
         (case kind when 'hierarchical_arabic' then 0.98 when 'section_label' then 0.9 when 'simple_arabic' then 0.75 else 0 end)::double as confidence""",
    sql_strip("coalesce(visible_text, '')") + " s",
)
scalar("f12_text_lengths", "blocks", "visible_text", lambda: {"n": F.coalesce(F.length(S.delete_space(c("visible_text"))), F.lit(0))}, rf"coalesce(length(regexp_replace(visible_text, '{SP}+', '', 'g')), 0)::int as n")
scalar(
    "f13_instructions",
    "field_observations",
    "instruction",
    lambda: {"normal": S.field_instruction(c("instruction")), "own_command": S.field_command(c("instruction"))},
    r"regexp_replace(s, '\\{2,}', '\\', 'g') as normal, upper(string_split(normal, ' ')[1]) as own_command",
    sql_collapse("coalesce(instruction, '')") + " s",
)
scalar(
    "f14_field_identity",
    "field_observations",
    "instruction",
    lambda: {"identity": S.field_identity(c("instruction")), "dependency": S.field_dependency(c("instruction"))},
    r"""case when regexp_matches(s, '(?i)^(REF|PAGEREF|STYLEREF)[\s\p{Z}]+([^\\\s\p{Z}]+)(.*)$') then upper(regexp_extract(s, '(?i)^(REF|PAGEREF|STYLEREF)', 1)) || ' <bookmark>' || regexp_extract(s, '(?i)^(REF|PAGEREF|STYLEREF)[\s\p{Z}]+([^\\\s\p{Z}]+)(.*)$', 3) else s end as identity,
      case when regexp_matches(instruction, '(?i)^[\s\p{Z}]*(REF|PAGEREF|STYLEREF|SEQ|TOC|HYPERLINK)[\s\p{Z}]+([^\\\s\p{Z}]+)') then upper(regexp_extract(instruction, '(?i)^[\s\p{Z}]*([a-z]+)', 1)) || ':' || regexp_extract(instruction, '(?i)^[\s\p{Z}]*[a-z]+[\s\p{Z}]+([^\\\s\p{Z}]+)', 1) end as dependency""",
    sql_collapse("coalesce(instruction, '')") + " s",
)
scalar("f15_hyperlinks", "field_observations", "target, cached_value, field_id", lambda: {"link": S.hyperlink_target(c("target"), c("cached_value"), c("field_id"))}, "coalesce('#' || nullif(target, ''), nullif(cached_value, ''), nullif(field_id, '')) as link")
scalar(
    "f16_identities",
    "role_assignments",
    "source_sha256, part_uri, element_path, assignment_id",
    lambda: {"occurrence": S.occurrence_id(c("source_sha256"), c("part_uri"), c("element_path"), F.lit("main"), F.lit("body"), c("assignment_id")), "marker": S.marker_name(S.occurrence_id(c("source_sha256"), c("part_uri"), c("element_path"), F.lit("main"), F.lit("body"), c("assignment_id")))},
    "concat_ws('|', source_sha256, part_uri, element_path, 'main', 'body', assignment_id::varchar) as occurrence, '_Src_' || substr(sha256(concat_ws('|', source_sha256, part_uri, element_path, 'main', 'body', assignment_id::varchar)), 1, 28) as marker",
)
scalar("f17_collision_keys", "inventory_items", "content", lambda: {"key": collision_key("content"), "font_key": font_key("content")}, f"nfc_normalize(replace(lower(nfc_normalize(content)), 'ß', 'ss')) as key, replace(lower({sql_strip('content')}), 'ß', 'ss') as font_key")
scalar(
    "f18_filenames",
    "manifest_files",
    "file_name",
    lambda: {"fault": S.filename_fault(c("file_name")), "docx_fault": S.filename_fault(F.regexp_replace(F.regexp_replace("file_name", "^.*/", ""), "json$", "docx")), "draft": S.draft_name(c("file_name"))},
    "case when file_name is null then 'empty' else 'suffix' end as fault, case when file_name is null then 'empty' end as docx_fault, regexp_replace(file_name, '(\\.[^.]*)?$', '-draft\\1') as draft",
)
scalar(
    "f20_units",
    "part",
    "p_size, p_retailprice",
    lambda: {"mm_twips": S.to_twips(c("p_size").cast("double") * 254, F.lit("mm")), "pt_twips": S.to_twips(c("p_size").cast("double"), F.lit("pt")), "char_twips": S.to_twips(c("p_size").cast("double"), F.lit("char"), F.lit(16.0)), "mm_points": F.round(S.to_points(c("p_size").cast("double"), F.lit("mm")), 6)},
    "p_size * 14400 as mm_twips, p_size * 20 as pt_twips, p_size * 320 as char_twips, round(p_size * 72 / 25.4, 6) as mm_points",
)
scalar("f21_toggles", "role_assignments", "confirmed, provenance", lambda: {"state": S.toggle(c("confirmed").isNotNull(), c("confirmed").cast("string"))}, "confirmed as state")
scalar(
    "f22_content_boxes",
    "tables_topology",
    "row_count, col_count",
    lambda: {"room": S.content_size(F.lit(12), c("row_count"), c("col_count")), "width": F.round(S.fitted_box(c("col_count").cast("double"), c("row_count").cast("double"), F.lit(14.0), F.lit(26.0))["width"], 6), "height": F.round(S.fitted_box(c("col_count").cast("double"), c("row_count").cast("double"), F.lit(14.0), F.lit(26.0))["height"], 6)},
    "greatest(1, 12 - row_count - col_count) as room, round(case when row_count <= 0 or col_count <= 0 then 14 else least(14.0, 26.0 * col_count / row_count) end, 6) as width, round(case when row_count <= 0 or col_count <= 0 then 26 else least(26.0, 14.0 * row_count / col_count) end, 6) as height",
)
scalar(
    "f23_column_widths",
    "tables_topology",
    "table_id, grid_widths",
    lambda: {"fitted": S.rescaled_columns(c("grid_widths"), F.lit(9000))},
    """case when t <= 9000 or t <= 0 then grid_widths else list_concat(list_transform(grid_widths[1:len(grid_widths)-1], lambda w: greatest(1, round_even(w * 9000.0::double / t, 0)::int)),
       [greatest(1, 9000 - coalesce(list_sum(list_transform(grid_widths[1:len(grid_widths)-1], lambda w: greatest(1, round_even(w * 9000.0::double / t, 0)::int))), 0)::int)]) end as fitted""",
    "list_sum(grid_widths) t",
)
scalar(
    "f24_tolerances",
    "lineitem",
    "l_discount, l_tax, l_returnflag, l_linestatus",
    lambda: {"near": S.near((c("l_discount") * 100).cast("int").cast("double"), (c("l_tax") * 100).cast("int").cast("double"), 1.0), "font": S.same_font(c("l_returnflag"), F.lower("l_linestatus")), "colour": S.same_colour(c("l_returnflag"), c("l_linestatus"))},
    "abs((l_discount * 100)::int - (l_tax * 100)::int) <= 1 as near, lower(l_returnflag) = lower(l_linestatus) as font, l_returnflag = l_linestatus as colour".replace("(l_discount * 100)::int", "trunc(l_discount * 100)").replace("(l_tax * 100)::int", "trunc(l_tax * 100)"),
)
scalar("f31_templates", "orders", "o_orderkey, o_orderpriority, o_orderstatus", lambda: {"text": S.fill_template(F.lit("{{key}}: {{prio}}/{{key}} {{status}}."), {"{{key}}": c("o_orderkey"), "{{prio}}": c("o_orderpriority"), "{{status}}": c("o_orderstatus")})}, "o_orderkey || ': ' || o_orderpriority || '/' || o_orderkey || ' ' || o_orderstatus || '.' as text")
scalar("f33_record_status", "field_observations", "cached_value, target", lambda: {"status": S.record_status(F.lit(None).cast("string"), c("cached_value"), c("target"))}, "case when cached_value is null or target is null then 'unverified' when cached_value = target then 'verified' else 'mismatch' end as status")
scalar("pj10_reserved_keys", "blocks", "p_style_id", lambda: {"comment": c("p_style_id").startswith("_comment"), "device": S.reserved_name(c("p_style_id"))}, "starts_with(p_style_id, '_comment') as comment, upper(trim(string_split(p_style_id, '.')[1])) in (" + ",".join(f"'{n}'" for n in S.RESERVED_NAMES) + ") as device")
scalar("pj11_roles_and_hashes", "role_assignments", "role, text_hash", lambda: {"heading": (c("role") == "title") | c("role").startswith("heading."), "sha256": c("text_hash").rlike("^[0-9a-f]{64}$")}, "role = 'title' or starts_with(role, 'heading.') as heading, regexp_matches(text_hash, '^[0-9a-f]{64}$') as sha256")
scalar("pj13_page_number_lines", "field_observations", "cached_value", lambda: {"only_number": S.page_number_line(c("cached_value"))}, r"regexp_matches(cached_value, '^\d+$') or regexp_full_match(upper(cached_value), '[IVXLCDM]+') as only_number")
