"""Queries of filters, projections and orderings."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sheaf.functions import scalars as S
from sheaf.operators.candidates import ranked_candidates
from sheaf.operators.matching import first_contained, first_rule
from sheaf.operators.windows import numbered, ranked_position, text_position
from sheaf.plans.carriers import CURRENT, current_blocks, distinct_rows
from sheaf.plans.joins import ASSIGNED, assigned
from sheaf.plans.problems import _OBJECTS_SQL
from sheaf.plans.registry import SQL, query
from sheaf.plans.scalars import SP, sql_strip
from sheaf.plans.windows import ORDERED, ordered
from sheaf.session import table

c = F.col
KEY = ["source_sha256", "part_uri", "element_path"]
_K = "source_sha256, part_uri, element_path"

PROSE = ("content", "fingerprint")


@query("pj01_redacted", "select distinct item_id, source, kind, item_ord, story_type, extracted_at from inventory_items")
def pj01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without the columns that hold prose."""
    return table(spark, sf_dir, "inventory_items").drop(*PROSE).distinct()


@query("pj02_toc_entries", f"with {CURRENT} select {_K}, outline_level from current_blocks where outline_level is not null and coalesce(outline_source <> 'direct' or outline_level <= 2, true)")
def pj02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a table of contents: deep ones set directly are left out, an unknown source counts as included."""
    return current_blocks(spark, sf_dir).where(c("outline_level").isNotNull() & F.coalesce((c("outline_source") != "direct") | (c("outline_level") <= 2), F.lit(True))).select(*KEY, "outline_level")


IGNORED = ("draft", "tmp", "header")


@query("pj03_not_ignored", f"with {CURRENT} select {_K} from current_blocks where not " + "(" + " or ".join(f"contains(regexp_replace(part_uri, '{S.MATCH_NOISE}', '', 'g'), '{w}')" for w in IGNORED) + ")")
def pj03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of parts whose normal name contains no ignored key; an empty key would ignore everything and is left out."""
    name = S.clean_match_key(c("part_uri"))
    hit = reduce(lambda a, b: a | b, [name.contains(w) for w in IGNORED if w])
    return current_blocks(spark, sf_dir).where(~hit).select(*KEY)


PROTECTED = ("drawing", "formula", "field", "footnote_ref", "sdt")


@query("pj04_substantive", f"with {CURRENT} select {_K}, (regexp_replace(coalesce(visible_text, ''), '{SP}+', '', 'g') <> '' or structure_type = 'table' or contains(element_path, '/w:tbl[') or coalesce(list_has_any(protected_objects, {list(PROTECTED)}), false)) substantive from current_blocks")
def pj04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block holds text, is part of a table, or has a protected object."""
    protected = F.coalesce(F.arrays_overlap("protected_objects", F.array(*map(F.lit, PROTECTED))), F.lit(False))
    return current_blocks(spark, sf_dir).select(*KEY, ((S.delete_space(F.coalesce("visible_text", F.lit(""))) != "") | (c("structure_type") == "table") | c("element_path").contains("/w:tbl[") | protected).alias("substantive"))


def path_order(path: F.Column) -> F.Column:
    """The indices of a path, compared from the left. Not document order: paragraphs and tables count apart."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


@query("pj05_node_range", f"with {CURRENT} select {_K}, list_transform(regexp_extract_all(element_path, '\\[(\\d+)\\]', 1), lambda x: x::int) path_order from current_blocks where list_sort([path_order, [5]])[1] = [5] and list_sort([path_order, [20]])[2] = [20]")
def pj05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose path lies in a range."""
    order = path_order(c("element_path"))
    low, high = F.array(F.lit(5)), F.array(F.lit(20))
    return current_blocks(spark, sf_dir).select(*KEY, order.alias("path_order")).where((c("path_order") >= low) & (c("path_order") <= high))


SCOPES = (("restyle", [1], [10_000]), ("preserve", [10], [30]), ("restyle", [20], [25]))
_SCOPE = "case " + " ".join(f"when o between {lo} and {hi} then '{mode}'" for mode, lo, hi in reversed(SCOPES)) + " end"


@query("pj06_scoped_roles", f"with {ASSIGNED} select assignment_id, {_SCOPE} as mode from (select *, list_transform(regexp_extract_all(element_path, '\\[(\\d+)\\]', 1), lambda x: x::int) o from assigned)")
def pj06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last scope of a policy that holds an assignment's node."""
    array = lambda xs: F.array(*map(F.lit, xs))
    mode = reduce(lambda found, s: F.when((c("o") >= array(s[1])) & (c("o") <= array(s[2])), s[0]).otherwise(found), SCOPES, F.lit(None).cast("string"))
    return assigned(spark, sf_dir, "element_path").withColumn("o", path_order(c("element_path"))).select("assignment_id", mode.alias("mode"))


@query("pj07_restyled", f"with {ASSIGNED} select assignment_id, coalesce(o[1] between 20 and 25 or o[1] < 10 or o[1] > 30, false) restyled from (select *, list_transform(regexp_extract_all(element_path, '\\[(\\d+)\\]', 1), lambda x: x::int) o from assigned)")
def pj07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a node's first index lies in a restyled scope."""
    first = F.try_element_at(path_order(c("element_path")), F.lit(1))
    return assigned(spark, sf_dir, "element_path").select("assignment_id", F.coalesce(first.between(20, 25) | (first < 10) | (first > 30), F.lit(False)).alias("restyled"))


PARTS = ((1, 8), (15, 30))


@query("pj08_content_parts", f"with {ORDERED} select source_sha256, n, element_path from ordered where " + " or ".join(f"n between {a} and {b}" for a, b in PARTS))
def pj08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks within any of a delivery's parts, given by first and last place."""
    return ordered(spark, sf_dir).where(reduce(lambda a, b: a | b, [c("n").between(*p) for p in PARTS])).select("source_sha256", "n", "element_path")


@query(
    "pj09_region_slices",
    f"with {ORDERED}, e as (select source_sha256, min(n) filter (outline_level = 1) s, min(n) filter (outline_level = 2) t from ordered group by 1) select o.source_sha256, o.n from ordered o join e on o.source_sha256 = e.source_sha256 where o.n >= e.s and (e.t is null or e.t <= e.s or o.n < e.t)",
)
def pj09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first heading of level 1 up to the first of level 2, else to the document's end."""
    blocks = ordered(spark, sf_dir).select("source_sha256", "n", "outline_level")
    ends = blocks.groupBy("source_sha256").agg(F.min(F.when(c("outline_level") == 1, c("n"))).alias("s"), F.min(F.when(c("outline_level") == 2, c("n"))).alias("t"))
    return blocks.join(ends, "source_sha256").where("n >= s and (t is null or t <= s or n < t)").select("source_sha256", "n")


@query("pj12_cover_documents", f"select doc_id, coalesce(bool_or(k >= 3 and contains(lower(line), 'plan')), false) cover from (select *, sum((regexp_replace(line, '{SP}+', '', 'g') = '')::int) over (partition by doc_id order by ord) k from (select doc_id, unnest(string_split(text, chr(10))[1:12]) line, generate_subscripts(string_split(text, chr(10))[1:12], 1) ord from documents)) group by doc_id")
def pj12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a plan's title behind three empty lines within the first twelve: a fold over the lines, row by row."""
    lines = F.slice(F.split("text", "\n"), 1, 12)
    state = F.struct(F.lit(0).alias("k"), F.lit(False).alias("hit"))
    step = lambda s, x: F.struct((s["k"] + (S.delete_space(x) == "").cast("int")).alias("k"), (s["hit"] | ((s["k"] + (S.delete_space(x) == "").cast("int") >= 3) & F.lower(x).contains("plan"))).alias("hit"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.aggregate(lines, state, step, lambda s: s["hit"]).alias("cover"))


@query("pj14_publishable", "select source_sha256, bool_and(story <> 'body' or cached_value is not null or command in ('TOC', 'DATE')) publishable, list_sort(list(distinct command) filter (story = 'body' and cached_value is null and command not in ('TOC', 'DATE'))) open_ from (select distinct * from field_observations) group by source_sha256")
def pj14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents all of whose required fields have a value, and the commands of those that have none."""
    done = (c("story") != "body") | c("cached_value").isNotNull() | c("command").isin("TOC", "DATE")
    open_ = F.array_sort(F.collect_set(F.when(~done, c("command"))))
    return distinct_rows(spark, sf_dir, "field_observations", "obs_id", "source_sha256", "story", "command", "cached_value").groupBy("source_sha256").agg(F.every(done).alias("publishable"), F.when(F.size(open_) > 0, open_).alias("open_"))


@query("pj15_json_rows", f"with {CURRENT} select {_K}, to_json(list_sort(coalesce(protected_objects, []))) safe from current_blocks")
def pj15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets as sorted JSON arrays."""
    return current_blocks(spark, sf_dir).select(*KEY, F.to_json(F.array_sort(F.coalesce("protected_objects", F.array().cast("array<string>")))).alias("safe"))


@query(
    "pj16_field_evidence",
    f"with {CURRENT} select field, status, count(*) n from (select unnest(['p_style_id', 'p_style_name', 'outline_level', 'outline_source', 'visible_text']) field, unnest([p_style_id is not null, p_style_name is not null, outline_level is not null, outline_source is not null, visible_text is not null]) ok from current_blocks), lateral (select case when ok then 'observed' else 'unverified' end status) group by all",
)
def pj16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field of each block as observed or unverified, counted."""
    fields = ("p_style_id", "p_style_name", "outline_level", "outline_source", "visible_text")
    rows = current_blocks(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(c(f).isNotNull(), "observed").otherwise("unverified").alias("status")) for f in fields])).alias("e"))
    return rows.groupBy("e.field", "e.status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pj17_trimmed_blocks",
    f"with {ORDERED}, s as (select source_sha256, max(n) filter (where regexp_replace(coalesce(visible_text, ''), '{SP}+', '', 'g') <> '') last_n from ordered group by 1) select o.source_sha256, o.n from ordered o join s on o.source_sha256 = s.source_sha256 where o.n <= last_n",
)
def pj17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks up to the last substantive one of their document."""
    blocks = ordered(spark, sf_dir).select("source_sha256", "n", "visible_text")
    last = blocks.where(S.delete_space(F.coalesce("visible_text", F.lit(""))) != "").groupBy("source_sha256").agg(F.max("n").alias("last_n"))
    return blocks.join(last, "source_sha256").where("n <= last_n").select("source_sha256", "n")


@query("pj18_unsupported", f"with {CURRENT} select structure_type, count(*) n from current_blocks where structure_type not in ('paragraph', 'table') group by all")
def pj18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of types that a slice can't hold."""
    return current_blocks(spark, sf_dir).where(~c("structure_type").isin("paragraph", "table")).groupBy("structure_type").agg(F.count(F.lit(1)).alias("n"))


@query("pj19_logical_ranges", "select inv_id, extracted_at, count(*) n, min(length(e.key)) shortest, max(length(e.key)) longest from (select distinct inv_id, extracted_at, e from inventory_prepared, unnest(map_entries(paragraph_counts)) t(e)) group by all")
def pj19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of text lengths of each inventory's paragraphs."""
    entries = table(spark, sf_dir, "inventory_prepared").select("inv_id", "extracted_at", F.explode("paragraph_counts").alias("k", "v")).distinct()
    return entries.groupBy("inv_id", "extracted_at").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("k")).alias("shortest"), F.max(F.length("k")).alias("longest"))


#: First numbers from here on share a slice.
WIDEST = (1 << 20) - 1


@query(
    "o01_natural_order",
    f"with {CURRENT}, h as (select {_K}, visible_text, case when regexp_matches(s, '^\\d+(?:\\.\\d+)*') then list_transform(string_split(regexp_extract(s, '^(\\d+(?:\\.\\d+)*)', 1), '.'), lambda x: try_cast(x as int)) else [999] end parts from (select *, {sql_strip('visible_text')} s from current_blocks where outline_level is not null and visible_text is not null)) select {_K}, row_number() over (partition by source_sha256 order by parts, visible_text, part_uri, element_path) k from h",
)
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a document in the natural order of their numbers."""
    rows = current_blocks(spark, sf_dir).where("outline_level is not null and visible_text is not null").select(*KEY, "visible_text", S.name_parts(c("visible_text"))["parts"].alias("parts"))
    first = F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit(-1))
    # by the first number; headings with only one, as all without number are, also by their first two characters
    more = F.when(first >= WIDEST, (1 << 43) - 1).when(F.size("parts") > 1, F.lit(1 << 42) + F.try_element_at("parts", F.lit(2))).otherwise(text_position(c("visible_text")))
    place = F.least(first, F.lit(WIDEST)).cast("long") * (1 << 43) + F.coalesce(more, F.lit(0))
    return numbered(rows.withColumn("_p", place), ["source_sha256"], ["parts", "visible_text", "part_uri", "element_path"], "k", "_p", 1).select(*KEY, "k")


_when = lambda when, points: f"case when {when} then {points}e0 else 0e0 end"
_RANKED = f"""with {ORDERED}, num as ({SQL["f11_numbering"]}),
  k as (select source_sha256, n, coalesce(size_pt, 0) size, coalesce(bold, false) bold, alignment, structure_type, visible_text, lag(size_pt) over w before, lead(size_pt) over w behind from ordered window w as (partition by source_sha256 order by n)),
  r as (select k.*, length(regexp_replace(coalesce(k.visible_text, ''), '{SP}+', '', 'g')) len, num.depth, coalesce(num.kind in ('date_or_version', 'decimal_or_version'), false) rejected, num.kind is not null and not coalesce(num.kind in ('date_or_version', 'decimal_or_version'), false) numbered from k left join num on num.visible_text is not distinct from k.visible_text where structure_type = 'paragraph'),
  base as (select source_sha256, coalesce(quantile_cont(size, 0.5) filter (len > 80 or not bold), quantile_cont(size, 0.5)) body from r where size > 0 group by 1),
  s as (select r.*, case when size > 0 then round_even(size / coalesce(body, 12), 3) else 1e0 end rel from r left join base using (source_sha256)),
  fam as (select *, count(*) over (partition by source_sha256) families, dense_rank() over (partition by source_sha256 order by key desc) rank from (select source_sha256, round(size, 1) key, count(*) like_n from s where len <= 42 and bold and numbered and size > 0 and rel >= 1.08e0 group by all)),
  most as (select source_sha256, max(families) families from fam group by 1),
  u as (select s.*, like_n, most.families, case when rank <= 9 then rank end size_level, coalesce(depth >= 2, false) deep, bold or coalesce(alignment, '') = 'center' emphasis, coalesce(alignment = 'center', false) centered from s left join fam on fam.source_sha256 = s.source_sha256 and fam.key = round(s.size, 1) left join most on most.source_sha256 = s.source_sha256),
  v as (select *, case when deep then depth else size_level end inferred, deep and coalesce(size_level <> depth, false) differs from u),
  x as (select *, inferred is not null and coalesce(like_n, 0) >= 1 and coalesce(families, 0) >= 2 and len <= 42 and emphasis and numbered and not len > 80 and not differs and not rejected calibrated,
    (0.05e0 + case when rel >= 1.15e0 then least(0.35e0, (rel - 1e0) * 0.45e0) else 0e0 end) + (0e0 + {_when("len <= 42", 0.2)} + {_when("emphasis", 0.12)} + {_when("numbered", 0.1)} + {_when("rejected", -0.25)} + {_when("len > 80", -0.28)} + {_when("coalesce(abs(before - size) < 0.1, false) and coalesce(abs(behind - size) < 0.1, false) and not numbered", -0.1)}) raw from v),
  y as (select *, case when calibrated then 0.985e0 else greatest(0e0, least(0.95e0, raw)) end heading from x),
  z as (select *, 'heading.' || coalesce(inferred, 1) heading_role, list_sort([{{'m': -(case when centered and rel >= 1.35e0 and len <= 42 then least(0.98e0, heading + 0.2e0) when not centered or rel < 1.2e0 then greatest(0e0, heading - 0.18e0) else heading end), 'role': 'title'}}, {{'m': -heading, 'role': 'heading.' || coalesce(inferred, 1)}},
    {{'m': -least(0.92e0, 0.3e0 + (0e0 + {_when("len > 80", 0.3)} + {_when("rel <= 1.1e0", 0.2)} + {_when("not emphasis and not numbered", 0.1)})), 'role': 'body'}}, {{'m': -(case when len <= 42 and not numbered then 0.25e0 else 0.08e0 end), 'role': 'caption'}}]) every from y),
  t as (select *, (case when len(list_filter(every, lambda q: q.m <= -0.25e0)) > 0 then list_filter(every, lambda q: q.m <= -0.25e0) else every[1:1] end)[1:3] top from z)
  select source_sha256, n, case when calibrated or differs then heading_role when -top[1].m >= 0.58e0 and coalesce(top[2].m - top[1].m >= 0.05e0, true) then top[1].role else 'body' end selected_role, round(-top[1].m, 4) selected_score,
    case when calibrated then 'auto_accepted' when differs or rejected then 'pending_review' else 'selected' end review_status, list_transform(top, lambda q: q.role) roles from t"""


@query("o02_ranked_roles", _RANKED)
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three scored roles for each paragraph, and the one selected."""
    return ranked_candidates(ordered(spark, sf_dir), "source_sha256", "n").select("source_sha256", "n", "selected_role", F.round("selected_score", 4).alias("selected_score"), "review_status", F.transform("candidates", lambda x: x["role"]).alias("roles"))


PRIORITY = ("Weekly", "Central", "report")
_PRIORITY = "case " + " ".join(f"when contains(visible_text, '{w}') then {i}" for i, w in enumerate(PRIORITY)) + " else 999 end"


@query("o04_priority_order", f"with {ORDERED} select source_sha256, n, row_number() over (partition by source_sha256 order by {_PRIORITY}, n) k from ordered where outline_level is not null")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by the first declared key they contain, else last; old order within."""
    rows = ordered(spark, sf_dir).where("outline_level is not null").select("source_sha256", "n", F.coalesce(first_contained(c("visible_text"), list(PRIORITY)), F.lit(999)).alias("i"))
    return numbered(rows.withColumn("_p", ranked_position(c("i"), c("n"))), ["source_sha256"], ["i", "n"], "k", "_p").select("source_sha256", "n", "k")


ELEMENTS = ("Title", "Heading1", "Heading2", "Heading3", "Normal")


@query("o05_enumerated_order", f"with {ORDERED} select source_sha256, n, row_number() over (partition by source_sha256 order by coalesce(nullif(list_position({list(ELEMENTS)}, p_style_id), 0), 999), n) k from ordered")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by their style's place in a list, unknown ones last; old order within."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ELEMENTS)), c("p_style_id")), F.lit(0)), F.lit(999))
    rows = ordered(spark, sf_dir).select("source_sha256", "n", place.alias("i")).withColumn("_p", ranked_position(c("i"), c("n")))
    return numbered(rows, ["source_sha256"], ["i", "n"], "k", "_p").select("source_sha256", "n", "k")


@query("o06_content_first", "select inv_id, row_number() over (partition by delivery_id order by has desc, inv_id) k from (select inv_id, min(coalesce(delivery_id, '')) delivery_id, bool_or(len(map_entries(paragraph_counts)) > 0) has from inventory_prepared group by inv_id)")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories with content before those without, within their delivery."""
    has = F.coalesce(F.bool_or(F.size("paragraph_counts") > 0), F.lit(False))
    rows = table(spark, sf_dir, "inventory_prepared").groupBy("inv_id").agg(F.min(F.coalesce("delivery_id", F.lit(""))).alias("delivery_id"), has.alias("has"))
    placed = rows.withColumn("later", (~c("has")).cast("int")).withColumn("_p", ranked_position(c("later"), c("inv_id")))
    return numbered(placed, ["delivery_id"], ["later", "inv_id"], "k", "_p").select("inv_id", "k")


@query("o07_samples", f"with {ORDERED} select source_sha256, n, element_path from (select *, row_number() over (partition by source_sha256 order by n) k from ordered where length(visible_text) > 0) where k <= 5")
def o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five blocks with text of each document."""
    return numbered(ordered(spark, sf_dir).where("length(visible_text) > 0"), ["source_sha256"], ["n"], "k", "n").where("k <= 5").select("source_sha256", "n", "element_path")


RULES = ((r"^\d+\.\d+\.\d+", 3), (r"^\d+\.\d+", 2), (r"^\d+", 1))
_RULES = "case " + " ".join(f"when regexp_matches(visible_text, '{p}') then {n}" for p, n in RULES) + " end"


@query("s05_outline_by_rules", f"with {CURRENT} select * from (select {_K}, {_RULES} rule_level, visible_text as title from current_blocks where structure_type = 'paragraph') where rule_level is not null")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline levels by the first of a list of patterns that a paragraph matches."""
    return current_blocks(spark, sf_dir).where("structure_type = 'paragraph'").select(*KEY, first_rule(c("visible_text"), list(RULES)).alias("rule_level"), c("visible_text").alias("title")).where("rule_level is not null")


@query("s23_project_matches", "with p as (select distinct project_key from manifest_files where project_key is not null) select project_key, case when lower(project_key) = '1-1' then 1 when contains(lower(project_key), '1-1') then 2 end tier from p where contains(lower(project_key), '1-1')")
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that match a name exactly, or else contain it."""
    wanted, key = F.lit("1-1"), F.lower("project_key")
    return table(spark, sf_dir, "manifest_files").select("project_key").distinct().withColumn("tier", F.when(key == wanted, 1).when(key.contains(wanted), 2)).where("tier is not null")


@query("s24_template_scores", "select format_id, case when contains(lower(format_id), 'cover') or contains(lower(format_id), 'report') then 60 when contains(lower(format_id), 'academic') then 50 when contains(lower(format_id), 'memo') then 30 else 10 end score from (select distinct format_id from format_files where format_id is not null)")
def s24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each package's name suits as a template."""
    name = F.lower("format_id")
    score = F.when(name.contains("cover") | name.contains("report"), 60).when(name.contains("academic"), 50).when(name.contains("memo"), 30).otherwise(10)
    return table(spark, sf_dir, "format_files").where("format_id is not null").select("format_id").distinct().withColumn("score", score)


@query(
    "s25_measurement_faults",
    "with m as (select distinct obs_id, source_sha256, target, cached_value from field_observations where command = 'PAGEREF'), t as (select source_sha256, target from m where target is not null group by all having count(*) > 1) select obs_id, case when target is null then 'no_name' when cached_value is null then 'no_value' when not regexp_matches(cached_value, '^\\d+$') then 'no_number' when cached_value::int < 1 then 'below_one' when exists (select 1 from t where t.source_sha256 = m.source_sha256 and t.target = m.target) then 'repeated' end fault from m",
)
def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each measured line: no name, no value, no number, below one, or a name measured twice."""
    rows = table(spark, sf_dir, "field_observations").where("command = 'PAGEREF'").select("obs_id", "source_sha256", "target", "cached_value").distinct()
    twice = rows.where("target is not null and source_sha256 is not null").groupBy("source_sha256", "target").agg(F.count(F.lit(1)).alias("k"))
    value = c("cached_value")
    fault = F.when(c("target").isNull(), "no_name").when(value.isNull(), "no_value").when(~value.rlike(r"^\d+$"), "no_number").when(value.try_cast("int") < 1, "below_one").when(c("k") > 1, "repeated")
    return rows.join(twice, ["source_sha256", "target"], "left").select("obs_id", fault.alias("fault"))


def _leaves(file: str | None) -> bool:
    path = posixpath.normpath(file or "")
    return path.startswith("/") or path == ".." or path.startswith("../")


def _compiles(pattern: str | None) -> bool:
    try:
        re.compile(pattern or "")
    except (re.error, OverflowError, RecursionError):
        return False
    return True


@F.arrow_udf(BooleanType())
def outside(files: pa.Array) -> pa.Array:
    """Whether a path leaves the folder it is relative to; each different one is looked at once a batch."""
    known = files.dictionary_encode()
    return pa.array([_leaves(x) for x in known.dictionary.to_pylist()] + [False], pa.bool_()).take(known.indices.fill_null(len(known.dictionary)))


@F.arrow_udf(BooleanType())
def compiles(patterns: pa.Array) -> pa.Array:
    """Whether a pattern can be compiled; each different one is tried once a batch, null as an empty one."""
    known = patterns.dictionary_encode()
    return pa.array([_compiles(x) for x in known.dictionary.to_pylist()] + [True], pa.bool_()).take(known.indices.fill_null(len(known.dictionary)))


@query(
    "s06_tree_faults",
    _OBJECTS_SQL.split("--")[0].rstrip()
    + r""", n as (select manifest_id file_id, pointer, value v, (length(pointer) - length(replace(pointer, '/children', ''))) // 9 depth, json_extract_string(value, '$.type') kind from nodes),
    r as (select manifest_id file_id, pointer || '/outline_rules/' || unnest(range(json_array_length(value, '$.outline_rules')::bigint)) pointer, unnest(json_extract(value, '$.outline_rules[*]')) v, (length(pointer) - length(replace(pointer, '/children', ''))) // 9 + 1 depth from nodes where json_type(value, '$.outline_rules') = 'ARRAY')
    select distinct file_id, pointer node_pointer, fault from (
      select file_id, pointer, unnest([case when try_cast(json_extract_string(v, '$.level') as int) <> depth + 1 then 'level' end, case when coalesce(json_extract_string(v, '$.title'), '') = '' then 'title' end,
        case when kind = 'folder' and coalesce(json_type(v, '$.children') <> 'OBJECT' and json_array_length(v, '$.children') = 0, true) then 'empty_folder' end, case when kind <> 'folder' and regexp_matches(json_extract_string(v, '$.file'), '^/|^\.\.(/|$)') then 'file_outside' end]) fault from n
      union all select file_id, pointer, unnest([case when coalesce(json_type(v, '$.pattern'), '') <> 'VARCHAR' then 'pattern' end, case when coalesce(try_cast(json_extract_string(v, '$.level') as int), -1) < depth then 'rule_level' end]) from r) where fault is not null""",
)
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline nodes whose level is not their depth, that have no title, that are folders without children, or whose
    file lies outside the source's folder; and rules without a pattern that compiles, or of a level above their node's."""
    from sheaf.operators.nesting import RULES, flat_objects, typed_table

    flat = flat_objects(table(spark, sf_dir, "manifest_files"), "manifest_id", "raw_json", RULES)
    nodes, rules = typed_table(flat, "outline_node"), typed_table(flat, "outline_rule")
    faults = F.array_compact(F.array(F.when(c("level") != c("depth") + 1, "level"), F.when(F.coalesce("title", F.lit("")) == "", "title"), F.when((c("type") == "folder") & ~c("variant").contains("children:list") & ~c("variant").contains("children:single"), "empty_folder"), F.when((c("type") != "folder") & outside("file"), "file_outside")))
    broken = ~c("variant").startswith("string") | ~compiles("pattern")
    of_rules = F.array_compact(F.array(F.when(broken, "pattern"), F.when(c("level").isNull() | (c("level") < c("depth")), "rule_level")))
    return nodes.select("file_id", "node_pointer", F.explode(faults).alias("fault")).unionByName(rules.select("file_id", "node_pointer", F.explode(of_rules).alias("fault")))


@query("k03_build_inputs", "select source_sha256, count(*) n_rows from (select distinct source_sha256, part_uri, element_path from blocks) where source_sha256 is not null group by all")
def k03_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a build reads, with their number of nodes."""
    from sheaf.sources.files import build_inputs

    return build_inputs(distinct_rows(spark, sf_dir, "blocks", *KEY))


@query(
    "k03_build_record",
    """with h as (select distinct source_sha256 s from blocks where source_sha256 is not null), l as (select s[:3] p, count(*) n, sha256(string_agg(s, chr(10) order by s)) h from h group by 1),
    k as (select case when cached_value is null then 'not_run' else 'passed' end status, count(*) n from (select distinct * from field_observations) group by 1)
    select coalesce(sum(n), 0)::bigint inputs, sha256(coalesce(string_agg(h, chr(10) order by p), '')) digest, (select '{' || string_agg('"' || status || '":' || n, ',' order by status) || '}' from k) checks from l""",
)
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that records the inputs and the fields by whether they have a value."""
    from sheaf.sources.files import build_record

    checks = distinct_rows(spark, sf_dir, "field_observations", "obs_id", "cached_value").select(F.when(c("cached_value").isNull(), "not_run").otherwise("passed").alias("status"))
    return build_record(table(spark, sf_dir, "blocks"), checks)


@query("s14_semantic_inventory", f"with {CURRENT} select source_sha256, kind, count(*) n from (select source_sha256, 'paragraph' kind from current_blocks where regexp_replace(coalesce(visible_text, ''), '{SP}+', '', 'g') <> '' union all select source_sha256, unnest(protected_objects) from current_blocks) group by all")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document must keep: its paragraphs with text and its protected objects, counted by kind."""
    blocks = current_blocks(spark, sf_dir)
    paragraphs = blocks.where(S.delete_space(F.coalesce("visible_text", F.lit(""))) != "").select("source_sha256", F.lit("paragraph").alias("kind"))
    objects = blocks.select("source_sha256", F.explode("protected_objects").alias("kind"))
    return paragraphs.unionByName(objects).groupBy("source_sha256", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("s17_feature_counts", "select manifest_id, f as feature, ((length(raw_json) - length(replace(raw_json, f, ''))) // length(f))::int as n from (select distinct manifest_id, raw_json from manifest_files), unnest(['\"children\"', '\"outline_rules\"', '\"_comment']) t(f) where contains(raw_json, f)")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of a list of raw tokens stands in each file."""
    rows = table(spark, sf_dir, "manifest_files").select("manifest_id", "raw_json").distinct()
    tokens = rows.withColumn("feature", F.explode(F.array(*map(F.lit, ('"children"', '"outline_rules"', '"_comment')))))
    n = ((F.length("raw_json") - F.length(F.replace("raw_json", "feature", F.lit("")))) / F.length("feature")).cast("int")
    return tokens.where(F.contains("raw_json", "feature")).select("manifest_id", "feature", n.alias("n"))
