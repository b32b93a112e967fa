"""Queries of hierarchies, reference graphs and layered configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.drift import consistent_manifests
from sheaf.operators.hierarchy import cycle_members, nearest_ancestor, preorder, resolve_chain
from sheaf.operators.layers import json_leaves, merge_layers, shuffled, spans
from sheaf.operators.windows import latest
from sheaf.plans.carriers import CURRENT, current_blocks, distinct_rows
from sheaf.plans.joins import KEY, j11, u02
from sheaf.plans.registry import SQL, query
from sheaf.session import table

c = F.col

#: Parts as a tree of ten children a node: number 123 stands below 12; every third has a size of its own, every second a brand.
TREE = "t as (select p_partkey id, nullif(p_partkey // 10, 0) up, case when p_partkey % 3 = 0 then p_size end size, case when p_partkey % 2 = 0 then p_brand end brand from part where p_partkey > 0)"
_CHAIN = f"with recursive {TREE}, walk as (select id, id pos, 0 depth from t union all select w.id, t.up, w.depth + 1 from walk w join t on t.id = w.pos join t u on u.id = t.up)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = c("p_partkey")
    return table(spark, sf_dir, "part").where(key > 0).select(key.alias("id"), F.nullif(F.floor(key / 10), F.lit(0).cast("long")).alias("up"), F.when(key % 3 == 0, c("p_size")).alias("size"), F.when(key % 2 == 0, c("p_brand")).alias("brand"))


@query("r01_chains", _CHAIN + " select id, max(depth)::int depth, arg_max(pos, depth) root from walk group by id")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and root of every node."""
    return resolve_chain(tree(spark, sf_dir), "id", "up", []).select("id", "depth", "root")


@query("r02_inherited", _CHAIN + " select w.id, arg_min(t.size, w.depth) filter (t.size is not null) size, arg_min(t.brand, w.depth) filter (t.brand is not null) brand from walk w join t on t.id = w.pos group by w.id")
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attribute from the nearest node that sets it."""
    return resolve_chain(tree(spark, sf_dir), "id", "up", ["size", "brand"]).select("id", "size", "brand")


@query(
    "r03_inherited_pairs",
    _CHAIN + " select w.id, arg_min(case when t.id % 6 = 0 then 'hanging' else 'first_line' end, w.depth) filter (t.size is not null) indent_kind, arg_min(t.size, w.depth) filter (t.size is not null) indent from walk w join t on t.id = w.pos group by w.id",
)
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attributes that clear each other, inherited as one tagged pair."""
    pair = F.when(c("size").isNotNull(), F.struct(F.when(c("id") % 6 == 0, "hanging").otherwise("first_line").alias("kind"), c("size").alias("value")))
    return resolve_chain(tree(spark, sf_dir).withColumn("indent", pair), "id", "up", ["indent"]).select("id", c("indent.kind").alias("indent_kind"), c("indent.value").alias("indent"))


@query(
    "r06_reference_cycles",
    "with recursive e as (select p_partkey a, (p_partkey * 7 + 3) % (select max(p_partkey) + 1 from part) b from part where p_partkey > 0), w as (select a, b pos from e union select w.a, e.b from w join e on e.a = w.pos) select a as id from w where pos = a",
)
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles of references."""
    part = table(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey")
    top = part.agg(F.max("p_partkey")).first()[0] or 0
    return cycle_members(part.select(c("p_partkey").alias("id"), ((c("p_partkey") * 7 + 3) % (top + 1)).alias("to")), "id", "to")


@query("r05_resolved_references", _CHAIN + " select w.id, arg_min(t.brand, w.depth) filter (t.brand is not null) as text from walk w join t on t.id = w.pos group by w.id")
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each reference shows in the end, its target's or what that refers to; cycles show what they meet."""
    return resolve_chain(tree(spark, sf_dir), "id", "up", ["brand"]).select("id", c("brand").alias("text"))


@query("w01_preorder", "with recursive " + TREE + ", p as (select id, 1 as level, [id] path from t where up is null union all select t.id, level + 1, list_append(path, t.id) from p join t on t.up = p.id) select id, level, path from p")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each node in the flattened tree, as a path of ordinals."""
    return preorder(tree(spark, sf_dir).withColumn("o", c("id")), "id", "up", "o")


@query("r08_declaring_tables", f"with {CURRENT}, d as (select distinct regexp_replace(element_path, '/w:tr.*$', '') pos from current_blocks where contains(element_path, '/w:tbl[')) select source_sha256, part_uri, element_path, arg_max(pos, length(pos)) declared from (select * from current_blocks b left join d on b.element_path = d.pos or starts_with(b.element_path, d.pos || '/')) group by all".replace("group by all", "group by 1, 2, 3"))
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each node the nearest ancestor among declared paths."""
    blocks = current_blocks(spark, sf_dir).select(*KEY)
    declared = blocks.where(c("element_path").contains("/w:tbl[")).select(F.regexp_replace("element_path", "/w:tr.*$", "").alias("at")).distinct().withColumn("v", c("at"))
    return nearest_ancestor(blocks, "element_path", declared, "at", "v", "declared").select(*KEY, "declared")


SNIPPETS = ("Weekly report", "final document", "项目还没有", "muss vor dem Druck")


@query("r09_leaked_snippets", f"with {CURRENT} select source_sha256, part_uri, element_path, list_filter({list(SNIPPETS)}, lambda s: contains(visible_text, s)) leaked from current_blocks where " + " or ".join(f"contains(visible_text, '{s}')" for s in SNIPPETS))
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that contain a forbidden snippet of six characters or more, from a configured list."""
    own = [s for s in SNIPPETS if len(s) >= 6 or not s.isascii()]
    leaked = F.filter(F.array(*map(F.lit, own)), lambda s: F.contains(c("visible_text"), s))
    return current_blocks(spark, sf_dir).select(*KEY, leaked.alias("leaked")).where(F.size("leaked") > 0)


@query("r10_dangling_hosts", f"with {CURRENT} select distinct bookmark_id, host_path from bookmarks b where source_sha256 is not null and host_path is not null and not exists (select 1 from current_blocks k where k.source_sha256 = b.source_sha256 and k.element_path = b.host_path)")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks whose host element is in no part of their package."""
    hosts = table(spark, sf_dir, "bookmarks").where("source_sha256 is not null and host_path is not null").select("bookmark_id", "source_sha256", c("host_path").alias("element_path")).distinct()
    return hosts.join(current_blocks(spark, sf_dir).select("source_sha256", "element_path"), ["source_sha256", "element_path"], "left_anti").select("bookmark_id", c("element_path").alias("host_path"))


def _merged_sql(by: str, layer: str, rows: str) -> str:
    """Leaves of layered files, and of those the ones that no later layer replaces, takes the place of or stands in."""
    return f"""with recursive f as ({rows}),
  walk(b, layer, pointer, value) as (select {by}, {layer}, '', raw_json::json from f where json_valid(raw_json)
    union all select b, layer, pointer || '/' || replace(replace(k, '~', '~0'), '/', '~1'), json_extract(value, '$."' || k || '"') from (select *, unnest(json_keys(value)) k from walk where json_type(value) = 'OBJECT')),
  l as (select distinct b, layer, pointer, value::varchar v, case json_type(value) when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end kind from walk where json_type(value) <> 'OBJECT' or len(json_keys(value)) = 0)"""


_KEPT_SQL = """, a as (select b, pointer, max(layer) own, arg_max({'k': kind, 'v': v}, layer) w, max(layer) filter (kind <> 'object') solid from kept group by all),
  d as (select a.*, (select max(x.layer) from kept x where x.b = a.b and starts_with(x.pointer, a.pointer || '/')) below, (select max(x.layer) from kept x where x.b = a.b and x.kind <> 'object' and starts_with(a.pointer, x.pointer || '/')) above from a),
  merged as (select b, pointer, w.k kind, w.v as value, own as layer from d where not (coalesce(above > own, false) or coalesce(below > own, false) or w.k = 'object' and coalesce(below > greatest(coalesce(solid, -1), coalesce(above, -1)), false)))"""


@query("m01_merged_manifests", _merged_sql("project_key", "batch_no", "select * from manifest_files where project_key is not null and batch_no is not null qualify row_number() over (partition by project_key, batch_no order by manifest_id desc) = 1") + ", kept as (select * from l)" + _KEPT_SQL + " select b project_key, pointer, kind, value, layer from merged")
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's manifests laid over each other by batch: each leaf with the batch that gave it."""
    rows = table(spark, sf_dir, "manifest_files").where("project_key is not null and batch_no is not null")
    last = latest(rows.select("project_key", "batch_no", "manifest_id", "raw_json"), ["project_key", "batch_no"], [c("manifest_id")])
    return merge_layers(json_leaves(last, ["project_key", "batch_no"], "raw_json"), ["project_key"], "batch_no")


@query(
    "r04_inherited_packages",
    _merged_sql("format_id", "file_id", "select distinct format_id, file_id, raw_json from format_files where format_id is not null")
    + ", t as (select b, min(layer) first from l group by 1), g as (select l.*, kind = 'null' and layer > first refused from l join t using (b)), kept as (select * from g where not refused)"
    + _KEPT_SQL
    + " select b format_id, pointer, kind, value, layer, null::varchar fault from merged union all select b, pointer, kind, v, layer, 'null_refused' from g where refused",
)
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format packages laid over the version before: each leaf with the version's number.

    A null of the first version is a leaf; one of a later version is refused, changes nothing and is a row with a fault.
    """
    rows = table(spark, sf_dir, "format_files").where("format_id is not null").select("format_id", "file_id", "raw_json")
    files = latest(rows, ["format_id", "file_id"], [c("raw_json")])
    marked = files.join(shuffled(spans(json_leaves(files, ["format_id", "file_id"], "raw_json"), ["format_id"], "file_id")), "format_id")
    read = lambda which: json_leaves(marked.where(which), ["format_id", "file_id", "first"], "raw_json").withColumn("refused", (c("kind") == "null") & (c("file_id") > c("first"))).drop("first")
    leaves = read("not alone")
    whole = read("alone").select("format_id", "pointer", "kind", "value", c("file_id").alias("layer"))  # nothing is laid over the only version
    merged = merge_layers(leaves.where("not refused").drop("refused"), ["format_id"], "file_id").unionByName(whole).withColumn("fault", F.lit(None).cast("string"))
    refused = leaves.where("refused").select("format_id", "pointer", "kind", "value", c("file_id").alias("layer"), F.lit("null_refused").alias("fault"))
    return merged.unionByName(refused)


def _whole_sql(path: str) -> str:
    at = f"json_extract(j, '{path}')"
    text = f"nullif(regexp_extract(case when json_type({at}) in ('VARCHAR', 'DOUBLE', 'UBIGINT', 'BIGINT') then json_extract_string(j, '{path}') end, '^[ \"]*[vV]?(-?[0-9]{{1,10}})(\\.0+)?[ \"]*$', 1), '')"
    return f"try_cast({text} as int)"


def _filled(path: str) -> str:
    return f"coalesce(json_type(j, '{path}'), 'NULL') <> 'NULL'"


def _renamed(old: str, new: str) -> str:
    return f"case when {_filled('$.' + old)} and not {_filled('$.' + new)} then 'rename {new}' end"


def _cast(path: str) -> str:
    """The step of a whole number: none for one as it is."""
    raw = f"json_extract(j, '$.{path}')"
    return f"case when {_filled('$.' + path)} and not (json_type({raw}) in ('UBIGINT', 'BIGINT') and {_whole_sql('$.' + path)} is not null) then case when {_whole_sql('$.' + path)} is null then 'reject {path} ' || {raw}::varchar else 'cast {path}' end end, case when {_whole_sql('$.' + path)} is null then 'default {path}' end"


_TEXT = "case when json_type(j, '{0}') in ('OBJECT', 'ARRAY') then null else json_extract_string(j, '{0}') end"
_MIGRATED = f"""with m as (select distinct manifest_id, raw_json::json j from manifest_files where json_valid(raw_json) and json_type(raw_json) = 'OBJECT'),
  d as (select manifest_id, case when json_type(j, '$.output.documents') = 'ARRAY' then json_extract(j, '$.output.documents[*]') when json_type(j, '$.output.compiled_document') = 'VARCHAR' then [json_object('id', 'main', 'filename', json_extract(j, '$.output.compiled_document'))] else [] end docs,
    json_type(j, '$.output.documents') = 'ARRAY' and len(list_filter(json_extract(j, '$.output.documents[*]'), lambda x: coalesce(json_type(x, '$.parts'), '') <> 'ARRAY')) = 0 as kept from m)"""


@query(
    "m03_migrated_manifests",
    _MIGRATED
    + f""" select manifest_id, coalesce({_whole_sql("$.schema_version")}, 2) schema_version, {_TEXT.format("$.project_name")} project_name, coalesce({_TEXT.format("$.cover.main_title")}, {_TEXT.format("$.cover.title")}) main_title, coalesce({_TEXT.format("$.cover.author")}, {_TEXT.format("$.cover.prepared_by")}) author,
      case when json_type(j, '$.cover.date') = 'OBJECT' then array_to_string(list_transform(list_filter([json_extract_string(j, '$.cover.date.year'), json_extract_string(j, '$.cover.date.month'), json_extract_string(j, '$.cover.date.day')], lambda x: x is not null), lambda x: case when length(x) < 2 then '0' || x else x end), '-') else {_TEXT.format("$.cover.date")} end cover_date,
      coalesce({_TEXT.format("$.source.file")}, {_TEXT.format("$.source.path")}) source_file, coalesce({_whole_sql("$.toc_depth")}, 3) toc_depth,
      list_filter([{_renamed("cover.title", "cover.main_title")}, {_renamed("cover.prepared_by", "cover.author")}, {_renamed("fonts.heading_1", "fonts.h1")}, {_renamed("fonts.text", "fonts.body")}, {_renamed("source.path", "source.file")}, {_cast("schema_version")}, {_cast("toc_depth")}, case when json_type(j, '$.cover.date') = 'OBJECT' then 'cast cover.date' end, case when not coalesce(kept, false) then 'documents output.documents' end], lambda x: x is not null) steps
      from m join d using (manifest_id)""",
)
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed columns of manifests in the latest form and the steps that brought each there."""
    return consistent_manifests(table(spark, sf_dir, "manifest_files")).drop("producer_id", "project_key", "batch_no", "documents", "rest")


@query(
    "m03_migrated_documents",
    _MIGRATED
    + """ select manifest_id, (ord - 1)::int ord, json_extract_string(x, '$.id') id, json_extract_string(x, '$.filename') filename,
      case json_type(x, '$.parts') when 'VARCHAR' then list_filter(list_transform(string_split(json_extract_string(x, '$.parts'), ','), lambda p: trim(p)), lambda p: p <> '') when 'ARRAY' then list_transform(list_filter(json_extract(x, '$.parts[*]'), lambda p: json_type(p) = 'VARCHAR'), lambda p: json_extract_string(p, '$')) else ['cover', 'toc', 'body'] end parts
      from (select manifest_id, unnest(docs) x, generate_subscripts(docs, 1) ord from d)""",
)
def m03_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries of manifests in the latest form, one row each, with the parts each has."""
    made = consistent_manifests(table(spark, sf_dir, "manifest_files"))
    return made.select("manifest_id", F.posexplode("documents").alias("ord", "d")).select("manifest_id", "ord", c("d.id").alias("id"), c("d.filename").alias("filename"), c("d.parts").alias("parts"))


@query("m04_decision_starters", f"with {CURRENT} select source_sha256, coalesce(p_style_id, '') as style, case when count(*) > 1 then 'pending' else 'skip' end decision from current_blocks group by all")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A starting decision for each style of a document: pending, or skipped if used once."""
    return current_blocks(spark, sf_dir).groupBy("source_sha256", F.coalesce("p_style_id", F.lit("")).alias("style")).agg(F.when(F.count(F.lit(1)) > 1, "pending").otherwise("skip").alias("decision"))


@query("m05_page_setups", "select distinct file_id, case when json_valid(raw_json) then coalesce(try_cast(json_extract_string(raw_json, '$.page.width_mm') as double), try_cast(json_extract_string(raw_json, '$.page.width_mm.value') as double)) / 10 end width_cm, case when json_valid(raw_json) then json_extract_string(raw_json, '$.page.orientation') end orientation from format_files")
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's page in the units of old configurations."""
    raw = F.try_parse_json("raw_json").cast("string")
    get = lambda p: F.get_json_object(raw, p)
    width = F.coalesce(get("$.page.width_mm").try_cast("double"), get("$.page.width_mm.value").try_cast("double"))
    return table(spark, sf_dir, "format_files").select("file_id", (width / 10).alias("width_cm"), get("$.page.orientation").alias("orientation")).distinct()


@query("m06_part_registry", "select distinct manifest_id, json_extract_string(d, '$.id') part_id, json_extract_string(d, '$.filename') filename from manifest_files, unnest(case when json_valid(raw_json) and json_type(raw_json, '$.output.documents') = 'ARRAY' then json_extract(raw_json, '$.output.documents[*]') else [] end) u(d)")
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries that manifests declare, as typed rows."""
    rows = table(spark, sf_dir, "manifest_files").select("manifest_id", F.from_json(F.get_json_object(F.try_parse_json("raw_json").cast("string"), "$.output.documents"), "array<struct<id: string, filename: string>>").alias("d"))
    return rows.select("manifest_id", F.explode("d").alias("d")).select("manifest_id", c("d.id").alias("part_id"), c("d.filename").alias("filename")).distinct()


@query(
    "m07_changed_inputs",
    "with p as (select source_sha256, part_uri, element_path, min(recorded_at) a, arg_min(text_hash, {'a': recorded_at, 'b': text_hash}) x, arg_max(text_hash, {'a': recorded_at, 'b': text_hash}) y from blocks where text_hash is not null group by all) select source_sha256, part_uri, element_path, x as planned, y as now from p where x <> y",
)
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose hash is no longer what was first recorded."""
    order = F.struct("recorded_at", "text_hash")
    both = table(spark, sf_dir, "blocks").where("text_hash is not null").groupBy(*KEY).agg(F.min_by("text_hash", order).alias("planned"), F.max_by("text_hash", order).alias("now"))
    return both.where("planned <> now")


@query("m08_public_plan", f"with {CURRENT} select source_sha256, part_uri, element_path, structure_type, outline_level, text_hash from current_blocks")
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan without any prose."""
    return current_blocks(spark, sf_dir).select(*KEY, "structure_type", "outline_level", "text_hash")


@query(
    "m09_format_report",
    f"with {CURRENT}, a as (select distinct source_sha256, part_uri, element_path, role, level from role_assignments where role is not null), x as (select b.source_sha256, unnest(['outline_level', 'style']) attribute, unnest([coalesce(a.level, -1) = coalesce(b.outline_level, -1), (a.role = 'title') = coalesce(b.p_style_name = 'Title', false)]) ok from a join current_blocks b on a.source_sha256 = b.source_sha256 and a.part_uri = b.part_uri and a.element_path = b.element_path) select source_sha256, attribute, count(*) n, count_if(not ok)::bigint violations, count_if(not ok) = 0 passed from x group by all",
)
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual attributes of assigned blocks, by document and attribute."""
    roles = table(spark, sf_dir, "role_assignments").where("role is not null").select(*KEY, "role", "level").distinct()
    joined = roles.join(current_blocks(spark, sf_dir).select(*KEY, "outline_level", "p_style_name"), KEY)
    level = F.coalesce("level", F.lit(-1)) == F.coalesce("outline_level", F.lit(-1))
    title = (c("role") == "title") == F.coalesce(c("p_style_name") == "Title", F.lit(False))
    rows = joined.select("source_sha256", F.explode(F.array(F.struct(F.lit("outline_level").alias("attribute"), level.alias("ok")), F.struct(F.lit("style").alias("attribute"), title.alias("ok")))).alias("x"))
    return rows.groupBy("source_sha256", "x.attribute").agg(F.count(F.lit(1)).alias("n"), F.count_if(~c("x.ok")).alias("violations")).withColumn("passed", c("violations") == 0)


_VIOLATIONS = f"select 'missing_content' kind, source_sha256 subject, norm detail from ({SQL['u02_missing_content']}) union all select fault, source_sha256, name from ({SQL['u06_structure_faults']}) union all select fault, assignment_id::varchar, null from ({SQL['j01_assignment_faults']})"


@query("m10_integrity_violations", _VIOLATIONS)
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations of content checks in one table, not the first only."""
    from sheaf.plans.joins import j01, u06

    missing = u02(spark, sf_dir).select(F.lit("missing_content").alias("kind"), c("source_sha256").alias("subject"), c("norm").alias("detail"))
    faults = u06(spark, sf_dir).select(c("fault").alias("kind"), c("source_sha256").alias("subject"), c("name").alias("detail"))
    nodes = j01(spark, sf_dir).select(c("fault").alias("kind"), c("assignment_id").cast("string").alias("subject"), F.lit(None).cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, (missing, faults, nodes))


@query("m11_verification_context", f"with {CURRENT}, m as (select distinct source_sha256, part_uri, element_path, 1 hit from role_assignments) select b.source_sha256, count(*) expected, count(hit) mapped, count(*) - count(hit) missing from current_blocks b left join m on b.source_sha256 = m.source_sha256 and b.part_uri = m.part_uri and b.element_path = m.element_path where b.source_sha256 is not null group by all")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and mapped nodes of each document, and those never mapped."""
    expected = j11(spark, sf_dir).select(*KEY)
    mapped = distinct_rows(spark, sf_dir, "role_assignments", *KEY).withColumn("hit", F.lit(1))
    return expected.join(mapped, KEY, "left").groupBy("source_sha256").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("mapped"), (F.count(F.lit(1)) - F.count("hit")).alias("missing"))
