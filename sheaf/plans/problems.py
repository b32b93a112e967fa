"""Queries of the data problems: orphan references, nested files, drifting schemas, two copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.copies import copy_balance, copy_differences, inventory_fields
from sheaf.operators.drift import consistent_manifests, schema_changes, schema_versions
from sheaf.operators.nesting import FORMAT, LABEL_TYPES, MANIFEST, RULES, TYPED, flat_objects, label_table, labelled_objects, labels, typed_table
from sheaf.operators.references import Parents, References, orphan_references
from sheaf.plans.registry import query
from sheaf.session import table

_CASES_SQL = """
with refs as (
  select 'field_observations' ref_table, 'target' ref_field, obs_id record_id, observed_at ts, source_sha256 s, 'bookmarks' p, '' u, target k from field_observations
  union all select 'role_assignments', 'bookmark_name', assignment_id, assigned_at, source_sha256, 'bookmarks', '', bookmark_name from role_assignments
  union all select 'role_assignments', 'element_path', assignment_id, assigned_at, source_sha256, 'blocks', part_uri, element_path from role_assignments),
parents as (
  select 'bookmarks' p, source_sha256 s, '' u, bookmark_name k, created_at o, removed_at c from bookmarks
  union all select 'blocks', source_sha256, part_uri, element_path, recorded_at, deleted_at from blocks),
cases as (
  select distinct ref_table, ref_field, record_id, strftime(ts, '%Y-%m') ref_month,
    case when exists (select 1 from parents q where q.p = r.p and q.s = r.s and q.u = r.u and q.k = r.k and q.o <= r.ts and (q.c is null or q.c > q.o)) then 'deleted'
         when exists (select 1 from parents q where q.p = r.p and q.s = r.s and q.u = r.u and q.k = r.k and q.o is not null and (q.c is null or q.c > q.o)) then 'late' else 'missing' end status
  from refs r where s is not null and u is not null and k is not null and ts is not null
    and not exists (select 1 from parents q where q.p = r.p and q.s = r.s and q.u = r.u and q.k = r.k and q.o <= r.ts and (q.c is null or q.c > r.ts)))
"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, roles = table(spark, sf_dir, "field_observations"), table(spark, sf_dir, "role_assignments")
    return orphan_references(
        [
            References("field_observations", "target", fields, "obs_id", "observed_at", ("source_sha256", "target"), "bookmarks"),
            References("role_assignments", "bookmark_name", roles, "assignment_id", "assigned_at", ("source_sha256", "bookmark_name"), "bookmarks"),
            References("role_assignments", "element_path", roles, "assignment_id", "assigned_at", ("source_sha256", "part_uri", "element_path"), "blocks"),
        ],
        [
            Parents("bookmarks", table(spark, sf_dir, "bookmarks"), ("source_sha256", "bookmark_name"), "created_at", "removed_at"),
            Parents("blocks", table(spark, sf_dir, "blocks"), ("source_sha256", "part_uri", "element_path"), "recorded_at", "deleted_at"),
        ],
    )


@query("p1_found", _CASES_SQL + "select ref_table, ref_field, record_id, ref_month from cases")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a row valid at their time."""
    return _cases(spark, sf_dir).where("status <> 'undated'").select("ref_table", "ref_field", "record_id", "ref_month")


@query("p1_report", _CASES_SQL + "select ref_table, ref_field, ref_month, status, count(*) n_references from cases group by all")
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, month and status."""
    return _cases(spark, sf_dir).groupBy("ref_table", "ref_field", "ref_month", "status").agg(F.count(F.lit(1)).alias("n_references"))


#: Trees written as strings of JSON are opened; roles and variants are found by where they stand.
_OBJECTS_SQL = r"""
with trees as (
  select manifest_id, case json_type(raw_json, '$.source.tree') when 'VARCHAR' then json_extract_string(raw_json, '$.source.tree')::json else json_extract(raw_json, '$.source.tree') end tree
  from (select distinct manifest_id, raw_json from manifest_files where json_valid(raw_json))),
nodes as (
  select manifest_id, '/source/tree' || regexp_replace(replace(replace(fullkey[2:], '[', '/'), ']', ''), '\.', '/', 'g') pointer, value from (select manifest_id, tree from trees where json_type(tree) = 'ARRAY') x, json_tree(x.tree) t
  where t.type = 'OBJECT' and regexp_matches(fullkey, '^\$\[\d+\](\.children(\[\d+\])?)*$')),
parts as (
  select file_id, '/roles/' || regexp_replace(regexp_replace(replace(replace(regexp_replace(fullkey[3:], '"([^"]*)"', '\1'), '[', '/'), ']', ''), '\.variants/', '/variants/', 'g'), '^\.', '') pointer, t.type, t.value
  from (select distinct file_id, raw_json from format_files where json_valid(raw_json)) x, json_tree(json_extract(x.raw_json, '$.roles')) t
  where regexp_matches(fullkey, '^\$\.("[^"]*"|[^."\[]+)(\.variants\[\d+\])*$'))
--
select distinct 'manifest_files' file_table, manifest_id file_id, pointer node_pointer, case when regexp_matches(pointer, '/children') then regexp_replace(pointer, '/children(/\d+)?$', '') else '' end parent_pointer from nodes where json_type(value, '$.title') is not null and json_type(value, '$.title') <> 'NULL'
union select 'format_files', file_id, pointer, case when contains(pointer, '/variants/') then regexp_replace(pointer, '/variants/\d+$', '') else '' end from parts where type = 'VARCHAR' or type = 'OBJECT' and coalesce(json_type(value, '$.style'), 'NULL') <> 'NULL'
union select 'format_files', file_id, '/page', '' from format_files where json_valid(raw_json) and coalesce(json_type(raw_json, '$.page.width_mm'), 'NULL') <> 'NULL'
"""


@query("p3_found", _OBJECTS_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline nodes, roles, variants and pages with a label, each with its place and its parent's."""
    return labelled_objects(table(spark, sf_dir, "manifest_files"), table(spark, sf_dir, "format_files"))


_KINDS_SQL = "case {0} when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else case when {0} is null then 'absent' else 'number' end end"
_HELD_SQL = {"string": "type = 'VARCHAR'", "int": "type in ('UBIGINT', 'BIGINT')", "double": "type in ('UBIGINT', 'BIGINT', 'DOUBLE')", "boolean": "type = 'BOOLEAN'"}
#: The objects of each kind with their JSON (a role written as a string as that string), and the parts that they may hold.
_SOURCES_SQL = {
    "outline_node": ("select manifest_id file_id, pointer, case when contains(pointer, '/children') then regexp_replace(pointer, '/children(/\\d+)?$', '') else '' end up, (length(pointer) - length(replace(pointer, '/children', ''))) // 9 depth, value v from nodes", ("children",)),
    "outline_rule": ("select manifest_id file_id, pointer || '/outline_rules/' || (unnest(range(json_array_length(value, '$.outline_rules')::bigint))) pointer, pointer up, (length(pointer) - length(replace(pointer, '/children', ''))) // 9 + 1 depth, unnest(json_extract(value, '$.outline_rules[*]')) v from nodes where json_type(value, '$.outline_rules') = 'ARRAY'", ()),
    "page": ("select file_id, '/page' pointer, '' up, 0 depth, json_extract(raw_json, '$.page') v from (select distinct file_id, raw_json from format_files where json_valid(raw_json) and json_type(raw_json, '$.page') = 'OBJECT')", ()),
    "role": ("select file_id, pointer, '' up, 0 depth, value v from parts where not contains(pointer, '/variants/') and type in ('OBJECT', 'VARCHAR')", ("variants",)),
    "variant": ("select file_id, pointer, regexp_replace(pointer, '/variants/\\d+$', '') up, (length(pointer) - length(replace(pointer, '/variants/', ''))) // 10 depth, value v from parts where contains(pointer, '/variants/') and type = 'OBJECT'", ("variants",)),
}


def _typed_sql(what: str, label: str | None = None) -> str:
    """The typed table of a kind, or of its variants with one type of label."""
    rows, nested = _SOURCES_SQL[what]
    own = TYPED[what] | ({labels()[what]: LABEL_TYPES[label]} if label else {})
    name = labels()[what]
    shape = _KINDS_SQL.format(f"json_type(v, '$.{name}')") + "".join(f" || case json_type(v, '$.{p}') when 'OBJECT' then '+{p}:single' when 'ARRAY' then case when json_array_length(v, '$.{p}') > 0 then '+{p}:list' else '+{p}:empty' end else '' end" for p in nested)
    text = lambda c: f"case when json_type(v, '$.{c}') not in ('OBJECT', 'ARRAY') then json_extract_string(v, '$.{c}') end"
    column = {c: f"case when json_type(v) = 'VARCHAR' then json_extract_string(v, '$') else {text(c)} end" if what == "role" and c == name else text(c) for c in own}
    if what == "page":
        column |= {"width_mm": f"coalesce({text('width_mm')}, json_extract_string(v, '$.width_mm.value'))", "width_unit": f"coalesce({text('width_unit')}, json_extract_string(v, '$.width_mm.unit'))"}
    held = " or ".join(f"key = '{c}' and {_HELD_SQL[t]}" for c, t in TYPED[what].items()) + "".join(f" or key = '{p}' and type in ('OBJECT', 'ARRAY')" for p in nested)
    rest = f"case when json_type(v) = 'OBJECT' then (select '{{' || coalesce(string_agg(to_json(key)::varchar || ':' || value::varchar, ',' order by key), '') || '}}' from json_each(x.v) where type <> 'NULL' and not ({held})) else '{{}}' end"
    made = f"select distinct file_id, pointer node_pointer, up parent_pointer, case when json_type(v) = 'VARCHAR' then 'plain' else {shape} end variant, depth::int depth, {', '.join(f'try_cast({column[c]} as {t}) "{c}"' for c, t in own.items())}, {rest} rest from ({rows}) x where json_type(v) in ('OBJECT', 'VARCHAR')"
    return _OBJECTS_SQL.split("--")[0] + (f"select * from ({made}) where string_split(variant, '+')[1] = '{label}'" if label else made)


def _register_typed() -> None:
    """The table of each kind, and of those of its variants that have a label of one type."""
    for what, name, file_id, states in (("outline_node", "manifest_files", "manifest_id", MANIFEST), ("outline_rule", "manifest_files", "manifest_id", RULES), *((k, "format_files", "file_id", FORMAT) for k in ("page", "role", "variant"))):
        flat = lambda spark, sf_dir, name=name, file_id=file_id, states=states: flat_objects(table(spark, sf_dir, name), file_id, "raw_json", states)
        query(f"p3_{what}s", _typed_sql(what))(lambda spark, sf_dir, what=what, flat=flat: typed_table(flat(spark, sf_dir), what))
        for label in {"page": ("number", "string", "object"), "role": ("plain", "string")}.get(what, ("string",)):
            query(f"p3_{what}s_{label}", _typed_sql(what, label))(lambda spark, sf_dir, what=what, label=label, flat=flat: label_table(flat(spark, sf_dir), what, label))


_register_typed()


_CHANGES_SQL = r"""
with files as (select distinct producer_id, batch_no, project_key, raw_json from manifest_files where json_valid(raw_json) and producer_id is not null and batch_no is not null),
leaves as (
  select distinct producer_id, batch_no, project_key, regexp_replace(fullkey[3:], '\[\d+\]', '[]', 'g') path,
    case t.type when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'BOOLEAN' then 'boolean' else 'number' end kind, case when t.type not in ('OBJECT', 'ARRAY') then t.atom::varchar end atom
  from files f, json_tree(f.raw_json) t where t.type <> 'NULL' and fullkey <> '$' and not regexp_matches(fullkey, '\."?_comment') and not regexp_matches(fullkey, '^\$\.source\.tree($|[.\[])')),
batches as (select producer_id, batch_no, lag(batch_no) over (partition by producer_id order by batch_no) earlier from (select distinct producer_id, batch_no from files)),
prints as (select producer_id, batch_no, path, list_sort(list(distinct kind)) kinds from leaves group by all),
sides as (
  select b.producer_id, b.batch_no, b.earlier, p.path, p.kinds before, null::varchar[] after from batches b join prints p on p.producer_id = b.producer_id and p.batch_no = b.earlier
  union all select b.producer_id, b.batch_no, b.earlier, p.path, null, p.kinds from batches b join prints p on p.producer_id = b.producer_id and p.batch_no = b.batch_no where b.earlier is not null),
changed as (select producer_id, batch_no, earlier, path, max(before) before, max(after) after from sides group by all having max(before) is distinct from max(after)),
vals as (select producer_id, batch_no, project_key, path, list_sort(list(distinct kind || ':' || atom)) v from leaves where atom is not null and not contains(path, '[]') and project_key is not null group by all),
there as (select distinct producer_id, batch_no, project_key from files),
olds as (select c.producer_id, c.batch_no, c.path, v.project_key, v.v from changed c join vals v on v.producer_id = c.producer_id and v.batch_no = c.earlier and v.path = c.path join there t on t.producer_id = c.producer_id and t.batch_no = c.batch_no and t.project_key = v.project_key where c.after is null),
news as (select c.producer_id, c.batch_no, c.path, v.project_key, v.v from changed c join vals v on v.producer_id = c.producer_id and v.batch_no = c.batch_no and v.path = c.path where c.before is null),
renamed as (
  select producer_id, batch_no, old_path, new_path from (select o.producer_id, o.batch_no, o.path old_path, n.path new_path, count(*) kept from olds o join news n using (producer_id, batch_no, project_key, v) group by all)
  join (select producer_id, batch_no, path old_path, count(*) needed from olds group by all) using (producer_id, batch_no, old_path) where kept = needed)
select producer_id, batch_no, 'renamed' change_kind, old_path, new_path from renamed
union all select producer_id, batch_no, 'removed', path, '' from changed c where after is null and not exists (select 1 from renamed r where r.producer_id = c.producer_id and r.batch_no = c.batch_no and r.old_path = c.path)
union all select producer_id, batch_no, 'added', '', path from changed c where before is null and not exists (select 1 from renamed r where r.producer_id = c.producer_id and r.batch_no = c.batch_no and r.new_path = c.path)
union all select producer_id, batch_no, 'retyped', path, path from changed where before is not null and after is not null
"""


@query("p4_found", _CHANGES_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of schema from batch to batch of a producer."""
    return schema_changes(table(spark, sf_dir, "manifest_files"))


_VERSIONS_SQL = (
    _CHANGES_SQL[: _CHANGES_SQL.index("sides as (")]
    + """made as (select f.producer_id, f.batch_no, md5(coalesce(string_agg(p.path || ':' || array_to_string(p.kinds, ','), chr(10) order by p.path || ':' || array_to_string(p.kinds, ',')), '')) fingerprint, count(p.path) n_paths from (select distinct producer_id, batch_no from files) f left join prints p using (producer_id, batch_no) group by all)
    select producer_id, batch_no, version, fingerprint, n_paths from made join (select producer_id, fingerprint, row_number() over (partition by producer_id order by b)::int as version from (select producer_id, fingerprint, min(batch_no) b from made group by all)) using (producer_id, fingerprint)"""
)


@query("p4_versions", _VERSIONS_SQL)
def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema's version in each batch of a producer, by its fingerprint."""
    return schema_versions(table(spark, sf_dir, "manifest_files"))


@query("p4_table")
def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All manifests in one form, each with the steps that brought it there."""
    files = table(spark, sf_dir, "manifest_files")
    return consistent_manifests(files, schema_changes(files))


_FORMS_SQL = """
    case when paragraph_counts is not null then list_sort(list_transform(list_filter(map_entries(paragraph_counts), lambda x: x.value is null or x.value <> 0), lambda x: x.key || chr(0) || coalesce(x.value::varchar, '-'))) end c,
    case when media_hashes is not null then list_sort(list_distinct(list_transform(media_hashes, lambda x: lower(x)))) end m,
    list_sort(missing_occurrences) o, paragraph_total t"""
_COPY_SQL = """
with both_copies as (select 'a' side, * from (select distinct * from inventory_prepared) union all by name select 'b' side, * from (select distinct * from inventory_delivered)),
latest as (
  select distinct side, inv_id, """ + _FORMS_SQL + """
  from both_copies where inv_id is not null
  qualify extracted_at is not distinct from max(extracted_at) over (partition by side, inv_id)),
paired as (select coalesce(a.inv_id, b.inv_id) inv_id, a.inv_id ia, b.inv_id ib, a.c ac, b.c bc, a.m am, b.m bm, a.o ao, b.o bo, a.t at_, b.t bt
  from (select * from latest where side = 'a') a full join (select * from latest where side = 'b') b on a.inv_id = b.inv_id),
found as (
  select inv_id, 'row' field_name, case when ib is null then 'only_prepared' else 'only_delivered' end diff_kind from paired where ia is null or ib is null
  union select inv_id, 'paragraph_counts', 'differs' from paired where ia = ib and ac is distinct from bc
  union select inv_id, 'media_hashes', 'differs' from paired where ia = ib and am is distinct from bm
  union select inv_id, 'missing_occurrences', 'differs' from paired where ia = ib and ao is distinct from bo
  union select inv_id, 'paragraph_total', 'differs' from paired where ia = ib and at_ is distinct from bt)
"""


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_differences(table(spark, sf_dir, "inventory_prepared"), table(spark, sf_dir, "inventory_delivered"), "inv_id", inventory_fields(), "extracted_at", ("prepared", "delivered"))


@query("p5_found", _COPY_SQL + "select inv_id, field_name, diff_kind from found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories in one copy only, and every field that differs between the copies."""
    return _differences(spark, sf_dir)


@query("p5_report", _COPY_SQL + "select field_name, diff_kind, count(*) n_inventories from found group by all")
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many inventories differ in each field."""
    return _differences(spark, sf_dir).groupBy("field_name", "diff_kind").agg(F.count(F.lit(1)).alias("n_inventories"))


#: Every order of the larger side's rows is tried for the smaller side's, which keys of a few rows bear.
_BALANCE_SQL = f"""
with recursive r as (select 'a' side, inv_id, {_FORMS_SQL} from (select distinct * from inventory_prepared) union all select 'b', inv_id, {_FORMS_SQL} from (select distinct * from inventory_delivered)),
counted as (select inv_id, c, m, o, t, count(*) filter (side = 'a') na, count(*) filter (side = 'b') nb from r where inv_id is not null group by all),
keys as (select inv_id, sum(least(na, nb)) cancelled, sum(greatest(na - nb, 0)) la, sum(greatest(nb - na, 0)) lb from counted group by 1 having sum(na) > 0 and sum(nb) > 0),
opened as (select inv_id, c, m, o, t, 'a' side, unnest(range(na - nb)) from counted where na > nb union all select inv_id, c, m, o, t, 'b', unnest(range(nb - na)) from counted where nb > na),
sided as (select o.*, (o.side = 'a') = (k.la <= k.lb) small, row_number() over (partition by inv_id, side) i from opened o join keys k using (inv_id)),
walk(inv_id, i, used, cost) as (
  select inv_id, 0::bigint, []::bigint[], 0 from keys
  union all select w.inv_id, a.i, list_append(w.used, b.i), w.cost + (a.c is distinct from b.c)::int + (a.m is distinct from b.m)::int + (a.o is distinct from b.o)::int + (a.t is distinct from b.t)::int
  from walk w join sided a on a.inv_id = w.inv_id and a.small and a.i = w.i + 1 join sided b on b.inv_id = w.inv_id and not b.small and not list_contains(w.used, b.i))
select k.inv_id, k.cancelled::bigint n_cancelled, least(k.la, k.lb)::bigint n_pairs, (select min(cost) from walk w where w.inv_id = k.inv_id and w.i = least(k.la, k.lb))::bigint n_differing, abs(k.la - k.lb)::bigint n_surplus from keys k
"""


@query("p5_pairs", _BALANCE_SQL)
def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of each inventory, paired between the copies so that the pairs differ in the fewest fields."""
    return copy_balance(table(spark, sf_dir, "inventory_prepared"), table(spark, sf_dir, "inventory_delivered"), "inv_id", inventory_fields())
