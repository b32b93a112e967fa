"""Queries of joins by key, place, interval and occurrence, and of bag comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import scalars as S
from sheaf.operators.matching import bag_difference, by_occurrence, greedy_matches, latest_before, overlay
from sheaf.operators.windows import latest, numbered, ranked_position, text_position
from sheaf.plans.aggregates import CLUSTERS, FONTS, a03, found_clusters, style_fonts
from sheaf.plans.carriers import CURRENT, current_blocks, distinct_rows, drawn_blocks
from sheaf.plans.registry import query
from sheaf.plans.scalars import SP
from sheaf.plans.windows import ORDERED, ordered, w16
from sheaf.session import table

c = F.col
KEY = ["source_sha256", "part_uri", "element_path"]
_ON = "a.source_sha256 = b.source_sha256 and a.part_uri = b.part_uri and a.element_path = b.element_path"
ASSIGNED = "assigned as (select distinct * from role_assignments)"


def assigned(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return distinct_rows(spark, sf_dir, "role_assignments", "assignment_id", *columns)


@query(
    "j01_assignment_faults",
    f"""with {CURRENT}, {ASSIGNED} select assignment_id, 'unknown_node' fault from assigned a where source_sha256 is not null and part_uri is not null and element_path is not null and not exists (select 1 from current_blocks b where {_ON})
    union all select assignment_id, 'stale_text' from assigned a join current_blocks b on {_ON} where a.text_hash <> b.text_hash
    union all select assignment_id, 'duplicate_bookmark' from assigned a where bookmark_name is not null and source_sha256 is not null and exists (select 1 from assigned d where d.source_sha256 = a.source_sha256 and d.bookmark_name = a.bookmark_name and d.assignment_id <> a.assignment_id)""",
)
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments to unknown nodes, of changed texts, or with a bookmark used twice."""
    rows, blocks = assigned(spark, sf_dir, *KEY, "text_hash", "bookmark_name"), current_blocks(spark, sf_dir).select(*KEY, c("text_hash").alias("now"), F.lit(True).alias("known"))
    known = reduce(lambda a, b: a & b, [c(k).isNotNull() for k in KEY])
    checked = rows.where(known).select("assignment_id", *KEY, "text_hash").join(blocks, KEY, "left")
    node = checked.select("assignment_id", F.when(c("known").isNull(), "unknown_node").when(c("text_hash") != c("now"), "stale_text").alias("fault")).where("fault is not null")
    named = rows.where("bookmark_name is not null and source_sha256 is not null").select("source_sha256", "bookmark_name", "assignment_id")
    twice = named.groupBy("source_sha256", "bookmark_name").agg(F.min("assignment_id").alias("a"), F.max("assignment_id").alias("b")).where("a <> b").select("source_sha256", "bookmark_name")
    return node.unionByName(named.join(twice, ["source_sha256", "bookmark_name"], "left_semi").select("assignment_id", F.lit("duplicate_bookmark").alias("fault")))


@query(
    "j02_role_map_coverage",
    f"""with {CURRENT}, {ASSIGNED}, n as (select source_sha256, part_uri, element_path, count(*) k from assigned group by all)
    select b.source_sha256, count(*) n_blocks, count(a.k) n_bound, count_if(a.k > 1)::bigint n_bound_twice, count(*) - count(a.k) n_uncovered from current_blocks b left join n a on {_ON} group by b.source_sha256""",
)
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each document have a role, several, or none."""
    counts = assigned(spark, sf_dir, *KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"))
    joined = current_blocks(spark, sf_dir).select(*KEY).join(counts, KEY, "left")
    return joined.groupBy("source_sha256").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("k").alias("n_bound"), F.count_if(c("k") > 1).alias("n_bound_twice"), (F.count(F.lit(1)) - F.count("k")).alias("n_uncovered"))


_VECTOR_ON = "b.source_sha256 = c.source_sha256 and b.outline_level is not distinct from c.outline_level and b.in_table = c.in_table and b.alignment is not distinct from c.alignment and b.size_pt is not distinct from c.size_pt and b.bold is not distinct from c.bold"


@query("j03_block_roles", f"with {CLUSTERS} select b.source_sha256, b.part_uri, b.element_path, c.cluster_id, coalesce(r.role, c.suggested_role, 'body') as role from drawn_blocks b join clusters c on {_VECTOR_ON} left join candidates r on r.source_sha256 = c.source_sha256 and r.cluster_id = c.cluster_id")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's cluster and the role the cluster was given; nulls of the style vector are values."""
    vector = ["outline_level", "in_table", "alignment", "size_pt", "bold"]
    blocks = drawn_blocks(spark, sf_dir).select(*KEY, F.to_json(F.struct(*vector)).alias("_key"))
    groups = found_clusters(spark, sf_dir).select("source_sha256", "_key", "cluster_id", "suggested_role")
    roles = a03(spark, sf_dir).select("source_sha256", "cluster_id", "role")
    named = groups.join(roles, ["source_sha256", "cluster_id"], "left")
    return blocks.join(named, ["source_sha256", "_key"]).select(*KEY, "cluster_id", F.coalesce("role", "suggested_role", F.lit("body")).alias("role"))


_HEADS = "heads as (select source_sha256, n, outline_level, element_path from ordered where outline_level is not null)"


def heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks = ordered(spark, sf_dir).select("source_sha256", "n", "element_path", "part_uri", "outline_level", "story_type", "p_style_name", "visible_text")
    return blocks, blocks.where("outline_level is not null").select("source_sha256", "n", c("n").alias("head"))


@query(
    "j04_latest_heading",
    f"with {ORDERED}, {_HEADS} select o.source_sha256, o.n, max(h.n) head from ordered o left join heads h on h.source_sha256 = o.source_sha256 and h.n < o.n where o.story_type <> 'body' or o.structure_type = 'section_break' group by all",
)
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For stories and breaks, the latest heading before them."""
    _, starts = heads(spark, sf_dir)
    rows = ordered(spark, sf_dir).where("story_type <> 'body' or structure_type = 'section_break'").select("source_sha256", "n", "element_path")
    return latest_before(rows, starts, ["source_sha256"], "n", "head", "head", "row").select("source_sha256", "n", "head")


@query(
    "j05_bookmark_sections",
    f"with {ORDERED}, {_HEADS}, m as (select distinct b.bookmark_id, o.source_sha256, o.n from (select distinct * from bookmarks) b join ordered o on b.source_sha256 = o.source_sha256 and b.host_path = o.element_path) select m.bookmark_id, m.source_sha256, m.n, max(h.n) section from m left join heads h on h.source_sha256 = m.source_sha256 and h.n <= m.n group by all",
)
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section - from one heading to the next - that each bookmark lies in."""
    blocks, starts = heads(spark, sf_dir)
    marks = distinct_rows(spark, sf_dir, "bookmarks", "bookmark_id", "source_sha256", "host_path").select("bookmark_id", "source_sha256", c("host_path").alias("element_path"))
    placed = marks.join(blocks.select("source_sha256", "element_path", "n"), ["source_sha256", "element_path"]).select("bookmark_id", "source_sha256", "n").distinct()
    return latest_before(placed, starts, ["source_sha256"], "n", "head", "section").select("bookmark_id", "source_sha256", "n", "section")


@query("j06_section_sizes", f"with {ORDERED}, {_HEADS}, s as (select o.source_sha256, o.n, o.visible_text, max(h.n) section from ordered o left join heads h on h.source_sha256 = o.source_sha256 and h.n <= o.n group by all) select source_sha256, section, count(*) n_blocks, sum(length(visible_text))::bigint n_chars from s group by all")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and characters of each section."""
    blocks, starts = heads(spark, sf_dir)
    owned = latest_before(blocks.select("source_sha256", "n", "visible_text"), starts, ["source_sha256"], "n", "head", "section")
    return owned.groupBy("source_sha256", "section").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("visible_text")).alias("n_chars"))


def contents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected paragraphs by inventory and the texts of current blocks, both by normal text."""
    norm = lambda x: S.delete_space(c(x))
    items = distinct_rows(spark, sf_dir, "inventory_items", "item_id", "item_ord", "source", "kind", "content").where("kind = 'paragraph'").select(c("source").alias("source_sha256"), "item_id", c("item_ord").cast("long").alias("item_ord"), norm("content").alias("norm")).where(F.length("norm") > 1)
    blocks = ordered(spark, sf_dir).select("source_sha256", "n", norm("visible_text").alias("norm")).where(F.length("norm") > 1)
    return items, blocks


#: One expected row after the other, each with the first actual row of its key behind the last match.
_GREEDY = "with recursive " + ", ".join(
    f"{side} as (select inv_id, unnest(missing_occurrences) occurrence, generate_subscripts(missing_occurrences, 1) - 1 place from (select * from (select distinct inv_id, extracted_at, missing_occurrences from {name}) qualify row_number() over (partition by inv_id order by extracted_at desc nulls last, to_json(missing_occurrences)::varchar desc nulls last) = 1))"
    for side, name in (("e", "inventory_prepared"), ("a", "inventory_delivered"))
) + """, walk(inv_id, place, occurrence, matched, back) as (
  select distinct inv_id, -1::bigint, null::varchar, null::bigint, -1::bigint from e
  union all select w.inv_id, e.place, e.occurrence, min(a.place), coalesce(min(a.place), w.back) from walk w join e on e.inv_id = w.inv_id and e.place = w.place + 1 left join a on a.inv_id = w.inv_id and a.occurrence = e.occurrence and a.place > w.back group by w.inv_id, e.place, e.occurrence, w.back)"""


@query("j07_greedy_matches", _GREEDY + " select inv_id, place, occurrence, matched from walk where place >= 0")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered paragraph keys matched in order, each with the first one behind the match before."""
    pages = lambda name: distinct_pairs(spark, sf_dir, name)
    return greedy_matches(pages("inventory_prepared"), pages("inventory_delivered"), "inv_id", "occurrence", "place")


def distinct_pairs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select("inv_id", "extracted_at", "missing_occurrences").distinct()
    return latest(rows, ["inv_id"], [c("extracted_at"), F.to_json("missing_occurrences")]).select("inv_id", F.posexplode("missing_occurrences").alias("place", "occurrence")).withColumn("place", c("place").cast("long"))


@query(
    "j08_occurrence_pairs",
    """with i as (select item_id, source, fingerprint, row_number() over (partition by source, fingerprint order by item_ord, item_id) k from (select distinct * from inventory_items) where source is not null and fingerprint is not null),
    a as (select assignment_id, source_sha256 source, text_hash fingerprint, row_number() over (partition by source_sha256, text_hash order by assignment_id) k from (select distinct * from role_assignments) where source_sha256 is not null and text_hash is not null)
    select coalesce(i.source, a.source) source, coalesce(i.fingerprint, a.fingerprint) fingerprint, coalesce(i.k, a.k) k, item_id left_id, assignment_id right_id from i full join a on i.source = a.source and i.fingerprint = a.fingerprint and i.k = a.k""",
)
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and assignments paired by the ordinal of their text; what is left over stays single."""
    items = distinct_rows(spark, sf_dir, "inventory_items", "item_id", "item_ord", "source", "fingerprint").where("fingerprint is not null and source is not null")
    roles = assigned(spark, sf_dir, "source_sha256", "text_hash").select(c("source_sha256").alias("source"), c("text_hash").alias("fingerprint"), "assignment_id").where("fingerprint is not null and source is not null")
    return by_occurrence(items, roles, ["source", "fingerprint"], ["item_ord", "item_id"], ["assignment_id"], "item_id", "assignment_id", "item_ord", "assignment_id")


_SPANS = """spans as (select source_sha256, element_path, part_uri, e - coalesce(length(visible_text), 0) span_start, e span_end from (select *, (sum(coalesce(length(visible_text), 0)) over (partition by source_sha256 order by block_ord, part_uri, element_path))::bigint e from current_blocks where source_sha256 is not null)),
  tiles as (select source_sha256, unnest(range(0, t, 500)) span_start, t from (select source_sha256, max(span_end) t from spans group by 1))"""


@query(
    "j09_span_overlay",
    f"with {CURRENT}, {_SPANS} select s.source_sha256, greatest(s.span_start, t.span_start) span_start, least(s.span_end, t.span_start + 500, t.t) span_end, s.part_uri || s.element_path value_one, 'tile-' || (t.span_start // 500) value_two from spans s join tiles t on s.source_sha256 = t.source_sha256 and s.span_start < least(t.span_start + 500, t.t) and t.span_start < s.span_end and s.span_start < s.span_end",
)
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text spans of blocks laid over tiles of 500 characters: every elementary interval with what covers it."""
    spans = w16(spark, sf_dir).select("source_sha256", "span_start", "span_end", F.concat("part_uri", "element_path").alias("v"))
    total = spans.groupBy("source_sha256").agg(F.max("span_end").alias("t")).where("t > 0")
    tiles = total.select("source_sha256", "t", F.explode(F.sequence(F.lit(0), F.floor((c("t") - 1) / 500).cast("long"))).alias("i")).select("source_sha256", (c("i") * 500).alias("span_start"), F.least(c("i") * 500 + 500, "t").alias("span_end"), F.concat(F.lit("tile-"), c("i").cast("string")).alias("v"))
    return overlay(spans, tiles, ["source_sha256"], "span_start", "span_end", "v")


OVERRIDES = ("Weekly", "report and index", "Central", "document")


def _override_sql(text: str) -> str:
    return "case " + " ".join(f"when contains({text}, '{w}') then {i}" for i, w in enumerate(OVERRIDES)) + " end"


@query("j10_overrides", f"with {CURRENT} select source_sha256, part_uri, element_path, case when visible_text in ({','.join(repr(w) for w in OVERRIDES)}) then 'exact' when {_override_sql('visible_text')} is not null then 'contained' else 'none' end tier, {_override_sql('visible_text')} as rule from current_blocks where outline_level is not null")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The override of each heading: an exact key, else the first declared key it contains. The keys are a fixed list of a configuration."""
    text = c("visible_text")
    rule = reduce(lambda found, w: F.when(text.contains(w[1]), w[0]).otherwise(found), reversed(list(enumerate(OVERRIDES))), F.lit(None).cast("int"))
    tier = F.when(text.isin(*OVERRIDES), "exact").when(rule.isNotNull(), "contained").otherwise("none")
    return current_blocks(spark, sf_dir).where("outline_level is not null").select(*KEY, tier.alias("tier"), rule.alias("rule"))


@query(
    "j11_expected_nodes",
    f"with {ORDERED}, {ASSIGNED}, one as (select source_sha256, part_uri, element_path, max(assignment_id) assignment_id, arg_max(role, assignment_id) as role from assigned where role is not null group by all) select b.source_sha256, b.part_uri, b.element_path, b.n - 1 source_order_index, coalesce(a.role, case when b.in_table then 'table.body' else 'body' end) as role, row_number() over (partition by b.source_sha256, coalesce(a.role, case when b.in_table then 'table.body' else 'body' end) order by b.n) - 1 occurrence_index from ordered b left join one a on {_ON}",
)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with its role - assigned last, else by its place - and its index in the document and in the role."""
    roles = assigned(spark, sf_dir, *KEY, "role").where("role is not null").groupBy(*KEY).agg(F.max_by("role", "assignment_id").alias("given"))
    blocks = ordered(spark, sf_dir).select(*KEY, "n", "in_table").join(roles, KEY, "left")
    role = F.coalesce("given", F.when(c("in_table"), "table.body").otherwise("body"))
    placed = numbered(blocks.withColumn("role", role), ["source_sha256", "role"], ["n"], "k", "n")
    return placed.select(*KEY, (c("n") - 1).alias("source_order_index"), "role", (c("k") - 1).alias("occurrence_index"))


@query(
    "j12_page_references",
    r"with p as (select source_sha256, bookmark_name, min(regexp_extract(host_path, 'p\[(\d+)\]$', 1)) expected from bookmarks group by all) select distinct obs_id, target, expected, case when expected = trim(cached_value) then 'verified' else 'failed' end status from field_observations f left join p on f.source_sha256 = p.source_sha256 and f.target = p.bookmark_name where command = 'PAGEREF'",
)
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page references against the place measured for their target."""
    measured = table(spark, sf_dir, "bookmarks").where("source_sha256 is not null and bookmark_name is not null").groupBy("source_sha256", c("bookmark_name").alias("target")).agg(F.min(F.regexp_extract("host_path", r"p\[(\d+)\]$", 1)).alias("expected"))
    fields = table(spark, sf_dir, "field_observations").where("command = 'PAGEREF'").select("obs_id", "source_sha256", "target", "cached_value")
    status = F.when(c("expected") == F.trim("cached_value"), "verified").otherwise("failed")
    return fields.join(measured, ["source_sha256", "target"], "left").select("obs_id", "target", "expected", status.alias("status")).distinct()


_CONTENTS = f"""items as (select source source_sha256, item_id, item_ord, regexp_replace(content, '{SP}+', '', 'g') norm from (select distinct * from inventory_items) where kind = 'paragraph'),
  texts as (select source_sha256, n, regexp_replace(visible_text, '{SP}+', '', 'g') norm from ordered)"""


@query(
    "j13_allowances",
    "with i as (select source, fingerprint, kind, count(*) have from (select distinct * from inventory_items) where source is not null and fingerprint is not null group by all), a as (select source_sha256, text_hash, count(*) given from (select distinct * from role_assignments) group by all) select source, fingerprint, kind, have, least(have, coalesce(given, 0)) from_source, least(greatest(have - coalesce(given, 0), 0), 2) from_allowance, greatest(have - coalesce(given, 0) - 2, 0) extra from i left join a on i.source = a.source_sha256 and i.fingerprint = a.text_hash",
)
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences used up by what the source holds, then by an allowance of two a text; the rest is extra."""
    have = distinct_rows(spark, sf_dir, "inventory_items", "item_id", "source", "kind", "fingerprint").where("source is not null and fingerprint is not null").groupBy("source", "fingerprint", "kind").agg(F.count(F.lit(1)).alias("have"))
    given = assigned(spark, sf_dir, "source_sha256", "text_hash").groupBy(c("source_sha256").alias("source"), c("text_hash").alias("fingerprint")).agg(F.count(F.lit(1)).alias("given"))
    open_ = F.greatest(c("have") - F.coalesce("given", F.lit(0)), F.lit(0))
    return have.join(given, ["source", "fingerprint"], "left").select("source", "fingerprint", "kind", "have", F.least("have", F.coalesce("given", F.lit(0))).alias("from_source"), F.least(open_, F.lit(2)).alias("from_allowance"), F.greatest(open_ - 2, F.lit(0)).alias("extra"))


def _counts(spark: SparkSession, sf_dir: str, name: str, into: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select("inv_id", "extracted_at", "paragraph_counts")
    entries = rows.select("inv_id", "extracted_at", F.explode("paragraph_counts").alias("paragraph", "k")).distinct()
    return entries.groupBy("inv_id", "paragraph").agg(F.max_by("k", F.struct("extracted_at", "k")).alias(into))


@query(
    "j14_counted_texts",
    "with p as (select inv_id, e.key paragraph, arg_max(e.value, {'a': extracted_at, 'b': e.value}) expected from inventory_prepared, unnest(map_entries(paragraph_counts)) t(e) group by all), d as (select inv_id, e.key paragraph, arg_max(e.value, {'a': extracted_at, 'b': e.value}) actual from inventory_delivered, unnest(map_entries(paragraph_counts)) t(e) group by all) select coalesce(p.inv_id, d.inv_id) inv_id, coalesce(p.paragraph, d.paragraph) paragraph, expected, actual from p full join d on p.inv_id = d.inv_id and p.paragraph = d.paragraph where expected is distinct from actual",
)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose count differs between the copies, by the latest row that has them."""
    both = _counts(spark, sf_dir, "inventory_prepared", "expected").join(_counts(spark, sf_dir, "inventory_delivered", "actual"), ["inv_id", "paragraph"], "full_outer")
    return both.where("not expected <=> actual")


INSTALLED = ("grotesk a", "serif a")
FALLBACKS = {"grotesk b": ("grotesk c", "grotesk a"), "serif b": ("serif a",)}


@query("j15_font_checks", f"with {FONTS} select distinct file_id, font, case when lower(font) in {INSTALLED} then 'installed' else 'missing' end status from fonts")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needed fonts against the installed list of a configuration."""
    return style_fonts(spark, sf_dir).select("file_id", "font", F.when(F.lower("font").isin(*INSTALLED), "installed").otherwise("missing").alias("status")).distinct()


@query("j16_font_fallbacks", f"with {FONTS} select distinct file_id, font, case when lower(font) in {INSTALLED} then null when lower(font) = 'grotesk b' then 'grotesk a' when lower(font) = 'serif b' then 'serif a' end fallback from fonts")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each missing font the first declared candidate that is installed."""
    declared = F.create_map(*[x for k, v in FALLBACKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    first = F.try_element_at(F.filter(F.try_element_at(declared, F.lower("font")), lambda f: f.isin(*INSTALLED)), F.lit(1))
    return style_fonts(spark, sf_dir).select("file_id", "font", F.when(~F.lower("font").isin(*INSTALLED), first).alias("fallback")).distinct()


@query(
    "j17_broken_contracts",
    f"""with {CURRENT}, {ASSIGNED} select 'label_document' as contract, doc_id as id from (select distinct doc_id from reading_labels) l where not exists (select 1 from documents d where d.doc_id = l.doc_id)
    union all select 'assignment_bookmark', assignment_id from assigned a where bookmark_name is not null and source_sha256 is not null and not exists (select 1 from bookmarks b where b.source_sha256 = a.source_sha256 and b.bookmark_name = a.bookmark_name)
    union all select 'order_customer', o_orderkey from orders o where not exists (select 1 from customer k where k.c_custkey = o.o_custkey)""",
)
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a reference between tables, by contract."""
    labels = table(spark, sf_dir, "reading_labels").select("doc_id").distinct().join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_anti").select(F.lit("label_document").alias("contract"), c("doc_id").alias("id"))
    marks = table(spark, sf_dir, "bookmarks").select("source_sha256", "bookmark_name")
    roles = assigned(spark, sf_dir, "source_sha256", "bookmark_name").where("bookmark_name is not null and source_sha256 is not null").join(marks, ["source_sha256", "bookmark_name"], "left_anti").select(F.lit("assignment_bookmark").alias("contract"), c("assignment_id").alias("id"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select(F.lit("order_customer").alias("contract"), c("o_orderkey").alias("id"))
    return labels.unionByName(roles).unionByName(orders)


@query(
    "j18_contract_differences",
    "with p as (select inv_id, arg_max(delivery_id, {'a': extracted_at, 'b': coalesce(delivery_id, '')}) x, count(distinct extracted_at) v from inventory_prepared group by 1), d as (select inv_id, arg_max(delivery_id, {'a': extracted_at, 'b': coalesce(delivery_id, '')}) x, count(distinct extracted_at) v from inventory_delivered group by 1) select coalesce(p.inv_id, d.inv_id) inv_id, p.x prepared, d.x delivered, p.v prepared_versions, d.v delivered_versions from p full join d on p.inv_id = d.inv_id where p.x is distinct from d.x or p.v is distinct from d.v",
)
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories whose delivery or number of versions differs between the copies, null-safe."""
    def side(name: str) -> DataFrame:
        rows = table(spark, sf_dir, f"inventory_{name}")
        by_time = rows.groupBy("inv_id", "extracted_at").agg(F.max_by("delivery_id", F.coalesce("delivery_id", F.lit(""))).alias("x"))
        return by_time.groupBy("inv_id").agg(F.max_by("x", F.struct("extracted_at", F.coalesce("x", F.lit("")))).alias(name), F.count("extracted_at").alias(f"{name}_versions"))

    return side("prepared").join(side("delivered"), "inv_id", "full_outer").where("not prepared <=> delivered or not prepared_versions <=> delivered_versions").select("inv_id", "prepared", "delivered", "prepared_versions", "delivered_versions")


@query(
    "j19_split_runs",
    f"""with {ORDERED}, {_HEADS}, m as (select *, sum(case when n = 1 or p_style_id is distinct from prev then 1 else 0 end) over (partition by source_sha256 order by n) run from (select *, lag(p_style_id) over (partition by source_sha256 order by n) prev from ordered)),
    r as (select source_sha256, min(p_style_id) p_style_id, min(n) first_n, max(n) last_n from m group by source_sha256, run)
    select source_sha256, p_style_id, first_n, last_n from r where p_style_id is not null and (select max(h.n) from heads h where h.source_sha256 = r.source_sha256 and h.n <= first_n) is distinct from (select max(h.n) from heads h where h.source_sha256 = r.source_sha256 and h.n <= last_n)""",
)
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style runs that overlap a section without lying within it: the section at their start is not that at their end."""
    from sheaf.plans.windows import w13

    _, starts = heads(spark, sf_dir)
    runs = w13(spark, sf_dir).where("p_style_id is not null").select("source_sha256", "p_style_id", c("first").alias("first_n"), c("last").alias("last_n"))
    begun = latest_before(runs.withColumn("at", c("first_n")), starts.withColumnRenamed("n", "at"), ["source_sha256"], "at", "head", "section_first")
    ended = latest_before(begun.withColumn("at", c("last_n")), starts.withColumnRenamed("n", "at"), ["source_sha256"], "at", "head", "section_last")
    return ended.where("not section_first <=> section_last").select("source_sha256", "p_style_id", "first_n", "last_n")


@query(
    "j20_remapped_bookmarks",
    "with n as (select source_sha256, bookmark_name, row_number() over (partition by bookmark_name order by source_sha256) k from (select distinct source_sha256, bookmark_name from bookmarks where source_sha256 is not null and bookmark_name is not null)) select distinct f.obs_id, f.target old_name, case when k > 1 then f.target || '_' || (k - 1) else f.target end new_name from field_observations f join n on n.source_sha256 = f.source_sha256 and n.bookmark_name = f.target",
)
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References rewritten to names that are unique over all documents: the first keeps its name, others get a number."""
    names = table(spark, sf_dir, "bookmarks").where("source_sha256 is not null").select("source_sha256", c("bookmark_name").alias("target")).distinct()
    mapped = numbered(names.withColumn("_p", text_position(c("source_sha256"))), ["target"], ["source_sha256"], "k", "_p", 1)
    new = F.when(c("k") > 1, F.concat("target", F.lit("_"), (c("k") - 1).cast("string"))).otherwise(c("target"))
    return table(spark, sf_dir, "field_observations").join(mapped, ["source_sha256", "target"]).select("obs_id", c("target").alias("old_name"), new.alias("new_name")).distinct()


@query("j21_node_index", f"with {CURRENT} select source_sha256, part_uri, element_path, text_hash, recorded_at from current_blocks")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node, the last recorded."""
    return current_blocks(spark, sf_dir).select(*KEY, "text_hash", "recorded_at")


@query("j22_compiled_roles", f"with {CLUSTERS} select r.source_sha256, r.role, coalesce(case when r.role = 'title' then 24.0 end, c.size_pt) size_pt, coalesce(c.bold, false) bold, try_cast(regexp_extract(r.role, 'heading\\.(\\d)', 1) as int) outline_level from candidates r join clusters c on r.source_sha256 = c.source_sha256 and r.cluster_id = c.cluster_id")
def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of each role: its cluster's, overlaid by the decisions' (a title of 24 points), the outline level by the role."""
    style = found_clusters(spark, sf_dir).select("source_sha256", "cluster_id", "size_pt", "bold")
    size = F.coalesce(F.when(c("role") == "title", 24.0), "size_pt")
    return a03(spark, sf_dir).join(style, ["source_sha256", "cluster_id"]).select("source_sha256", "role", size.alias("size_pt"), F.coalesce("bold", F.lit(False)).alias("bold"), F.regexp_extract("role", r"heading\.(\d)", 1).try_cast("int").alias("outline_level"))


@query("j23_texts_by_path", f"with {CURRENT}, {ASSIGNED} select assignment_id, b.visible_text from assigned a join current_blocks b on {_ON}")
def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each assignment's node."""
    return assigned(spark, sf_dir, *KEY).join(current_blocks(spark, sf_dir).select(*KEY, "visible_text"), KEY).select("assignment_id", "visible_text")


@query(
    "j24_preferred_matches",
    f"""with {CURRENT}, {ASSIGNED}, h as (select source_sha256, text_hash, min(element_path) element_path from current_blocks group by all)
    select a.assignment_id, case when b.element_path is not null then 0 when h.element_path is not null then 1 end preference, coalesce(b.element_path, h.element_path) element_path from assigned a left join current_blocks b on {_ON} left join h on h.source_sha256 = a.source_sha256 and h.text_hash = a.text_hash""",
)
def j24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assignment's node by its path, else the first of its text: the least rank of preference holds."""
    blocks = current_blocks(spark, sf_dir)
    exact = blocks.select(*KEY, c("element_path").alias("by_path"))
    text = blocks.groupBy("source_sha256", "text_hash").agg(F.min("element_path").alias("by_text"))
    joined = assigned(spark, sf_dir, *KEY, "text_hash").join(exact, KEY, "left").join(text, ["source_sha256", "text_hash"], "left")
    return joined.select("assignment_id", F.when(c("by_path").isNotNull(), 0).when(c("by_text").isNotNull(), 1).alias("preference"), F.coalesce("by_path", "by_text").alias("element_path"))


@query(
    "u01_bag_difference",
    f"with {ORDERED}, {_CONTENTS}, d as (select source_sha256, norm from items where length(norm) > 1 except all select source_sha256, norm from texts) select source_sha256, norm, count(*) n from d group by all",
)
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that the inventory has more often than the document."""
    items, blocks = contents(spark, sf_dir)
    return bag_difference(items, blocks, ["source_sha256", "norm"])


@query(
    "u02_missing_content",
    f"with {ORDERED}, {_CONTENTS}, r as (select source_sha256, norm, count(*) required from items where length(norm) > 1 group by all), h as (select source_sha256, norm, count(*) have from texts group by all) select r.source_sha256, r.norm, required, coalesce(have, 0) actual from r left join h on r.source_sha256 is not distinct from h.source_sha256 and r.norm = h.norm where coalesce(have, 0) < required",
)
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that stand less often in the document than required."""
    items, blocks = contents(spark, sf_dir)
    required = items.groupBy("source_sha256", "norm").agg(F.count(F.lit(1)).alias("required"))
    have = blocks.groupBy("source_sha256", "norm").agg(F.count(F.lit(1)).alias("have"))
    actual = F.coalesce("have", F.lit(0))
    return required.join(have, ["source_sha256", "norm"], "left").where(actual < c("required")).select("source_sha256", "norm", "required", actual.alias("actual"))


@query(
    "u03_ordered_union",
    "select row_number() over (partition by source order by copy, item_ord, item_id) k, source, copy, item_id from (select 0 copy, source, item_ord, item_id from (select distinct * from inventory_items) where kind = 'paragraph' union all select 1, source, item_ord, item_id from (select distinct * from inventory_items) where kind <> 'paragraph') where source is not null",
)
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inventories one after the other, order kept within each."""
    rows = distinct_rows(spark, sf_dir, "inventory_items", "source", "kind", "item_ord", "item_id")
    joined = rows.where("kind = 'paragraph'").withColumn("copy", F.lit(0)).unionByName(rows.where("kind <> 'paragraph'").withColumn("copy", F.lit(1)))
    placed = joined.withColumn("_p", ranked_position(c("copy"), c("item_ord")))
    return numbered(placed, ["source"], ["copy", "item_ord", "item_id"], "k", "_p").select("k", "source", "copy", "item_id")


@query("u04_unexpected_order", _GREEDY + " select inv_id, place, occurrence from walk where place >= 0 and matched is null")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of the first copy that do not follow in order in the second: those a greedy match leaves out."""
    return j07(spark, sf_dir).where("matched is null").drop("matched")


@query("u05_first_targets", "select source_sha256, target, min(obs_id) first_id from field_observations where command = 'PAGEREF' and target is not null group by all")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets once each, in order of their first reference."""
    return table(spark, sf_dir, "field_observations").where("command = 'PAGEREF' and target is not null").groupBy("source_sha256", "target").agg(F.min("obs_id").alias("first_id"))


@query(
    "u06_structure_faults",
    """with b as (select source_sha256, bookmark_name, count(distinct bookmark_id) k from bookmarks where source_sha256 is not null and bookmark_name is not null group by all), f as (select distinct source_sha256, target from field_observations where command in ('REF', 'PAGEREF') and source_sha256 is not null and target is not null)
    select source_sha256, bookmark_name as name, 'duplicate' fault from b where k > 1 union all select source_sha256, target, 'missing' from f where not exists (select 1 from b where b.source_sha256 = f.source_sha256 and b.bookmark_name = f.target) union all select source_sha256, bookmark_name, 'unused' from b where not exists (select 1 from f where b.source_sha256 = f.source_sha256 and b.bookmark_name = f.target)""",
)
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmark names used twice, missing, or never referred to."""
    marks = table(spark, sf_dir, "bookmarks").where("source_sha256 is not null and bookmark_name is not null").groupBy("source_sha256", c("bookmark_name").alias("name")).agg(F.min("bookmark_id").alias("lo"), F.max("bookmark_id").alias("hi"))
    fields = table(spark, sf_dir, "field_observations").where("command in ('REF', 'PAGEREF') and source_sha256 is not null and target is not null").select("source_sha256", c("target").alias("name"), F.lit(True).alias("used")).distinct()
    both = marks.join(fields, ["source_sha256", "name"], "full_outer")
    faults = F.array_compact(F.array(F.when(c("lo") != c("hi"), "duplicate"), F.when(c("lo").isNull(), "missing"), F.when(c("used").isNull(), "unused")))
    return both.select("source_sha256", "name", F.explode(faults).alias("fault"))


@query(
    "u07_tolerant_difference",
    r"""with f as (select distinct obs_id, source_sha256, instruction, case when regexp_matches(instruction, '(?i)^(REF|PAGEREF|STYLEREF)\s+[^\\\s]+') then regexp_replace(instruction, '^(\w+)\s+[^\\\s]+', '\1 <bookmark>') else instruction end identity, story like 'body%' body from field_observations where instruction is not null)
    select identity, count(*) n from (select source_sha256, identity from f where body except all select source_sha256, identity from f where not body) group by all""",
)
def u07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field instructions that bodies have more often than other stories, targets of references masked."""
    rows = table(spark, sf_dir, "field_observations").where("instruction is not null").select("obs_id", "source_sha256", "instruction", "story").distinct()
    fields = rows.withColumn("identity", S.field_identity(c("instruction")))
    body = c("story").startswith("body")
    return bag_difference(fields.where(body), fields.where(~body), ["source_sha256", "identity"]).groupBy("identity").agg(F.sum("n").alias("n"))


@query("u08_note_counts", "select source, count_if(story_type = 'footnote')::bigint n_definitions, count_if(story_type = 'body')::bigint n_body, count_if(story_type = 'footnote' and coalesce(content, '') = '')::bigint n_empty from (select distinct * from inventory_items) group by source")
def u08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and body items of each document, and notes without text."""
    note = c("story_type") == "footnote"
    rows = table(spark, sf_dir, "inventory_items").select("item_id", "source", "story_type", F.when(F.coalesce("content", F.lit("")) == "", "").otherwise("x").alias("content")).distinct()
    return rows.groupBy("source").agg(F.count_if(note).alias("n_definitions"), F.count_if(c("story_type") == "body").alias("n_body"), F.count_if(note & (F.coalesce("content", F.lit("")) == "")).alias("n_empty"))


@query(
    "u09_region_faults",
    f"with {ORDERED}, {_HEADS} select o.source_sha256, o.n, 'uncovered' fault from ordered o where story_type = 'body' and length(coalesce(visible_text, '')) > 0 and not exists (select 1 from heads h where h.source_sha256 = o.source_sha256 and h.n <= o.n)",
)
def u09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substantive blocks in no region; regions run from heading to heading, so they cannot overlap."""
    blocks, starts = heads(spark, sf_dir)
    rows = blocks.where((c("story_type") == "body") & (F.length(F.coalesce("visible_text", F.lit(""))) > 0)).select("source_sha256", "n", "element_path")
    return latest_before(rows, starts, ["source_sha256"], "n", "head", "region").where("region is null").select("source_sha256", "n", F.lit("uncovered").alias("fault"))


KNOWN_KEYS = ("schema_version", "project_name", "cover", "fonts", "toc_depth", "source", "output", "format", "formatting", "layout")


@query("u10_unknown_keys", f"select manifest_id, list_sort(list_filter(json_keys(raw_json), lambda k: k not in {KNOWN_KEYS} and not starts_with(k, '_comment'))) unknown from (select distinct manifest_id, raw_json from manifest_files where json_valid(raw_json)) where len(list_filter(json_keys(raw_json), lambda k: k not in {KNOWN_KEYS} and not starts_with(k, '_comment'))) > 0")
def u10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level keys of manifests outside the contract; comments are no keys."""
    rows = table(spark, sf_dir, "manifest_files").select("manifest_id", "raw_json").distinct()
    keys = F.json_object_keys(F.try_parse_json("raw_json").cast("string"))
    unknown = F.array_sort(F.filter(keys, lambda k: ~k.isin(*KNOWN_KEYS) & ~k.startswith("_comment")))
    return rows.select("manifest_id", unknown.alias("unknown")).where("size(unknown) > 0")
