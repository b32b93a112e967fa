"""Queries of clusters, roles, metrics and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions import scalars as S
from sheaf.operators.clustering import CORE_ROLES, clusters, missing_roles, role_candidates
from sheaf.operators.metrics import per_role, role_metrics
from sheaf.operators.windows import numbered
from sheaf.plans.carriers import CURRENT, DRAWN, current_blocks, distinct_rows, drawn_blocks
from sheaf.plans.registry import query
from sheaf.plans.scalars import SP
from sheaf.session import table

VECTOR = ["outline_level", "in_table", "alignment", "size_pt", "bold"]
ORDER = ["block_ord", "part_uri", "element_path"]
c = F.col

CLUSTERS = (
    DRAWN
    + """, keyed as (select *, row_number() over (partition by source_sha256, outline_level, in_table, alignment, size_pt, bold order by block_ord, part_uri, element_path) k,
      sum((length(trim(visible_text)) > 0)::int) over (partition by source_sha256, outline_level, in_table, alignment, size_pt, bold order by block_ord, part_uri, element_path) t from drawn_blocks where source_sha256 is not null),
    grouped as (select source_sha256, outline_level, in_table, alignment, size_pt, bold, count(*) n, list_sort(list(distinct p_style_id) filter (p_style_id is not null)) p_style_ids,
      min({'a': block_ord, 'b': part_uri, 'c': element_path}) f, arg_min(p_style_name, {'a': block_ord, 'b': part_uri, 'c': element_path}) sn, arg_min(outline_source, {'a': block_ord, 'b': part_uri, 'c': element_path}) os,
      list(element_path order by k) filter (k <= 5) sample_nodes, list(substr(visible_text, 1, 60) order by t) filter (t <= 3 and length(trim(visible_text)) > 0) sample_texts from keyed group by all),
    clusters as (select *, printf('cluster-%02d', rank) cluster_id,
      case when in_table then 'table.body' when outline_level between 1 and 9 then 'heading.' || outline_level when contains(lower(sn), 'title') and not contains(lower(sn), 'sub') then 'title' else 'body' end suggested_role,
      case when in_table then 0.95::double when outline_level between 1 and 9 and os = 'direct' then 0.99 when outline_level between 1 and 9 then 0.95 when contains(lower(sn), 'title') then 0.9 else 0.85 end confidence
      from (select *, row_number() over (partition by source_sha256 order by n desc, f) rank from grouped)),
    best as (select source_sha256, suggested_role as role, cluster_id, confidence, n from clusters qualify row_number() over (partition by source_sha256, suggested_role order by case when suggested_role in ('body', 'table.body') then 0 else confidence end desc, n desc, rank) = 1),
    candidates as (select * from best union all select source_sha256, 'body', cluster_id, confidence, n from (select * from clusters c where not exists (select 1 from best b where b.source_sha256 = c.source_sha256 and b.role = 'body') and not exists (select 1 from best b where b.source_sha256 = c.source_sha256 and b.cluster_id = c.cluster_id) qualify row_number() over (partition by source_sha256 order by n desc, rank) = 1))"""
)


def found_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(drawn_blocks(spark, sf_dir), "source_sha256", VECTOR, ORDER, "block_ord")


@query("a01_style_clusters", f"with {CLUSTERS} select source_sha256, outline_level, in_table, alignment, size_pt, bold, n, coalesce(p_style_ids, []) p_style_ids, sample_nodes, coalesce(sample_texts, []) sample_texts, suggested_role, confidence from clusters")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style clusters of each document with bounded samples."""
    return found_clusters(spark, sf_dir).drop("cluster_id", "rank", "_key")


@query("o03_clusters_by_size", f"with {CLUSTERS} select source_sha256, cluster_id, n from clusters")
def o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters numbered by falling size, ties by first block."""
    return found_clusters(spark, sf_dir).select("source_sha256", "cluster_id", "n")


@query("a02_style_usage", f"with {CURRENT} select p_style_name, count(*) n_blocks, count(distinct source_sha256) n_documents, count(*) - count(p_style_id) n_unnamed from current_blocks group by all")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each style is used, by how many documents, and how often by name only."""
    by_document = current_blocks(spark, sf_dir).groupBy("p_style_name", "source_sha256").agg(F.count(F.lit(1)).alias("n"), F.count("p_style_id").alias("named"))
    return by_document.groupBy("p_style_name").agg(F.sum("n").alias("n_blocks"), F.count("source_sha256").alias("n_documents"), (F.sum("n") - F.sum("named")).alias("n_unnamed"))


@query("a03_role_candidates", f"with {CLUSTERS} select * from candidates")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cluster of each role of each document."""
    return role_candidates(found_clusters(spark, sf_dir), "source_sha256")


@query("a04_confidence_summary", f"with {CLUSTERS} select source_sha256, count(*) n_roles, count_if(confidence < 0.98)::bigint to_review, count_if(confidence >= 0.98)::bigint automatic, min(confidence) lowest, max(confidence) highest from candidates group by all")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each document's roles are."""
    return a03(spark, sf_dir).groupBy("source_sha256").agg(F.count(F.lit(1)).alias("n_roles"), F.count_if(c("confidence") < 0.98).alias("to_review"), F.count_if(c("confidence") >= 0.98).alias("automatic"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"))


@query(
    "a05_sample_counts",
    f"with {CURRENT} select source_sha256, count(*) n_blocks, count_if(structure_type = 'paragraph')::bigint n_paragraphs, count_if(contains(element_path, '/w:tbl['))::bigint n_in_tables, count_if(outline_level is not null)::bigint n_outlined, sum(runs_count)::bigint n_runs, count_if(len(protected_objects) > 0)::bigint n_protected from current_blocks group by all",
)
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a document's parts."""
    return current_blocks(spark, sf_dir).groupBy("source_sha256").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(c("structure_type") == "paragraph").alias("n_paragraphs"),
        F.count_if(c("element_path").contains("/w:tbl[")).alias("n_in_tables"),
        F.count_if(c("outline_level").isNotNull()).alias("n_outlined"),
        F.sum("runs_count").alias("n_runs"),
        F.count_if(F.size("protected_objects") > 0).alias("n_protected"),
    )


_CORE = "unnest(['" + "','".join(CORE_ROLES) + "'])"


@query(
    "a06_missing_roles",
    f"with {CLUSTERS} select source_sha256, role, 'inherit_from:' || case when role = 'heading.2' and has('heading.1') then 'heading.1' when role = 'heading.3' and has('heading.2') then 'heading.2' when role = 'title' and has('heading.1') then 'heading.1' else 'body' end fallback from (select d.source_sha256, {_CORE} role, roles from (select distinct source_sha256 from current_blocks) d left join (select source_sha256, list(role) roles from candidates group by 1) r on d.source_sha256 = r.source_sha256) x where not coalesce(list_contains(roles, role), false)".replace(
        "has('", "list_contains(roles, '"
    ),
)
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core roles that a document does not show, and what they would inherit from."""
    return missing_roles(a03(spark, sf_dir), current_blocks(spark, sf_dir), "source_sha256")


_LEN = f"length(regexp_replace(coalesce(visible_text, ''), '{SP}+', '', 'g'))"


@query("a07_body_sizes", f"with {DRAWN} select source_sha256, coalesce(median(size_pt) filter ({_LEN} > 80 or not bold), median(size_pt), 12.0) body_size from drawn_blocks where structure_type = 'paragraph' group by all")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median size of body-like paragraphs, else of all, else 12."""
    body = (F.length(S.delete_space(F.coalesce("visible_text", F.lit("")))) > 80) | ~c("bold")
    paragraphs = drawn_blocks(spark, sf_dir).where("structure_type = 'paragraph'").groupBy("source_sha256", "size_pt").agg(F.count(F.lit(1)).alias("n"), F.count_if(body).alias("nb"))
    middle = lambda n: F.expr(f"percentile(size_pt, 0.5, {n})")  # noqa: E731  (of counts by size: a document of any length is a few rows)
    return paragraphs.groupBy("source_sha256").agg(F.coalesce(middle("nb"), middle("n"), F.lit(12.0)).alias("body_size"))


@query("a08_size_frequencies", f"with {DRAWN} select source_sha256, size_pt, count(*) n_all, count_if(bold and {_LEN} <= 42)::bigint n_heading_like from drawn_blocks where structure_type = 'paragraph' group by all")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each size is used, and how often heading-like."""
    like = c("bold") & (F.length(S.delete_space(F.coalesce("visible_text", F.lit("")))) <= 42)
    return drawn_blocks(spark, sf_dir).where("structure_type = 'paragraph'").groupBy("source_sha256", "size_pt").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(like).alias("n_heading_like"))


def labelled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role assignments as labels, the role that the block's style suggests as prediction, accepted unless it is body."""
    blocks = drawn_blocks(spark, sf_dir)
    name = F.lower("p_style_name")
    role = F.when(c("in_table"), "table.body").when(c("outline_level").isNotNull(), F.concat(F.lit("heading."), c("outline_level").cast("string"))).when(name == "title", "title").when(name.isin("caption", "quote"), name).otherwise("body")
    predicted = blocks.select("source_sha256", "part_uri", "element_path", role.alias("prediction"))
    labels = distinct_rows(spark, sf_dir, "role_assignments", "assignment_id", "source_sha256", "part_uri", "element_path", "role", "provenance", "story_type", "level").select("assignment_id", "source_sha256", "part_uri", "element_path", c("role").alias("label"), "provenance", "story_type", "level")
    joined = labels.join(predicted, ["source_sha256", "part_uri", "element_path"], "left")
    return joined.withColumns({"accepted": F.when(c("prediction") != "body", c("prediction")), "candidates": F.array_compact(F.array(c("prediction"), F.lit("body")))})


NODES = (
    DRAWN
    + """, nodes as (select *, case when prediction <> 'body' then prediction end accepted, list_filter([prediction, 'body'], lambda x: x is not null) candidates from (
      select distinct a.assignment_id, a.role as label, a.provenance, a.story_type, a.level, b.prediction from (select distinct * from role_assignments) a left join (
        select source_sha256, part_uri, element_path, case when in_table then 'table.body' when outline_level is not null then 'heading.' || outline_level when lower(p_style_name) = 'title' then 'title' when lower(p_style_name) in ('caption', 'quote') then lower(p_style_name) else 'body' end prediction from drawn_blocks) b
      on a.source_sha256 = b.source_sha256 and a.part_uri = b.part_uri and a.element_path = b.element_path))"""
)
_H = "(coalesce({0} = 'title' or starts_with({0}, 'heading.'), false))"
_MEASURES = f"""count_if(t)::bigint accepted_count, count_if(t and {_H.format("accepted")} and {_H.format("label")})::bigint accepted_heading_count, count_if(t and accepted = label)::bigint exact_role_count, count_if({_H.format("label")})::bigint heading_count,
  count_if({_H.format("label")} and list_contains(candidates, label))::bigint candidate_exact_role_count, count_if(t and label = 'body' and {_H.format("accepted")})::bigint body_as_heading_false_positives, count_if(accepted is not null and label is null)::bigint unlabelled,
  accepted_heading_count / nullif(accepted_count, 0) heading_detection_precision, exact_role_count / nullif(accepted_count, 0) exact_role_auto_precision, accepted_heading_count / nullif(heading_count, 0) auto_acceptance_coverage, exact_role_count / nullif(heading_count, 0) correct_auto_coverage, candidate_exact_role_count / nullif(heading_count, 0) candidate_exact_role_coverage"""


@query("a09_role_metrics", f"with {NODES} select {_MEASURES} from (select *, accepted is not null and label is not null t from nodes)")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven measures of predicted roles."""
    return role_metrics(labelled_nodes(spark, sf_dir))


@query(
    "a10_per_role",
    f"with {NODES} select role, sum(l)::bigint support, sum(p)::bigint predicted, sum(tp)::bigint tp, (sum(p) - sum(tp))::bigint fp, (sum(l) - sum(tp))::bigint fn, sum(tp) / nullif(sum(p), 0) as precision, sum(tp) / nullif(sum(l), 0) recall from (select label as role, 1 l, 0 p, coalesce((label = prediction)::int, 0) tp from nodes union all select prediction, 0, 1, 0 from nodes) where role is not null group by role",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of each role."""
    return per_role(labelled_nodes(spark, sf_dir))


@query("a11_metric_grains", f"with {NODES} select provenance, story_type, grouping(provenance, story_type) grain, {_MEASURES} from (select *, accepted is not null and label is not null t from nodes) group by grouping sets ((), (provenance), (story_type), (provenance, story_type))")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measures overall, by provenance, by story and by both."""
    return role_metrics(labelled_nodes(spark, sf_dir), sets=[[], ["provenance"], ["story_type"], ["provenance", "story_type"]])


@query(
    "a12_paragraph_bag",
    f"select doc_id, norm, count(*) n, min(ord)::int first_ord from (select doc_id, regexp_replace(line, '{SP}+', '', 'g') norm, ord from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 ord from documents)) where length(norm) > 1 group by all",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag of each document's paragraphs without white space."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return lines.select("doc_id", "ord", S.delete_space(c("line")).alias("norm")).where(F.length("norm") > 1).groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


@query(
    "a13_merged_inventories",
    "with o as (select source, fingerprint, row_number() over (partition by source order by item_ord, item_id) k from (select distinct * from inventory_items) where source is not null), s as (select source, (k - 1) // 1024 slice, sha256(string_agg(fingerprint, '|' order by k)) h, count(*) n from o group by all) select source, sha256(string_agg(h, '|' order by slice)) digest, sum(n)::bigint n_items from s group by source",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of each document's ordered fingerprints: of the digests of slices, so no document is collected whole."""
    placed = numbered(distinct_rows(spark, sf_dir, "inventory_items", "item_id", "item_ord", "source", "fingerprint"), ["source"], ["item_ord", "item_id"], "k", "item_ord")
    joined = lambda order, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "|"), 256)
    slices = placed.groupBy("source", F.floor((c("k") - 1) / 1024).alias("slice")).agg(joined("k", "fingerprint").alias("h"), F.count(F.lit(1)).alias("n"))
    return slices.groupBy("source").agg(joined("slice", "h").alias("digest"), F.sum("n").alias("n_items"))


@query(
    "a14_coverage_counts",
    "select delivery_id, count(*) n_inventories, sum(len(map_entries(paragraph_counts)))::bigint expected, sum(len(missing_occurrences))::bigint missing, count_if(len(missing_occurrences) > 0)::bigint incomplete, count_if(paragraph_counts is null)::bigint unknown from (select distinct * from inventory_prepared) group by all",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and missing occurrences of each delivery."""
    rows = table(spark, sf_dir, "inventory_prepared")
    plain = rows.withColumn("paragraph_counts", F.map_from_entries(F.array_sort(F.map_entries("paragraph_counts")))).withColumn("_k", F.to_json("paragraph_counts"))
    own = plain.dropDuplicates([x for x in plain.columns if x != "paragraph_counts"])
    n = lambda x: F.when(x.isNotNull(), F.size(x))
    return own.groupBy("delivery_id").agg(F.count(F.lit(1)).alias("n_inventories"), F.sum(n(c("paragraph_counts"))).alias("expected"), F.sum(n(c("missing_occurrences"))).alias("missing"), F.count_if(F.size("missing_occurrences") > 0).alias("incomplete"), F.count_if(c("paragraph_counts").isNull()).alias("unknown"))


_STATUS = "case when target is null and command in ('REF', 'PAGEREF') then 0 when command in ('DATE', 'TOC') then 1 when cached_value is null then 2 else 3 end"


@query("a15_status_rollup", f"select source_sha256, ['failed', 'unsupported', 'not_run', 'passed'][min({_STATUS}) + 1] status, list_sort(list(distinct command) filter (command is not null and {_STATUS} = 0)) failing, count(*) n from (select distinct * from field_observations) group by source_sha256")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst status of a document's fields: failed, unsupported, not_run, passed."""
    rank = F.when(c("target").isNull() & c("command").isin("REF", "PAGEREF"), 0).when(c("command").isin("DATE", "TOC"), 1).when(c("cached_value").isNull(), 2).otherwise(3)
    names = F.array(*map(F.lit, ("failed", "unsupported", "not_run", "passed")))
    failing = F.array_sort(F.collect_set(F.when(rank == 0, c("command"))))
    return distinct_rows(spark, sf_dir, "field_observations", "obs_id", "source_sha256", "command", "target", "cached_value").groupBy("source_sha256").agg(names[F.min(rank)].alias("status"), F.when(F.size(failing) > 0, failing).alias("failing"), F.count(F.lit(1)).alias("n"))


@query("a16_plan_counts", f"with {CURRENT} select part_uri, story_type, count(*) n_blocks, count_if(outline_level is not null)::bigint n_headings, count_if(structure_type = 'section_break')::bigint n_breaks from current_blocks group by all")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan would assemble, by part and story."""
    return current_blocks(spark, sf_dir).groupBy("part_uri", "story_type").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(c("outline_level").isNotNull()).alias("n_headings"), F.count_if(c("structure_type") == "section_break").alias("n_breaks"))


TITLE_RULES = (("template", "Templates"), ("report", "Reports"), ("schedule", "Schedules"))


@query("a17_group_titles", f"with {CURRENT} select source_sha256, case when bool_or(contains(lower(visible_text), 'template')) then 'Templates' when bool_or(contains(lower(visible_text), 'report')) then 'Reports' when bool_or(contains(lower(visible_text), 'schedule')) then 'Schedules' else 'Other' end title from current_blocks where outline_level is not null group by all")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title for each document's headings by the first keyword that any has."""
    title = F.lit("Other")
    for word, name in reversed(TITLE_RULES):
        title = F.when(F.bool_or(F.lower("visible_text").contains(word)), name).otherwise(title)
    return current_blocks(spark, sf_dir).where("outline_level is not null").groupBy("source_sha256").agg(title.alias("title"))


FONTS = """fonts as (select file_id, k style, json_extract_string(v, '$.run.latin') font from (select file_id, unnest(json_keys(raw_json, '$.styles')) k, raw_json from (select distinct file_id, raw_json from format_files where json_valid(raw_json) and json_type(raw_json, '$.styles') = 'OBJECT')), lateral (select json_extract(raw_json, '$.styles."' || k || '"') v) where font is not null)"""


def style_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, style, font of every style of a format package."""
    rows = table(spark, sf_dir, "format_files").select("file_id", "raw_json").distinct()
    parsed = rows.select("file_id", F.from_json(F.try_parse_json("raw_json").cast("string"), "styles map<string, struct<run: struct<latin: string>>>").alias("j"))
    return parsed.select("file_id", F.explode("j.styles").alias("style", "v")).select("file_id", "style", c("v.run.latin").alias("font")).where("font is not null")


@query("a18_required_fonts", f"with {FONTS} select lower(font) font_key, min(font) font, count(distinct file_id) n_files, count(*) n_styles from fonts group by 1")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fonts that format packages need."""
    files = style_fonts(spark, sf_dir).groupBy(F.lower("font").alias("font_key"), "file_id").agg(F.min("font").alias("font"), F.count(F.lit(1)).alias("n"))
    return files.groupBy("font_key").agg(F.min("font").alias("font"), F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_styles"))


@query("a22_font_report", f"with {FONTS} select lower(font) font_key, list_sort(list(distinct style))[1:3] first_styles, count(distinct style) n_styles from fonts group by 1")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each font the first three styles that use it, and how many do."""
    pairs = style_fonts(spark, sf_dir).select(F.lower("font").alias("font_key"), "style").distinct()
    first = pairs.withColumn("k", F.row_number().over(Window.partitionBy("font_key").orderBy("style"))).where("k <= 3")  # all but three of each task are dropped before the shuffle
    first = first.groupBy("font_key").agg(F.array_sort(F.collect_list("style")).alias("first_styles"))
    return pairs.groupBy("font_key").agg(F.count(F.lit(1)).alias("n_styles")).join(first, "font_key").select("font_key", "first_styles", "n_styles")


@query(
    "a19_page_checks",
    f"select doc_id, n_lines, case when n_lines = 0 then 'blank' when n_lines = 1 and longest < 60 then 'heading_only' when n_lines = 2 then 'orphan' else 'filled' end page_status from (select doc_id, coalesce(sum(case when regexp_replace(line, '{SP}+', '', 'g') <> '' and not regexp_matches(line, '^[\\- ]*\\d+[\\- ]*$') then 1 end), 0)::bigint n_lines, max(length(line)) longest from (select doc_id, unnest(string_split(text, chr(10))) line from documents) group by doc_id)",
)
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken as pages: blank, with a heading only, with a line or two, or filled; page number lines don't count."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    content = (S.delete_space(c("line")) != "") & ~c("line").rlike(r"^[\- ]*\d+[\- ]*$")
    pages = lines.groupBy("doc_id").agg(F.count_if(content).alias("n_lines"), F.max(F.length("line")).alias("longest"))
    status = F.when(c("n_lines") == 0, "blank").when((c("n_lines") == 1) & (c("longest") < 60), "heading_only").when(c("n_lines") == 2, "orphan").otherwise("filled")
    return pages.select("doc_id", "n_lines", status.alias("page_status"))
