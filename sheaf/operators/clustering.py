"""Style clusters of documents, the role each suggests, and the choice of one cluster for each role.

A cluster is a document's blocks with one style vector. Samples are bounded by each block's place within its cluster,
so a cluster of any size is aggregated in parts and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.operators.windows import running

#: How sure a suggestion is, and the roles a finished format must have.
SURE = {"table": 0.95, "direct": 0.99, "inherited": 0.95, "named": 0.90, "body": 0.85}
CORE_ROLES = ("title", "heading.1", "heading.2", "heading.3", "body", "table.body")
SAMPLE_PATHS, SAMPLE_TEXTS, SAMPLE_CHARS = 5, 3, 60


def suggested(outline: Column, in_table: Column, style: Column, source: Column) -> Column:
    """Role and confidence of a cluster by its table place, outline level or style name, else body."""
    name = F.lower(F.coalesce(style, F.lit("")))
    case = lambda role, confidence: F.struct(role.alias("role"), F.lit(confidence).alias("confidence"))
    heading = F.concat(F.lit("heading."), outline.cast("string"))
    return (
        F.when(in_table, case(F.lit("table.body"), SURE["table"]))
        .when(outline.between(1, 9) & (source == "direct"), case(heading, SURE["direct"]))
        .when(outline.between(1, 9), case(heading, SURE["inherited"]))
        .when(name.contains("title") & ~name.contains("sub"), case(F.lit("title"), SURE["named"]))
        .when(name.contains("subtitle"), case(F.lit("subtitle"), SURE["named"]))
        .when(name.rlike("(heading|标题) ?[123]"), case(F.concat(F.lit("heading."), F.regexp_extract(name, "(?:heading|标题) ?([123])", 1)), SURE["named"]))
        .otherwise(case(F.lit("body"), SURE["body"]))
    )


def clusters(blocks: DataFrame, document: str, vector: list[str], order: list[str], position: str) -> DataFrame:
    """One row per document and style vector: id by falling size, count, styles, first block, bounded samples, suggested role.

    Ids are given by falling count, ties by first place. Nulls in the vector are values. Blocks without document are left out.
    """
    keyed = blocks.withColumn("_key", F.to_json(F.struct(*vector)))
    text = F.col("visible_text")
    placed = running(keyed, [document, "_key"], order, {"_k": F.lit(1), "_t": (F.length(F.trim(text)) > 0).cast("int")}, position=position)
    first = lambda n, limit, value: F.transform(F.array_sort(F.collect_list(F.when((F.col(n) <= limit), F.struct(F.col(n).alias("k"), value.alias("v"))))), lambda x: x["v"])
    grouped = placed.groupBy(document, "_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set("p_style_id")).alias("p_style_ids"),
        F.min(F.struct(*order)).alias("_first"),
        F.min_by(F.struct(*vector, "p_style_name", "outline_source"), F.struct(*order)).alias("_v"),
        first("_k", SAMPLE_PATHS, F.col("element_path")).alias("sample_nodes"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("_t") <= SAMPLE_TEXTS) & (F.length(F.trim(text)) > 0), F.struct(F.col("_t").alias("k"), F.substring(text, 1, SAMPLE_CHARS).alias("v"))))), lambda x: x["v"]).alias("sample_texts"),
    )
    rank = F.row_number().over(Window.partitionBy(document).orderBy(F.desc("n"), "_first"))
    role = suggested(F.col("_v.outline_level"), F.col("_v.in_table"), F.col("_v.p_style_name"), F.col("_v.outline_source"))
    return (
        grouped.withColumn("rank", rank)
        .withColumn("_r", role)
        .select(document, F.format_string("cluster-%02d", "rank").alias("cluster_id"), "rank", "_key", *[F.col(f"_v.{v}").alias(v) for v in vector], "n", "p_style_ids", "sample_nodes", "sample_texts", F.col("_r.role").alias("suggested_role"), F.col("_r.confidence").alias("confidence"))
    )


def role_candidates(found: DataFrame, document: str) -> DataFrame:
    """document, role, cluster_id, confidence, n: the best cluster of each role; body falls back to any cluster not taken.

    Headings and titles are chosen by confidence, then size; tables and body by size; ties go to the earlier cluster.
    """
    strength = F.when(F.col("suggested_role").rlike("^(title|heading)"), F.col("confidence")).otherwise(0.0)
    own = found.where(F.col("suggested_role").rlike(r"^(title|heading\.[1-9]|table\.body|body)$"))
    pick = F.max_by(F.struct("cluster_id", "confidence", "n"), F.struct(strength, F.col("n"), -F.col("rank"))).alias("b")
    best = own.groupBy(document, F.col("suggested_role").alias("role")).agg(pick).select(document, "role", "b.*")
    without_body = found.join(best.where("role = 'body'").select(document), document, "left_anti")
    free = without_body.join(best.select(document, "cluster_id"), [document, "cluster_id"], "left_anti")
    fallback = free.groupBy(document).agg(F.max_by(F.struct("cluster_id", "confidence", "n"), F.struct(F.col("n"), -F.col("rank"))).alias("b")).select(document, F.lit("body").alias("role"), "b.*")
    return best.unionByName(fallback)


def missing_roles(candidates: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """document, role, fallback: the core roles a document shows no cluster for, and the role to inherit from."""
    seen = documents.select(document).distinct().join(candidates.groupBy(document).agg(F.collect_set("role").alias("roles")), document, "left")
    seen = seen.withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    have = lambda r: F.array_contains("roles", r)
    rows = seen.withColumn("role", F.explode(F.array_except(F.array(*map(F.lit, CORE_ROLES)), "roles")))
    base = F.when((F.col("role") == "heading.2") & have("heading.1"), "heading.1").when((F.col("role") == "heading.3") & have("heading.2"), "heading.2").when((F.col("role") == "title") & have("heading.1"), "heading.1").otherwise("body")
    return rows.select(document, "role", F.concat(F.lit("inherit_from:"), base).alias("fallback"))
