"""Roles of paragraphs without structural styles, scored from size, weight, place and numbering.

All of a document's paragraphs share its body size, its heading sizes and their counts; these are a few rows by
document and size, joined back, and a block meets its neighbours by ordinal. Scores are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions import scalars as S
from sheaf.operators.windows import neighbours

# Thresholds and points of the scores.
LEAST, AUTOMATIC, CLEAR, MARGIN, SHORT, LONG = 0.25, 0.985, 0.58, 0.05, 42, 80
HEADING_BASE, HEADING_TOP, SIZE_FROM, SIZE_SLOPE, SIZE_TOP, FAMILY_FROM = 0.05, 0.95, 1.15, 0.45, 0.35, 1.08
IS_SHORT, HAS_EMPHASIS, HAS_SPACING, IS_NUMBERED, IS_REJECTED, IS_LONG, IS_ALIKE = 0.20, 0.12, 0.10, 0.10, -0.25, -0.28, -0.10
TITLE_FROM, TITLE_GAIN, TITLE_TOP, TITLE_UNDER, TITLE_LOSS = 1.35, 0.20, 0.98, 1.20, 0.18
BODY_BASE, BODY_TOP, BODY_TO, BODY_LONG, BODY_SIZED, BODY_PLAIN = 0.30, 0.92, 1.10, 0.30, 0.20, 0.10
CAPTION, NO_CAPTION, SPACE_FROM = 0.25, 0.08, 6


def _points(*terms: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for when, points in terms:
        total = total + F.when(when, points).otherwise(0.0)
    return total


def ranked_candidates(blocks: DataFrame, document: str, ordinal: str) -> DataFrame:
    """document, ordinal, selected_role, selected_score, review_status, conflicts, candidates (role, score; at most three).

    blocks has size_pt, bold, alignment, structure_type, visible_text and optionally space_before_pt; sizes of null
    count as 0. Only paragraphs are rated; tables count as neighbours. A document without sizes has a body of 12.
    """
    if "space_before_pt" not in blocks.columns:
        blocks = blocks.withColumn("space_before_pt", F.lit(None).cast("double"))
    c = F.col
    known = blocks.select(document, ordinal, F.coalesce("size_pt", F.lit(0.0)).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"), "alignment", "structure_type", "visible_text", "space_before_pt")
    beside = neighbours(known, [document], ordinal, ["size"]).select(document, ordinal, c("prev_size"), c("next_size"))
    number = S.numbering(c("visible_text"))
    rows = known.where("structure_type = 'paragraph'").withColumns({"length": F.length(S.delete_space(F.coalesce("visible_text", F.lit("")))), "kind": number["kind"], "depth": number["depth"]})
    rows = rows.withColumns({"rejected": c("kind").isin("date_or_version", "decimal_or_version"), "key": F.round("size", 1)}).withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    rows = rows.withColumn("numbered", c("kind").isNotNull() & ~c("rejected"))
    sizes = rows.where("size > 0").groupBy(document, "size").agg(F.count_if((c("length") > LONG) | ~c("bold")).alias("nb"), F.count(F.lit(1)).alias("n"))
    body = sizes.groupBy(document).agg(F.coalesce(F.expr("percentile(size, 0.5, nb)"), F.expr("percentile(size, 0.5, n)")).alias("body"))
    rows = rows.join(body, document, "left").withColumn("body", F.coalesce("body", F.lit(12.0)))
    rows = rows.withColumn("rel", F.coalesce(F.when(c("size") > 0, F.bround(c("size") / c("body"), 3)), F.lit(1.0)))
    like = (c("length") <= SHORT) & c("bold") & c("numbered") & (c("size") > 0) & (c("rel") >= FAMILY_FROM)
    families = rows.where(like).groupBy(document, "key").agg(F.count(F.lit(1)).alias("like_n"))
    families = families.withColumn("rank", F.dense_rank().over(Window.partitionBy(document).orderBy(F.desc("key")))).withColumn("families", F.max("rank").over(Window.partitionBy(document)))
    most = families.groupBy(document).agg(F.max("families").alias("families"))
    rows = rows.join(families.select(document, "key", "like_n", F.when(c("rank") <= 9, c("rank")).alias("level")), [document, "key"], "left").join(most, document, "left").join(beside, [document, ordinal])

    short, long, emphasis = c("length") <= SHORT, c("length") > LONG, c("bold") | (F.coalesce("alignment", F.lit("")) == "center")
    centered, rel, numbered = F.coalesce(c("alignment") == "center", F.lit(False)), c("rel"), c("numbered")
    deep = F.coalesce(c("depth") >= 2, F.lit(False))
    inferred = F.when(deep, c("depth")).otherwise(c("level"))
    differs = deep & F.coalesce(c("level") != c("depth"), F.lit(False))
    conflicts = F.array_compact(F.array(F.when(differs, "numbering_vs_size_level"), F.when(c("rejected"), "numbering_rejected")))
    family = inferred.isNotNull() & (F.coalesce("like_n", F.lit(0)) >= 1) & (F.coalesce("families", F.lit(0)) >= 2)
    calibrated = family & short & emphasis & numbered & ~long & ~differs & ~c("rejected")
    alike = F.coalesce(F.abs(c("prev_size") - c("size")) < 0.1, F.lit(False)) & F.coalesce(F.abs(c("next_size") - c("size")) < 0.1, F.lit(False))
    spacing = F.coalesce(c("space_before_pt") >= SPACE_FROM, F.lit(False))
    raw = F.lit(HEADING_BASE) + F.when(rel >= SIZE_FROM, F.least(F.lit(SIZE_TOP), (rel - 1.0) * SIZE_SLOPE)).otherwise(0.0)
    raw = raw + _points((short, IS_SHORT), (emphasis, HAS_EMPHASIS), (spacing, HAS_SPACING), (numbered, IS_NUMBERED), (c("rejected"), IS_REJECTED), (long, IS_LONG), (alike & ~numbered, IS_ALIKE))
    heading = F.when(calibrated, AUTOMATIC).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(HEADING_TOP), raw)))
    title = F.when(centered & (rel >= TITLE_FROM) & short, F.least(F.lit(TITLE_TOP), heading + TITLE_GAIN)).when(~centered | (rel < TITLE_UNDER), F.greatest(F.lit(0.0), heading - TITLE_LOSS)).otherwise(heading)
    body_score = F.least(F.lit(BODY_TOP), F.lit(BODY_BASE) + _points((long, BODY_LONG), (rel <= BODY_TO, BODY_SIZED), (~emphasis & ~numbered, BODY_PLAIN)))
    heading_role = F.concat(F.lit("heading."), F.coalesce(inferred, F.lit(1)).cast("string"))
    scored = lambda role, score: F.struct((-score).alias("minus"), role.alias("role"), score.alias("score"))
    every = F.array_sort(F.array(scored(F.lit("title"), title), scored(heading_role, heading), scored(F.lit("body"), body_score), scored(F.lit("caption"), F.when(short & ~numbered, CAPTION).otherwise(NO_CAPTION))))
    rows = rows.withColumns({"_all": every, "conflicts": conflicts, "_calibrated": calibrated, "_differs": differs, "_heading": heading_role})
    able = F.filter("_all", lambda x: x["score"] >= LEAST)
    top = F.slice(F.when(F.size(able) > 0, able).otherwise(F.slice("_all", 1, 1)), 1, 3)
    rows = rows.withColumn("_top", top)
    first, second = c("_top")[0], F.try_element_at("_top", F.lit(2))
    clear = (first["score"] >= CLEAR) & F.coalesce(first["score"] - second["score"] >= MARGIN, F.lit(True))
    selected = F.when(c("_calibrated") | c("_differs"), c("_heading")).when(clear, first["role"]).otherwise("body")
    status = F.when(c("_calibrated"), "auto_accepted").when(F.size("conflicts") > 0, "pending_review").otherwise("selected")
    return rows.select(document, ordinal, selected.alias("selected_role"), first["score"].alias("selected_score"), status.alias("review_status"), "conflicts", F.transform("_top", lambda x: F.struct(x["role"].alias("role"), x["score"].alias("score"))).alias("candidates"))
