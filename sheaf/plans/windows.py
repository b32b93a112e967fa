"""Queries of ordered computations over documents, fields and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions import scalars as S
from sheaf.operators.windows import islands, neighbours, numbered, running
from sheaf.plans.carriers import CURRENT, DRAWN, current_blocks, distinct_rows, drawn_blocks
from sheaf.plans.registry import query
from sheaf.plans.scalars import SP
from sheaf.session import table

ORDER = ["block_ord", "part_uri", "element_path"]
_O = "order by block_ord, part_uri, element_path"
c = F.col


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current blocks with their place n in the document."""
    return numbered(drawn_blocks(spark, sf_dir), ["source_sha256"], ORDER, "n", "block_ord")


ORDERED = DRAWN + f", ordered as (select *, row_number() over (partition by source_sha256 {_O}) n from drawn_blocks where source_sha256 is not null)"


@query("w02_bookmark_numbers", f"with {CURRENT} select source_sha256, element_path, part_uri, '_Toc_' || lpad((row_number() over (partition by source_sha256 {_O}))::varchar, 4, '0') bookmark from current_blocks where outline_level is not null")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings numbered through each document."""
    heads = numbered(current_blocks(spark, sf_dir).where("outline_level is not null"), ["source_sha256"], ORDER, "n", "block_ord")
    return heads.select("source_sha256", "element_path", "part_uri", F.concat(F.lit("_Toc_"), F.when(c("n") < 10000, F.lpad(c("n").cast("string"), 4, "0")).otherwise(c("n").cast("string"))).alias("bookmark"))


@query(
    "w03_sibling_titles",
    f"""with {CURRENT}, h as (select *, row_number() over (partition by source_sha256, outline_level {_O}) seq from current_blocks where outline_level is not null and visible_text is not null)
    select source_sha256, element_path, outline_level, seq, case when outline_level = 1 then (case when regexp_matches(visible_text, '^[一二三四五六七八九十]+、') then visible_text else coalesce(['{"','".join(S.CHINESE_NUMERALS)}'][seq], seq::varchar) || '、' || visible_text end)
      when outline_level = 2 then (case when regexp_matches(visible_text, '^\\d+\\.') then visible_text else seq || '. ' || visible_text end)
      when outline_level = 3 then (case when regexp_matches(visible_text, '^（\\d+）') then visible_text else '（' || seq || '）' || visible_text end) else visible_text end title from h""",
)
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings numbered within their level, in the level's style."""
    heads = numbered(current_blocks(spark, sf_dir).where("outline_level is not null and visible_text is not null"), ["source_sha256", "outline_level"], ORDER, "seq", "block_ord")
    return heads.select("source_sha256", "element_path", "outline_level", "seq", S.node_title(c("visible_text"), c("outline_level"), c("seq")).alias("title"))


@query(
    "w04_neighbour_sizes",
    f"with {ORDERED} select source_sha256, n, size_pt, coalesce(abs(size_pt - lag(size_pt) over w) < 0.1, false) same_before, coalesce(abs(size_pt - lead(size_pt) over w) < 0.1, false) same_after from ordered window w as (partition by source_sha256 order by n)",
)
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the blocks before and after have the same size."""
    beside = neighbours(ordered(spark, sf_dir), ["source_sha256"], "n", ["size_pt"])
    same = lambda x: F.coalesce(F.abs(c("size_pt") - c(x)) < 0.1, F.lit(False))
    return beside.select("source_sha256", "n", "size_pt", same("prev_size_pt").alias("same_before"), same("next_size_pt").alias("same_after"))


@query(
    "w05_size_levels",
    f"with {DRAWN}, s as (select distinct source_sha256, size_pt from drawn_blocks where size_pt > 12) select source_sha256, size_pt, r::int size_level from (select *, dense_rank() over (partition by source_sha256 order by size_pt desc) r from s) where r <= 9",
)
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels by rank of the sizes used, the nine largest."""
    sizes = drawn_blocks(spark, sf_dir).where("size_pt > 12").select("source_sha256", "size_pt").distinct()
    rank = F.dense_rank().over(Window.partitionBy("source_sha256").orderBy(F.desc("size_pt")))
    return sizes.withColumn("size_level", rank).where("size_level <= 9")


@query(
    "w06_heading_counters",
    f"with {CURRENT} select source_sha256, element_path, part_uri, (sum(case when outline_level is not null then 1 else 0 end) over (partition by source_sha256 {_O}))::bigint headings_so_far, case when outline_level is not null then '_Toc_' || substr(md5(element_path), 1, 6) end marker from current_blocks where source_sha256 is not null",
)
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many headings stand at or before each block, and each heading's marker."""
    counted = running(current_blocks(spark, sf_dir), ["source_sha256"], ORDER, {"headings_so_far": c("outline_level").isNotNull().cast("long")}, position="block_ord")
    return counted.select("source_sha256", "element_path", "part_uri", "headings_so_far", F.when(c("outline_level").isNotNull(), F.concat(F.lit("_Toc_"), F.substring(F.md5("element_path"), 1, 6))).alias("marker"))


@query("w07_occurrence_ordinals", "select item_id, row_number() over (partition by source, kind, content order by item_ord, item_id) ordinal from (select distinct * from inventory_items) where source is not null and kind is not null and content is not null")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which occurrence of its text in its document each item is."""
    return numbered(distinct_rows(spark, sf_dir, "inventory_items", "item_id", "item_ord", "source", "kind", "content"), ["source", "kind", "content"], ["item_ord", "item_id"], "ordinal", "item_ord").select("item_id", "ordinal")


@query(
    "w08_duplicate_index",
    "select item_id, row_number() over (partition by source, fingerprint order by item_ord, item_id) - 1 duplicate_index, row_number() over (partition by source order by item_ord, item_id) - 1 source_index from (select distinct * from inventory_items) where source is not null and fingerprint is not null",
)
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of each item among those of its fingerprint and among all of its document, from 0."""
    items = distinct_rows(spark, sf_dir, "inventory_items", "item_id", "item_ord", "source", "fingerprint").where("fingerprint is not null")
    both = numbered(numbered(items, ["source", "fingerprint"], ["item_ord", "item_id"], "a", "item_ord"), ["source"], ["item_ord", "item_id"], "b", "item_ord")
    return both.select("item_id", (c("a") - 1).alias("duplicate_index"), (c("b") - 1).alias("source_index"))


_SEQ = r"""f as (select distinct obs_id, source_sha256, instruction, lower(string_split(regexp_replace(trim(instruction), '\s+', ' ', 'g'), ' ')[2]) category,
    try_cast(nullif(regexp_extract(instruction, '(?i)\\r\s+(\d+)', 1), '') as int) reset, regexp_matches(instruction, '(?i)\\c(?:\s|$)') again, nullif(regexp_extract(instruction, '\\\*\s+([A-Za-z]+)', 1), '') picture
    from field_observations where command = 'SEQ' and source_sha256 is not null),
  g as (select *, coalesce(sum((reset is not null)::int) over (partition by source_sha256, category order by obs_id), 0) seg from f where category is not null),
  h as (select *, row_number() over (partition by source_sha256, category, seg order by obs_id) r, max(reset) over (partition by source_sha256, category, seg) base from g)
"""


@query(
    "w09_sequence_counters",
    f"with {_SEQ} select obs_id, category, (coalesce(base, 0) + sum(case when reset is not null or again and not (seg = 0 and r = 1) then 0 else 1 end) over (partition by source_sha256, category, seg order by obs_id))::bigint as value, picture from h",
)
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each sequence field: one more than the last of its category, set by a reset switch, repeated by a repeat switch."""
    own = table(spark, sf_dir, "field_observations").where("command = 'SEQ'").select("obs_id", "source_sha256", "instruction").distinct()
    text = c("instruction")
    fields = own.select(
        "obs_id",
        "source_sha256",
        F.lower(F.try_element_at(F.split(S.collapse_space(text), " "), F.lit(2))).alias("category"),
        S.first_group(text, r"(?i)\\r\s+(\d+)").try_cast("int").alias("reset"),
        text.rlike(r"(?i)\\c(?:\s|$)").alias("again"),
        S.first_group(text, r"\\\*\s+([A-Za-z]+)").alias("picture"),
    )
    group = ["source_sha256", "category"]
    segments = running(fields, group, ["obs_id"], {"segment": c("reset").isNotNull().cast("long"), "place": F.lit(1)}, {"base": c("reset")}, "obs_id")
    step = F.when(c("reset").isNotNull() | (c("again") & (c("place") > 1)) | (c("again") & (c("segment") > 0)), 0).otherwise(1)
    return running(segments, [*group, "segment"], ["obs_id"], {"steps": step}, position="obs_id").select("obs_id", "category", (F.coalesce(c("base"), F.lit(0)) + c("steps")).cast("long").alias("value"), "picture")


@query(
    "w10_list_prefixes",
    f"""with {CURRENT}, l as (select source_sha256, element_path, p_style_id, row_number() over (partition by source_sha256, p_style_id {_O}) k from current_blocks where p_style_id in ('Quote', 'Caption', 'Heading1') and source_sha256 is not null)
    select source_sha256, element_path, p_style_id, case p_style_id when 'Quote' then k || '.  ' when 'Caption' then (case when k <= 26 then chr((64 + k)::int) else k::varchar end) || ')  ' else coalesce(['{"','".join(S.CHINESE_NUMERALS)}'][k], k::varchar) || '、  ' end prefix from l""",
)
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List numbers in document order, decimal, by letter or by Chinese numeral."""
    items = numbered(current_blocks(spark, sf_dir).where(c("p_style_id").isin("Quote", "Caption", "Heading1")), ["source_sha256", "p_style_id"], ORDER, "k", "block_ord")
    k = c("k").cast("int")
    letter = F.when(k <= 26, S.to_letters(k, True)).otherwise(k.cast("string"))
    numeral = F.coalesce(F.try_element_at(F.array(*map(F.lit, S.CHINESE_NUMERALS)), k), k.cast("string"))
    prefix = F.when(c("p_style_id") == "Quote", F.concat(k.cast("string"), F.lit(".  "))).when(c("p_style_id") == "Caption", F.concat(letter, F.lit(")  "))).otherwise(F.concat(numeral, F.lit("、  ")))
    return items.select("source_sha256", "element_path", "p_style_id", prefix.alias("prefix"))


_PAGES = r"""pages as (select source_sha256, obs_id, p, row_number() over (partition by source_sha256 order by obs_id) n from (select distinct source_sha256, obs_id, try_cast(cached_value as int) p from field_observations where command = 'PAGEREF' and source_sha256 is not null) where p is not null)"""


def page_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "field_observations").where("command = 'PAGEREF'").select("source_sha256", "obs_id", c("cached_value").try_cast("int").alias("p")).where("p is not null").distinct()
    return numbered(own, ["source_sha256"], ["obs_id"], "n", "obs_id")


@query(
    "w11_page_continuity",
    f"with {_PAGES} select source_sha256, n, p, lag(p) over w as before, case when lag(p) over w is null then 'start' when p < lag(p) over w then 'descends' when p > lag(p) over w + 1 then 'gap' else 'continues' end step from pages window w as (partition by source_sha256 order by n)",
)
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page number follows the one before it."""
    beside = neighbours(page_values(spark, sf_dir), ["source_sha256"], "n", ["p"])
    before = c("prev_p")
    return beside.select("source_sha256", "n", "p", before.alias("before"), F.when(before.isNull(), "start").when(c("p") < before, "descends").when(c("p") > before + 1, "gap").otherwise("continues").alias("step"))


@query(
    "w13_style_islands",
    f"with {ORDERED}, m as (select *, sum(case when n = 1 or p_style_id is distinct from prev then 1 else 0 end) over (partition by source_sha256 order by n) run from (select *, lag(p_style_id) over (partition by source_sha256 order by n) prev from ordered)) select source_sha256, min(p_style_id) p_style_id, min(n) as first, max(n) as last, count(*) as n from m group by source_sha256, run",
)
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blocks with one style."""
    return islands(ordered(spark, sf_dir).withColumnRenamed("n", "at"), ["source_sha256"], "at", "p_style_id")


@query("w14_non_empty_blocks", f"with {CURRENT} select source_sha256, element_path, part_uri from current_blocks where structure_type <> 'paragraph' or regexp_replace(visible_text, '{SP}+', '', 'g') <> ''")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without the empty paragraphs."""
    return current_blocks(spark, sf_dir).where((c("structure_type") != "paragraph") | (S.delete_space(c("visible_text")) != "")).select("source_sha256", "element_path", "part_uri")


@query(
    "w15_inherited_headings",
    f"with {CURRENT} select source_sha256, element_path, part_uri, last_value(case when outline_level is not null then visible_text end ignore nulls) over (partition by source_sha256 {_O} rows between unbounded preceding and current row) heading from current_blocks where source_sha256 is not null",
)
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading under which each block stands, carried forward."""
    return running(current_blocks(spark, sf_dir), ["source_sha256"], ORDER, lasts={"heading": F.when(c("outline_level").isNotNull(), c("visible_text"))}, position="block_ord").select("source_sha256", "element_path", "part_uri", "heading")


@query(
    "w16_text_offsets",
    f"with {CURRENT} select source_sha256, element_path, part_uri, e - coalesce(length(visible_text), 0) as span_start, e as span_end from (select *, (sum(coalesce(length(visible_text), 0)) over (partition by source_sha256 {_O}))::bigint e from current_blocks where source_sha256 is not null)",
)
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each block's text lies in its document's text."""
    size = F.coalesce(F.length("visible_text"), F.lit(0)).cast("long")
    return running(current_blocks(spark, sf_dir), ["source_sha256"], ORDER, {"span_end": size}, position="block_ord").select("source_sha256", "element_path", "part_uri", (c("span_end") - size).alias("span_start"), "span_end")


@query(
    "w17_path_indices",
    f"with {CURRENT} select source_sha256, element_path, part_uri, row_number() over (partition by source_sha256, part_uri, regexp_replace(element_path, '/[^/]+$', ''), regexp_extract(element_path, '/([^/\\[]+)(\\[\\d+\\])?$', 1) {_O}) tag_index from current_blocks where source_sha256 is not null",
)
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of each element among those of its tag under one parent."""
    rows = current_blocks(spark, sf_dir).withColumns({"parent": F.regexp_replace("element_path", "/[^/]+$", ""), "tag": F.regexp_extract("element_path", r"/([^/\[]+)(\[\d+\])?$", 1)})
    return numbered(rows, ["source_sha256", "part_uri", "parent", "tag"], ORDER, "tag_index", "block_ord").select("source_sha256", "element_path", "part_uri", "tag_index")


@query(
    "w19_bookmark_texts",
    f"""with {ORDERED}, m as (select distinct b.bookmark_id, b.source_sha256, o.n from (select distinct * from bookmarks) b join ordered o on b.source_sha256 = o.source_sha256 and b.host_path = o.element_path)
    select m.bookmark_id, string_agg(o.visible_text, '' order by o.n) as text, count(*) n_blocks from m join ordered o on o.source_sha256 = m.source_sha256 and o.n between m.n and m.n + 2 group by m.bookmark_id, m.n""",
)
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text between a bookmark's start and its end two blocks on; the interval is opened to its places, so blocks join by place."""
    blocks = ordered(spark, sf_dir).select("source_sha256", "element_path", "n", "visible_text")
    marks = distinct_rows(spark, sf_dir, "bookmarks", "bookmark_id", "source_sha256", "host_path").select("bookmark_id", "source_sha256", c("host_path").alias("element_path"))
    starts = marks.join(blocks.select("source_sha256", "element_path", "n"), ["source_sha256", "element_path"]).select("bookmark_id", "source_sha256", c("n").alias("start")).distinct()
    places = starts.withColumn("n", F.explode(F.sequence(c("start"), c("start") + 2)))
    met = places.join(blocks.select("source_sha256", "n", "visible_text"), ["source_sha256", "n"])
    parts = F.array_sort(F.collect_list(F.struct("n", "visible_text")))
    return met.groupBy("bookmark_id", "start").agg(parts.alias("p")).select("bookmark_id", F.when(F.exists("p", lambda x: x["visible_text"].isNotNull()), F.array_join(F.transform("p", lambda x: x["visible_text"]), "")).alias("text"), F.size("p").cast("long").alias("n_blocks"))


@query(
    "w20_sequence_audit",
    "select source_sha256, obs_id, given, place from (select *, row_number() over (partition by source_sha256 order by given, obs_id) place from (select distinct source_sha256, obs_id, try_cast(regexp_extract(field_id, '(\\d+)$', 1) as bigint) given from field_observations where source_sha256 is not null) where given is not null) where given <> place",
)
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose number is not their place in the sequence 1 to n."""
    rows = table(spark, sf_dir, "field_observations").select("source_sha256", "obs_id", F.regexp_extract("field_id", r"(\d+)$", 1).try_cast("long").alias("given")).where("given is not null").distinct()
    return numbered(rows, ["source_sha256"], ["given", "obs_id"], "place", "given").where("given <> place").select("source_sha256", "obs_id", "given", "place")
