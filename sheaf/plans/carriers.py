"""Tables that several queries start from, as DataFrames and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import table

#: How each paragraph style is drawn, for tables that name styles only.
STYLE_SIZE = {"Title": 22.0, "heading 1": 16.0, "heading 2": 14.0, "heading 3": 13.0, "caption": 10.5, "Table Text": 10.5}


def current_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block as recorded last. A column that a query does not use is pruned with its aggregate and never read."""
    blocks = table(spark, sf_dir, "blocks")
    key = ["source_sha256", "part_uri", "element_path"]
    order = F.struct("recorded_at", "block_ord")  # rows of one node, time and place are copies of each other
    return blocks.groupBy(*key).agg(*[F.max_by(x, order).alias(x) for x in blocks.columns if x not in key])


def drawn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current blocks with the size, weight and alignment of their style."""
    size = F.lit(12.0)
    for name, points in STYLE_SIZE.items():
        size = F.when(F.col("p_style_name") == name, points).otherwise(size)
    return current_blocks(spark, sf_dir).withColumns(
        {"size_pt": size, "bold": F.col("p_style_name").rlike("^(heading|Title)"), "alignment": F.when(F.col("p_style_name") == "Title", "center").otherwise("left"), "in_table": F.col("element_path").contains("/w:tbl[")}
    )


CURRENT = """current_blocks as (
  select * from (select distinct * from blocks)
  qualify row_number() over (partition by source_sha256, part_uri, element_path order by recorded_at desc nulls last, block_ord desc) = 1)"""
DRAWN = (
    CURRENT
    + ", drawn_blocks as (select *, case p_style_name "
    + " ".join(f"when '{n}' then {s}::double" for n, s in STYLE_SIZE.items())
    + " else 12.0::double end size_pt, regexp_matches(p_style_name, '^(heading|Title)') bold, case when p_style_name = 'Title' then 'center' else 'left' end alignment, contains(element_path, '/w:tbl[') in_table from current_blocks)"
)


def distinct_rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table without its repeated rows; its id is among them, so other columns need not be compared or sent."""
    return table(spark, sf_dir, name).select(*columns).distinct()
