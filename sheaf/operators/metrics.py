"""Quality of predicted roles against labels. A ratio without denominator is null, never 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_heading(role: Column) -> Column:
    return F.coalesce((role == "title") | role.startswith("heading."), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def role_metrics(nodes: DataFrame, by: list[str] | None = None, sets: list[list[str]] | None = None) -> DataFrame:
    """Eleven measures over nodes of label, accepted (null: not accepted) and candidates (array), by group or grouping sets.

    An accepted node without label makes `unlabelled` greater than zero; it is in no measure.
    """
    n = lambda x: F.coalesce(F.count_if(x), F.lit(0))
    label, accepted = F.col("label"), F.col("accepted")
    taken = accepted.isNotNull() & label.isNotNull()
    measures = [
        n(taken).alias("accepted_count"),
        n(taken & is_heading(accepted) & is_heading(label)).alias("accepted_heading_count"),
        n(taken & (accepted == label)).alias("exact_role_count"),
        n(is_heading(label)).alias("heading_count"),
        n(is_heading(label) & F.coalesce(F.array_contains("candidates", label), F.lit(False))).alias("candidate_exact_role_count"),
        n(taken & (label == "body") & is_heading(accepted)).alias("body_as_heading_false_positives"),
        n(accepted.isNotNull() & label.isNull()).alias("unlabelled"),
    ]
    if sets is not None:
        keys = sorted({k for s in sets for k in s})
        grouped = nodes.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
        counted = grouped.agg(F.grouping_id(*keys).alias("grain"), *measures)
    else:
        counted = nodes.groupBy(*(by or [])).agg(*measures)
    c = F.col
    return counted.withColumns(
        {
            "heading_detection_precision": ratio(c("accepted_heading_count"), c("accepted_count")),
            "exact_role_auto_precision": ratio(c("exact_role_count"), c("accepted_count")),
            "auto_acceptance_coverage": ratio(c("accepted_heading_count"), c("heading_count")),
            "correct_auto_coverage": ratio(c("exact_role_count"), c("heading_count")),
            "candidate_exact_role_coverage": ratio(c("candidate_exact_role_count"), c("heading_count")),
        }
    )


def per_role(nodes: DataFrame) -> DataFrame:
    """role, support, predicted, tp, fp, fn, precision, recall from nodes of label and prediction."""
    side = lambda role, l, p, tp: F.struct(role.alias("role"), F.lit(l).alias("l"), F.lit(p).alias("p"), tp.cast("int").alias("tp"))
    both = F.array(side(F.col("label"), 1, 0, F.col("label") == F.col("prediction")), side(F.col("prediction"), 0, 1, F.lit(0)))
    sides = nodes.select(F.explode(both).alias("s")).select("s.*")
    counts = sides.where("role is not null").groupBy("role").agg(F.sum("l").alias("support"), F.sum("p").alias("predicted"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    c = F.col
    return counts.select("role", "support", "predicted", "tp", (c("predicted") - c("tp")).alias("fp"), (c("support") - c("tp")).alias("fn"), ratio(c("tp"), c("predicted")).alias("precision"), ratio(c("tp"), c("support")).alias("recall"))
