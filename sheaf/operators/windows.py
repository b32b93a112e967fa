"""Ordered computations that stay spread out when one group holds a large part of all rows.

A running sum or carried value is computed in slices of a group: totals by slice are made before rows are shuffled,
carried from slice to slice - few rows - and joined back, so no task ever holds a whole group. Neighbours meet by their
ordinal, not by a window over their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE = 4096


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, position: str | None = None, size: int = SLICE) -> DataFrame:
    """rows with running sums, itself included, and the last value so far that is not null.

    by: the group; a row with a null in it is left out. order must tell all rows of a group apart. position is an
    integer column that rises with order and cuts a group into slices of size values; without it a group is one slice.
    """
    sums, lasts = sums or {}, lasts or {}
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    rows = rows.where(known).withColumns({f"_s_{k}": v for k, v in sums.items()} | {f"_l_{k}": v for k, v in lasts.items()})
    rows = rows.withColumn("_slice", F.coalesce(F.floor(F.col(position) / size), F.lit(-1)).cast("long") if position else F.lit(0).cast("long"))
    spot = F.struct(*order)
    totals = rows.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_s_{k}").alias(f"_c_{k}") for k in sums],
        *[F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), spot)).alias(f"_c_{k}") for k in lasts],
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_slice", *[F.sum(f"_c_{k}").over(before).alias(f"_c_{k}") for k in sums], *[F.last(f"_c_{k}", True).over(before).alias(f"_c_{k}") for k in lasts])
    within = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, [*by, "_slice"])
    return joined.withColumns(
        {k: F.coalesce(F.sum(f"_s_{k}").over(within), F.lit(0)) + F.coalesce(F.col(f"_c_{k}"), F.lit(0)) for k in sums}
        | {k: F.coalesce(F.last(f"_l_{k}", True).over(within), F.col(f"_c_{k}")) for k in lasts}
    ).drop("_slice", *[f"_{x}_{k}" for k in sums for x in "sc"], *[f"_{x}_{k}" for k in lasts for x in "lc"])


def numbered(rows: DataFrame, by: list[str], order: list[str], into: str = "n", position: str | None = None, size: int = SLICE) -> DataFrame:
    """rows with their ordinal in the group, from 1."""
    return running(rows, by, order, {into: F.lit(1)}, position=position, size=size)


def ranked_position(first: Column, second: Column) -> Column:
    """A position for an order by two integers: first, from 0 and small, before second, from 0 to 2^40."""
    return first.cast("long") * (1 << 40) + second.cast("long")


def text_position(text: Column) -> Column:
    """A position for an order by text: its first two characters, one slice each pair at size 1."""
    return F.ascii(F.substring(text, 1, 1)).cast("long") * (1 << 21) + F.ascii(F.substring(text, 2, 1))


def neighbours(rows: DataFrame, by: list[str], ordinal: str, columns: list[str]) -> DataFrame:
    """rows of by, ordinal and columns with the same columns of the row before (`prev_`) and after (`next_`), null at the ends.

    Each row is sent to its own ordinal and the two beside it and meets its neighbours there: one shuffle by group and
    ordinal, whatever the group's size.
    """
    own = F.struct(*columns)
    sent = rows.select(*by, F.explode(F.array(*[F.struct((F.col(ordinal) + d).alias("at"), F.lit(d).alias("d"), own.alias("row")) for d in (0, 1, -1)])).alias("s"))
    met = sent.groupBy(*by, F.col("s.at").alias(ordinal)).agg(*[F.max(F.when(F.col("s.d") == d, F.col("s.row"))).alias(name) for name, d in (("self", 0), ("prev", 1), ("next", -1))])
    return met.where("self is not null").select(*by, ordinal, *[F.col(f"self.{c}").alias(c) for c in columns], *[F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in ("prev", "next") for c in columns])


def islands(rows: DataFrame, by: list[str], ordinal: str, value: str) -> DataFrame:
    """by, value, first, last, n: maximal runs of one value along the ordinal; null is a value."""
    beside = neighbours(rows.withColumn("_one", F.lit(1)), by, ordinal, [value, "_one"])
    changes = beside.withColumn("_new", (F.col("prev__one").isNull() | ~F.col(value).eqNullSafe(F.col(f"prev_{value}"))).cast("int"))
    marked = running(changes, by, [ordinal], {"_run": F.col("_new")}, position=ordinal)
    return marked.groupBy(*by, "_run").agg(F.min(value).alias(value), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the last by order. Aggregated before the shuffle, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
