"""Joins by place, by interval and by occurrence.

Intervals are joined by the latest start at or before a place: both sides lie in one group's order and the start is
carried forward in slices (`windows.running`), so neither a range join nor a task per group is needed. Occurrences are
matched by their ordinal, an equi-join. What depends on the whole sequence before it - greedy matching in order - runs
per document, sorted, in one pass.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.windows import numbered, running


def latest_before(rows: DataFrame, starts: DataFrame, by: list[str], at: str, value: str, into: str, ties: str = "start") -> DataFrame:
    """rows with the value of the latest start at or before their place, null before the first.

    rows and starts have the columns by and the integer place at; starts also value. Of starts at one place the greatest
    value holds. With ties='row' a start at a row's own place does not count for it.
    """
    columns = [x for x in rows.columns if x not in (*by, at)]
    packed = rows.select(*by, at, F.struct(*columns).alias("_row"), F.lit(None).cast(dict(starts.dtypes)[value]).alias("_v"), F.lit(1 if ties == "start" else 0).alias("_kind"))
    marks = starts.where(F.col(value).isNotNull()).groupBy(*by, at).agg(F.max(value).alias("_v")).select(*by, at, F.lit(None).cast(packed.schema["_row"].dataType).alias("_row"), "_v", F.lit(0 if ties == "start" else 1).alias("_kind"))
    both = packed.unionByName(marks).withColumn("_id", F.monotonically_increasing_id())
    carried = running(both, by, [at, "_kind", "_id"], lasts={"_c": F.col("_v")}, position=at)
    return carried.where("_row is not null").select(*by, at, "_row.*", F.col("_c").alias(into))


def by_occurrence(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str], left_id: str, right_id: str, left_position: str | None = None, right_position: str | None = None) -> DataFrame:
    """key, k, left_id, right_id: the k-th occurrence of a key on the left with the k-th on the right; one is null where the other side has fewer."""
    a = numbered(left, key, left_order, "k", left_position).select(*key, "k", F.col(left_id).alias("left_id"))
    b = numbered(right, key, right_order, "k", right_position).select(*key, "k", F.col(right_id).alias("right_id"))
    return a.join(b, [*key, "k"], "full_outer")


def bag_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """key and n: how many more occurrences of a key the left has. Counts meet, not rows."""
    side = lambda rows, sign: rows.select(*key, F.lit(sign).alias("_n"))
    return side(left, 1).unionByName(side(right, -1)).groupBy(*key).agg(F.sum("_n").alias("n")).where("n > 0")


def overlay(one: DataFrame, two: DataFrame, by: list[str], start: str, end: str, value: str) -> DataFrame:
    """by, start, end, value_one, value_two: the elementary intervals of two sets of half-open intervals, and what covers each on either side.

    Intervals of one set must not overlap; empty ones cover nothing.
    """
    ends = lambda rows, side: rows.where(F.col(start) < F.col(end)).select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.struct(F.col(value).alias("v"), F.lit(True).alias("open")).alias("m"), F.lit(1).alias("o")), F.struct(F.col(end).alias("at"), F.struct(F.col(value).alias("v"), F.lit(False).alias("open")).alias("m"), F.lit(0).alias("o")))).alias("e")).select(*by, "e.at", F.lit(side).alias("side"), "e.m", "e.o")
    marks = ends(one, 1).unionByName(ends(two, 2))
    places = marks.groupBy(*by, "at").agg(*[F.max_by(F.when(F.col("side") == s, F.col("m")), F.when(F.col("side") == s, F.col("o"))).alias(f"m{s}") for s in (1, 2)])
    cover = running(places, by, ["at"], {"k": F.lit(1)}, {"c1": F.col("m1"), "c2": F.col("m2")}, position="at")
    following = cover.select(*by, (F.col("k") - 1).alias("k"), F.col("at").alias(end))
    held = lambda m: F.when(F.col(f"{m}.open"), F.col(f"{m}.v"))
    return cover.join(following, [*by, "k"]).select(*by, F.col("at").alias(start), end, held("c1").alias("value_one"), held("c2").alias("value_two")).where("value_one is not null or value_two is not null")


def greedy_matches(expected: DataFrame, actual: DataFrame, by: str, key: str, order: str) -> DataFrame:
    """by, order, key, matched: each expected row takes the first actual row of its key behind the last match; null where there is none.

    A row without partner leaves the cursor where it is. order, an integer, tells the rows of a group apart; rows with a
    null group or key match nothing. Each match depends on the one before, which admits no split of a document: groups
    are sorted by Spark, spilling where needed, and pass through one after another, the actual side first.
    """
    kind = {k: dict(expected.dtypes)[k] for k in (by, order)}
    side = lambda rows, mark: rows.where(F.col(by).isNotNull() & F.col(key).isNotNull()).select(by, F.col(order).cast("long").alias("_o"), F.xxhash64(key).alias("_k"), F.lit(mark).alias("_side"))
    both = side(expected, 1).unionByName(side(actual, 0)).repartition(by).sortWithinPartitions(by, "_side", "_o")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, places, cursor = None, {}, -(1 << 63)
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for g, o, k, wanted in zip(*(column.to_pylist() for column in batch.columns)):
                if g != group:
                    group, places, cursor = g, defaultdict(deque), -(1 << 63)
                if not wanted:
                    places[k].append(o)
                    continue
                queue = places.get(k)
                while queue and queue[0] <= cursor:
                    queue.popleft()
                hit = None
                if queue:
                    hit = cursor = queue.popleft()
                for column, value in zip(found, (g, o, hit)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], batch.schema.field(0).type), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=[by, "_o", "matched"])

    matched = both.mapInArrow(match, f"{by} {kind[by]}, _o long, matched long").select(by, F.col("_o").cast(kind[order]).alias(order), "matched")
    return expected.select(by, order, key).join(matched, [by, order], "left")


def first_rule(text: Column, rules: list[tuple[str, int]]) -> Column:
    """The level of the first pattern of a list that a text matches, null if none does."""
    return reduce(lambda found, rule: F.when(text.rlike(rule[0]), rule[1]).otherwise(found), reversed(rules), F.lit(None).cast("int"))


def first_contained(text: Column, words: list[str]) -> Column:
    """Position of the first word of a list that a text contains, null if none; an empty word is contained in every text."""
    return reduce(lambda found, w: F.when(text.contains(w[1]), w[0]).otherwise(found), reversed(list(enumerate(words))), F.lit(None).cast("int"))
