"""References to records that do not exist, by one merge of references and parent keys in time order.

Each parent row is two events of its key, opened and closed; each reference is one event. All events of a key lie in
one partition, sorted by time, and a running sum over them tells at each reference how many parent rows are valid and
how many there ever were. A key's events are cut into slices of time, each of which starts from the sums carried over
from the slices before, so a key with very many events is worked on in many places; the carried sums come from counts
by key and slice, made before any row is shuffled.

A reference is valid if a parent row was opened at or before it and not closed at or before it. Otherwise it is
`deleted` if a parent row had been opened before, `late` if one is opened only later, `missing` if none ever is, and
`undated` if it has no time.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.keys import digest

SLICE_SECONDS = 3_600


@dataclass(frozen=True)
class Parents:
    """Rows that can be referred to: valid from opened (inclusive) to closed (exclusive, null: for good)."""

    name: str
    rows: DataFrame
    keys: tuple[str, ...]
    opened: str
    closed: str


@dataclass(frozen=True)
class References:
    """A column of rows that names rows of a parent; keys in the order of the parent's keys, a null in one is no reference."""

    table: str
    field: str
    rows: DataFrame
    record: str
    at: str
    keys: tuple[str, ...]
    parent: str = field(default="")


def _key(parent: str, keys: tuple[str, ...]) -> Column:
    return digest(F.lit(parent), *map(F.col, keys))


def _parent_events(p: Parents) -> DataFrame:
    opened, closed = F.col(p.opened).cast("timestamp"), F.col(p.closed).cast("timestamp")
    rows = p.rows.select(_key(p.name, p.keys).alias("key"), opened.alias("o"), closed.alias("c"))
    rows = rows.where("key is not null and o is not null and (c is null or c > o)")
    event = lambda at, active, ever: F.struct(at.alias("at"), F.lit(active).alias("active"), F.lit(ever).alias("ever"))
    return (
        rows.select("key", F.explode(F.array(event(F.col("o"), 1, 1), event(F.col("c"), -1, 0))).alias("e"))
        .where("e.at is not null")
        .select("key", "e.at", F.lit(0).cast("byte").alias("kind"), "e.active", "e.ever", F.lit(None).cast("byte").alias("ref"), F.lit(None).cast("long").alias("record_id"))
    )


def _reference_events(r: References, code: int) -> DataFrame:
    return r.rows.select(
        _key(r.parent, r.keys).alias("key"),
        F.col(r.at).cast("timestamp").alias("at"),
        F.lit(1).cast("byte").alias("kind"),
        F.lit(0).alias("active"),
        F.lit(0).alias("ever"),
        F.lit(code).cast("byte").alias("ref"),
        F.col(r.record).cast("long").alias("record_id"),
    ).where("key is not null")


def orphan_references(references: list[References], parents: list[Parents], slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """ref_table, ref_field, record_id, ref_month and status of every reference without a parent valid at its time.

    Keys are compared exactly. Repeated rows of either side count once; parents without opening time or never open
    are none; a reference without time is `undated`, with a null month. Empty tables give no rows.
    """
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    refs = union([_reference_events(r, i) for i, r in enumerate(references)])
    events = union([_parent_events(p) for p in parents]).unionByName(refs.where("at is not null"))
    events = events.withColumn("slice", F.floor(F.unix_timestamp("at") / slice_seconds).cast("int"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy("key", "slice")
        .agg(F.sum("active").cast("int").alias("active"), F.sum("ever").cast("int").alias("ever"), F.max("kind").alias("refs"))
        .select(
            "key",
            "slice",
            "refs",
            F.coalesce(F.sum("active").over(earlier), F.lit(0)).cast("int").alias("active"),
            F.coalesce(F.sum("ever").over(earlier), F.lit(0)).cast("int").alias("ever"),
            F.sum("ever").over(Window.partitionBy("key")).cast("int").alias("total"),
        )
        .where("refs = 1")
        .select("key", "slice", F.lit(None).cast("timestamp").alias("at"), F.lit(-1).cast("byte").alias("kind"), "active", "ever", F.lit(None).cast("byte").alias("ref"), F.lit(None).cast("long").alias("record_id"), "total")
    )
    so_far = Window.partitionBy("key", "slice").orderBy(F.col("at").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        events.withColumn("total", F.lit(0))
        .unionByName(carried)
        .select("at", "kind", "ref", "record_id", F.sum("active").over(so_far).alias("open"), F.sum("ever").over(so_far).alias("opened"), F.max("total").over(so_far).alias("total"))
        .where("kind = 1 and open <= 0")
    )
    status = F.when(F.col("opened") > 0, "deleted").when(F.col("total") > 0, "late").otherwise("missing")
    cases = merged.select("ref", "record_id", F.date_format("at", "yyyy-MM").alias("ref_month"), status.alias("status"))
    undated = refs.where("at is null").select("ref", "record_id", F.lit(None).cast("string").alias("ref_month"), F.lit("undated").alias("status"))
    names = F.array(*[F.struct(F.lit(r.table).alias("t"), F.lit(r.field).alias("f")) for r in references])
    return (
        cases.unionByName(undated)
        .distinct()
        .withColumn("name", names[F.col("ref")])
        .select(F.col("name.t").alias("ref_table"), F.col("name.f").alias("ref_field"), "record_id", "ref_month", "status")
    )
