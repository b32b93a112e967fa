"""Layered configurations as leaf rows: the last layer wins leaf by leaf, objects merge, everything else replaces."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.jsontree import NotJson, json_text, kind, parse, pointer


def leaves_of(document: Any) -> Iterator[tuple[str, str, str]]:
    """JSON pointer, kind and compact JSON text, members in the order written, of every leaf: a scalar, an array, null, or an empty object."""
    waiting = [("", document)]
    while waiting:
        at, value = waiting.pop()
        if isinstance(value, dict) and value:
            waiting += [(pointer(at, k), v) for k, v in value.items()]
        else:
            yield at, kind(value), json_text(value, compact=True)


def json_leaves(files: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """keys, pointer, kind, value of every leaf of a JSON column; texts that are not JSON have none."""
    chosen = files.select(*keys, raw)
    schema = ", ".join(f"`{k}` {t}" for k, t in chosen.drop(raw).dtypes) + ", pointer string, kind string, value string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, columns = [], ([], [], [])
            for i, text in enumerate(batch.column(len(keys))):
                try:
                    document = parse(text.as_py())
                except NotJson:
                    continue
                for leaf in leaves_of(document):
                    index.append(i)
                    for column, value in zip(columns, leaf):
                        column.append(value)
            own = [batch.column(k).take(pa.array(index, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.string()) for x in columns)], names=[*keys, "pointer", "kind", "value"])

    return chosen.mapInArrow(read, schema)


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, joined by a shuffle only: Spark's estimates know nothing of how many leaves a file has, and by them the leaves would be sent to the driver."""
    return rows.hint("merge")


def spans(leaves: DataFrame, by: list[str], layer: str) -> DataFrame:
    """by, first: the first layer with leaves, alone: whether it is the only one."""
    own = F.col(layer)
    one = F.coalesce((F.min(own) == F.max(own)) & F.bool_and(own.isNotNull()), F.lit(False))
    return leaves.groupBy(*by).agg(F.min(own).alias("first"), one.alias("alone"))


def later_nulls(leaves: DataFrame, by: list[str], layer: str) -> DataFrame:
    """The leaves with refused: whether one is null in any but the first layer."""
    first = leaves.groupBy(*by).agg(F.min(layer).alias("_first"))
    return leaves.join(first, by).withColumn("refused", (F.col("kind") == "null") & (F.col(layer) > F.col("_first"))).drop("_first")


def merge_layers(leaves: DataFrame, by: list[str], layer: str, refuse_null: bool = False) -> DataFrame:
    """by, pointer, kind, value, layer of the merged configuration (M01): each leaf with the layer it comes from.

    A leaf is dropped if a later layer has the same leaf, a leaf above it (which replaced the object) or a leaf below it
    (which put an object in its place). An empty object adds nothing where there is an object already. With refuse_null
    (M02) a null in any but the first layer is an error. Ancestors are met by equality, never by prefix.
    """
    c = F.col
    if refuse_null:
        leaves = later_nulls(leaves, by, layer).withColumn("value", F.when(c("refused"), F.raise_error(F.concat(F.lit("null at "), "pointer"))).otherwise(c("value"))).drop("refused")
    parts = F.split("pointer", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda n: F.array_join(F.slice(parts, 1, n + 1), "/"))
    opened = leaves.select(*by, c(layer).alias("_l"), "pointer", F.explode(F.when(c("pointer") != "", ancestors).otherwise(F.array().cast("array<string>"))).alias("_up"))
    below = opened.groupBy(*by, c("_up").alias("pointer")).agg(F.max("_l").alias("_below"))  # the last layer with anything under a pointer
    solid = (c("kind") != "object").cast("int")
    at = leaves.groupBy(*by, "pointer").agg(F.max_by(F.struct("kind", "value", c(layer).alias("layer")), F.struct(solid * 0 + c(layer))).alias("_w"), F.max(F.when(c("kind") != "object", c(layer))).alias("_solid"))
    solids = at.where("_solid is not null").select(*by, c("pointer").alias("_up"), "_solid")
    above = opened.join(shuffled(solids), [*by, "_up"]).groupBy(*by, "pointer").agg(F.max("_solid").alias("_above"))
    kept = at.join(shuffled(below), [*by, "pointer"], "left").join(shuffled(above), [*by, "pointer"], "left")
    own = c("_w.layer")
    empty = c("_w.kind") == "object"
    dropped = F.coalesce(c("_above") > own, F.lit(False)) | F.coalesce((c("_below") > own) | (empty & (c("_below") > F.coalesce(F.greatest(F.coalesce("_solid", F.lit(-1)), F.coalesce("_above", F.lit(-1))), F.lit(-1)))), F.lit(False))
    return kept.where(~dropped).select(*by, "pointer", c("_w.kind").alias("kind"), c("_w.value").alias("value"), own.alias("layer"))
