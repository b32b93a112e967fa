"""Pages of headings, found in order."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heading_pages(headings: DataFrame, lines: DataFrame, by: str, ordinal: str, key: str, page: str) -> DataFrame:
    """by, ordinal, page: for each heading the first page, not before that of the heading above, with a line of its key.

    A heading found on no such page stays on the page of the one above, the first on page 1. The pages of each key of a
    document's headings are read once, in order, and headings step through them: pages before the last one found never
    count again, so a document takes its headings and pages, not their product. What depends on the heading above
    admits no split of a document; only the pages of keys that its headings have are held. Headings of no document have no row.
    """
    kind = {k: dict(headings.dtypes)[k] for k in (by, ordinal)}
    asked = headings.where(F.col(by).isNotNull()).select(by, F.col(ordinal).cast("long").alias("_o"), F.xxhash64(key).alias("_k"), F.lit(1).alias("_side"))
    pages = lines.where(F.col(key).isNotNull()).select(by, F.col(page).cast("long").alias("_o"), F.xxhash64(key).alias("_k"), F.lit(0).alias("_side")).where("_o is not null").distinct()
    both = pages.join(asked.select(by, "_k"), [by, "_k"], "left_semi").select(by, "_o", "_k", "_side").unionByName(asked).repartition(by).sortWithinPartitions(by, "_side", "_o")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, places, now = None, {}, 1
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for g, o, k, heading in zip(*(column.to_pylist() for column in batch.columns)):
                if g != group:
                    group, places, now = g, defaultdict(deque), 1
                if not heading:
                    places[k].append(o)
                    continue
                queue = places.get(k)
                while queue and queue[0] < now:
                    queue.popleft()
                now = queue[0] if queue else now
                for column, value in zip(out, (g, o, now)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=[by, "_n", page])

    walked = both.mapInArrow(walk, f"{by} {kind[by]}, _n long, {page} int")
    return walked.select(by, F.col("_n").cast(kind[ordinal]).alias(ordinal), page)
