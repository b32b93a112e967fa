"""Schemas that drift between batches of files: fingerprints, every change, and one table through migration steps.

A batch's fingerprint is the set of its paths with the JSON types each takes. Neighbouring fingerprints of a producer
give the paths gone, new and retyped; a gone and a new path are one field renamed if all projects in both batches kept
its values. Fingerprints are small against the files and are written once; files are read a second time only where a
batch has both gone and new paths, and only for those paths.

`consistent_manifests` sends each file through its version's chain of steps and lists those that changed it: first the
renames found between its producer's batches, undone from its own batch back to the producer's first, then the renames,
defaults and casts between the known schema versions. What the typed columns do not hold stands beside them by its path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.jsontree import NotJson, json_text, kind, parse, pointer, scalar_text
from sheaf.session import cut

LEFT_OUT = "source.tree"
COMMENT = "_comment"


def paths(document: Any) -> Iterator[tuple[str, str, bytes | None]]:
    """Each path with a type it takes and, for a scalar outside arrays, a digest of its value."""
    waiting = [("", document)]
    while waiting:
        path, value = waiting.pop()
        what = kind(value)
        if path and what != "null":
            scalar = what not in ("object", "array") and "[]" not in path
            yield path, what, hashlib.md5(scalar_text(value).encode()).digest() if scalar else None
        if isinstance(value, dict):
            for key, part in value.items():
                below = f"{path}.{key}" if path else key
                if not key.startswith(COMMENT) and below != LEFT_OUT:
                    waiting.append((below, part))
        elif isinstance(value, list):
            waiting += [(path + "[]", part) for part in value]


def leaves(files: DataFrame) -> DataFrame:
    """producer_id, batch_no, project_key, path, type, value: once for each file that is JSON; and a row of path '' for it."""
    names = ["producer_id", "batch_no", "project_key", "path", "type", "value"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for *own, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    document = parse(text)
                except NotJson:
                    continue
                for row in {("", "", None), *paths(document)}:
                    for column, value in zip(columns, (*own, *row)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = files.where("raw_json is not null and producer_id is not null and batch_no is not null")
    return rows.select("producer_id", F.col("batch_no").cast("int").alias("batch_no"), "project_key", "raw_json").mapInArrow(read, "producer_id long, batch_no int, project_key string, path string, type string, value binary")


def schema_changes(files: DataFrame) -> DataFrame:
    """producer_id, batch_no, change_kind, old_path, new_path: each change from a producer's next lower batch.

    A batch is all its files that are JSON, whenever received; batches of which no file is JSON count as never sent.
    Files without producer or batch are left out; files without project take no part in telling renamed paths.
    Nulls, comment keys and source.tree are no paths. Repeated files change nothing; no files, no rows.
    """
    batch = ["producer_id", "batch_no"]
    prints = cut(leaves(files).groupBy(*batch, "path").agg(F.array_sort(F.collect_set("type")).alias("types")))
    steps = prints.where("path = ''").select(*batch, F.lag("batch_no").over(Window.partitionBy("producer_id").orderBy("batch_no")).alias("earlier")).where("earlier is not null")
    later = prints.join(steps, batch).select(*batch, "path", F.lit(None).cast("array<string>").alias("before"), F.col("types").alias("after"))
    earlier = steps.select("producer_id", F.col("batch_no").alias("next"), F.col("earlier").alias("batch_no"))
    before = prints.join(earlier, batch).select("producer_id", F.col("next").alias("batch_no"), "path", F.col("types").alias("before"), F.lit(None).cast("array<string>").alias("after"))
    pair = before.unionByName(later).groupBy(*batch, "path").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    changed = cut(pair.where("path <> '' and not before <=> after"))
    gone, new = changed.where("after is null").select(*batch, F.col("path").alias("old_path")), changed.where("before is null").select(*batch, F.col("path").alias("new_path"))
    retyped = changed.where("before is not null and after is not null").select(*batch, F.lit("retyped").alias("change_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"))

    movable = lambda rows, c: rows.where(~F.col(c).contains("[]"))
    both = movable(gone, "old_path").select(*batch).distinct().join(movable(new, "new_path").select(*batch).distinct(), batch).join(steps, [*batch])
    # the files of the two batches of each such step, under the later batch's number
    reads = both.select("producer_id", F.col("batch_no").alias("next"), F.explode(F.array(F.struct(F.col("earlier").alias("b"), F.lit(0).alias("side")), F.struct(F.col("batch_no").alias("b"), F.lit(1).alias("side")))).alias("r"))
    wanted = reads.select("producer_id", "next", F.col("r.b").alias("batch_no"), F.col("r.side").alias("side"))
    asked = movable(gone, "old_path").select(*batch, F.lit(0).alias("side"), F.col("old_path").alias("path")).unionByName(movable(new, "new_path").select(*batch, F.lit(1).alias("side"), F.col("new_path").alias("path")))
    asked = asked.unionByName(wanted.select("producer_id", F.col("next").alias("batch_no"), "side", F.lit("").alias("path"))).select("producer_id", F.col("batch_no").alias("next"), "side", "path")
    some = files.join(wanted.select(*batch).distinct(), batch, "left_semi")
    own = ["producer_id", "next", "side", "project_key", "path"]
    values = (
        leaves(some)
        .where("project_key is not null and (value is not null or path = '')")
        .join(wanted, batch)
        .join(asked, ["producer_id", "next", "side", "path"], "left_semi")
        .select(*own, "type", "value")
        .distinct()
        .groupBy(*own)
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("type", "value")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "type", "value")).alias("y"))
    )
    values = cut(values)
    project = ["producer_id", "next", "project_key"]
    there = values.where("path = '' and side = 1").select(*project)
    old = values.where("path <> '' and side = 0").join(there, project, "left_semi").select(*project, F.col("path").alias("old_path"), "n", "x", "y")
    fresh = values.where("path <> '' and side = 1").select(*project, F.col("path").alias("new_path"), "n", "x", "y")
    needed = old.groupBy("producer_id", "next", "old_path").agg(F.count(F.lit(1)).alias("needed"))
    renamed = (
        old.join(fresh, [*project, "n", "x", "y"])
        .groupBy("producer_id", "next", "old_path", "new_path")
        .agg(F.count(F.lit(1)).alias("kept"))
        .join(needed, ["producer_id", "next", "old_path"])
        .where("kept = needed")
        .select("producer_id", F.col("next").alias("batch_no"), F.lit("renamed").alias("change_kind"), "old_path", "new_path")
    )
    renamed = cut(renamed)
    removed = gone.join(renamed, [*batch, "old_path"], "left_anti").select(*batch, F.lit("removed").alias("change_kind"), "old_path", F.lit("").alias("new_path"))
    added = new.join(renamed, [*batch, "new_path"], "left_anti").select(*batch, F.lit("added").alias("change_kind"), F.lit("").alias("old_path"), "new_path")
    return renamed.unionByName(removed).unionByName(added).unionByName(retyped)


def schema_versions(files: DataFrame) -> DataFrame:
    """producer_id, batch_no, version, fingerprint, n_paths: the fingerprint of each batch and its number among the producer's.

    A fingerprint is the digest of a batch's paths and the types each takes; version counts the producer's different
    fingerprints in order of their first batch, so a batch that goes back to an earlier schema has that one's number.
    Batches count as in schema_changes.
    """
    c = F.col
    prints = leaves(files).groupBy("producer_id", "batch_no", "path").agg(F.array_sort(F.collect_set("type")).alias("types")).where("path <> ''")
    line = F.concat("path", F.lit(":"), F.array_join("types", ","))
    batches = leaves(files).where("path = ''").select("producer_id", "batch_no").distinct()
    made = prints.groupBy("producer_id", "batch_no").agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("fingerprint"), F.count(F.lit(1)).alias("n_paths"))
    made = cut(batches.join(made, ["producer_id", "batch_no"], "left").select("producer_id", "batch_no", F.coalesce("fingerprint", F.md5(F.lit(""))).alias("fingerprint"), F.coalesce("n_paths", F.lit(0)).alias("n_paths")))
    first = made.groupBy("producer_id", "fingerprint").agg(F.min("batch_no").alias("_first"))
    number = first.select("producer_id", "fingerprint", F.row_number().over(Window.partitionBy("producer_id").orderBy("_first")).alias("version"))
    return made.join(number, ["producer_id", "fingerprint"]).select("producer_id", "batch_no", c("version"), "fingerprint", "n_paths")


#: Migration steps in the order in which a file goes through them: what, from path or default, to path.
MIGRATION: tuple[tuple[str, Any, str], ...] = (
    ("rename", "cover.title", "cover.main_title"),
    ("rename", "cover.prepared_by", "cover.author"),
    ("rename", "fonts.heading_1", "fonts.h1"),
    ("rename", "fonts.text", "fonts.body"),
    ("rename", "source.path", "source.file"),
    ("cast", "integer", "schema_version"),
    ("default", 2, "schema_version"),
    ("cast", "integer", "toc_depth"),
    ("default", 3, "toc_depth"),
    ("cast", "text", "cover.date"),
    ("documents", "output.compiled_document", "output.documents"),
)
#: The parts a delivery has if its manifest names none.
DEFAULT_PARTS = ("cover", "toc", "body")
TABLE = "manifest_id long, producer_id long, project_key string, batch_no int, schema_version int, project_name string, main_title string, author string, cover_date string, source_file string, toc_depth int, documents array<struct<id:string,filename:string,parts:array<string>>>, steps array<string>, rest array<struct<path:string,value:string>>"
#: What the typed columns hold as it is: texts, whole numbers, and the parts of the entries of documents.
TEXTS = {"/project_name", "/cover/main_title", "/cover/author", "/cover/date", "/source/file"}
NUMBERS = {"/schema_version", "/toc_depth"}
DOCUMENTS = "/output/documents"
#: Objects are opened so many levels deep; below, and in source.tree, they stay one text, as paths would grow with the depth.
OPENED = 32


def _get(document: dict, path: str) -> Any:
    for key in path.split("."):
        document = document.get(key) if isinstance(document, dict) else None
    return document


def _put(document: dict, path: str, value: Any) -> None:
    *above, last = path.split(".")
    for key in above:
        if not isinstance(document.get(key), dict):
            document[key] = {}
        document = document[key]
    document[last] = value


def _take(document: dict, path: str) -> None:
    *above, last = path.split(".")
    holders = []
    for key in above:
        holders.append((document, key))
        document = document.get(key) if isinstance(document, dict) else None
    if isinstance(document, dict):
        document.pop(last, None)
        for holder, key in reversed(holders):  # an object that this emptied goes, too
            if holder[key] == {}:
                del holder[key]


def _null_on(document: dict, path: str) -> list[str]:
    """The pointer of the null that stands on the way to a path, if one does."""
    at, value = "", document
    for key in path.split("."):
        if not isinstance(value, dict) or key not in value:
            return []
        at, value = pointer(at, key), value[key]
        if value is None:
            return [at]
    return []


def _move(document: dict, path: str, to: str, nulls: list[str]) -> bool:
    """Whether there was a value to move and room for it: nothing at its new path and no scalar or array above.

    nulls gets the pointer of a null that the value replaces.
    """
    value = _get(document, path)
    if value is None or _get(document, to) is not None:
        return False
    _take(document, path)
    above = to.split(".")[:-1]
    room = all(isinstance(_get(document, ".".join(above[: n + 1])), dict | None) for n in range(len(above)))
    nulls += _null_on(document, to) if room else []
    _put(document, to if room else path, value)
    return room


#: A whole number, however written: `3`, `"3"`, `"v3"`, `3.0`.
WHOLE = re.compile(r'[ "]*[vV]?(-?[0-9]{1,10})(?:\.0+)?[ "]*')


def _whole(value: Any) -> int | None:
    """The whole number of 32 bits that a value stands for, if it does for one."""
    found = WHOLE.fullmatch(scalar_text(value)) if not isinstance(value, (dict, list, bool)) else None
    number = int(found[1]) if found else None
    return number if number is not None and -(1 << 31) <= number < 1 << 31 else None


def _two_digits(value: Any) -> str:
    return f"{int(value):02d}" if isinstance(value, int) or isinstance(value, float) and value.is_integer() else str(value)


def remaining(document: dict) -> list[tuple[str, str]]:
    """JSON pointer and JSON text of each leaf that the typed columns do not hold as it is; comment keys are none.

    A leaf is a scalar, null, an array or an empty object. A value that a cast changes is here as it was.
    """
    out, waiting = [], [("", 0, document)]
    while waiting:
        at, depth, value = waiting.pop()
        if isinstance(value, dict) and value and depth < OPENED and at != pointer("/source", "tree"):
            waiting += [(pointer(at, k), depth + 1, v) for k, v in value.items() if not k.startswith(COMMENT)]
        elif at == DOCUMENTS and isinstance(value, list) and value:
            for i, entry in enumerate(value):
                if not isinstance(entry, dict) or not entry:
                    out.append((pointer(at, i), json_text(entry)))
                    continue
                for k, v in entry.items():
                    held = k in ("id", "filename") and isinstance(v, str) or k == "parts" and isinstance(v, list) and all(isinstance(p, str) for p in v)
                    if not held and not k.startswith(COMMENT):
                        out.append((pointer(pointer(at, i), k), json_text(v)))
        elif not (at in TEXTS and isinstance(value, str) or at in NUMBERS and type(value) is int and _whole(value) is not None):
            out.append((at, json_text(value)))
    return out


def migrated(document: dict, renames: list[tuple[str, str]] = ()) -> tuple[list[str], list[tuple[str, str]]]:
    """Brings one manifest to the latest form in place; the steps that changed it, and what remains beside the typed columns.

    renames: new and old path of the producer's renames up to this file's batch, the last one first.
    """
    nulls: list[str] = []
    done = [f"undo {new}" for new, old in renames if _move(document, new, old, nulls)]
    done += [f"{step} {path}" for step, what, path in MIGRATION if step == "rename" and _move(document, what, path, nulls)]
    rest = sorted((dict.fromkeys(nulls, "null") | dict(remaining(document))).items())
    for step, what, path in MIGRATION:
        have = _get(document, path)
        if step == "default" and have is None:
            _put(document, path, what)
        elif step == "cast" and what == "integer" and have is not None and (type(have) is not int or _whole(have) is None):
            _put(document, path, _whole(have))
            if _whole(have) is None:
                done.append(f"reject {path} {json_text(have)}")
                continue
        elif step == "cast" and what == "text" and isinstance(have, dict):
            _put(document, path, "-".join(_two_digits(have[k]) for k in ("year", "month", "day") if k in have))
        elif step == "documents":
            single = _get(document, what)
            entries = have if isinstance(have, list) else [{"id": "main", "filename": single}] if isinstance(single, str) else []
            made, old = [], isinstance(have, list)
            for entry in entries:
                entry = entry if isinstance(entry, dict) else {}
                parts = entry.get("parts")
                if isinstance(parts, str):
                    parts = [p.strip() for p in parts.split(",") if p.strip()]
                elif not isinstance(parts, list):
                    parts = list(DEFAULT_PARTS)
                old &= parts == entry.get("parts")
                made.append({"id": entry.get("id"), "filename": entry.get("filename"), "parts": [p for p in parts if isinstance(p, str)]})
            _put(document, path, made)
            if old:
                continue
        else:
            continue
        done.append(f"{step} {path}")
    return done, rest


def consistent_manifests(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row for each manifest that is a JSON object, in the latest form, with the migration steps that changed it.

    rest: by JSON pointer, the JSON text of everything else in the manifest, after renames and before casts. A value that
    is no whole number where one is due is rejected: a step names it, rest has it, and the default stands.
    changes: of schema_changes; with it renames that only one producer made are undone, too. Null and broken files have
    no row, repeated files one.
    """
    text = lambda v: None if v is None or isinstance(v, (dict, list)) else str(v)

    def migrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.struct([("id", pa.string()), ("filename", pa.string()), ("parts", pa.list_(pa.string()))])
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5, pa.int32(), pa.list_(kept), pa.list_(pa.string()), pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))]
        names = [x.strip().split(" ")[0] for x in TABLE.split("<")[0].split(",")] + ["steps", "rest"]
        for batch in batches:
            rows = []
            for *own, raw, renames in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    document = parse(raw)
                except NotJson:
                    continue
                if isinstance(document, dict):
                    steps, rest = migrated(document, [(r["new_path"], r["old_path"]) for r in reversed(renames or []) if own[3] is not None and r["batch_no"] <= own[3]])
                    get = lambda p, d=document: text(_get(d, p))
                    documents = [{k: text(v) if k != "parts" else v for k, v in d.items()} for d in _get(document, "output.documents")]
                    rows.append([*own, _get(document, "schema_version"), *map(get, ("project_name", "cover.main_title", "cover.author", "cover.date", "source.file")), _get(document, "toc_depth"), documents, steps, [{"path": p, "value": v} for p, v in rest]])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

    own = files.where("raw_json is not null").select("manifest_id", "producer_id", "project_key", F.col("batch_no").cast("int").alias("batch_no"), "raw_json")
    if changes is None:
        own = own.withColumn("renames", F.lit(None).cast("array<struct<batch_no:int,old_path:string,new_path:string>>"))
    else:
        chains = changes.where("change_kind = 'renamed'").groupBy("producer_id").agg(F.array_sort(F.collect_list(F.struct("batch_no", "old_path", "new_path"))).alias("renames"))
        own = own.join(chains, "producer_id", "left").select("manifest_id", "producer_id", "project_key", "batch_no", "raw_json", "renames")
    return own.mapInArrow(migrate, TABLE).distinct().withColumn("rest", F.map_from_entries("rest"))
