"""Folders, configurations and fonts as tables."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.jsontree import NotJson, parse
from sheaf.functions.scalars import file_type, name_parts, node_title
from sheaf.operators.windows import numbered

#: A file that is hidden by another of its name: suffix, the suffix that hides it.
HIDDEN_BY = ((".doc", ".docx"), (".pdf", ".pptx"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Path, folder, name, modificationTime and length of every file below a folder; contents are not read, empty files not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    return files.withColumns({"name": F.element_at(F.split("path", "/"), -1), "folder": F.regexp_replace("path", "/[^/]+$", "")})


def outline_of_files(files: DataFrame) -> DataFrame:
    """Folder, name, type, seq and title of the files that make an outline, in natural order within their folder.

    Hidden, lock and temporary files and unknown types are left out, and so is a file hidden by another of its name.
    Files are numbered in their folder only as far as they are emitted.
    """
    c = F.col
    name = F.lower("name")
    rows = files.where(~c("name").rlike(r"^(\.|~\$)|\.(bak|tmp)$") & ~c("path").contains("__pycache__")).withColumns({"type": file_type(c("name")), "stem": F.regexp_replace("name", r"\.[^.]*$", ""), "suffix": F.regexp_extract(name, r"(\.[^.]*)$", 1)})
    for hidden, by in HIDDEN_BY:
        above = rows.where(c("suffix") == by).select("folder", "stem", F.lit(hidden).alias("suffix")).distinct()
        rows = rows.join(above, ["folder", "stem", "suffix"], "left_anti")
    known = rows.where("type is not null").withColumns({"parts": name_parts(c("name"))["parts"], "raw": name_parts(c("name"))["title"]})
    placed = numbered(known, ["folder"], ["parts", "name"], "seq")
    return placed.select("folder", "name", "type", "seq", node_title(c("raw"), F.lit(2), c("seq")).alias("title"))


def single_documents(files: DataFrame) -> DataFrame:
    """S03 for many folders at once: folder, name and fault; the only document of each folder, else no name but none or several as fault."""
    own = F.lower("name").endswith(".docx") & ~F.col("name").startswith("~$")
    counted = files.groupBy("folder").agg(F.count_if(own).alias("n"), F.min(F.when(own, F.col("name"))).alias("first"))
    return counted.select("folder", F.when(F.col("n") == 1, F.col("first")).alias("name"), F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "several").alias("fault"))


def only_document(files: DataFrame, name: str | None = None) -> DataFrame:
    """The named document, else the only one there is; an error if there are none or several."""
    found = files.where(F.col("name") == name if name else F.lower("name").endswith(".docx") & ~F.col("name").startswith("~$"))
    n = found.agg(F.count(F.lit(1)).alias("n"))
    checked = n.select(F.when(F.col("n") == 1, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("documents found: "), F.col("n").cast("string")))).alias("_n"))
    return found.join(F.broadcast(checked), F.col("_n") == 1).drop("_n")  # one row


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Path and value, a variant, of whole JSON files; null where a file is no JSON."""
    return spark.read.format("binaryFile").load(path).select("path", F.try_parse_json(F.decode("content", "UTF-8")).alias("value"))


def merged(base: Any, patch: Any) -> Any:
    """Objects merge, everything else replaces, null included."""
    if not (isinstance(base, dict) and isinstance(patch, dict)):
        return patch
    return base | {k: merged(base[k], v) if k in base else v for k, v in patch.items()}


def load_configuration(layers: list[str], default: dict | None = None) -> dict:
    """Configuration files laid over each other in order, on the driver: a configuration is small. A missing file is skipped."""
    settings: dict = default or {}
    for layer in layers:
        path = Path(layer)
        if path.exists():
            try:
                settings = merged(settings, parse(path.read_text(encoding="utf-8")))
            except NotJson as error:
                raise ValueError(f"{layer} is no JSON: {error}") from None
    return settings


#: The name table's ids of interest.
FONT_NAMES = {1: "family", 2: "style", 4: "full", 6: "postscript", 16: "typographic_family"}
FONT = "path string, face int, name_kind string, name string, status string"


def font_faces(content: bytes) -> Iterator[tuple[int, str | None, str | None, str]]:
    """Face, kind of name, name and status of a font file; a broken or foreign file gives one row of its status."""
    try:
        if content[:2] == b"MZ":
            yield 0, None, None, "unsupported"
            return
        offsets = struct.unpack(f">{struct.unpack('>I', content[8:12])[0]}I", content[12 : 12 + 4 * struct.unpack(">I", content[8:12])[0]]) if content[:4] == b"ttcf" else (0,)
        for face, offset in enumerate(offsets):
            version, tables = struct.unpack(">4sH", content[offset : offset + 6])
            if version not in (b"\x00\x01\x00\x00", b"OTTO", b"true"):
                yield face, None, None, "error"
                continue
            directory = (struct.unpack(">4sIII", content[offset + 12 + 16 * i : offset + 28 + 16 * i]) for i in range(tables))
            at = next((d[2] for d in directory if d[0] == b"name"), None)
            if at is None:
                yield face, None, None, "error"
                continue
            _, count, strings = struct.unpack(">HHH", content[at : at + 6])
            seen = set()
            for i in range(count):
                platform, _, language, kind, length, start = struct.unpack(">HHHHHH", content[at + 6 + 12 * i : at + 18 + 12 * i])
                if kind in FONT_NAMES and language < 0x8000 and platform in (0, 1, 3):
                    raw = content[at + strings + start : at + strings + start + length]
                    name = raw.decode("mac_roman" if platform == 1 else "utf-16-be", "replace").strip("\0 ")
                    if name and (kind, name) not in seen:
                        seen.add((kind, name))
                        yield face, FONT_NAMES[kind], name, "ok"
    except struct.error:
        yield 0, None, None, "error"


def font_index(files: DataFrame) -> DataFrame:
    """One row per name of each face of the font files of a table of path and content."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *f) for p, x in zip(batch.column(0).to_pylist(), batch.column(1)) for f in font_faces(x.as_py() or b"")]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["path", "face", "name_kind", "name", "status"])

    return files.select("path", "content").mapInArrow(read, FONT)


def write_records(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows as JSON lines; an existing result is refused unless it may be overwritten."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def build_inputs(inputs: DataFrame) -> DataFrame:
    """source_sha256 and n_rows of each input, the list that a build record's digest is made of."""
    return inputs.where("source_sha256 is not null").groupBy("source_sha256").agg(F.count(F.lit(1)).alias("n_rows"))


def build_record(inputs: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: inputs, their number, digest, and checks, the number of checks by status as JSON.

    inputs has source_sha256; the digest does not depend on their order or repetition: hashes are listed in order by
    their first three characters, each list is hashed, and the hashes of the lists, in order, are hashed again.
    """
    hashes = inputs.select("source_sha256").where("source_sha256 is not null").distinct()
    listed_ = hashes.groupBy(F.substring("source_sha256", 1, 3).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("source_sha256")), "\n"), 256).alias("_h"))
    digest = listed_.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("inputs"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), "\n"), 256).alias("digest"))
    status = checks.groupBy("status").agg(F.count(F.lit(1)).alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("checks"))
    return digest.withColumn("_j", F.lit(1)).join(status.withColumn("_j", F.lit(1)), "_j").select("inputs", "digest", "checks")


def failure_records(failures: DataFrame, key: str, error: str, message: str) -> DataFrame:
    """K06 for many inputs: key and record, the JSON of what went wrong with each; rows without error have none."""
    return failures.where(F.col(error).isNotNull()).select(key, F.to_json(F.struct(F.col(error).alias("error"), F.col(message).alias("message"))).alias("record"))


def write_failure(path: str, error: BaseException, details: dict | None = None) -> None:
    """What went wrong, beside the results and never over a file that is there."""
    with open(path, "x", encoding="utf-8") as file:
        json.dump({"error": type(error).__name__, "message": str(error), **(details or {})}, file, ensure_ascii=False)


def build_outline(spark: SparkSession, strategy: str, path: str, rules: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """The outline of a source by its strategy; an unknown strategy or an empty outline is an error.

    directory_tree: the files of a folder. docx_document: headings of packages by outline level. highlighted_docx: their
    marked paragraphs, by rules. explicit_tree: the nodes of manifests.
    """
    from sheaf.operators.nesting import MANIFEST, flat_objects, typed_table
    from sheaf.sources.packages import MARK_RULES, marked_headings, read_packages, typed

    if strategy == "directory_tree":
        made = outline_of_files(listed(spark, path))
    elif strategy == "docx_document":
        made = typed(read_packages(spark, path), "block").where("outline_level is not null").select("source_sha256", "ord", F.col("outline_level").alias("level"), F.col("visible_text").alias("title"))
    elif strategy == "highlighted_docx":
        made = marked_headings(read_packages(spark, path), MARK_RULES if rules is None else tuple(rules))
    elif strategy == "explicit_tree":
        files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("manifest_id"), F.decode("content", "UTF-8").alias("raw_json"))
        made = typed_table(flat_objects(files, "manifest_id", "raw_json", MANIFEST), "outline_node")
    else:
        raise ValueError(f"no strategy named {strategy}")
    if made.isEmpty():
        raise ValueError("the outline is empty")
    return made
