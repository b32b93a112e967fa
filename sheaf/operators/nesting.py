"""Nested files as related flat tables, by a tree automaton over object shapes.

The automaton has a state for every place that can hold an object of interest. It goes down from the root: a state and
a key, or any element, give the state of the part. Going up, the shape of an object - the type of its label, which of its
parts are there and of what kind - decides its variant. All objects share the keys of one common table: file, pointer,
pointer of the enclosing object, kind, variant and depth. Each variant is routed to a typed table of its own over these
keys, in which the label has the type that it has in this variant; the tables of a kind share the kind's typed columns.
What no typed column holds as it is, arrays and objects included, stands beside them as JSON, so no member is lost.

Files are read one by one where they lie; nothing is shuffled before the final removal of repeated files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.jsontree import NotJson, json_text, kind, parse, pointer
from sheaf.session import cut


@dataclass(frozen=True)
class State:
    """A place in a file: the states of its members by key (`*`: of any) and of its elements; what it emits, if anything."""

    members: dict[str, str]
    elements: str | None = None
    emits: str | None = None
    label: str | None = None
    plain: bool = False  # a string stands for the label itself


#: The places of outline nodes in a project manifest.
MANIFEST = {
    "root": State({"source": "source"}),
    "source": State({"tree": "nodes"}),
    "nodes": State({}, elements="node"),
    "children": State({}, elements="node"),
    "node": State({"children": "children"}, emits="outline_node", label="title"),
}
#: The same with the rules by which nodes of documents find headings; p3_found asks for labelled nodes only.
RULES = MANIFEST | {
    "node": State({"children": "children", "outline_rules": "rules"}, emits="outline_node", label="title"),
    "rules": State({}, elements="rule"),
    "rule": State({}, emits="outline_rule", label="pattern"),
}
#: The places of the page, roles and variants in a format package.
FORMAT = {
    "root": State({"page": "page", "roles": "roles"}),
    "page": State({}, emits="page", label="width_mm"),
    "roles": State({"*": "role"}),
    "role": State({"variants": "variants"}, emits="role", label="style", plain=True),
    "variants": State({}, elements="variant"),
    "variant": State({"variants": "variants"}, emits="variant", label="style"),
}
#: States that one object stands in for a list of one.
SINGLE = {"children": "node"}

#: Typed columns by kind; the tables of its variants share them.
TYPED = {
    "outline_node": {"title": "string", "type": "string", "file": "string", "level": "int", "include_in_toc": "boolean"},
    "outline_rule": {"level": "int", "pattern": "string"},
    "page": {"width_mm": "double", "width_unit": "string", "height_mm": "double", "margin_top_mm": "double", "orientation": "string"},
    "role": {"style": "string", "outline_level": "int"},
    "variant": {"style": "string", "when": "string"},
}

#: The type of a label's column in the tables of variants, by its type in the variant; elsewhere the label has no column.
LABEL_TYPES = {"string": "string", "plain": "string", "number": "double", "boolean": "boolean", "object": "double"}
#: Python types that a typed column holds as they are.
HOLDS = {"string": (str,), "int": (int,), "double": (int, float), "boolean": (bool,)}
UNLABELLED = ("absent", "null")

COLUMNS = "file_id long, node_pointer string, parent_pointer string, kind string, variant string, depth int, fields map<string,string>, rest string"
_ARROW = pa.schema(
    [("file_id", pa.int64()), *((c, pa.string()) for c in ("node_pointer", "parent_pointer", "kind", "variant")), ("depth", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("rest", pa.string())]
)


def _opened(value: Any) -> Any:
    """A part written as a string of JSON, as if it stood there."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = parse(value)
        except NotJson:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def _scalar(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def parts_of(value: dict, state: State) -> dict[str, Any]:
    """The nested parts of an object that are objects or lists, in order of their keys."""
    return {key: part for key in sorted(state.members) if key in value and isinstance(part := _opened(value[key]), (dict, list))}


def shape(value: dict, state: State, parts: dict[str, Any]) -> str:
    """The variant of an object by its own shape: what its label and its nested parts are."""
    label = kind(value.get(state.label)) if state.label in value else "absent"
    return "+".join([label, *(f"{key}:{'single' if isinstance(part, dict) else 'list' if part else 'empty'}" for key, part in parts.items())])


def members_of(value: dict, what: str, parts: dict[str, Any]) -> tuple[list[tuple[str, str]], str]:
    """Scalars of an object as text, and the JSON of all members but its parts that no typed column holds as it is."""
    fields = {k: _scalar(v) for k, v in value.items() if v is not None and not isinstance(v, (dict, list))}
    width = value.get("width_mm")
    if what == "page" and isinstance(width, dict):
        fields |= {"width_mm": _scalar(width.get("value")), "width_unit": _scalar(width.get("unit"))}
    columns = TYPED[what]
    held = lambda k, v: k in columns and isinstance(v, HOLDS[columns[k]]) and (not isinstance(v, bool) or columns[k] == "boolean")
    rest = {k: value[k] for k in sorted(value) if value[k] is not None and k not in parts and not held(k, value[k])}
    return list(fields.items()), json_text(rest, compact=True)


def objects(document: Any, states: dict[str, State], members: bool = True) -> Iterator[tuple[str, str, str, str, int, list[tuple[str, str]], str]]:
    """Every object that a state emits, in document order, whatever the depth: pointer, parent, kind, variant, depth, and its members if wanted."""
    waiting = [("root", _opened(document), "", "", 0)]
    while waiting:
        name, value, at, parent, depth = waiting.pop()
        state = states[name]
        if name in SINGLE and isinstance(value, dict):
            name = SINGLE[name]
            state = states[name]
        if state.emits and (isinstance(value, dict) or state.plain and isinstance(value, str)):
            own = value if isinstance(value, dict) else {state.label: value}
            parts = parts_of(own, state)
            yield at, parent, state.emits, shape(own, state, parts) if isinstance(value, dict) else "plain", depth, *(members_of(own, state.emits, parts) if members else ([], "{}"))
            parent, depth = at, depth + 1
        below = []
        if isinstance(value, dict):
            below = [(to, _opened(part), pointer(at, key), parent, depth) for key, part in value.items() if (to := state.members.get(key, state.members.get("*")))]
        elif isinstance(value, list) and state.elements:
            below = [(state.elements, _opened(part), pointer(at, i), parent, depth) for i, part in enumerate(value)]
        waiting += reversed(below)


def flat_objects(files: DataFrame, file_id: str, raw: str, states: dict[str, State], members: bool = True) -> DataFrame:
    """One row per object of interest, with its place and that of the enclosing object (empty: none).

    Files that are null, empty or not JSON have no objects; repeated files give repeated rows; other columns are not
    read. Without members fields and rest are empty.
    """

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _ARROW]
            size = 0
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    document = parse(text.as_py())
                except NotJson:
                    continue
                for found in objects(document, states, members):
                    for column, value in zip(columns, (number, *found)):
                        column.append(value)
                    size += 200 + len(found[0]) + len(found[1]) + len(found[-1])  # pointers of deep files are long
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
                        columns, size = [[] for _ in _ARROW], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return files.where(F.col(raw).isNotNull()).select(F.col(file_id).cast("long").alias("file_id"), raw).mapInArrow(flatten, COLUMNS)


def label_type() -> Column:
    """The type of the label in a variant."""
    return F.substring_index("variant", "+", 1)


def labelled_objects(manifests: DataFrame, formats: DataFrame) -> DataFrame:
    """file_table, file_id, node_pointer and parent_pointer of every object whose variant has a label: the common keys of those variants' tables."""
    sides = [flat_objects(files, file_id, "raw_json", states, members=False).withColumn("file_table", F.lit(name)) for files, file_id, states, name in ((manifests, "manifest_id", MANIFEST, "manifest_files"), (formats, "file_id", FORMAT, "format_files"))]
    return sides[0].unionByName(sides[1]).where(~label_type().isin(*UNLABELLED)).select("file_table", "file_id", "node_pointer", "parent_pointer").distinct()


def typed_table(flat: DataFrame, what: str) -> DataFrame:
    """The rows of one kind, all its variants, with its typed columns and the rest; a value that is not of the type is null there and stands in the rest."""
    own = [F.col("fields")[c].try_cast(t).alias(c) for c, t in TYPED[what].items()]
    return flat.where(F.col("kind") == what).select("file_id", "node_pointer", "parent_pointer", "variant", "depth", *own, "rest").distinct()


def labels() -> dict[str, str]:
    """By kind the member that is its label."""
    return {s.emits: s.label for s in (*RULES.values(), *FORMAT.values()) if s.emits}


def label_table(flat: DataFrame, what: str, label: str) -> DataFrame:
    """The rows of those variants of a kind whose label is of one type, with the label in that type; without one it has no column."""
    own = TYPED[what] | ({labels()[what]: LABEL_TYPES[label]} if label in LABEL_TYPES else {})
    if label not in LABEL_TYPES:
        own = {c: t for c, t in own.items() if c != labels()[what]}
    rows = flat.where((F.col("kind") == what) & (label_type() == label))
    return rows.select("file_id", "node_pointer", "parent_pointer", "variant", "depth", *[F.col("fields")[c].try_cast(t).alias(c) for c, t in own.items()], "rest").distinct()


def variant_tables(flat: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """A typed table for each kind and structural variant that occurs, over the common keys; flat is read once.

    Their number is bounded by the automaton, whatever the files: label types times what each nested part can be.
    """
    held = cut(flat)
    there = sorted(tuple(r) for r in held.select("kind", "variant").distinct().collect())
    return {(what, variant): label_table(held.where(F.col("variant") == variant), what, variant.split("+")[0]).drop("variant") for what, variant in there}


def write_variants(flat: DataFrame, folder: str) -> None:
    """Routes every object to the folder of its kind and variant in one pass: `kind=.../variant=...`."""
    flat.write.partitionBy("kind", "variant").parquet(folder)
