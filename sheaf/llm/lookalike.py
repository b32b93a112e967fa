"""Texts that look the same, brought to one form.

A batch of Arrow strings is copied once into an array of code points and mapped as a whole: a table gather gives
each code point its target or the place of its expansion, marks are sorted and composed for all rows at once, and
what cannot be seen is masked out. No step calls a string function for a row.

The form keeps letter case, accents, raised and circled digits and words; it unifies the width of characters and
gaps, ways of writing an accent, look-alike letters of other scripts, hyphens of one length, radicals and ligatures,
and drops what a reader cannot see, gaps at either end included. Null stays null, an empty text stays empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sheaf.functions.keys import digest
from sheaf.session import cut, table

#: Letters and hyphens that most fonts draw as another one.
LOOKALIKE = {
    # Cyrillic small letters
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    # Cyrillic capital letters
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "Ү": "Y",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Greek capital letters
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian letters
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # Cherokee capital letters
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu capital letters
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M",
    "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # others
    "ѵ": "v", "Ѵ": "V", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-",
}

#: Ranges whose compatibility decomposition is drawn like the character itself.
SAME_DRAWN = (
    (0x00B5, 0x00B5),  # micro sign
    (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3),  # Latin digraphs
    (0x2160, 0x217F),  # Roman numerals
    (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5),  # radicals
    (0xFB00, 0xFB04), (0xFB06, 0xFB06),  # Latin ligatures
)

#: Ranges that are never drawn though their category is not Cf or Cc.
UNSEEN = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
#: Format characters that are drawn.
SEEN_FORMAT = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F))
#: Where code points with a mapping can lie; the rest are ideographs, syllables and private use.
SCANNED = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))

TOP = 0x110000
SPACE, DROP = 0x20, np.uint32(0xFFFFFFFF)
L_BASE, V_BASE, T_BASE, S_BASE, V_COUNT, T_COUNT = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28


def within(code: int, ranges: tuple) -> bool:
    return any(a <= code <= b for a, b in ranges)


class Tables(NamedTuple):
    target: np.ndarray  # by code point: its one target, DROP, or itself
    start: np.ndarray  # by code point: where its expansion starts in flat, or -1
    length: np.ndarray  # by code point: the length of its expansion
    flat: np.ndarray
    order: np.ndarray  # by code point: its combining class
    lone: np.ndarray  # by code point: its form beside others of the kind, where it has one code point of its own
    hard: np.ndarray  # by code point: whether it has none, as marks, jamo, expansions and what is dropped
    pair_keys: np.ndarray  # sorted starter << 21 | mark
    pair_made: np.ndarray


def _expand(char: str, lines: bool = False) -> list[str]:
    """What a character is drawn as: repeated until nothing changes. With lines the end of a line stays one."""
    if char in LOOKALIKE:
        return [LOOKALIKE[char]]
    if lines and char == "\n":
        return [char]
    if unicodedata.category(char) in ("Zs", "Zl", "Zp") or char in "\t\n\v\f\r\x85":
        return [" "]
    tag, _, rest = unicodedata.decomposition(char).rpartition("> ")
    if not rest or tag and not (tag in ("<wide", "<narrow", "<noBreak") or tag == "<compat" and within(ord(char), SAME_DRAWN)):
        return [char]
    return [y for x in rest.split() for y in _expand(chr(int(x, 16)))]


@lru_cache(maxsize=3)
def tables(caseless: bool = False, lines: bool = False) -> Tables:
    """Built once a process from the interpreter's character data; caseless folds letter case too, lines leaves their ends."""
    target = np.arange(TOP, dtype=np.uint32)
    start = np.full(TOP, -1, dtype=np.int32)
    length = np.ones(TOP, dtype=np.uint8)
    order = np.zeros(TOP, dtype=np.uint8)
    flat: list[int] = []
    pairs: dict[int, int] = {}
    for low, high in SCANNED:
        for code in range(low, high):
            char = chr(code)
            category = unicodedata.category(char)
            if category in ("Cn", "Co", "Cs") and not within(code, UNSEEN):
                continue
            order[code] = unicodedata.combining(char)
            if within(code, UNSEEN) or category in ("Cf", "Cc") and char not in "\t\n\v\f\r\x85" and not within(code, SEEN_FORMAT):
                target[code] = DROP
                continue
            drawn = _expand(char, lines)
            if caseless:
                drawn = [y for x in "".join(drawn).casefold() for y in _expand(x, lines)]
            if len(drawn) > 1:
                start[code], length[code] = len(flat), len(drawn)
                flat += map(ord, drawn)
            else:
                target[code] = ord(drawn[0])
            parts = unicodedata.decomposition(char).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", char) == char:
                a, b = (int(x, 16) for x in parts)
                pairs[a << 21 | b] = code
    keys = np.array(sorted(pairs), dtype=np.uint64)
    lone, hard = target.copy(), (target == DROP) | (start >= 0)
    for code in np.flatnonzero(start >= 0):
        whole = unicodedata.normalize("NFC", "".join(map(chr, flat[start[code] : start[code] + length[code]])))
        if len(whole) == 1:
            lone[code], hard[code] = ord(whole), False
    hard |= order[np.minimum(lone, TOP - 1)] > 0
    hard[L_BASE : T_BASE + T_COUNT] = True
    return Tables(target, start, length, np.array(flat, dtype=np.uint32), order, lone, hard, keys, np.array([pairs[int(k)] for k in keys], dtype=np.uint32))


def compose(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks sorted by class behind their starter and joined to it where a composed letter exists; first marks where rows begin."""
    t = tables()
    order = t.order[codes]
    marks = np.flatnonzero(order)
    keep = np.ones(len(codes), dtype=bool)
    if len(marks):
        heads = np.flatnonzero((order == 0) | first)
        run = np.searchsorted(heads, marks, side="right") - 1
        by = np.lexsort((marks, order[marks], run))  # a head that is itself a mark stays first of its row by its place
        codes = codes.copy()
        codes[marks] = codes[marks[by]]
        order = t.order[codes]
        rank = marks - heads[run]
        at, last = codes[heads].astype(np.uint64), np.zeros(len(heads), dtype=np.uint8)
        usable = order[heads] == 0
        steps = np.argsort(rank, kind="stable")
        bounds = np.searchsorted(rank[steps], np.arange(1, rank.max() + 2))
        for low, high in zip(bounds[:-1], bounds[1:]):
            where = steps[low:high]
            place, own = marks[where], run[where]
            key = at[own] << np.uint64(21) | codes[place].astype(np.uint64)
            hit = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
            joins = (t.pair_keys[hit] == key) & usable[own] & ((last[own] == 0) | (last[own] < order[place]))
            at[own[joins]] = t.pair_made[hit[joins]]
            keep[place[joins]] = False
            last[own[~joins]] = order[place[~joins]]
        codes[heads] = at.astype(np.uint32)
    lead = np.flatnonzero((codes >= L_BASE) & (codes < L_BASE + 19))  # Hangul jamo: two, then a third
    if len(lead):
        codes = codes.copy()
        lead = lead[lead + 1 < len(codes)]
        lead = lead[(codes[lead + 1] >= V_BASE) & (codes[lead + 1] < V_BASE + V_COUNT) & ~first[lead + 1]]
        codes[lead] = S_BASE + ((codes[lead] - L_BASE) * V_COUNT + codes[lead + 1] - V_BASE) * T_COUNT
        keep[lead + 1] = False
    tail = np.flatnonzero((codes > T_BASE) & (codes < T_BASE + T_COUNT) & ~first)
    if len(tail):
        codes = codes.copy()
        kept = np.flatnonzero(keep)
        before = kept[np.maximum(np.searchsorted(kept, tail) - 1, 0)]
        gap = np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
        fits = (before < tail) & (gap[tail] <= before) & (codes[before] >= S_BASE) & (codes[before] < S_BASE + 11172) & ((codes[before] - S_BASE) % T_COUNT == 0)
        codes[before[fits]] += codes[tail[fits]] - T_BASE
        keep[tail[fits]] = False
    return codes, keep


def squeezed(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One gap where several stand, none at either end of a row."""
    gap = codes == SPACE
    if not gap.any():
        return codes, row
    ahead = np.empty(len(codes), dtype=bool)  # a gap, or nothing, stands before
    ahead[0], ahead[1:] = True, gap[:-1] | (row[1:] != row[:-1])
    keep = ~(gap & ahead)
    codes, row, gap = codes[keep], row[keep], gap[keep]
    keep = np.ones(len(codes), dtype=bool)
    if len(codes):
        keep[-1] = not gap[-1]
        keep[:-1] = ~(gap[:-1] & (row[1:] != row[:-1]))
    return codes[keep], row[keep]


def expanded(codes: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Targets and expansions in place of code points, without what is not seen, marks composed."""
    grown = np.flatnonzero(t.start[codes] >= 0)
    out = t.target[codes]
    if len(grown):
        length = t.length[codes].astype(np.int64)
        end = np.cumsum(length)
        out = np.repeat(out, length)
        begin, many = end[grown] - length[grown], length[grown]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(begin, many) + step] = t.flat[np.repeat(t.start[codes[grown]], many) + step]
        row = np.repeat(row, length)
    seen = out != DROP
    out, row = out[seen], row[seen]
    if not len(out):
        return out, row
    first = np.empty(len(out), dtype=bool)
    first[0], first[1:] = True, row[1:] != row[:-1]
    out, keep = compose(out, first)
    return out[keep], row[keep]


def fold_codes(codes: np.ndarray, bounds: np.ndarray, caseless: bool = False, gaps: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The form of every row: codes of all rows one after another, row i from bounds[i] to bounds[i + 1].

    Rows whose code points each have a form of their own are one gather; only the others are expanded and composed.
    Without gaps these are left as wide as they were, and ends of lines stay.
    """
    t, rows = tables(caseless, not gaps), len(bounds) - 1
    peculiar = np.flatnonzero(t.hard[codes])
    if not len(peculiar):
        out, ends = t.lone[codes], bounds
    else:
        hard = np.zeros(rows, dtype=bool)
        hard[np.searchsorted(bounds, peculiar, side="right") - 1] = True
        size = np.diff(bounds)
        inside = np.repeat(hard, size)
        made, row = expanded(codes[inside], np.repeat(np.flatnonzero(hard), size[hard]), t)
        size = np.where(hard, np.bincount(row, minlength=rows), size)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(hard, size)
        out = np.empty(ends[-1], dtype=np.uint32)
        out[at], out[~at] = made, t.lone[codes[~inside]]
    if not gaps or not len(out):
        return out, ends
    out, row = squeezed(out, np.repeat(np.arange(rows), np.diff(ends)))
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])


def to_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of an Arrow string array and the bounds of its rows; null rows are empty."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = data.slice(at[0], at[-1] - at[0]).to_pybytes() if data is not None else b""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def to_texts(codes: np.ndarray, bounds: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The Arrow string array of code points; where nulls is true the row is null."""
    raw = np.ascontiguousarray(codes, dtype="<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))])
    mask = None if nulls is None or not nulls.any() else pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    made = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [mask, pa.py_buffer(size[bounds].astype(np.int64).tobytes()), pa.py_buffer(raw)])
    return made


def sliced(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """A text array in parts of about limit bytes, each with its first row; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    ends = [*np.flatnonzero(np.diff(part)) + 1, len(texts)] if len(texts) else []
    for low, high in zip([0, *ends], ends):
        yield int(low), texts.slice(low, high - low)


def fold_array(texts: pa.Array, caseless: bool = False) -> pa.Array:
    """The one form of each text."""
    made = [
        to_texts(*fold_codes(*to_codes(part), caseless), nulls=np.asarray(part.is_null()) if part.null_count else None).cast(pa.string())
        for _, part in sliced(texts)
    ]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


@F.arrow_udf(StringType())
def fold(texts: pa.Array) -> pa.Array:
    return fold_array(texts)


def seen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph and table cell with a text: kind, its group, its id and the text."""
    paragraphs = (
        table(spark, sf_dir, "inventory_items")
        .where((F.col("kind") == "paragraph") & (F.length("content") > 0) & F.col("source").isNotNull())
        .select(F.lit("paragraph").alias("kind"), F.col("source").alias("grp"), F.col("item_id").alias("id"), F.col("content").alias("text"))
    )
    cells = (
        table(spark, sf_dir, "tables_topology")
        .select("table_id", F.posexplode("cell_texts").alias("at", "text"))
        .where((F.length("text") > 0) & F.col("table_id").isNotNull())
        .select(F.lit("cell").alias("kind"), F.col("table_id").cast("string").alias("grp"), (F.col("table_id") * 1000 + F.col("at")).alias("id"), "text")
    )
    return paragraphs.unionByName(cells)


def same_look_pairs(texts: DataFrame, chunk: int = 2000) -> DataFrame:
    """Pairs of ids of one kind and group whose texts differ but have one form: kind, id_a < id_b, each pair once.

    texts has kind, grp, id, text. Only forms with several writings go on; those are joined writing by writing and
    then opened to their ids, so rows written alike never meet. A writing with more than chunk ids is opened in
    several parts. Rows without text and repeated rows add nothing; an empty input gives no rows.
    """
    form = ["kind", "grp", "form"]
    rows = texts.where((F.length("text") > 0) & F.col("id").isNotNull()).select("kind", "grp", "id", digest(F.col("text")).alias("writing"), digest(fold("text")).alias("form"))
    mixed = rows.groupBy(*form).agg(F.min("writing").alias("a"), F.max("writing").alias("b")).where("a < b").select(*form)
    members = cut(rows.join(mixed, form, "left_semi").distinct())
    sizes = members.groupBy(*form, "writing").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    placed = members.join(sizes, [*form, "writing"]).select(*form, "writing", "id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    left, right = (sizes.select(*form, F.col("writing").alias(f"writing_{x}"), F.col("parts").alias(f"parts_{x}")) for x in "ab")
    writings = left.join(right, form).where("writing_a < writing_b")
    for x in "ab":
        opened = writings.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(f"parts_{x}") - 1)))
        writings = opened.join(placed.select(*form, F.col("writing").alias(f"writing_{x}"), "part", F.col("id").alias(x)), [*form, f"writing_{x}", "part"]).drop("part")
    return writings.where("a <> b").select("kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(seen_texts(spark, sf_dir))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item and cell with its text in the one form: kind, id, form."""
    return seen_texts(spark, sf_dir).select("kind", "id", fold("text").alias("form")).distinct()
