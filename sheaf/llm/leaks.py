"""Held-out evaluation passages inside training texts, also when numbers, names and units were replaced.

Texts are folded to one look and one letter case and cut into units: words, and for Chinese items single characters.
A unit gets a typed placeholder if it is a number, a unit of measure behind a number, or a name; every run of as many
units as the report asks for is hashed over placeholders and plain units, its template. Windows of items and documents
meet in a hash join of templates and of what fills their slots. A pair of windows is verbatim if their units agree, too,
and re-parameterised if the placeholders of one correspond one to one to those of the other: the pattern of which slots
repeat which is the same.

In verbatim windows each unit has its own place. For re-parameterised ones neighbouring numbers, and neighbouring names,
are one slot, so that `1200` fits `1,300` or `twelve`, and a name of one word one of two; at least half of such a window
must be plain. Names are told without letter case: words that two items share or one writes small are plain, every other
word is a name; Chinese characters are plain in pairs that two items share or in long runs. What is plain is found once over all
items, so a verbatim copy has its item's template.

Documents are read once, whatever the number of items, and never shuffled: a filter of fixed size tells which of their
windows can meet one of an item, and only these windows, as a few numbers, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.lookalike import fold_codes, sliced, to_codes
from sheaf.llm.tokens import FACTOR, HAN, UNDO, Units, characters_of, folded, inside, kinds, powers, scatter, words_of
from sheaf.session import cut, table

WORDS, CHARACTERS = 18, 40
#: The longest run of Chinese characters that can be a name.
NAME_CHARACTERS = 6
#: Bits of a filter, as a power of two: at most 2 M cells of 64 bits go to the driver and to each executor, whatever the items.
FILTER = 27
# Units of measure that may stand behind a number, in three languages, and numbers written as words.
MEASURES = (
    "nm µm mm cm dm m km in inch inches ft feet yd yards mile miles pt px em twips mg g kg t lb lbs oz ml cl dl l litres liters gal s ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "b kb mb gb tb bit bits byte bytes hz khz mhz ghz v kv a ma w kw j kj k c f pa kpa bar usd eur gbp dollars euros percent page pages line lines dpi "
    "seiten seite zeilen blatt blätter sekunden minuten stunden tage wochen monate jahre prozent zoll liter gramm kilogramm meter zentimeter millimeter kilometer"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million milliarde"
).split()
NUMERALS = "〇零一二三四五六七八九十百千万亿两"
PLAIN, NUMBER, NAME, MEASURE = range(4)
PLACEHOLDERS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Filter(NamedTuple):
    """A set of 64-bit hashes by their first bits: what is in it is found, what is not mostly is not, everywhere alike."""

    cell: np.ndarray
    bits: np.ndarray

    def opened(self) -> np.ndarray:
        whole = np.zeros(1 << FILTER - 6, dtype=np.uint64)
        whole[self.cell] = self.bits
        return whole


def held(values: np.ndarray, whole: np.ndarray) -> np.ndarray:
    at = values >> np.uint64(64 - FILTER)
    return (whole[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(hashes: DataFrame, column: str) -> Filter:
    """Of a column of 64-bit hashes; built by an aggregate, of which each cell comes to the driver as one number."""
    at = F.shiftrightunsigned(column, 64 - FILTER)
    cells = hashes.select(F.shiftright(at, 6).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - FILTER}) & 63 as int))").alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    return Filter(rows.column("cell").to_numpy(), rows.column("bits").to_numpy().view(np.uint64))


@lru_cache(maxsize=1)
def fixed_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the measures, of the numbers written as words, and of the Chinese numerals."""
    hash_of = lambda words: words_of(*folded(pa.array(list(words)))).hash
    return hash_of(MEASURES), hash_of(NUMBERS), scatter(np.array([ord(x) for x in NUMERALS], dtype=np.uint64))


def neighbours(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each pair of neighbouring characters of one text, and the place of its first one."""
    at = np.flatnonzero(units.row[1:] == units.row[:-1])
    return scatter(units.hash[at] * np.uint64(FACTOR) + units.hash[at + 1]), at


class Template(NamedTuple):
    """Units and slots of texts, one after another."""

    row: np.ndarray
    value: np.ndarray  # a placeholder or the unit itself
    exact: np.ndarray
    slot: np.ndarray


def typed(units: Units, plain: np.ndarray, characters: bool) -> np.ndarray:
    """What each unit is: plain, a number, a name or a measure."""
    measures, numbers, numerals = fixed_words()
    what = np.where(units.digits | np.isin(units.hash, numerals if characters else numbers), NUMBER, PLAIN).astype(np.int8)
    if characters:
        pair, at = neighbours(units)
        shared = held(pair, plain)
        known = what == NUMBER
        known[at[shared]] = known[at[shared] + 1] = True
        # a run of unknown characters is a name if it is short
        edge = np.ones(len(known), dtype=bool)
        edge[1:] = (known[1:] != known[:-1]) | (units.row[1:] != units.row[:-1])
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(known)))
        what[np.repeat(size <= NAME_CHARACTERS, size) & ~known] = NAME
    else:
        behind = np.zeros(len(what), dtype=bool)
        behind[1:] = (what[:-1] == NUMBER) & (units.row[1:] == units.row[:-1])
        behind &= np.isin(units.hash, measures)
        what[(what == PLAIN) & ~held(units.hash, plain)] = NAME
        what[behind] = MEASURE
    return what


def template(units: Units, plain: np.ndarray, characters: bool, spans: bool) -> Template:
    """With spans neighbouring numbers, and neighbouring names, are one slot."""
    what = typed(units, plain, characters)
    value = np.where(what == PLAIN, units.hash, PLACEHOLDERS[what])
    if not spans or not len(what):
        return Template(units.row, value, units.hash, what != PLAIN)
    first = np.ones(len(what), dtype=bool)
    first[1:] = (what[1:] != what[:-1]) | (what[1:] == PLAIN) | (what[1:] == MEASURE) | (units.row[1:] != units.row[:-1])
    start = np.flatnonzero(first)
    place = np.arange(len(what)) - np.repeat(start, np.diff(np.append(start, len(what))))
    exact = scatter(np.add.reduceat(scatter(units.hash + place.astype(np.uint64)), start))
    return Template(units.row[start], value[start], exact, what[start] != PLAIN)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size values; where it crosses into another text the caller must not look."""
    n = len(values)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * powers(FACTOR, n), dtype=np.uint64)])
    return scatter((total[size:] - total[: n - size + 1]) * powers(UNDO, n)[: n - size + 1])


def patterns(t: Template, at: np.ndarray, size: int) -> np.ndarray:
    """For the windows that begin at given places a hash of which slots repeat which."""
    slots = np.flatnonzero(t.slot)
    by = slots[np.lexsort((slots, t.exact[slots]))]
    back = np.zeros(len(t.slot), dtype=np.int64)  # how far before a slot the same one stands
    again = np.flatnonzero((t.exact[by[1:]] == t.exact[by[:-1]]) & (t.row[by[1:]] == t.row[by[:-1]])) + 1
    back[by[again]] = by[again] - by[again - 1]
    made = np.empty(len(at), dtype=np.uint64)
    span, weight = np.arange(size), powers(FACTOR, size)
    for low in range(0, len(at), 50_000):
        far = back[at[low : low + 50_000, None] + span]
        made[low : low + 50_000] = (np.where(far <= span, far, 0).astype(np.uint64) * weight).sum(1, dtype=np.uint64)
    return scatter(made)


#: Salts of the kinds of windows: words, or characters, and with or without spans.
KINDS = {(characters, spans): scatter(np.array([1 + 2 * characters + spans], dtype=np.uint64))[0] for characters in (False, True) for spans in (False, True)}


def window_columns(texts: pa.Array, plain: np.ndarray, spans: tuple[bool, ...], characters: np.ndarray | None, wanted: np.ndarray | None) -> Iterator[list[np.ndarray]]:
    """Row, place, template, filling and whether it has spans, of windows of texts.

    The filling of a window with spans is the pattern of its slots, that of one without is all its units.
    characters: by text whether its windows are of characters or of words; None: both. wanted: the filter of templates.
    """
    codes, bounds = folded(texts)
    for of_characters, units, size in ((False, words_of(codes, bounds), WORDS), (True, characters_of(codes, bounds), CHARACTERS)):
        for merged in spans:
            t = template(units, plain, of_characters, merged)
            if len(t.row) < size:
                continue
            made = windows(t.value, size) ^ KINDS[of_characters, merged]
            good = t.row[: len(made)] == t.row[size - 1 :]
            if characters is not None:
                good &= characters[t.row[: len(made)]] == of_characters
            if wanted is not None:
                good &= held(made, wanted)
            if merged:
                slots = np.concatenate([[0], np.cumsum(t.slot)])
                good &= 2 * (slots[size:] - slots[: len(made)]) <= size
            at = np.flatnonzero(good)
            if len(at):
                # only the texts with a window go on
                have = np.zeros(len(texts), dtype=bool)
                have[t.row[at]] = True
                some = np.flatnonzero(have[t.row])
                own, new = Template(*(c[some] for c in t)), np.searchsorted(some, at)
                filling = patterns(own, new, size) if merged else windows(own.exact, size)[new]
                yield [t.row[at], at, made[at], filling, np.full(len(at), merged)]


ROWS = "id long, place long, template long, filling long, spans boolean"


def window_rows(ids: pa.Array, columns: list[np.ndarray]) -> pa.RecordBatch:
    row, place, *hashes, merged = columns
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(place.astype(np.int64)), *(pa.array(h.view(np.int64)) for h in hashes), pa.array(merged)], names=["id", "place", "template", "filling", "spans"])


def chinese(texts: pa.Array, langs: pa.Array) -> np.ndarray:
    """Whether an item is Chinese: by a language tag, or without one by mostly Chinese characters."""
    codes, bounds = folded(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    count = lambda mask: np.bincount(row[mask], minlength=len(texts))
    mostly = 2 * count(kinds()[codes] == HAN) > count(inside()[codes])
    return np.array([(lang or "").lower().startswith(("zh", "cn", "chi")) or not lang and m for lang, m in zip(langs.to_pylist(), mostly)], dtype=bool)


def plain_units(items: DataFrame) -> Filter:
    """Words that two items have or one writes small, and pairs of Chinese characters that two items have."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in sliced(batch.column(1)):
                codes, bounds = folded(part)
                units = words_of(codes, bounds)
                cased = words_of(*fold_codes(*to_codes(part), gaps=False))
                small = cased.hash[np.isin(cased.hash, units.hash)]  # folding case leaves them as they are
                letters = characters_of(codes, bounds)
                pair, at = neighbours(letters)
                rows, made = np.concatenate([units.row, letters.row[at]]), np.concatenate([units.hash, pair])
                ids = batch.column(0).slice(first, len(part)).take(pa.array(np.append(rows, np.zeros(len(small), dtype=rows.dtype))))
                flag = np.append(np.zeros(len(rows), dtype=bool), np.ones(len(small), dtype=bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.append(made, small).view(np.int64)), pa.array(flag)], names=["id", "unit", "small"])

    rows = items.select("item_id", "item_text").mapInArrow(read, "id long, unit long, small boolean")
    some = rows.groupBy("unit").agg(F.max("small").alias("small"), F.min("id").alias("a"), F.max("id").alias("b")).where("small or a < b")
    return filter_of(some, "unit")


def leak_windows(documents: DataFrame, items: DataFrame, spans: tuple[bool, ...] = (False, True)) -> DataFrame:
    """doc_id, item_id, place, spans: each window of a document that agrees with one of an item; one without spans agrees
    verbatim, one with spans in its template and the pattern of its slots.

    documents has doc_id and text, items item_id, item_text and lang; other columns are not read. Null and empty texts
    and texts shorter than a window share nothing; repeated rows give repeated windows; without items or documents
    there are no rows.
    """
    spark = documents.sparkSession
    asked = items.where("length(item_text) > 0 and item_id is not null").select("item_id", "item_text", "lang").distinct()
    plain = spark.sparkContext.broadcast(plain_units(asked))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plain.value.opened()
        for batch in batches:
            for first, part in sliced(batch.column(1)):
                for columns in window_columns(part, known, spans, chinese(part, batch.column(2).slice(first, len(part))), None):
                    yield window_rows(batch.column(0).slice(first, len(part)), columns)

    questions = cut(asked.mapInArrow(ask, ROWS).distinct())
    wanted = spark.sparkContext.broadcast(filter_of(questions, "template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = plain.value.opened(), wanted.value.opened()
        for batch in batches:
            for first, part in sliced(batch.column(1)):
                for columns in window_columns(part, known, spans, None, met):
                    yield window_rows(batch.column(0).slice(first, len(part)), columns)

    passages = documents.where(F.length("text") >= WORDS).select("doc_id", "text").mapInArrow(run, ROWS)
    left = questions.select(F.col("id").alias("item_id"), "template", "filling").distinct()
    return passages.join(left, ["template", "filling"]).select(F.col("id").alias("doc_id"), "item_id", "place", "spans")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and an item with a verbatim window."""
    return leak_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), (False,)).select("doc_id", "item_id").distinct()


def reworded_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and n_windows: pairs without a verbatim window whose templates agree with consistent slots, and in how many places."""
    pairs = leak_windows(documents, items).distinct().groupBy("doc_id", "item_id").agg(F.every("spans").alias("reworded"), F.count(F.lit(1)).alias("n_windows"))
    return pairs.where("reworded").select("doc_id", "item_id", "n_windows")


def reworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reworded_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
