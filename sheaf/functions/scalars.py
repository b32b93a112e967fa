"""Scalar functions over names, texts, field instructions, numbers and lengths, as built-in column expressions.

White space is any Unicode white space, written as a class that Java and RE2 read alike. Every function gives null
for null unless its text says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"
# Fixed values.
CHINESE_NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十")
FILE_TYPES = {".docx": "docx", ".doc": "docx", ".pdf": "pdf", ".pptx": "pptx", ".ppt": "pptx", ".jpg": "image", ".jpeg": "image", ".png": "image"}
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
ROMAN_DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
FONT_ALIASES = (("宋体", "SimSun"), ("黑体", "SimHei"), ("楷体", "KaiTi"), ("仿宋", "FangSong"))
BLACK = ("auto", "000000", "00000000")
MATCH_NOISE = r"[\s\p{Z}.、，。（）()|｜·/\-_:：—]"
LABEL_NOISE = r"[\s\p{Z}\-–—·•|｜:：()\[\]{}]+"
TWIPS_PER_MM, TWIPS_PER_PT = 1440 / 25.4, 20
# Patterns of numbers before names and headings, and of field instructions.
NAME_CHINESE = rf"^([一二三四五六七八九十]+)(?:{SPACE}|[、.：:]){SPACE}*(.*)$"
NAME_BRACKET = rf"^[(（](\d+)[)）]{SPACE}*(.*)$"
NAME_DOTTED = rf"^(\d+(?:\.\d+)*)(?:{SPACE}|[.、_\-])*(.*)$"
NUMBER_SEVERAL = rf"^(\d+(?:\.\d+)+)(?:[.)、]{SPACE}+|{SPACE}+)"
NUMBER_SECTION = r"^第([一二三四五六七八九十百]+|\d+)(?:章|节|篇|部分|级|条)"
NUMBER_SIMPLE = r"^(\d+)[.)、]"
NUMBER_VERSION = r"^(\d+\.\d+(?:\.\d+)*)(?:[^\p{L}\p{N}_.]|\.(?:[^0-9]|$)|$)"
NUMBER_DATE = rf"^(?:19\d\d|20\d\d|2100)\.\d{{1,2}}\.\d{{1,2}}(?:[.)、]{SPACE}+|{SPACE}+)"
NUMBER_CONFIDENCE = {"hierarchical_arabic": 0.98, "section_label": 0.90, "simple_arabic": 0.75}
FIELD_REFERENCE = r"(?i)^(REF|PAGEREF|STYLEREF)[\s\p{Z}]+([^\\\s\p{Z}]+)(.*)$"
FIELD_TARGET = r"(?i)^[\s\p{Z}]*(REF|PAGEREF|STYLEREF|SEQ|TOC|HYPERLINK)[\s\p{Z}]+([^\\\s\p{Z}]+)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def delete_space(text: Column) -> Column:
    """without any white space."""
    return F.regexp_replace(text, rf"{SPACE}+", "")


def collapse_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def text_hash(text: Column) -> Column:
    """SHA-256 of the collapsed text; of the empty text for null."""
    return F.sha2(collapse_space(F.coalesce(text, F.lit(""))), 256)


def clean_match_key(text: Column) -> Column:
    """without white space and the punctuation in which names of one thing differ."""
    return F.regexp_replace(text, MATCH_NOISE, "")


def file_type(name: Column) -> Column:
    """Docx, pdf, pptx or image by suffix; null for any other."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair]), F.when(suffix.isin(*FILE_TYPES), suffix))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern, null where the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def name_parts(name: Column) -> Column:
    """struct of the leading number's parts (999: none), its Chinese numeral and the title behind it.

    Ordering by parts is natural order at any depth and size, which a decimal of two digits a level is not.
    """
    stem = strip(F.regexp_replace(name, r"(?i)\.(docx?|pdf|pptx?|jpe?g|png)$", ""))
    chinese, bracket, dotted = NAME_CHINESE, NAME_BRACKET, NAME_DOTTED
    numerals = F.array(*map(F.lit, CHINESE_NUMERALS))
    numeral = first_group(stem, chinese)
    place = F.array_position(numerals, numeral).cast("int")
    number = lambda c: F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    title = F.regexp_extract(stem, dotted, 2)
    made = lambda parts, numeral, title: F.struct(parts.cast("array<int>").alias("parts"), numeral.cast("string").alias("numeral"), title.alias("title"))
    return (
        F.when(stem.rlike(chinese), made(F.array(F.when(place > 0, place).otherwise(99)), numeral, strip(F.regexp_extract(stem, chinese, 2))))
        .when(stem.rlike(bracket), made(number(F.regexp_extract(stem, bracket, 1)), F.lit(None), strip(F.regexp_extract(stem, bracket, 2))))
        .when(stem.rlike(dotted), made(number(F.regexp_extract(stem, dotted, 1)), F.lit(None), strip(F.when(title == "", stem).otherwise(title))))
        .when(stem.isNotNull(), made(F.array(F.lit(999)), F.lit(None), stem))
    )


def node_title(title: Column, level: Column, seq: Column) -> Column:
    """A title with its number in the style of its level; one that already has it stays."""
    numerals = F.array(*map(F.lit, CHINESE_NUMERALS))
    numeral = F.coalesce(F.try_element_at(numerals, seq.cast("int")), seq.cast("string"))
    done = ((level == 1) & title.rlike(r"^[一二三四五六七八九十]+、")) | ((level == 2) & title.rlike(r"^\d+\.")) | ((level == 3) & title.rlike(r"^（\d+）"))
    return F.when(done, title).when(level == 1, F.concat(numeral, F.lit("、"), title)).when(level == 2, F.concat(seq.cast("string"), F.lit(". "), title)).when(level == 3, F.concat(F.lit("（"), seq.cast("string"), F.lit("）"), title)).otherwise(title)


def to_roman(value: Column) -> Column:
    """the decimal digits for zero and below."""
    out, rest = F.lit(""), value
    for n, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(rest / n).cast("int")))
        rest = rest % n
    return F.when(value <= 0, value.cast("string")).otherwise(out)


def from_roman(text: Column) -> Column:
    """read from the right, a smaller letter before a larger subtracts; null if any letter is none or the sum not positive."""
    own = F.upper(strip(text))
    digits = F.create_map(*[F.lit(x) for pair in ROMAN_DIGITS.items() for x in pair])
    values = F.transform(F.split(F.reverse(own), ""), lambda c: F.try_element_at(digits, c))
    total = F.aggregate(
        values,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda s, v: F.struct(F.when(v < s["last"], s["sum"] - v).otherwise(s["sum"] + v).alias("sum"), F.when(v < s["last"], s["last"]).otherwise(v).alias("last")),
        lambda s: s["sum"],
    )
    return F.when(own.rlike("^[IVXLCDM]+$") & (total > 0), total)


def to_letters(value: Column, capital: bool = False) -> Column:
    """1 is a, 26 z, 27 aa; the decimal digits for zero and below."""
    first = 65 if capital else 97
    letters = F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),  # seven letters hold every int
        F.struct(value.cast("long").alias("n"), F.lit("").alias("out")),
        lambda s, _: F.when(s["n"] > 0, F.struct(F.floor((s["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char((s["n"] - 1) % 26 + first), s["out"]).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    return F.when(value <= 0, value.cast("string")).otherwise(letters)


def page_number(value: Column, style: Column) -> Column:
    """a number in one of five styles, decimal for any other."""
    return F.when(style == "lowerRoman", F.lower(to_roman(value))).when(style == "upperRoman", to_roman(value)).when(style == "lowerLetter", to_letters(value)).when(style == "upperLetter", to_letters(value, True)).otherwise(value.cast("string"))


def page_label(line: Column) -> Column:
    """a footer line without its decoration."""
    return strip(F.regexp_replace(F.regexp_replace(strip(line), f"^{LABEL_NOISE}", ""), f"{LABEL_NOISE}$", ""))


def page_number_line(line: Column) -> Column:
    """Whether a line is nothing but a page number."""
    own = F.regexp_replace(strip(line), r"^[\- ]+|[\- ]+$", "")
    return own.rlike(r"^\d+$") | (from_roman(own).isNotNull())


def numbering(text: Column) -> Column:
    """what the number before a heading is: kind, parts, depth and confidence; kind null if there is none."""
    own = strip(F.coalesce(text, F.lit("")))
    parts = F.split(F.regexp_extract(own, NUMBER_SEVERAL, 1), r"\.")

    def case(kind: str | None, parts: Column, depth: Column) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("kind"), parts.alias("parts"), depth.cast("int").alias("depth"), F.lit(NUMBER_CONFIDENCE.get(kind, 0.0)).alias("confidence"))

    none = F.lit(None)
    return (
        F.when(own.rlike(NUMBER_DATE), case("date_or_version", parts, none))
        .when(own.rlike(NUMBER_SEVERAL), case("hierarchical_arabic", parts, F.size(parts)))
        .when(own.rlike(NUMBER_SECTION), case("section_label", F.array(F.regexp_extract(own, NUMBER_SECTION, 1)), F.lit(1)))
        .when(own.rlike(NUMBER_SIMPLE), case("simple_arabic", F.array(F.regexp_extract(own, NUMBER_SIMPLE, 1)), F.lit(1)))
        .when(own.rlike(NUMBER_VERSION), case("decimal_or_version", F.split(F.regexp_extract(own, NUMBER_VERSION, 1), r"\."), none))
        .otherwise(case(None, F.array().cast("array<string>"), none))
    )


def field_instruction(text: Column) -> Column:
    """a field's instruction with single spaces and single backslashes; empty for null."""
    return F.regexp_replace(collapse_space(F.coalesce(text, F.lit(""))), r"\\{2,}", r"\\")


def field_command(text: Column) -> Column:
    return F.upper(F.split(field_instruction(text), " ")[0])


def field_identity(text: Column) -> Column:
    """the instruction with the target of a reference masked, so that renamed bookmarks compare alike."""
    own = collapse_space(F.coalesce(text, F.lit("")))
    pattern = FIELD_REFERENCE
    return F.when(own.rlike(pattern), F.concat(F.upper(F.regexp_extract(own, pattern, 1)), F.lit(" <bookmark>"), F.regexp_extract(own, pattern, 3))).otherwise(own)


def field_dependency(text: Column) -> Column:
    """COMMAND:target of a field that depends on something, else null."""
    pattern = FIELD_TARGET
    return F.when(text.rlike(pattern), F.concat(F.upper(F.regexp_extract(text, pattern, 1)), F.lit(":"), F.regexp_extract(text, pattern, 2)))


def hyperlink_target(anchor: Column, external: Column, relationship: Column) -> Column:
    """the anchor, else the external address, else the relationship."""
    return F.coalesce(F.concat(F.lit("#"), F.nullif(anchor, F.lit(""))), F.nullif(external, F.lit("")), F.nullif(relationship, F.lit("")))


def occurrence_id(*parts: Column) -> Column:
    """F16: the identity of an occurrence, its parts joined by bars."""
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def marker_name(identity: Column, prefix: str = "_Src_", length: int = 28) -> Column:
    """F16: a short stable bookmark name of an identity."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(identity, 256), 1, length))


def reserved_name(name: Column) -> Column:
    """P10: whether a file name is a device's."""
    return F.upper(F.trim(F.split(name, r"\.")[0])).isin(*RESERVED_NAMES)


def filename_fault(name: Column) -> Column:
    """the first fault of a delivery's file name, null if it has none."""
    stem = F.regexp_replace(name, r"(?i)\.docx$", "")
    return (
        F.when(name.isNull() | (strip(name) == ""), "empty")
        .when(~name.rlike(r"(?is).\.docx\z"), "suffix")
        .when(name.rlike(r'[<>:"/\\|?*]'), "forbidden")
        .when(name.rlike(r"[\x00-\x1f\x7f-\x{9f}]"), "control")
        .when(name.rlike(r"^(\.|~\$)"), "hidden")
        .when(name.rlike(r"[. ]$") | stem.rlike(r"[. ]$") | (name != strip(name)), "edge")
        .when(reserved_name(name) | reserved_name(stem), "reserved")
    )


def draft_name(name: Column) -> Column:
    """the file name of a draft."""
    return F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit("-draft"), F.regexp_extract(name, r"(\.[^./]*)$", 1))


def to_twips(value: Column, unit: Column, font_size: Column | None = None) -> Column:
    """a length in twips, halves to even; a char is the font's size, null without one."""
    size = font_size if font_size is not None else F.lit(None).cast("double")
    return F.when(unit == "mm", F.bround(value * TWIPS_PER_MM)).when(unit == "pt", F.bround(value * TWIPS_PER_PT)).when(unit == "char", F.bround(value * size * TWIPS_PER_PT)).cast("int")


def to_points(value: Column, unit: Column, font_size: Column | None = None) -> Column:
    """a length in points."""
    size = font_size if font_size is not None else F.lit(None).cast("double")
    return F.when(unit == "mm", value * 72 / 25.4).when(unit == "pt", value).when(unit == "char", value * size)


def toggle(present: Column, value: Column) -> Column:
    """absent is null (inherited), without a value or with any but an off word true."""
    return F.when(present, ~F.coalesce(F.lower(value).isin("0", "false", "off", "none"), F.lit(False)))


def content_size(page: Column, before: Column, after: Column) -> Column:
    """what margins leave of a page, one at least."""
    return F.greatest(F.lit(1), page - before - after)


def fitted_box(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """an image's size within a box, its proportion kept; the whole box for an image without size."""
    aspect = height / width
    wide = box_width * aspect <= box_height
    return F.when((width <= 0) | (height <= 0), F.struct(box_width.alias("width"), box_height.alias("height"))).otherwise(
        F.struct(F.when(wide, box_width).otherwise(box_height / aspect).alias("width"), F.when(wide, box_width * aspect).otherwise(box_height).alias("height"))
    )


def rescaled_columns(widths: Column, room: Column) -> Column:
    """column widths brought into the room in proportion, each one at least, the last takes the rounding's rest; unchanged if they fit."""
    total = F.aggregate(widths, F.lit(0).cast("long"), lambda s, w: s + F.coalesce(w, F.lit(0)))
    head = F.transform(F.slice(widths, 1, F.greatest(F.size(widths) - 1, F.lit(0))), lambda w: F.greatest(F.lit(1), F.bround(F.coalesce(w, F.lit(0)) * room / total).cast("int")))
    used = F.aggregate(head, F.lit(0).cast("long"), lambda s, w: s + w)
    return F.when((total <= room) | (total <= 0), widths).otherwise(F.concat(head, F.array(F.greatest(F.lit(1), (room - used).cast("int")))))


def near(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """numbers within a tolerance; nulls agree with nulls only."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def same_font(a: Column, b: Column) -> Column:
    """one name in any letter case, or two names of one font; an unasked name agrees with any."""
    pairs = [((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in FONT_ALIASES]
    alias = pairs[0]
    for p in pairs[1:]:
        alias = alias | p
    return F.when(a.isNull(), True).when(b.isNull(), False).otherwise((F.lower(a) == F.lower(b)) | alias)


def same_colour(a: Column, b: Column) -> Column:
    """equal, or two writings of black."""
    return a.eqNullSafe(b) | F.coalesce(F.lower(a).isin(*BLACK) & F.lower(b).isin(*BLACK), F.lit(False))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """every token of a template replaced once, from left to right; values are not looked through again."""
    pattern = "(" + "|".join("\\Q" + t + "\\E" for t in sorted(values, key=len, reverse=True)) + ")"
    between = F.split(template, pattern, -1)
    tokens = F.regexp_extract_all(template, F.lit(pattern), 1)
    known = F.create_map(*[x for t, v in values.items() for x in (F.lit(t), F.coalesce(v.cast("string"), F.lit("")))])
    filled = F.concat(F.transform(tokens, lambda t: known[t]), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, filled, lambda a, b: F.concat(a, b)), "")


def record_status(explicit: Column, observed: Column, expected: Column) -> Column:
    """the given status, else verified, mismatch or unverified by observed and expected label."""
    return F.coalesce(explicit, F.when(observed.isNull() | expected.isNull(), "unverified").when(observed == expected, "verified").otherwise("mismatch"))
