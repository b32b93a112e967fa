"""Passages of items in documents, verbatim and re-parameterised, against a plain search."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import regex

from sheaf.llm.leaks import MEASURES, NAME_CHARACTERS, NUMBERS, NUMERALS, found, leak_windows, reworded_pairs
from sheaf.llm.lookalike import fold_array

DATA = "/root/testdata/sf0.01"
WORD, CHARACTER = regex.compile(r"[\p{L}\p{N}\p{M}]+"), regex.compile(r"[\p{L}\p{N}\p{M}]")


def folded(texts, caseless=True):
    return fold_array(pa.array(texts, pa.string()), caseless).to_pylist()


def is_chinese(lang):
    return (lang or "").lower().startswith(("zh", "cn", "chi"))


def plain(documents, items):
    index = defaultdict(set)
    for (number, _, lang), text in zip(items, folded([t for _, t, _ in items])):
        cut, size = (CHARACTER, 40) if is_chinese(lang) else (WORD, 18)
        units = cut.findall(text or "")
        for i in range(len(units) - size + 1):
            index[cut, tuple(units[i : i + size])].add(number)
    out = set()
    for (number, _), text in zip(documents, folded([t for _, t in documents])):
        for cut, size in ((CHARACTER, 40), (WORD, 18)):
            units = cut.findall(text or "")
            for i in range(len(units) - size + 1):
                out |= {(number, x) for x in index.get((cut, tuple(units[i : i + size])), ())}
    return out


def slots(text, known, characters):
    """The units of a text as (type, text), neighbouring numbers and neighbouring names in one."""
    units = (CHARACTER if characters else WORD).findall(text or "")
    number = lambda u: regex.fullmatch(r"\p{N}+", u) and u not in NUMERALS or u in (NUMERALS if characters else NUMBERS)
    if characters:
        sure = [bool(number(u)) or tuple(units[i : i + 2]) in known or i > 0 and tuple(units[i - 1 : i + 1]) in known for i, u in enumerate(units)]
        for i in range(len(units)):
            if not sure[i] and (i == 0 or sure[i - 1]):
                j = i
                while j < len(units) and not sure[j]:
                    j += 1
                if j - i > NAME_CHARACTERS:
                    sure[i:j] = [None] * (j - i)  # plain after all
        kinds = ["number" if number(u) else "name" if sure[i] is False else "plain" for i, u in enumerate(units)]
    else:
        kinds = ["number" if number(u) else "measure" if i and number(units[i - 1]) and u in MEASURES else "plain" if u in known else "name" for i, u in enumerate(units)]
    out = []
    for kind, unit in zip(kinds, units):
        if out and kind in ("number", "name") and out[-1][0] == kind:
            out[-1] = (kind, f"{out[-1][1]} {unit}")
        else:
            out.append((kind, unit))
    return out


def plainly_reworded(documents, items):
    texts = folded([t for _, t, _ in items])
    own = [WORD.findall(t or "") for t in texts]
    many = Counter(w for words in own for w in set(words))
    many.update(p for t in texts if regex.search(r"\p{Han}", t or "") for u in [CHARACTER.findall(t)] for p in set(zip(u, u[1:])))
    small = {w for t, words in zip(folded([t for _, t, _ in items], False), own) for w in WORD.findall(t or "") if w in words}
    known = {w for w in many if many[w] > 1} | small
    windows = lambda units, size: [units[i : i + size] for i in range(len(units) - size + 1)]
    shape = lambda window: tuple(u if k == "plain" else (k,) for k, u in window)
    index = defaultdict(list)
    for (number, _, lang), text in zip(items, texts):
        size = 40 if is_chinese(lang) else 18
        for window in windows(slots(text, known, is_chinese(lang)), size):
            if sum(k != "plain" for k, _ in window) * 2 <= size:
                index[is_chinese(lang), shape(window)].append((number, [u for _, u in window]))
    out = defaultdict(set)
    for (number, _), text in zip(documents, folded([t for _, t in documents])):
        for characters, size in ((False, 18), (True, 40)):
            if characters and not regex.search(r"\p{Han}", text or ""):
                continue
            for i, window in enumerate(windows(slots(text, known, characters), size)):
                mine = [u for _, u in window]
                for item, theirs in index.get((characters, shape(window)), ()):
                    if len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs)):
                        out[number, item].add((characters, i))
    verbatim = plain(documents, items)
    return {(d, i, len(places)) for (d, i), places in out.items() if (d, i) not in verbatim}


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).distinct().collect()]


def test_against_plain_search(spark):
    want = plain(read(spark, "documents", "doc_id", "text"), read(spark, "eval_items", "item_id", "item_text", "lang"))
    got = [tuple(r) for r in found(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def replanted(items, chance):
    """Items with other names, numbers and measures: each with what was put in their place."""
    words = Counter(w for _, t, _ in items for w in set(WORD.findall(t or "")))
    small = {w for w in words if w.islower()}
    for number, text, lang in items:
        if not text or is_chinese(lang) and not regex.search(r"\d", text):
            continue
        other: dict[str, str] = {}

        def swap(match, other=other):
            word = match[0]
            if word not in other:
                if word.isdigit():
                    other[word] = chance.choice([str(chance.randrange(10, 5000)), "twelve", "1,300"]) if not is_chinese(lang) else str(chance.randrange(10, 5000))
                elif word[0].isupper() and word.lower() not in small and words[word] == 1:
                    other[word] = chance.choice(["Quorbin", "Zalmet Orvik"]) + chance.choice("abcdefgh") * 3
                else:
                    other[word] = word
            return other[word]

        made = regex.sub(r"\d+" if is_chinese(lang) else r"[\p{L}\p{N}]+", swap, text)
        if made != text and len(set(other.values())) == len(other):
            yield number, made


def test_planted_rewordings(spark):
    items = read(spark, "eval_items", "item_id", "item_text", "lang")
    chance = random.Random(5)
    planted = list(replanted(items, chance))
    rest = [(n, t) for n, t in read(spark, "documents", "doc_id", "text") if n % 7 == 0]
    documents = [(10_000_000 + number, f"Some words before. {text} And some behind.") for number, text in planted] + rest
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    got = {tuple(r) for r in reworded_pairs(frame.repartition(5), spark.createDataFrame(items, "item_id long, item_text string, lang string")).collect()}
    assert got == plainly_reworded(documents, items)
    verbatim = plain(documents, items)
    long = [(n, t) for n, t in planted if (10_000_000 + n, n) not in verbatim]
    pairs = {(d, i) for d, i, _ in got}
    assert len(long) > 40 and sum((10_000_000 + n, n) in pairs for n, _ in long) / len(long) >= 0.9
    assert sum(d < 10_000_000 for d, _ in pairs) <= 3  # documents without a planted copy


ITEM = "Although the reliable hierarchy Kobar was approved before Kobar had 215 mm of the inventory, several members of the committee Zelin kept a provisional reference because it held"


def run(spark, texts, items):
    documents = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_text string")
    asked = spark.createDataFrame(items, "item_id long, item_text string, lang string")
    rows = leak_windows(documents, asked).collect()
    verbatim = {(r.doc_id, r.item_id) for r in rows if not r.spans}
    return verbatim, {(r.doc_id, r.item_id): r.n_windows for r in reworded_pairs(documents, asked).collect()}


def test_corner_cases(spark):
    words = ITEM.split()
    texts = [
        ITEM.upper().replace(",", " --\n"),
        " ".join(words[:17]) + " other " + " ".join(words[18:25]),
        "x " + " ".join(words[4:22]) + " y",
        ITEM.replace("Kobar", "Trebin").replace("Zelin", "Mor").replace("215", "90").replace(" mm ", " cm "),
        ITEM.replace("Kobar", "Trebin", 1).replace("215", "90").replace("Zelin", "Mor"),
        None,
        "",
        "ｌong " * 5 + ITEM.replace("a", "а"),
        ITEM.replace("Kobar", "Trebin Ostal").replace("Zelin", "Mor").replace("215", "1,300"),
        ITEM.replace("Kobar", "Trebin").replace("215", "twelve"),
        "Gor Nim Zal Tek Rum Vos Lim Pag Dor Hus Kel Mir Nos Pel Ras Sut Tov Vul Wex Yor",
    ]
    items = [(1, ITEM, "en"), (1, ITEM, "en"), (2, None, "en"), (3, "", None), (4, "short text", "en"), (5, "Other small words: although the approved before several members of was kept a to because it held hierarchy reliable inventory committee provisional reference", "en")]
    items.append((6, "Bor Dim Fal Gek Hum Jos Kim Lag Mor Nus Pel Qir Ros Sel Tas Uut Vov Wul Xex Zor", "en"))  # nothing but names
    verbatim, reworded = run(spark, texts, items)
    assert verbatim == {(0, 1), (2, 1), (7, 1)}
    assert {(3, 1), (8, 1), (9, 1)} <= set(reworded) and not any(d in (1, 5, 6, 10) for d, _ in reworded)
    assert reworded[3, 1] > reworded.get((4, 1), 0)  # windows with both names agree only if both were replaced alike
    assert run(spark, texts, []) == (set(), {}) and run(spark, texts[5:7], items) == (set(), {})
    assert run(spark, texts * 2, items)[0] == {(0, 1), (2, 1), (7, 1), (11, 1), (13, 1), (18, 1)}


def test_other_items_do_not_hide_one(spark):
    """Found alone or beside another item that shares a few of its words."""
    text = ITEM.replace("Kobar", "Trebin").replace("Zelin", "Mor").replace("215", "90")
    for others in ([], [(2, "Although the Zelin was approved before the inventory of several members of the committee was approved by the inventory", "en")]):
        assert (0, 1) in run(spark, [text], [(1, ITEM, "en"), *others])[1]


def test_chinese(spark):
    text = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    dotted = "，".join(text[i : i + 5] for i in range(0, 60, 5))
    verbatim, _ = run(spark, [dotted, text[:39] + "x" + text[40:], text[10:50], "a " * 50], [(1, text, "zh"), (2, text, None)])
    assert verbatim == {(0, 1), (0, 2), (2, 1), (2, 2)}
    other = "".join(chr(0x7E00 + i) for i in range(5))
    with_number = f"{text[:20]}12{text[20:40]}345{text[40:]}"
    _, reworded = run(spark, [with_number.replace("12", "7").replace("345", "三十"), with_number.replace(text[25:28], other[:2])], [(1, with_number, "zh"), (2, text, "zh"), (3, text[:25] + text[28:], "zh")])
    assert (0, 1) in reworded
