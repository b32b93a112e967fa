"""Reading levels on held-out labels and in corner cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheaf.llm.lookalike import fold_array
from sheaf.llm.reading import document_counts, high_frequency_lists, lists_of, reading_levels, terms
from sheaf.llm.tokens import folded, reading_units

DATA = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    documents, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "reading_labels"))
    shown = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    bands = {r.doc_id: r.band for r in reading_levels(documents, shown).collect()}
    assert set(bands) == {r.doc_id for r in documents.where("length(text) >= 150").select("doc_id").collect()}
    opinions = defaultdict(set)
    for r in labels.where("band is not null").collect():
        opinions[r.doc_id].add(r.band)
    seen = {r.doc_id for r in shown.select("doc_id").collect()}
    held = [d for d in opinions if d not in seen and d in bands and len(opinions[d]) == 1]
    assert sum(bands[d] in opinions[d] for d in held) / len(held) >= 0.88 and len(held) > 50  # readers err, too


def test_counts(spark):
    rows = spark.createDataFrame([("Ab ab AB.",), ("ab cd",), ("",), (None,), ("12 ,",), ("中文字",)], "text string")
    counts = {r.word: r.n for r in document_counts(rows).collect()}
    word = lambda t: int(reading_units(*folded(pa.array([t])))[1][0].view("int64"))
    assert counts[word("ab")] == 2 and counts[word("cd")] == 1 and counts[word("文字")] == 1 and counts[0] == 3
    assert len(high_frequency_lists(spark.createDataFrame([("same words",)] * 5, "text string")).words) == 2
    assert len(high_frequency_lists(rows.limit(0)).words) == 0


def test_sentences():
    texts = ["One. Two! Three", "", None, "...\n\n", "你好。再见？", "a\nb", "é. b"]
    assert reading_units(*folded(pa.array(texts, pa.string())))[2].tolist() == [3, 0, 0, 0, 2, 2, 2]


def test_terms_against_plain_counts(spark):
    """Shares outside each list and the length of sentences, counted word by word."""
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) >= 150").select("text").limit(200).collect()]
    units = []
    for text, plain in zip(texts, fold_array(pa.array(texts), caseless=True).to_pylist()):
        han = re.findall(r"[\u3400-\u9fff]+", plain)
        words = re.findall(r"[^\W\d_\u3400-\u9fff]+", plain) + [run[i : i + 2] for run in han for i in range(len(run) - 1)]
        sentences = [x for x in re.split(r"[.!?;\n。．！？；]", text) if re.search(r"[^\W_]", x)]
        units.append((words, len(sentences)))
    counts = Counter(w for words, _ in units for w in set(words))
    listed = [w for w in counts if counts[w] >= 5]
    key = lambda w: reading_units(*folded(pa.array([w])))[1][0]
    on = np.array([[counts[w] >= 5, counts[w] >= 20] for w in listed])
    got, row, place = terms(pa.array(texts), lists_of(np.array([key(w) for w in listed]), on))
    outside = lambda words, least: sum(counts[w] < least for w in words) / max(len(words), 1)
    want = [(outside(words, 5), outside(words, 20), np.log1p(len(words) / max(n, 1))) for words, n in units]
    assert np.allclose(got, np.array(want))
    assert np.bincount(row, minlength=len(texts)).tolist() == [sum(counts[w] >= 5 for w in words) for words, _ in units]
    assert {listed[p] for p in place} == set(listed)


def test_rounds(spark):
    """The lists of bands must beat the first ones."""
    documents, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "reading_labels"))
    sure = {r.doc_id: r.a for r in labels.where("band is not null").groupBy("doc_id").agg(F.min("band").alias("a"), F.max("band").alias("b")).where("a = b").collect()}
    share = [sum(sure[r.doc_id] == r.band for r in rows) / len(rows) for n in (0, 1) for rows in [[r for r in reading_levels(documents, labels, n).collect() if r.doc_id in sure]]]
    assert share[1] > share[0] and share[1] > 0.93


def test_corner_cases(spark):
    documents = spark.createDataFrame([(1, "word " * 40, None), (1, "word " * 40, None), (2, "short", None), (3, None, None), (4, "", None), (5, "1 2 3 " * 60, None)], "doc_id long, text string, band int")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, reader string, band int")
    assert sorted(tuple(r) for r in reading_levels(documents, labels([(1, "r", None)])).collect()) == [(1, None), (5, None)]
    assert sorted(tuple(r) for r in reading_levels(documents, labels([(1, "r", 2), (1, "r", 2), (9, "r", 1), (5, "s", 7)])).collect()) == [(1, 2), (5, 2)]
    assert reading_levels(documents.limit(0), labels([(1, "r", 2)])).count() == 0
    assert [r[0] for r in reading_levels(documents, labels([(1, "r", 2)])).dtypes] == ["doc_id", "band"]
