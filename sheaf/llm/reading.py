"""Reading level of texts, by familiar words and sentence length.

The formula has two kinds of terms: the share of a document's words that are outside a high-frequency list, and the
average length of its sentences. A list holds the words that a given share of documents has; names and numbers fall
out there. A band is the one whose linear formula over these terms is highest; the few coefficients are fitted to
readers' opinions, words are never weighted by them.

Lists come from document frequencies of the whole corpus, in rounds. The first lists count all documents alike; as words
of all levels are about as frequent over all, their formula, which takes products of two terms, too, gives a coarse band
only. The next round counts the documents of each band by themselves, over the whole corpus again, and takes the
high-frequency lists of each band: what is familiar to readers of that level. All documents are counted in every round;
only the readers' sample is bounded.

Words are compared in one look and letter case, and Chinese text is read as pairs of neighbouring characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.lookalike import sliced
from sheaf.llm.tokens import folded, reading_units
from sheaf.session import cut, table

BANDS, LEAST_CHARS = 4, 150
#: Shares of all documents that have a word, for the first lists; no word below the first one is on any list.
SHARES = (0.001, 0.003, 0.01, 0.03, 0.1, 0.2)
LISTED_LEAST = 3
#: The same of the documents of one band, for the lists of that band.
BAND_SHARES = (0.003, 0.02, 0.08)
#: How often the documents are counted by band.
ROUNDS = 1
#: Bound of the labelled sample: documents, taken by the hash of their id.
LABELLED = 20_000


class Lists(NamedTuple):
    words: np.ndarray  # hashes of all listed words
    sets: np.ndarray  # the different sets of lists that words are on, the empty one last: one row each, one column a list
    of: np.ndarray  # by word: its row there


class Scale(NamedTuple):
    lists: Lists
    products: bool  # whether products of two terms are terms, too
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray


def lists_of(words: np.ndarray, on: np.ndarray) -> Lists:
    """on: whether each word is on each list."""
    sets, of = np.unique(on, axis=0, return_inverse=True) if len(on) else (on, np.zeros(0, dtype=np.int64))
    return Lists(words, np.vstack([sets, np.zeros((1, on.shape[1]), dtype=bool)]).astype(float), of.ravel().astype(np.int32))


def document_counts(documents: DataFrame) -> DataFrame:
    """word (a hash) and n, the number of documents that have it; under 0 the number of documents with any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in sliced(batch.column(0)):
                row, value, _ = reading_units(*folded(part))
                known = pa.array(value).dictionary_encode()
                words, place = known.dictionary.to_numpy(), known.indices.to_numpy().astype(np.int64)
                once = np.sort(row * max(len(words), 1) + place)
                once = once[np.append(True, once[1:] != once[:-1])[: len(once)]]
                counts = np.bincount(once % max(len(words), 1), minlength=len(words))
                texts = np.count_nonzero(np.bincount(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(words.view(np.int64), 0)), pa.array(np.append(counts, texts).astype(np.int64))], names=["word", "n"])

    return documents.select("text").where(F.length("text") > 0).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def high_frequency_lists(documents: DataFrame) -> Lists:
    """The lists of all documents, one for each of SHARES. There are at most a document's mean number of words over the least share."""
    counts = cut(document_counts(documents))
    total = counts.where("word = 0").first()
    least = [max(LISTED_LEAST, (total["n"] if total else 0) * share) for share in SHARES]
    rows = counts.where(F.col("n") >= min(least)).where("word <> 0").toArrow().sort_by("word")
    return lists_of(rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()[:, None] >= np.array(least))


def readers_sample(labels: DataFrame) -> dict[int, np.ndarray]:
    """By document the share of each band among its readers; a reader counts once, null and unknown bands not at all."""
    bands = [F.sum((F.col("band") == b).cast("int")).alias(f"b{b}") for b in range(1, BANDS + 1)]
    rows = (
        labels.where(F.col("band").between(1, BANDS) & F.col("doc_id").isNotNull())
        .select("doc_id", "reader", "band")
        .distinct()
        .groupBy("doc_id")
        .agg(*bands)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELLED)
        .toArrow()
    )
    votes = np.stack([rows.column(f"b{b}").to_numpy() for b in range(1, BANDS + 1)], 1).astype(float) if rows.num_rows else np.zeros((0, BANDS))
    return dict(zip(rows.column("doc_id").to_pylist(), votes / np.maximum(votes.sum(1, keepdims=True), 1)))


def terms(texts: pa.Array, lists: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formula's terms of each text; and row and place of every listed word in them."""
    row, value, sentences = reading_units(*folded(texts))
    place = pc.index_in(pa.array(value), value_set=pa.array(lists.words)).fill_null(-1).to_numpy()
    kinds = len(lists.sets)
    of = np.append(lists.of, kinds - 1)[place]  # place -1 is the empty set
    words = np.bincount(row, minlength=len(texts))
    on = np.bincount(row * kinds + of, minlength=len(texts) * kinds).reshape(-1, kinds) @ lists.sets
    length = np.log1p(words / np.maximum(sentences, 1))
    hit = place >= 0
    return np.column_stack([1 - on / np.maximum(words, 1)[:, None], length]), row[hit], place[hit]


def with_products(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, *[x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]])


def fit(x: np.ndarray, votes: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the terms and the coefficients of each band, by Newton's steps on the readers' shares."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    n, width = x.shape
    weight = np.zeros((width, BANDS))

    def chances(weight: np.ndarray) -> np.ndarray:
        z = x @ weight
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    loss = lambda p, w: -(votes * np.log(p + 1e-300)).sum() / n + ridge / 2 * (w * w).sum()
    p = chances(weight)
    for _ in range(30):
        slope = (x.T @ (p - votes) / n + ridge * weight).T.ravel()
        curve = np.block([[x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]) / n for b in range(BANDS)] for a in range(BANDS)])
        step = np.linalg.solve(curve + ridge * np.eye(len(curve)), slope).reshape(BANDS, width).T
        size, before = 1.0, loss(p, weight)
        while size > 1e-4 and loss(chances(weight - size * step), weight - size * step) > before:
            size /= 2
        weight = weight - size * step
        p = chances(weight)
        if np.abs(size * step).max() < 1e-4:
            break
    return mean, spread, weight


def bands_of(x: np.ndarray, scale: Scale) -> np.ndarray:
    """0 to BANDS - 1, of texts by their terms."""
    x = with_products(x) if scale.products else x
    return (np.column_stack([(x - scale.mean) / scale.spread, np.ones(len(x))]) @ scale.weight).argmax(1)


def scaled(sample: DataFrame, votes: dict[int, np.ndarray], lists: Lists, products: bool = False) -> Scale | None:
    """The formula over given lists, fitted to the sample; only its terms come to the driver. None for an empty sample."""
    shared = sample.sparkSession.sparkContext.broadcast(lists)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([terms(part, shared.value)[0] for _, part in sliced(batch.column(1))] or [np.zeros((0, shared.value.sets.shape[1] + 1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])

    rows = sample.mapInArrow(describe, "doc_id long, x array<double>").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return Scale(lists, products, *fit(with_products(x) if products else x, np.stack([votes[d] for d in rows.column("doc_id").to_pylist()])))


def lists_by_band(documents: DataFrame, scale: Scale) -> Lists:
    """The high-frequency lists of the documents of each band, bands being told by the formula as it is; over all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(scale)
    known = len(scale.lists.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((known + 1) * BANDS, dtype=np.int64)  # the last word stands for the document
        for batch in batches:
            for _, part in sliced(batch.column(0)):
                x, row, place = terms(part, shared.value.lists)
                band = bands_of(x, shared.value)
                once = np.sort(row * known + place)
                once = once[np.append(True, once[1:] != once[:-1])[: len(once)]]
                counts += np.bincount(once % max(known, 1) * BANDS + band[once // max(known, 1)], minlength=len(counts))
                counts[known * BANDS :] += np.bincount(band, minlength=BANDS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])

    rows = documents.where(F.length("text") >= LEAST_CHARS).select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((known + 1) * BANDS)
    counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(known + 1, BANDS)
    rate = counts[:known] / np.maximum(counts[known], 1)
    return lists_of(scale.lists.words, np.column_stack([np.ones(known, dtype=bool), *[rate >= share for share in BAND_SHARES]]))


def fitted(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Scale | None:
    """The scale of a corpus; None without labelled documents. With rounds 0 the one of the first lists."""
    votes = readers_sample(labels)
    if not votes:
        return None
    wanted = documents.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(list(votes), pa.int64())}))
    sample = cut(documents.where(F.length("text") >= LEAST_CHARS).select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi"))
    scale = scaled(sample, votes, high_frequency_lists(documents), products=True)
    for _ in range(rounds if scale else 0):
        scale = scaled(sample, votes, lists_by_band(documents, scale))
    return scale


def reading_levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and band of every document with a text of LEAST_CHARS code points or more.

    Shorter, empty and null texts have no row; without any labelled document band is null. Repeated rows count once.
    """
    long = documents.where(F.length("text") >= LEAST_CHARS).select("doc_id", "text")
    scale = fitted(documents, labels, rounds)
    if scale is None:
        return long.select("doc_id", F.lit(None).cast("int").alias("band")).distinct()
    shared = documents.sparkSession.sparkContext.broadcast(scale)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in sliced(batch.column(1)):
                band = bands_of(terms(part, shared.value.lists)[0], shared.value) + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(band.astype(np.int32))], names=["doc_id", "band"])

    return long.mapInArrow(rate, "doc_id long, band int").groupBy("doc_id").agg(F.max("band").alias("band"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents and code points of each language tag and source have each band."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(found(spark, sf_dir), "doc_id").groupBy("lang", "source", "band").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))
