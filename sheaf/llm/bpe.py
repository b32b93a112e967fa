"""Encoding of texts with a public byte-level BPE vocabulary, without replaying merges.

A batch is cut into pre-tokens as a whole, by the classes of its code points, and each different pre-token is encoded
once; the ids are gathered for all places. A pre-token's bytes run once through an Aho-Corasick automaton of all tokens, which gives the longest token that
starts at each byte. The encoder takes it if it may stand behind the token before, else the next shorter token that
is a prefix of it, and steps back where none fits; positions found dead are not tried again. Two tokens may stand
side by side if merging their joint bytes by rank gives just these two; the answers are kept in a table. Encodings
whose neighbours are all compatible are what merging the whole gives, so the result is exact, in linear time.

Decoding gathers token bytes by an offset table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from sheaf.llm.lookalike import TOP, sliced, to_codes
from sheaf.llm.tokens import hashed
from sheaf.session import table, tokenizer_dir

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens up to this many bytes are remembered, so many of them.
REMEMBERED_BYTES, REMEMBERED = 48, 300_000


OTHER, LETTER, NUMBER, GAP = range(4)
APOSTROPHE, SPACE = ord("'"), ord(" ")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """By code point: letter, number, white space or other, as the pattern has them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, TOP)]))
    kind = np.full(TOP, OTHER, dtype=np.uint8)
    for what, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (GAP, r"\s")):
        kind[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), dtype=np.uint32)] = what
    return kind


def piece_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; each ends where the next one begins, and rows are cut at their bounds.

    A run of one class is a pre-token and takes a space before it along; of a longer gap before something its last
    character stands alone if it is no space; a short ending behind an apostrophe that begins a pre-token goes with it.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    first = first[:n]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    gap, behind = kind == GAP, np.zeros(n, dtype=bool)
    behind[1:] = gap[:-1] & ~first[1:]  # a gap stands before, in the same row
    head = np.flatnonzero(run & ~gap & behind)  # what follows a gap
    spaced = head[codes[head - 1] == SPACE]
    start[head - 1] = True  # the gap's last character stands alone or, a space, goes along
    start[spaced] = False
    mark = np.flatnonzero((codes == APOSTROPHE) & start)
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1] & (kind[mark + 1] == LETTER)]
    if len(mark):
        one, two = codes[mark + 1], codes[np.minimum(mark + 2, n - 1)]
        two = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n - 1)], two, 0)
        size = np.where(np.isin(one, [ord(x) for x in "sdmt"]), 1, 0)
        for pair in ("ll", "ve", "re"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        rest = mark + 1 + size
        inside = rest < n
        rest = rest[inside]
        start[rest[~first[rest] & (kind[rest] == LETTER)]] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.ranks, self.split = ranks, regex.compile(pattern)
        top = max(ranks.values()) + 1
        self.size = [0] * top
        self.parts: list[bytes] = [b""] * top
        self.shorter = [-1] * top
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.size[rank], self.parts[rank] = len(token), token
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.automaton.make_automaton()
        self.blob = np.frombuffer(b"".join(self.parts), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.size)])
        self.beside: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The definition: the adjacent pair of least rank is merged until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        if (known := self.beside.get(key)) is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            known = self.beside[key] = self.merged(self.parts[left] + self.parts[right]) == [left, right]
        return known

    def piece(self, text: str) -> list[int]:
        """The ids of one pre-token, its bytes given as latin-1."""
        longest, size, shorter, compatible = [0] * len(text), self.size, self.shorter, self.compatible
        for end, token in self.automaton.iter(text):
            longest[end - size[token] + 1] = token  # ends rise, so the last is the longest
        ids: list[int] = []
        alive = bytearray(b"\1") * (len(text) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if alive[end] and (not ids or compatible(ids[-1], token)):
                ids.append(token)
                if end == len(text):
                    return ids
                at, token = end, longest[end]
                continue
            while (token := shorter[token]) < 0:
                alive[at] = 0
                token = ids.pop()
                at -= size[token]

    def unknown(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        own = self.piece(raw.decode("latin-1"))
        if len(raw) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = own
        return own

    def encode(self, text: str | None) -> list[int]:
        words = self.split.findall(text or "")
        made = list(map(self.known.get, words))
        if None in made:
            made = [self.unknown(word) if own is None else own for word, own in zip(words, made)]
        return list(chain.from_iterable(made))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has; null texts have none."""
        flat: list[np.ndarray] = [np.zeros(0, dtype=np.int32)]
        count = np.zeros(len(texts), dtype=np.int64)
        for at, part in sliced(texts):
            codes, bounds = to_codes(part)
            start = piece_starts(codes, bounds)
            if not len(start):
                continue
            end = np.append(start[1:], len(codes))
            place = pa.array(hashed(codes, start, end)).dictionary_encode().indices.to_numpy()
            one = np.zeros(place.max() + 1, dtype=np.int64)
            one[place[::-1]] = np.arange(len(place))[::-1]  # the first place of each
            step = np.repeat(start[one[place]] - start, end - start) + np.arange(len(codes))
            if ((end - start) != (end - start)[one[place]]).any() or (codes[step] != codes).any():  # two pieces with one hash
                made = [np.array(self.encode(t), dtype=np.int32) for t in part.to_pylist()]
                flat += made
                count[at : at + len(part)] = list(map(len, made))
                continue
            words = [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(start[one], end[one])]
            ids = [self.unknown(w) if (own := self.known.get(w)) is None else own for w in words]
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            every = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=size.sum())
            low, many = (np.cumsum(size) - size)[place], size[place]
            flat.append(every[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())])
            before = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(start, bounds)]
            count[at : at + len(part)] = np.diff(before)
        return np.concatenate(flat), count

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decoded(np.asarray(ids, dtype=np.int64))[0].tobytes()

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after another, and how many each has."""
        low, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.blob[np.repeat(low, size) + step], size


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(path: str):
    """A function of a text column: its ids, an empty list for a null or empty text."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for texts in batches:
            flat, count = own.encode_all(texts)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, ArrayType(IntegerType(), False))


def decode_column(path: str):
    """A function of an ids column: the text, null where it is null."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for lists in batches:
            octets, size = own.decoded(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
            nulls = None if not lists.null_count else pc.is_valid(lists).buffers()[1]
            raw = pa.Array.from_buffers(pa.large_binary(), len(lists), [nulls, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(octets)])
            try:
                yield raw.cast(pa.string())
            except pa.ArrowInvalid:  # ids that are no encoding of a text
                yield pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, StringType())


def encode_texts(texts: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """texts with the ids of a text column; null and empty texts get an empty list. No shuffle."""
    return texts.withColumn(into, encode_column(path or f"{tokenizer_dir()}/{VOCABULARY}")(F.col(text)))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document, by byte_bpe_50k without special tokens."""
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language tag and source: documents, tokens, code points, and whether every text decodes to itself."""
    path = f"{tokenizer_dir()}/{VOCABULARY}"
    rows = encode_texts(table(spark, sf_dir, "documents").select("lang", "source", "text"), path=path)
    back = decode_column(path)(F.col("ids"))
    return (
        rows.withColumn("same", F.coalesce(F.col("text"), F.lit("")) == back)
        .groupBy("lang", "source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.sum(F.length("text")).alias("n_chars"), F.every("same").alias("round_trip"))
    )
