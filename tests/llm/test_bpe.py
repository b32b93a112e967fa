"""Exact encodings, checked against a library that replays merges."""

import base64
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
import tiktoken

from sheaf.llm import bpe
from sheaf.llm.bpe import PATTERN, VOCABULARY, Encoder, decode_column, encode_texts, ids, piece_starts, token_counts
from sheaf.llm.lookalike import to_codes
from sheaf.session import tokenizer_dir

PATH = f"{tokenizer_dir()}/{VOCABULARY}"


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(PATH).read_bytes().splitlines())}
    public = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return Encoder(PATH), tiktoken.Encoding("test", pat_str=public, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(both):
    own, other = both
    random.seed(5)
    parts = ["a", "b", " ", "  ", "\n", "é", "中", "🎉", "th", "ing", " the", "1", "23", "'s", "'ll", "'", ".", "aaaa", "‍", "\xa0", "ABC", "<|endoftext|>"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 50))) for _ in range(4000)] + ["a" * 30_000, "中文" * 5000, " " * 9999, "ab" * 7777, "\x00\x01"]
    for text in texts:
        made = own.encode(text)
        assert made == other.encode_ordinary(text)
        assert own.decode(made).decode() == text
    flat, count = own.encode_all(pa.array([None, "", *texts, None], pa.string()))
    assert flat.tolist() == [i for t in texts for i in other.encode_ordinary(t)]
    assert count.tolist() == [0, 0, *(len(other.encode_ordinary(t)) for t in texts), 0]


def test_pieces_of_a_batch(both):
    """Cut as the pattern cuts, whatever stands beside what; also where one text ends as the next begins."""
    own, _ = both
    random.seed(8)
    parts = [" ", " ", "\n", "\t", "\u3000", "'", "'", "s", "ll", "ve", "re", "d", "x", "r", "v", "l", "S", "7", "٣", "½", "!", "\u2019", "é", "中", "\u0301", "\x85", "\x1c", "🎉", "_"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(20_000)]
    codes, bounds = to_codes(pa.array(texts))
    start = piece_starts(codes, bounds)
    assert [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(start, [*start[1:], len(codes)])] == [w for t in texts for w in own.split.findall(t)]


def test_two_pieces_of_one_hash(both, monkeypatch):
    own, other = both
    monkeypatch.setattr(bpe, "hashed", lambda codes, start, end: (end - start).astype("uint64"))
    texts = ["abc def", "xyz", None, "abc xyz"]
    flat, count = own.encode_all(pa.array(texts, pa.string()))
    assert flat.tolist() == [i for t in texts if t for i in other.encode_ordinary(t)] and count[2] == 0


def test_pieces_are_what_merging_gives(both):
    own, _ = both
    random.seed(6)
    for _ in range(500):
        raw = bytes(random.choice(b"aehinorst \xe4\xb8\xad\xe6\x96\x87") for _ in range(random.randint(1, 24)))
        assert own.piece(raw.decode("latin-1")) == own.merged(raw)
    assert own.decode([]) == b"" and PATTERN


def own_text(token):
    return Encoder(PATH).parts[token].decode("utf-8", "replace")


def test_queries(spark, both):
    _, other = both
    data = "/root/testdata/sf0.001"
    got = {r.doc_id: r.ids for r in ids(spark, data).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert got == {d: other.encode_ordinary(t) if t else [] for d, t in texts.items()} and None in texts.values()
    larger = "/root/testdata/sf0.01"  # every document of it, by the library that replays merges
    rows = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang", "source", "text").collect()
    want = {r.doc_id: other.encode_ordinary(r.text) if r.text else [] for r in rows}
    assert {r.doc_id: r.ids for r in ids(spark, larger).collect()} == want and len(want) == len(rows)
    counts = Counter()
    for r in rows:
        for n, k in ((1, 0), (len(want[r.doc_id]), 1), (len(r.text or ""), 2)):
            counts[r.lang, r.source, k] += n
    for r in token_counts(spark, larger).collect():
        assert (r.n_docs, r.n_tokens, r.n_chars or 0, r.round_trip) == (*(counts[r.lang, r.source, k] for k in range(3)), True)
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id long, text string, ids string").drop("ids")
    made = encode_texts(rows).withColumn("back", decode_column(PATH)("ids"))
    assert sorted((r.doc_id, r.ids, r.back) for r in made.collect()) == [(1, [], ""), (2, [], ""), (3, [64, 275], "a b"), (3, [64, 275], "a b")]
    assert encode_texts(rows.limit(0)).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([64],), ([9673, 64],), ([447],)], "ids array<int>")  # the last one is half a character
    assert [r[0] for r in odd.select(decode_column(PATH)("ids")).collect()] == [None, "", "a", own_text(9673) + "a", "\ufffd"]
