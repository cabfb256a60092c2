"""Encoding, counting and packing against the public tokenizer libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from snapline.llm import bpe, packing, token_count

PATTERN = public_tokenizers.PATTERN
RANKS, FILE = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))


def hard_texts():
    draw = random.Random(7)
    texts = [
        "", "a", " ", "  ", "\n\n x", "  a b  c \n d  ", "'s 's'll ''s don't I'LL 'reX", "'s\n\nb", "a" * 3000, "ab" * 700,
        "日本語 テスト", "  x\x1c y", "x \x85 y", "é" * 100, "\x00\x01 \x02", "123 4567 ½²", "!!! ...'re", " " * 500,
        "\t\t x\t y \t", "x<|endoftext|> y", "<|endoftext|><|endoftext|>a  <|endoftext|>", "\U0001f600 \U00020000x",
    ]
    for _ in range(1500):
        texts.append("".join(draw.choice("ab''srtevlmd  \n\t.1é　\x1c!") for _ in range(draw.randint(0, 40))))
    for _ in range(60):
        texts.append("".join(draw.choice("thenaioustr") for _ in range(draw.randint(0, 2000))))
    return texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_encoding_is_that_of_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.Merges.read(RANKS), PATTERN)
    texts = hard_texts()
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
            assert encoder.decode(ids) == text.encode()


def test_words_beyond_the_memory_are_encoded_alike(monkeypatch):
    whole = bpe.Encoder(bpe.Merges.read(RANKS), PATTERN)
    monkeypatch.setattr(bpe, "MEMORY", 5)
    small = bpe.Encoder(whole.merges, PATTERN)
    texts = hard_texts()[:200]
    assert [small.encode([t]) for t in texts] == [whole.encode([t]) for t in texts]


def test_long_and_short_pieces_merge_alike():
    merges = bpe.Merges.read(RANKS)
    draw = random.Random(1)
    pieces = ["".join(draw.choice("thearin") for _ in range(draw.randint(2, 64))).encode() for _ in range(300)]
    assert merges.merge(pieces) == {p: bpe.as_bytes(merges.merge_long(p)) for p in pieces}


def test_counts_are_those_of_the_library(library):
    counter = token_count.Counter(bpe.Merges.read(FILE))
    texts = hard_texts()
    expected = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == expected
    assert [counter.count([t])[0] for t in texts[:300]] == expected[:300]
    assert counter.count([None, "", "x"]) == [0, 0, 1]


def test_counts_survive_new_tables_and_small_chunks(library, monkeypatch):
    monkeypatch.setattr(token_count, "CHUNK", 7)
    monkeypatch.setattr(token_count, "MOST_STATES", 50)
    counter = token_count.Counter(bpe.Merges.read(FILE))
    texts = hard_texts()[:400]
    expected = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [n for t in range(0, 400, 20) for n in counter.count(texts[t : t + 20])] == expected


@pytest.mark.parametrize("chunk, look", [(7, 0), (16, 3), (64, 64)])
def test_counts_within_long_pieces(library, monkeypatch, chunk, look):
    """Guesses of the entry state that are often wrong, and pieces over very many chunks."""
    monkeypatch.setattr(token_count, "CHUNK", chunk)
    monkeypatch.setattr(token_count, "LOOK", look)
    rng = random.Random(chunk)
    counter = token_count.Counter(bpe.Merges.read(FILE))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 400))) + " ab " * rng.randint(0, 3) for _ in range(80)]
    texts += ["the" * 700 + " and " + "x" * 900, "aé" * 500, "0123456789" * 90]
    assert counter.count(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_a_megabyte_without_a_break(library):
    rng = random.Random(4)
    counter = token_count.Counter(bpe.Merges.read(FILE))
    long = "".join(rng.choice(["tion", "the", "ing", "er", "an", "on", "ly", "re"]) for _ in range(400_000))
    odd = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert counter.count([long, odd]) == [len(library.encode(t, add_special_tokens=False).ids) for t in (long, odd)]


def test_scan_composes_maps_in_order():
    maps = [{"a": ("b", 1)}, {"b": ("a", 2), "c": ("c", 9)}, {"a": ("c", 3), "c": ("a", 4)}, {"c": ("b", 5), "a": ("a", 1)}, {"b": ("c", 7)}]
    got = token_count.prefixes(maps)
    assert [m["a"] for m in got] == [("b", 1), ("a", 3), ("c", 6), ("b", 11), ("c", 18)]


DOCS = "doc_id long, text string, ids string, n_tokens int, window string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(texts)], DOCS)


def test_round_trip_in_spark(spark):
    texts = [None, "", "one two", "one two", "日本 " * 300, "z" * 20_000]
    tokens = bpe.decode(bpe.encode(frame(spark, texts), RANKS, PATTERN), RANKS, PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in tokens} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.n_tokens * 4 == len(r.ids) for r in tokens)


def test_counts_in_spark(spark):
    rows = token_count.count_tokens(frame(spark, [None, "", "one two", "é " * 600]), FILE).collect()
    assert {(r.doc_id, r.n_bytes) for r in rows} == {(0, 0), (1, 0), (2, 7), (3, 1800)}
    assert [r.over_limit for r in sorted(rows)] == [False, False, False, True]


@pytest.mark.parametrize("open_windows", [1, 4])
def test_packing_keeps_every_id_once(spark, library, open_windows):
    draw = random.Random(3)
    texts = [None, "", "", "a <|endoftext|> b"] + [" ".join("w%d" % draw.randint(0, 99) for _ in range(draw.randint(0, 400))) for _ in range(150)]
    size = 256
    rows = packing.pack(frame(spark, texts).repartition(5), FILE, PATTERN, size, open_windows=open_windows).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    if open_windows == 4:
        assert sum(r.length for r in rows) > 0.9 * size * len(by_sequence)


def test_merging_of_open_windows_over_many_tasks(spark):
    draw = random.Random(5)
    units = [((task << packing.TASK_BITS) + i, draw.randint(1, 99)) for task in range(300) for i in range(3)]
    found = packing.merge_windows(spark.createDataFrame(units, "unit long, fill int"), 100).collect()
    fills, spans = dict(units), defaultdict(list)
    assert sorted(r.unit for r in found) == sorted(fills)
    for r in found:
        spans[r.sequence_id].append((r.base, fills[r.unit]))
    for parts in spans.values():
        at = 0
        for base, fill in sorted(parts):
            assert base == at
            at += fill
        assert at <= 100


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bpe.decode(bpe.encode(none, RANKS, PATTERN), RANKS, PATTERN).count() == 0
    assert token_count.count_tokens(none, FILE).count() == 0
    assert packing.pack(none, FILE, PATTERN).count() == 0


def test_digest_of_ids(spark):
    row = bpe.encode(frame(spark, ["hello"]), RANKS, PATTERN).selectExpr("sha2(ids, 256) as s").first()
    assert row.s == hashlib.sha256(np.array([31373], "<u4").tobytes()).hexdigest()
