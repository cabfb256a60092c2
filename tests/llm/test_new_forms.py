"""Spelling variants, token files and centroid rounds against brute force, and the registered queries against libraries."""

import hashlib
import json
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from snapline.llm import centroids, id_batches, packing, queries, spelling, token_files

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
given = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


# Spelling variants


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, factor=5):
    """Every pair of words that share a form with one letter less, or differ in one place, compared."""
    near = {w: set() for w in counts}
    cut = {}
    for w in counts:
        for i in range(len(w)):
            cut.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            if w[:i] + w[i + 1 :] in near:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in cut.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-counts[x], x)) if around else None
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("most", [40, 8192])
def test_variants_match_pairs(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(900)}
    words |= {"abcabc" + x * 70 for x in "abc"} | {"abcabc" + "a" * 70 + x for x in "bcd"}  # beyond short words
    counts = {w: rng.choice([5, 6, 7, 30, 200, 2000]) for w in words}
    assert any(one_apart(a, b) for a in sorted(words)[:50] for b in sorted(words)[:50])
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(df, most=most)) == plain_variants(counts)


def plain_counts(docs, every):
    total = Counter()
    for key, text in docs:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def test_words_of_odd_rows(spark):
    text = "Éclair ÉCLAIR éclairs größer×größer a÷b don't ZZZZZZ zzzzzz "
    docs = [(1, text * 5), (1, text * 5), (2, None), (None, "seventh " * 6), (3, ""), (4, "x" * 70_000), (5, "日本 letters " * 6)]
    rows = [(k, t, "a", "b", 1) for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n string, shard int")
    for every in (7, 199):
        got = {r["word"]: r["n"] for r in spelling.word_counts(df, flaw_every=every).collect()}
        want = plain_counts([("" if k is None else k, t) for k, t in docs], every)
        assert got == want and want
    empty = spelling.variants(spelling.word_counts(df.limit(0)))
    assert empty.collect() == []


@given
def test_registered_spelling(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op11_spelling(spark, SF)) == plain_variants(plain_counts(docs, 199))


# Token files


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_words_hold_any_numbers(block):
    rng = np.random.default_rng(block)
    kinds = [
        rng.integers(0, 50257, 3000), np.zeros(1500, int), rng.integers(0, 2, 700), rng.integers(0, 1 << 62, 500),
        rng.choice([0, 1, (1 << 60) - 1, 1 << 60, (1 << 63) + 5], 900), np.repeat(rng.integers(0, 1 << 40, 30), 40), np.zeros(0),
    ]
    for values in kinds:
        values = values.astype(np.uint64)
        words, first = token_files.pack(values, block)
        assert (token_files.unpack(words) == values).all() and len(first) == -(-len(values) // block)
        segment = token_files.Segment(token_files.write_segment([None, -5, 1 << 62], np.array([len(values), 0, 0]), values, block))
        assert segment.keys == [None, -5, 1 << 62] and segment.lengths.tolist() == [len(values), 0, 0]
        for k in range(len(first)):
            assert (segment.of_block(k) == values[k * block : (k + 1) * block]).all()


def test_damaged_segments_are_told():
    data = bytearray(token_files.write_segment([1], np.array([3]), np.array([1, 2, 3])))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.Segment(bytes(data))


def by_library(library, docs, end=2):
    out, start = [], 0
    for key, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes()
        out.append((key, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_files_of_odd_rows(spark, library, tmp_path):
    docs = [(None, "no key"), (-3, "<|endoftext|> in  text"), (1, ""), (2, None), (3, "long " * 40_000), (4, "same"), (4, "same"), (9, "ü" * 5000)]
    rows = [(k, t, "a", 1, 2) for k, t in docs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, file int, ids int")
    manifest = token_files.write(df, JSON, PATTERN, folder=f"file://{tmp_path}/ids", segment=1000, block=64)
    back = token_files.read(manifest, with_ids=True)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in back.collect()), key=lambda r: r[1])
    assert got == by_library(library, docs)
    names = manifest.select("file").distinct().collect()
    assert all(os.path.exists(r["file"]) for r in names) and len(names) > 1
    for r in back.collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
    assert token_files.read(token_files.write(df.limit(0), JSON, PATTERN)).collect() == []


@given
def test_registered_token_files(spark, library):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = queries.op12_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == by_library(library, docs)


def test_batches_of_ids_are_the_librarys(library):
    rng = random.Random(2)
    parts = [" ", "  ", "a", "'s", "\n", "\t", "é", "1", "!", "<|endoftext|>", " ", "日", "🙂", "the", "\x1c", "\r\n"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    ids, places = id_batches.BatchEncoder(JSON, PATTERN).encode(texts)
    for text, a, b in zip(texts, places, places[1:]):
        assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_a_vocabulary_in_another_order(tmp_path):
    """Ids that don't follow the merges, as a file may have them."""
    with open(JSON, encoding="utf-8") as f:
        file = json.load(f)
    vocab = file["model"]["vocab"]
    file["model"]["vocab"] = {t: i if i > 50000 else 50000 - i for t, i in vocab.items()}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    texts = ["The quick brown fox, it's 42!", "größere Zahlen  und\n\nmehr"]
    ids, places = id_batches.BatchEncoder(str(path), PATTERN).encode(texts)
    other = Tokenizer.from_file(str(path))
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [other.encode(t).ids for t in texts]


@given
def test_registered_packing(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = queries.op9_packing(spark, SF).collect()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in docs.items()}
    for r in pieces:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    assert len(packing.Windows(8, 2, 0).rooms) == 0


# Centroid rounds


def plain_rounds(rows, clusters, rounds, dims, scale=1024, seed=3):
    kept = {}
    for key, x in rows:
        if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) for v in x):
            kept[key] = [int(np.floor(scale * float(v))) for v in x]
    order = sorted(kept, key=lambda k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest())
    centres = [kept[k] for k in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        sets = [[] for _ in centres]
        for v in kept.values():
            sets[nearest(v)[1]].append(v)
        centres = [[sum(col) // len(s) for col in zip(*s)] if s else c for s, c in zip(sets, centres)]
    near = {k: nearest(v) for k, v in kept.items()}
    own = Counter()
    for d, i in near.values():
        own[i] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return {(k, i, d, own[i], sum(own.values()), names[i]) for k, (d, i) in near.items()}


def clustered(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("clusters, spread", [(8, 3.0), (20, 0.004), (3, 100.0)])
def test_rounds_match_plain_ones(spark, clusters, spread):
    rng = np.random.default_rng(clusters)
    rows = [(i, [float(v) for v in rng.choice([-1, 0, 1, 0.5], 6) * spread]) for i in range(400)]  # many ties and repeats
    rows += [(900, None), (901, [1.0] * 5), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [1.0, float("nan")] * 3), (904, [float("inf")] * 6)]
    df = spark.createDataFrame([(k, x, "a", 1) for k, x in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    got = clustered(centroids.cluster(df, clusters, 6, 6))
    assert len(got) == 400 and set(got) == plain_rounds(rows, clusters, 6, 6)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert set(clustered(centroids.cluster(spark.createDataFrame(rows, schema), 8, 3, 2))) == plain_rounds(rows, 8, 3, 2)
    none = centroids.cluster(spark.createDataFrame([(1, None)], schema), 8, 3, 2)
    assert none.collect() == [] and none.columns == centroids.cluster(spark.createDataFrame(rows, schema), 8, 3, 2).columns
    repeated = clustered(centroids.cluster(spark.createDataFrame([*rows, rows[0], (None, [9.0, 9.0])], schema), 1, 3, 2))
    assert len(repeated) == 4 and sum(k is None for k, *_ in repeated) == 1
    with pytest.raises(Exception, match="vector 7"):
        centroids.cluster(spark.createDataFrame([(7, [1e30, 0.0])], schema), 8, 3, 2)


def test_tree_leaves_centroids_out():
    rng = np.random.default_rng(5)
    centres = np.concatenate([rng.integers(-9, 9, (30, 8)) + 1000 * i for i in range(4)])
    centres[7] = centres[3]  # equal centroids: the smaller number
    tree = centroids.VantageTree(centres)
    vectors = centres[rng.integers(0, len(centres), 500)] + rng.integers(-2, 3, (500, 8))
    which, squared, measured = tree.nearest(vectors)
    every = ((vectors[:, None] - centres) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (squared == every.min(1)).all()
    assert measured < 0.6 * every.size
