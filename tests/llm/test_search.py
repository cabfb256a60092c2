"""Near duplicates, repeated strings, top-k search and languages against brute force; the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from snapline.llm import components, language_id, simhash, substrings, topk


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    x = np.array(prints, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_segment_counts_bound_the_bits():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 2**64, (2, 1000), np.uint64)
    bound = np.bitwise_count(simhash.segment_counts(a) ^ simhash.segment_counts(b))
    by_hand = [sum(abs((int(x) >> i & 3).bit_count() - (int(y) >> i & 3).bit_count()) for i in range(0, 64, 2)) for x, y in zip(a, b, strict=True)]
    assert bound.tolist() == by_hand and (bound <= np.bitwise_count(a ^ b)).all()


def test_fingerprints_by_hand():
    draw = random.Random(1)
    for text in [None, "", " \n", "A", "a B", "É x Y z\x85"] + [" ".join(draw.choice("abcXYZ") for _ in range(draw.randint(0, 40))) for _ in range(200)]:
        assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("cell_limit", [100, 50_000])
def test_groups_are_those_of_all_pairs(spark, cell_limit):
    draw = random.Random(3)
    centre, prints = draw.getrandbits(64), {0, 1, 7}
    for _ in range(700):
        v = centre
        for _ in range(draw.randint(0, 4)):
            v ^= 1 << draw.randrange(64)
        prints.add(v)
        v = draw.getrandbits(64)
        prints.add(v)
        for b in draw.sample(range(64), draw.randint(0, 5)):
            v ^= 1 << b
        prints.add(v)
    prints = list(prints)
    table = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(prints)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(table, cell_limit).collect()}
    assert [got[signed(v)] for v in prints] == roots(prints)


def test_near_duplicates_with_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text, 1), (3, text + " end", 2), (9, "other thing entirely", 3), (None, text, 4), (7, None, 5), (8, "", 6), (9, "other thing entirely", 7), (None, "lonely words here now", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    group = {(r.doc_id, r.fingerprint): r.component_id for r in found}
    assert group[(7, "0" * 16)] == group[(8, "0" * 16)] == 7
    assert group[(None, f"{plain_print(text):016x}")] in (3, 5)
    assert group[(None, f"{plain_print('lonely words here now'):016x}")] is None
    stays = simhash.deduplicated(docs)
    assert stays.columns == docs.columns
    kept = [r.doc_id for r in stays.collect()]
    assert kept.count(9) == 1 and kept.count(7) == 1 and 8 not in kept and kept.count(None) == 1


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (None, 3), (7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def plain_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mask = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(r, mask, strict=True) if not m)
        out.append((len(r), sum(mask), sum(m and not p for p, m in zip(b"\0" + mask, mask, strict=False)), kept))
    return out


def repeated_texts():
    draw = random.Random(5)
    words = lambda n: " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 8))) for _ in range(n))
    passages = [words(draw.randint(10, 60)) for _ in range(25)]
    texts = []
    for _ in range(200):
        parts = []
        for _ in range(draw.randint(1, 5)):
            p = draw.choice(passages) if draw.random() < 0.6 else words(draw.randint(0, 60))
            p = p[draw.choice([0, draw.randint(0, 60)]) : len(p) - draw.choice([0, draw.randint(0, 60)])]
            if p and draw.random() < 0.3:
                k = draw.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts.append(p)
        texts.append(draw.choice(["", " ", "é"]).join(parts))
    return texts + ["a" * 500, "a" * 200, "a" * 199, "ab" * 300, "", None, texts[0], texts[0], "x" * 201, "abc\0" * 99 + "q" + "abc\0" * 99]


@pytest.mark.parametrize("length", [200, 64])
def test_removed_bytes_are_those_of_all_strings(spark, length):
    texts = repeated_texts()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, key string, place int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.without_repeats(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removed(texts, length)


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 300)
    texts = repeated_texts()[:60]
    for text in texts:
        raw = text.encode()
        starts = [i for part in substrings.anchors(raw, 200) for s, e in zip(part[1], part[2], strict=True) for i in range(s, e + 1)]
        assert starts == list(range(max(0, len(raw) - 199)))


def test_multikey_quicksort_sorts_rows():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 3, (500, 6), np.uint64)
    assert words[substrings.multikey_quicksort(words)].tolist() == sorted(words.tolist())


def test_repeated_rows_and_missing_ids(spark):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(400))
    docs = spark.createDataFrame([(1, text, None), (1, text, "b"), (None, "short é", "c"), (4, None, "d")], "doc_id long, text string, kept string")
    rows = substrings.without_repeats(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 400), (1, 400), (4, 0)]
    clean = substrings.cleaned(docs)
    assert clean.columns == docs.columns
    assert sorted((r.kept or "", r.text) for r in clean.collect() if r.text is not None) == [("", ""), ("b", ""), ("c", "short é")]


def test_top_k_is_that_of_all_products(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(0, 0.2, (700, 16)).round(2)
    vectors[::7] = vectors[0]
    rows = [(i * 2, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(100, None, "y"), (150, [1.0, None], "y"), (200, [float("nan")] * 16, "y"), (250, [float("inf")] * 16, "y"), (None, vectors[1].tolist(), "y"), (2, vectors[1].tolist(), "y"), (5000, [0.5], "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _row string").repartition(3)
    got = {}
    for r in topk.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(k, np.floor(np.array(v) * 256).astype(int)) for k, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    asked = [(i, k, v) for i, (k, v) in enumerate(good) if k is not None and k % 50 == 0 and len(v) == 16]
    assert set(got) == {k for _, k, _ in asked}
    for i, k, v in asked:
        scored = sorted((-int(v @ w), key is None, key or 0) for j, (key, w) in enumerate(good) if j != i and len(w) == 16)
        assert [(s, key) for _, key, s in sorted(got[k])] == [(-s, None if none else key) for s, none, key in scored[:5]]


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert topk.search(spark.createDataFrame([], kind)).count() == 0
    assert topk.search(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    assert [tuple(r) for r in topk.search(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], kind)).collect()] == [(0, 1, 1, -65536)]


def test_vectors_beyond_32_bits_are_an_error(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, float("nan")]), (2, [float("inf"), 1.0]), (3, None), (4, [8e6, -8e6]), (5, [2.0, None])]
    schema = "vec_id long, embedding array<double>"
    found = topk.whole_numbers(spark.createDataFrame(rows, schema), "vec_id", "embedding", 256).collect()
    assert sorted(r._key for r in found) == [0, 4]
    for x in (8388608.0, -9e6, 1e300, 1e307):
        with pytest.raises(Exception, match="the vector of key 7 holds"):
            topk.search(spark.createDataFrame([*rows, (7, [x, 0.0])], schema))


def test_exact_products_of_large_numbers():
    a = np.array([[2**31 - 1, -(2**31)]])
    assert topk.product(a, a).tolist() == [[(2**31 - 1) ** 2 + 2**62]]


def test_languages_are_told_apart(spark):
    draw = random.Random(9)
    sounds = {"aa": "bcd aou", "bb": "fgh eiy", "cc": "klm öüa"}
    rows = []
    for i in range(600):
        lang = draw.choice(list(sounds))
        rows.append((i, "".join(draw.choice(sounds[lang]) for _ in range(draw.randint(30, 200))), lang))
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.fit(language_id.held_out(docs).where("not held_out"))
    found = {r.doc_id: r for r in language_id.predict(language_id.held_out(docs), model, ("doc_id", "held_out")).collect()}
    tested = [(i, lang) for i, _, lang in rows if found[i].held_out]
    assert len(tested) > 80 and sum(found[i].lang_pred == lang for i, lang in tested) > 0.98 * len(tested)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_all_languages_are_learnt_from_rows_without_repeats(spark):
    letters = [chr(0x4E00 + i) for i in range(1400)]
    rows = [(20 * c + i, " ".join(letters[20 * c : 20 * c + 20]) + f" {i}", f"l{c:02}") for c in range(70) for i in range(3)]
    docs = spark.createDataFrame(rows + [(9000, rows[0][1], "l00")] * 300, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 70
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert all(found[i] == lang for i, _, lang in rows)

    same = [("1", "some words", "en")] * 500 + [("1", "some words", "fr"), ("2", "other words", "en")]
    sample = language_id.sample(spark.createDataFrame(same, "doc_id string, text string, lang string"), 2, language_id.Settings())
    assert sorted((r.doc_id, r.lang) for r in sample.collect()) == [("1", "en"), ("1", "fr"), ("2", "en")]


def test_penalties_leave_few_weights():
    draw = np.random.default_rng(4)
    rows = [(np.array([i % 2, 2 + int(draw.integers(500))]), np.array([0.8, 0.6]), i % 2) for i in range(400)]
    weights, temperature = language_id.train(rows, 2, language_id.Settings(l1=0.5))
    assert np.count_nonzero(weights) < 100 and temperature > 0


def test_pipeline_stages(spark):
    draw = random.Random(11)
    prose = lambda n: " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(n))
    shared = prose(60)
    base = prose(200)
    texts = [base, base, base + " end", prose(80) + " " + shared, shared + " " + prose(90), prose(70) + " mail a@b.co " + prose(40), "too short", None, ""]
    docs = spark.createDataFrame([(i, t, None, "s", 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, fp string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "personal_data", "packing"]

    class Reader:
        """The session's reader, but for the labels."""

        def __init__(self):
            self.read = self

        def parquet(self, path):
            return labels

    kept = stages["quality"](Reader(), docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    kept = stages["near_duplicates"](spark, kept, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    kept = stages["repeated_passages"](spark, kept, "")
    found = {r.doc_id: r for r in kept.collect()}
    assert shared not in found[3].text and shared not in found[4].text and found[0].text == base
    assert all(r.n_chars == len(r.text) for r in found.values())
    kept = stages["personal_data"](spark, kept, "")
    assert "<email>" in {r.doc_id: r.text for r in kept.collect()}[5]
    assert kept.columns == docs.columns
    pieces = stages["packing"](spark, kept, "").collect()
    assert {r.doc_id for r in pieces} == {0, 3, 4, 5}
    for stage in list(stages)[1:]:
        assert stages[stage](spark, docs.limit(0), "").count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == simhash.deduplicated(docs).count() == 0
    assert substrings.without_repeats(docs).count() == substrings.cleaned(docs).count() == 0


def plain_ftrl(rows, classes, s):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n = {}, {}

    def weight(c, i):
        zi = z.get((c, i), 0.0)
        if abs(zi) <= s.l1:
            return 0.0
        return -(zi - math.copysign(s.l1, zi)) / ((s.beta + math.sqrt(n.get((c, i), 0.0))) / s.alpha + s.l2)

    for _ in range(s.rounds):
        for at, value, label in rows:
            now = {(c, i): weight(c, i) for c in range(classes) for i in at}
            scores = [sum(now[c, i] * v for i, v in zip(at, value)) for c in range(classes)]
            top = max(scores)
            e = [math.exp(x - top) for x in scores]
            for c in range(classes):
                error = e[c] / sum(e) - (c == label)
                for i, v in zip(at, value):
                    g, before = error * v, n.get((c, i), 0.0)
                    z[c, i] = z.get((c, i), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / s.alpha * now[c, i]
                    n[c, i] = before + g * g
    return {(c, i): weight(c, i) for c, i in z}


def test_training_matches_plain_steps():
    rng = random.Random(11)
    rows = []
    for k in range(60):
        at = sorted(rng.sample(range(40), 9))
        value = [rng.random() + (i % 3 == k % 3) for i in at]
        norm = math.sqrt(sum(v * v for v in value))
        rows.append((np.array(at), np.array(value) / norm, k % 3))
    s = language_id.Settings(l1=0.05, calibrate=0.2)
    full, temperature = language_id.train(rows, 3, s)
    plain = plain_ftrl([(at.tolist(), v.tolist(), c) for at, v, c in rows[:48]], 3, s)
    assert any(w == 0 for w in plain.values())
    assert all(full[c, i] == pytest.approx(w, abs=1e-9) for (c, i), w in plain.items())
    assert np.count_nonzero(full) == sum(w != 0 for w in plain.values())

    def loss(t):
        out = 0.0
        for at, v, label in rows[48:]:
            x = full[:, at] @ v / t
            out -= x[label] - x.max() - math.log(np.exp(x - x.max()).sum())
        return out

    assert loss(temperature) <= min(loss(0.05 * 1.02**i) for i in range(300)) + 1e-4


def test_weights_of_a_text_match_plain_counts(spark):
    texts = ["Der Hund", "the dog and the cat", "", "el perro", None, "the end", "ÄÖ ß " * 9000]  # the last beyond 8,192 n-grams
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.feature: r.n for r in language_id.document_frequencies(df).collect()}
    one = lambda g: int(language_id.grams(g)[0][-1])
    names = {}
    for t in filter(None, texts):
        low = t.lower()
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                names.setdefault(low[i : i + n], None)
    number = {}
    for g in names:
        at, counts = language_id.grams(g)
        shorter = [x for n in range(1, len(g)) for i in range(len(g) - n + 1) for x in [g[i : i + n]]]
        rest = Counter(number[x] for x in shorter)
        number[g] = next(int(a) for a, c in zip(at, counts) if c > rest.get(int(a), 0))
    plain = Counter()
    for t in filter(None, texts):
        low = t.lower()
        plain.update({number[low[i : i + n]] for n in (1, 2, 3) for i in range(len(low) - n + 1)})
    total = found.pop(-1)
    assert total == 5 and found == plain and one("d") == number["d"]
    idf = np.full(language_id.FEATURES, math.log(1 + total))
    for f, n in plain.items():
        idf[f] = math.log((1 + total) / (1 + n)) + 1e-3
    for t in filter(None, texts):
        low = t.lower()
        counts = Counter(number[low[i : i + n]] for n in (1, 2, 3) for i in range(len(low) - n + 1))
        raw = {f: (1 + math.log(c)) * idf[f] for f, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        at, value = language_id.weighted(t, idf)
        assert dict(zip(at.tolist(), value.tolist())) == pytest.approx({f: v / norm for f, v in raw.items()}, abs=1e-9)


def test_languages_beside_clashing_columns_and_a_hot_one(spark):
    rows = [(i, ("the cat and the dog " if i % 10 else "der Hund und die Katze ") * 3 + str(i), "en" if i % 10 else "de", 1, "x", 2.0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, feature int, lang_pred string, score double")
    model = language_id.fit(df, language_id.Settings(per_language=30))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model).collect()}
    assert got == {r[0]: r[2] for r in rows}
    usable = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    sample = language_id.sample(usable, 2, language_id.Settings(per_language=30)).collect()
    draws = {r["doc_id"]: (r["draw"], r["lang"]) for r in usable.withColumn("draw", F.xxhash64("doc_id", "text")).collect()}
    want = [k for c in ("en", "de") for k in sorted((k for k, v in draws.items() if v[1] == c), key=lambda k: (draws[k][0], k))[:30]]
    assert sorted(r["doc_id"] for r in sample) == sorted(want)
