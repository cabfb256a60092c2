"""Personal data, secrets and quality rules against plain regular expressions and counts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from snapline.llm import pii, quality, secret_scan


def luhn(digits):
    odd = [int(c) for c in digits[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= sum(c.isdigit() for c in s) <= 15),
}


def plain_spans(text):
    return [
        (k, *m.span()) for k, (p, good) in PLAIN.items() for m in re.finditer(p, text or "") if good(m.group())
    ]


def personal_texts():
    draw = random.Random(2)
    texts = [
        None, "", "a.b@c.de@f.g.h", "x@@y.z a@b a@b.c.", "10.0.0.256 1.2.3.4.5 001.002.003.004", "4111 1111 1111 1111",
        "4111-1111-1111-1111 and 5500000000000004", "+1 (234) 567-8901 +123 +49 30 1234567", "é" * 9 + " a@b.co",
        "call +1(((((((((((((", "9" * 5000, "a" * 5000, "\U0001f600 x@y.zz",
    ]
    for _ in range(3000):
        texts.append("".join(draw.choice("a.@-+ 1234(5)6é") for _ in range(draw.randint(0, 60))))
    return texts


def test_base_spans_are_those_of_the_patterns():
    for text in personal_texts():
        assert [x[:3] for x in pii.find(text) if x.kind in pii.BASE_KINDS] == plain_spans(text), text


def test_checksums_and_words_nearby_decide_added_spans():
    kinds = lambda t: [x.kind for x in pii.find(t)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("iban GB83 WEST 1234 5698 7654 32.") == []
    assert kinds("SSN: 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("amex card 378282246310005") == ["account"]
    assert kinds("example card 378282246310005") == []


def test_personal_data_in_spark(spark):
    texts = personal_texts()[:200]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip int")
    for r in pii.personal_data(docs).collect():
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in PLAIN]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in base).encode()).hexdigest()
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()}[2] == "<email>@f.g.h"
    assert clean.where("text is null").count() == 1


SECRETS = {
    "assign": (r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}


def secret_spans(text):
    found = [
        (m.start(), i, m.end(), k)
        for i, (k, (p, g, least)) in enumerate(SECRETS.items())
        for m in re.finditer(p, text or "", re.A)
        if len(m.group(g)) >= least
    ]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_base_secrets_are_those_of_the_patterns(spark):
    draw = random.Random(4)
    texts = [None, "", "secret=token:abcdefgh", "Password = 'hunter22'", "AKIA" + "A1" * 9, "AKIAAKIA" + "A" * 20, "é\U0001f600 api_key:" + "0a" * 20, "ab" * 5000]
    words = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "abc", "123456", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "é", "x."]
    texts += ["".join(draw.choice(words) for _ in range(draw.randint(0, 15))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "s%d" % (i % 3), "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, hash string")
    rows = secret_scan.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = secret_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in SECRETS]
        assert set(base) <= set(r.spans.split(","))


def test_owners_tell_live_secrets_from_examples(spark):
    key = "ghp_" + "Ab1" * 12
    rows = [(i, f"use {key} here", f"repo{i}") for i in range(5)] + [(9, "use ghp_" + "Zz9" * 12, "repo1"), (10, "ghp_" + "Yy8" * 12, None)]
    found = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [found[i].spans for i in range(5)] == [""] * 5
    assert found[9].spans == "prefixed:4:44" and found[9].n_live == 1
    assert found[10].n_live == 1


def test_copies_of_one_owner_stay_live(spark):
    mine, spread = "glpat-" + "Qw3" * 8, "sk_live_" + "Er5" * 8
    rows = [(i, f"{mine} {mine}", "repo1") for i in range(30)] + [(100 + i, spread, f"repo{i % 2}") for i in range(4)]
    rows += [(200, f"password = {mine}", "repo1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert all(found[i].spans == "prefixed:0:30,prefixed:31:61" and found[i].n_live == 2 for i in range(30))
    assert all(found[100 + i].spans == "" for i in range(4))
    assert (found[200].n_live, found[200].n_example) == (2, 0)
    nobody = docs.selectExpr("doc_id", "text", "source", "cast(null as string) nobody")
    found = {r.doc_id: r for r in secret_scan.scan(nobody, owner="nobody").collect()}
    assert found[0].n_live == 2 and found[100].spans == ""


def test_no_python_in_the_secret_scan(spark):
    docs = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    plan = secret_scan.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_metrics_by_hand_and_by_chance():
    draw = random.Random(6)
    texts = [None, "", " \n ", "a b c a b c\nx\nx\n \n", "a a a a", "é\x85é\xa0 x", "x\x1cy"]
    texts += ["".join(draw.choice("ab  \n\t#é") for _ in range(draw.randint(0, 80))) for _ in range(800)]
    for text in texts:
        assert quality.measure(text)[:5] == plain_metrics(text), text


def test_binomial_bound_is_exact():
    from math import comb

    for n, p in ((1, 0.3), (20, 0.05), (60, 0.5)):
        for k in range(n + 1):
            assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoff_stops_at_the_first_that_fails():
    n = len(quality.GRID)
    above = [0] * 5 + [50] * (n - 5)
    assert quality.choose_cutoff(above, 1000, [10] * n, 0.01, 0.01) == quality.GRID[0]
    assert quality.choose_cutoff(above, 1000, [10, 20, 30, 40, 50] + [900] * (n - 5), 0.01, 0.01) == quality.GRID[4]
    assert quality.choose_cutoff([0] * n, 20, [5] * n, 0.01, 0.01) is None
    assert quality.choose_cutoff([0] * n, 1000, [0] * n, 0.01, 0.01) is None


def test_rules_reject_bad_and_spare_good(spark):
    draw = random.Random(8)
    prose = lambda: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(60))
    rows = [(i, prose(), "en") for i in range(1500)] + [(i, prose().replace(" ", "### "), "en") for i in range(1500, 1700)]
    rows += [(3000, None, None), (3001, "", "xx"), (3002, prose(), None), (3003, prose().replace(" ", "### "), "zz"), (3002, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1700)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = {}
    for r in quality.judge(docs, labels, false_reject=0.06).collect():
        kept.setdefault(r.doc_id, set()).add(r.kept)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert all(kept[i] == {True} for i in range(1500)) and all(kept[i] == {False} for i in range(1500, 1700))
    assert (kept[3000], kept[3001], kept[3002], kept[3003]) == ({False}, {False}, {True}, {True})
    stays = quality.filtered(docs, labels, false_reject=0.06)
    assert stays.columns == docs.columns and stays.count() == 1500 + 3
    assert quality.judge(docs, labels.limit(0)).where("kept").count() == 1700 + 3


def test_few_labels_are_enough_with_the_production_parameters(spark):
    draw = random.Random(9)
    prose = lambda: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(60))
    junk = lambda: prose().replace(" ", " # ", 30)
    rows = [(i, prose(), lang, 1) for lang, at, n in (("en", 0, 700), ("de", 1000, 500), ("es", 2000, 40)) for i in range(at, at + n)]
    rows += [(5000 + i, junk(), lang, 0) for i, lang in enumerate(["en", "de", "es"] * 20)]
    rows += [(6000 + i, junk(), lang, None) for i, lang in enumerate(["en", "de", "es"] * 20)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[3] is not None], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert [kept[i] for i, *_ in rows if i >= 5000] == [False] * 120
    for lang, n in (("en", 700), ("de", 500), ("es", 40)):
        assert sum(not kept[i] for i, _, of, good in rows if of == lang and good) <= 0.012 * n


def test_all_rules_have_one_budget():
    assert quality.needed(0.012, 0.05) == 249 and quality.needed(0.012, 0.0125) == 363
    assert quality.families({"en": 2000, "de": 400, "es": 300}, 0.012, 0.05) == (["en", "de"], True, 0.05 / 3)
    assert quality.families({"en": 2000, "de": 400}, 0.012, 0.05) == (["en", "de"], False, 0.025)
    assert quality.families({"en": 150, "de": 110}, 0.012, 0.05) == ([], True, 0.05)
    assert quality.families({"en": 100}, 0.012, 0.05)[:2] == ([], False)
    # Four rejections of each of two steps pass alone but not together.
    assert quality.binomial_cdf(4, 1000, 0.012) <= 0.01 < quality.binomial_cdf(8, 1000, 0.012)
    assert quality.accepted([4, 996], [50, 0], 0.012, 0.01) == 1
    assert quality.accepted([4, 4, 0, 992], [50, 50, 50, 0], 0.012, 0.01) == 1
    n = len(quality.GRID)
    free, dear = [0.0] * n, [float(i) for i in range(n)]
    steps = quality.path({"a": [9.0] * n, "b": [5.0] * 3 + [80.0] * (n - 3)}, {"a": free, "b": [0.0, *dear[:-1]]})
    assert steps[0] == ("a", 0) and ("b", 3) in steps and all(i <= 3 for _, i in steps)


def test_places_agree_with_the_verdict_on_the_grid(spark):
    scores = [0.0, 0.01, 0.2, 0.5, 0.75, 0.8, 0.81, 1.0, 1.5, *(i / 40 for i in range(41))]
    rows = spark.createDataFrame([(x,) for x in scores], "score double").select("score", quality._place(F.col("score")).alias("place"))
    for r in rows.collect():
        assert [r.score > cutoff for cutoff in quality.GRID] == [i >= r.place for i in range(len(quality.GRID))], r


def test_bad_documents_on_a_grid_point_are_rejected(spark):
    draw = random.Random(10)
    words = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(n)]
    rows = [(i, " ".join(words(60)), "en", 1) for i in range(500)]
    rows += [(1000 + i, " ".join(w + "#" * (k % 2) for k, w in enumerate(words(60))), "en", 0) for i in range(50)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] for i in range(500)) and not any(kept[1000 + i] for i in range(50))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pii.personal_data(docs).count() == pii.redacted(docs).count() == secret_scan.scan(docs).count() == 0
    assert quality.judge(docs, labels).count() == quality.filtered(docs, labels).count() == 0


def test_words_nearby_move_the_score_of_every_kind():
    for kind, value, word in (
        ("email", "a.b@example.org", "mail: "), ("ip", "10.0.0.1", "server "), ("card", "4111 1111 1111 1111", "visa "), ("phone", "+49 30 1234567", "phone "),
    ):
        plain, near, doubtful = (pii.find(x + value)[0] for x in ("it is ", word, "sample " if kind != "email" else "version "))
        assert {plain.kind, near.kind, doubtful.kind} == {kind}
        assert near.score > plain.score > doubtful.score >= 0, kind
    row = pii._row("mail: a@b.de, server 10.0.0.1")
    assert row[5] == "email:6:12,ip:21:29" and row[6] == "1.0,0.7" and row[7] == pytest.approx(0.7)
