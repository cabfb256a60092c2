"""Quality rules whose cutoffs are chosen with a bound on how many good documents they reject.

Each rule gives a document a score, higher is worse. The rules have one budget together: what is tested is the union
of what they reject. An eighth of the good labels, with the bad ones, lays down a path, an order of steps that each
tighten one rule; the other good labels then take the path from its start, and as they had no part in it, trying many
steps needs no correction (fixed-sequence testing): a step is accepted if an exact binomial test shows, at the corrected
level, that all rules so far reject less than the budget of the good documents, and the first that fails ends the path.
Strata with enough labels are tested by themselves, the others take the cutoffs of all strata pooled; only the tests
that are made share the error level (Bonferroni), which depends on numbers of labels alone.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_text, laid_flat, map_texts, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

#: Scores of the rules, from the metrics of a document with words.
RULES = {
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
    "repeat_word_share": "n_repeat_words / nullif(n_words, 0)",
    "upper_share": "n_upper / nullif(word_chars, 0)",
    "marks_per_word": "n_marks / nullif(n_words, 0)",
    "mean_word_length": "word_chars / nullif(n_words, 0) / 40",
}

#: Cutoffs tried for every rule, from lenient to strict.
GRID = tuple(round(1.0 - i / 40, 3) for i in range(40))

#: One of so many good labels lays down the path, the others test it.
PATH_PART = 8


def measure(text: str | None) -> tuple[int, ...]:
    """The METRICS of one text; null counts as empty. Words are runs of anything but ASCII white space."""
    if not text:
        return (0,) * len(METRICS)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    upper = len(raw) - len(raw.translate(None, UPPER))
    return n, word_chars, symbols, dup_lines, repeated, len(lines), upper, raw.count(b"!")


def document_metrics(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """Columns ``keep`` and the METRICS of every document."""
    empty = [[] for _ in METRICS]
    return map_texts(
        docs,
        keep,
        [(m, "long") for m in METRICS],
        lambda texts: [list(v) for v in zip(*map(measure, texts), strict=True)] or empty,
        with_text,
    )


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed from its largest term."""
    if k >= n:
        return 1.0
    log = lambda i: (
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    )
    top = min(k, int((n + 1) * p))
    total = 0.0
    for run in (range(top, -1, -1), range(top + 1, k + 1)):
        for i in run:
            term = math.exp(log(i))
            total += term
            if term < total * 1e-17:
                break
    return min(1.0, total)


def choose_cutoff(above: list[int], good: int, bad_above: list[int], share: float, level: float) -> float | None:
    """A cutoff of GRID that passes, None if the most lenient fails.

    ``above[i]`` good documents of ``good`` and ``bad_above[i]`` others score above ``GRID[i]``. A cutoff passes if a
    true rejection rate of ``share`` or more would give so few rejections with probability ``level`` at most; that is,
    if the upper Clopper-Pearson bound at that level is below ``share``. Of those that pass it takes the one with the
    largest surplus of bad over good rejections, of equal ones the most lenient; a cutoff without any surplus is none.
    """
    chosen, best = None, 0
    for cutoff, k, bad in zip(GRID, above, bad_above, strict=True):
        if binomial_cdf(k, good, share) > level:
            break
        if bad - k > best:
            chosen, best = cutoff, bad - k
    return chosen


def needed(share: float, level: float) -> int:
    """Good labels of a test that passes at ``level`` if none of them is rejected."""
    return math.ceil(math.log(level) / math.log1p(-share))


def families(good: dict[str, int], share: float, error: float) -> tuple[list[str], bool, float]:
    """Strata tested by themselves, whether the pool is tested, and the level of each test, from numbers of good labels.

    As many strata as have enough labels when all tests share ``error``; the pool is one more test if any is left out.
    """
    by_size = sorted(good, key=lambda s: (-good[s], s))
    for own in range(len(by_size), -1, -1):
        pooled = own < len(by_size)
        level = error / max(1, own + pooled)
        sizes = [good[s] for s in by_size[:own]] + [sum(good.values())] * pooled
        if all(n >= needed(share, level) for n in sizes):
            return by_size[:own], pooled, level
    return [], False, error


def path(gain: dict[str, list[float]], cost: dict[str, list[float]]) -> list[tuple[str, int]]:
    """Steps (rule, place in GRID), each tightening one rule, the most worthwhile first.

    ``gain[rule][i]`` bad and ``cost[rule][i]`` good documents score above ``GRID[i]``. Steps that cost nothing come
    first, those farthest from the first place with a cost before others; then those that gain most for their cost, as
    long as they gain more than they cost.
    """
    steps = []
    for number, rule in enumerate(gain):
        up, down = gain[rule], cost[rule]
        free = sum(c == 0 for c in down)
        at, had = -1, 0.0
        for i in range(free):
            if up[i] > had:
                steps.append((0, i - free, number, i, rule))
                at, had = i, up[i]
        paid, worst = (down[at] if at >= 0 else 0.0), 0.0
        while True:
            # Along the upper hull, so that later steps of a rule never look better than earlier ones.
            ahead = [((down[i] - paid) / (up[i] - had), i) for i in range(max(at + 1, free), len(GRID)) if up[i] > had]
            if not ahead or min(ahead)[0] >= 1:
                break
            worst, at = max(worst, min(ahead)[0]), min(ahead)[1]
            paid, had = down[at], up[at]
            steps.append((1, worst, number, at, rule))
    return [(rule, i) for *_, i, rule in sorted(steps)]


def accepted(good: list[int], bad: list[int], share: float, level: float) -> int:
    """How many steps of a path hold.

    ``good[i]`` and ``bad[i]``: documents that step i is the first to reject, the last entry those never rejected. Of
    the steps before the first that fails, the last with the largest surplus of bad over good rejections.
    """
    n, k, surplus, best, taken = sum(good), 0, 0, 0, 0
    for i, (g, b) in enumerate(zip(good[:-1], bad[:-1], strict=True)):
        k, surplus = k + g, surplus + b - g
        if binomial_cdf(k, n, share) > level:
            break
        if surplus >= best:
            best, taken = surplus, i + 1
    return taken


def cutoffs(
    metrics: DataFrame,
    labels: DataFrame,
    stratum: str,
    false_reject: float = 0.012,
    error: float = 0.05,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Per stratum (column ``_stratum``) a cutoff for each rule, null where none is safe or none is of use.

    ``false_reject`` bounds the share of good documents that all rules together may reject of those that pass the base,
    in each stratum with enough labels and in all strata pooled; ``error`` bounds the probability that any bound fails.
    Strata with fewer labels take the cutoffs of the pool, unless their own labels show that these reject more.
    ``labels``: doc_id and quality (1 good); a document with several labels counts as good if one says so, labels
    without doc_id or quality don't count. A stratum without labels has no row here and keeps its documents.
    """
    spark = metrics.sparkSession
    labelled = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg((F.max("quality") == 1).alias("_good"))
    )
    rules = list(RULES)
    lays = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(PATH_PART)) == 0
    scored = (
        metrics.where(f"n_words > 0 and doc_id is not null and not ({_base(min_words, max_repeat_percent)})")
        .join(labelled, F.col("doc_id") == F.col("_doc"))
        .select(
            F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"),
            F.when(~F.col("_good"), "bad").when(lays, "path").otherwise("test").alias("part"),
            *(_place(F.expr(f"double({e})")).alias(r) for r, e in RULES.items()),
        )
    )
    scored = written(scored, "quality-places")
    sizes: dict[str, Counter] = {}
    for r in scored.groupBy("_stratum", "part").count().collect():
        sizes.setdefault(r["_stratum"], Counter())[r["part"]] = r["count"]
    own, pooled, level = families({s: c["test"] for s, c in sizes.items()}, false_reject, error)
    schema = "_stratum string, " + ", ".join(f"cut_{r} double" for r in rules)
    if not own and not pooled:
        return spark.createDataFrame([(s, *[None] * len(rules)) for s in sizes], schema)

    counts: dict[str, dict[tuple, list[int]]] = {s: {} for s in own}
    group = F.when(F.col("_stratum").isin(own), F.col("_stratum"))
    places = scored.where("part != 'test'").select(
        group.alias("own"),
        "part",
        F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("place")) for r in rules))).alias("x"),
    )
    total: dict[tuple, list[int]] = {}
    for r in places.groupBy("own", "part", "x.rule", "x.place").count().collect():
        for table in [total] + ([counts[r["own"]]] if r["own"] is not None else []):
            table.setdefault((r["part"], r["rule"]), [0] * (len(GRID) + 1))[r["place"]] += r["count"]
    pool_sizes = sum(sizes.values(), Counter())

    def above(table: dict[tuple, list[int]], part: str, rule: str, n: int) -> list[float]:
        """Shares above the places of GRID."""
        return [x / max(n, 1) for x in accumulate(table.get((part, rule), [0] * (len(GRID) + 1))[:-1])]

    def laid(own_counts: dict[tuple, list[int]], own_sizes: Counter) -> list[tuple[str, int]]:
        """The path from a stratum's own labels and those of all, equally; shares count as documents of the pool."""
        rate = {}
        for part, n in (("bad", pool_sizes["bad"]), ("path", pool_sizes["path"] + pool_sizes["test"])):
            rate[part] = {
                rule: [
                    n * (x + y) / 2
                    for x, y in zip(
                        above(own_counts, part, rule, own_sizes[part]),
                        above(total, part, rule, pool_sizes[part]),
                        strict=True,
                    )
                ]
                for rule in rules
            }
        return path(rate["bad"], rate["path"])

    paths = {(False, s): laid(counts[s], sizes[s]) for s in own}
    if pooled:
        paths[True, ""] = laid(total, pool_sizes)
    # For every path, rule and place the step that first rejects such a score.
    first = []
    for (of_pool, s), steps in paths.items():
        lookup = []
        for rule in rules:
            at = [len(steps)] * (len(GRID) + 1)
            for number, (name, i) in reversed(list(enumerate(steps))):
                if name == rule:
                    at[: i + 1] = [number] * (i + 1)
            lookup.append(at)
        first.append((of_pool, s, lookup))
    lookups = spark.createDataFrame(first, "of_pool boolean, of string, steps array<array<int>>")
    whose = [F.struct(F.lit(False).alias("of_pool"), F.col("_stratum").alias("of"))]
    whose += [F.struct(F.lit(True).alias("of_pool"), F.lit("").alias("of"))] if pooled else []
    met = (
        scored.where("part != 'path'")
        .withColumn("_whose", F.explode(F.array(*whose)))
        .select("*", "_whose.of_pool", "_whose.of")
        .join(written(lookups, "quality-paths"), ["of_pool", "of"])
        .select(
            "of_pool",
            "_stratum",
            "part",
            F.least(*(F.col("steps")[i][F.col(r)] for i, r in enumerate(rules))).alias("step"),
        )
    )
    hits: dict[tuple, list[int]] = {}
    for r in met.groupBy("of_pool", "_stratum", "part", "step").count().collect():
        steps = paths[True, ""] if r["of_pool"] else paths[False, r["_stratum"]]
        hits.setdefault((r["of_pool"], r["_stratum"], r["part"]), [0] * (len(steps) + 1))[r["step"]] += r["count"]

    def tightened(steps: list[tuple[str, int]]) -> dict[str, float]:
        return {rule: GRID[i] for rule, i in steps}

    chosen = {}
    for s in own:
        none = [0] * (len(paths[False, s]) + 1)
        taken = accepted(hits.get((False, s, "test"), none), hits.get((False, s, "bad"), none), false_reject, level)
        chosen[s] = tightened(paths[False, s][:taken])
    if pooled:
        none = [0] * (len(paths[True, ""]) + 1)
        summed = {
            part: [sum(x) for x in zip(none, *(h for (p, _, q), h in hits.items() if p and q == part), strict=True)]
            for part in ("test", "bad")
        }
        taken = accepted(summed["test"], summed["bad"], false_reject, level)
        for s in sizes.keys() - set(own):
            good = hits.get((True, s, "test"), none)
            lost = sum(good[:taken])
            if lost and 1 - binomial_cdf(lost - 1, sum(good), false_reject) <= error:
                continue
            chosen[s] = tightened(paths[True, ""][:taken])
    return spark.createDataFrame([(s, *(chosen.get(s, {}).get(r) for r in rules)) for s in sizes], schema)


def _place(score: Column) -> Column:
    """The first place in GRID whose cutoff the score exceeds, by the comparison that the verdict makes."""
    kept = F.filter(F.array(*map(F.lit, GRID)), lambda cutoff: F.coalesce(score, F.lit(0.0)) <= cutoff)
    return F.size(kept)


def _base(min_words: int, max_repeat_percent: int) -> str:
    return f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words"


def judge(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    false_reject: float = 0.012,
    error: float = 0.05,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Per document: ``keep``, the METRICS, base_failed and kept.

    Null or empty texts have no words and fail. A null stratum is a stratum of its own. Without labels no rule beyond
    the base applies. Repeated rows are judged alike, each in a row of its own.
    """
    columns = list(dict.fromkeys([*keep, "doc_id", stratum]))
    metrics = written(document_metrics(docs, columns), "quality-metrics")
    chosen = cutoffs(metrics, labels, stratum, false_reject, error, min_words, max_repeat_percent)
    judged = _verdict(metrics, chosen, F.col(stratum), min_words, max_repeat_percent)
    return judged.select(*keep, *METRICS, "base_failed", "kept", *(f"cut_{r}" for r in RULES))


def _verdict(metrics: DataFrame, chosen: DataFrame, stratum: Column, min_words: int, max_repeat_percent: int) -> DataFrame:
    """Adds the cutoffs, base_failed and kept. The table of cutoffs is read from a file, so Spark knows its size."""
    joined = metrics.withColumn("_stratum", F.coalesce(stratum.cast("string"), F.lit(""))).join(
        written(chosen, "quality-cutoffs"), "_stratum", "left"
    )
    failed = F.expr(_base(min_words, max_repeat_percent))
    passes = F.lit(True)
    for rule, score in RULES.items():
        passes = passes & F.coalesce(F.expr(f"({score}) <= cut_{rule}"), F.lit(True))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes)


def filtered(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    false_reject: float = 0.012,
    error: float = 0.05,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Texts are measured twice but not shuffled."""
    names = docs.columns
    metrics = written(document_metrics(docs, list(dict.fromkeys(["doc_id", stratum]))), "quality-metrics")
    chosen = cutoffs(metrics, labels, stratum, false_reject, error, min_words, max_repeat_percent)
    whole = document_metrics(beside_text(docs), ["_doc"], with_text=True)
    judged = _verdict(whole, chosen, F.col("_doc")[stratum], min_words, max_repeat_percent)
    return laid_flat(judged.where("kept"), names)
