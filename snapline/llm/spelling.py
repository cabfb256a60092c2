"""Spelling variants: words that differ in one letter, grouped under their most frequent form.

Letters fall into groups; a word's counts of each group, the length first, are its path in a trie, and words lie at the
leaves. One letter replaced, inserted or deleted changes at most one count by +1 (the surplus) and one by -1 (the
deficit), so a search goes down the trie depth first and may spend each once. Of two near words the one with fewer
letters, or with the smaller first differing count, is the one that searches; so every pair is met once, and the surplus
is always spent before the deficit. Words at the leaves that are reached are compared letter by letter.

The upper levels of the trie are the shuffle: words that share them are a shard with a trie of its own, deep enough that
no shard holds more than ``SHARD`` words where paths tell words apart, and a word also visits the shards that its budget
reaches. Inside a shard, searches go down in blocks. A shard returns one row per word, its number of near words and the
best of them, not the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, ship_code, steps, written

#: Runs of letters in lower-cased UTF-8: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Letter groups: code points by their lower five bits, so that a-z have one each.
GROUPS = 32
#: Words of a shard, as far as the trie's upper levels tell them apart.
SHARD = 8192
#: Searches that go down together, and letters compared at a time.
BLOCK, LETTERS = 1 << 15, 1 << 22
#: What a search has spent, by whether it looks for words of its own length or one longer.
SAME, SURPLUS, BOTH, LONGER, INSERTED = range(5)
#: Different words that a task counts before it hands them on.
COUNTED = 200_000


def word_counts(
    docs: DataFrame, min_length: int = 6, min_count: int = 5, flaw_every: int | None = None, key: str = "doc_id"
) -> DataFrame:
    """Columns word and n: maximal runs of letters (a-z after lower-casing A-Z, U+00C0 to U+00FF) of all whole texts.

    Null and empty texts have none; repeated rows count as often as they come; columns beside ``key`` and ``text`` are
    not read. Words of fewer than ``min_length`` letters or fewer than ``min_count`` occurrences are left out. With
    ``flaw_every``, where that number divides the crc32 of ``<key>:<run>``, the run loses one letter (planted flaws).
    Tasks sum before the shuffle, so a word with a third of all occurrences is one row per task.
    """
    ship_code(docs.sparkSession)
    docs = docs.select(F.col(key).cast("string").alias("_key"), F.col("text").cast("string").alias("text"))

    def flawed(name: bytes, found: Counter) -> Counter:
        base, out = zlib.crc32(name + b":"), Counter()
        for run, n in found.items():
            h = zlib.crc32(run, base)
            if h % flaw_every == 0:
                word = run.decode()
                at = h % len(word)
                run = (word[:at] + word[at + 1 :]).encode()
            out[run] += n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(w.decode(), n) for w, n in total.items()]
            rows = [(w, n) for w, n in rows if len(w) >= min_length]
            total.clear()
            words, counts = zip(*rows, strict=True) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in steps(batches):
            texts = batch.column("text").to_pylist()
            for name, text in zip(batch.column("_key").to_pylist(), texts, strict=True):
                if text:
                    runs = RUN.findall(text.encode().lower())
                    total.update(flawed((name or "").encode(), Counter(runs)) if flaw_every else runs)
            if len(total) >= COUNTED:
                yield out()
        yield out()

    found = docs.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def paths(words: list[bytes], order: list[int]) -> np.ndarray:
    """Length and letter-group counts of words (Latin-1 bytes), a row each, groups in the given order."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    cell = np.repeat(np.arange(len(words)) * GROUPS, lengths) + flat % GROUPS
    counts = np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return np.column_stack([lengths, counts[:, order]])


class Trie:
    """Words by their paths from level ``depth`` on. A level is a sorted list of (node, count); a child's node is its
    place in the list, so counts one more or less lie next to each other."""

    def __init__(self, path: np.ndarray, depth: int):
        n = len(path)
        self.order = np.lexsort(path.T[::-1]) if n else np.zeros(0, np.int64)
        path = path[self.order]
        self.depth, self.levels, self.widths = depth, [], []
        node = np.zeros(n, np.int64)
        for level in range(depth, path.shape[1]):
            width = int(path[:, level].max(initial=0)) + 3
            keys, node = np.unique(node * width + path[:, level], return_inverse=True)
            self.levels.append(keys)
            self.widths.append(width)
        #: Leaf i holds the words ``order[first[i]:first[i + 1]]``.
        self.first = np.searchsorted(node, np.arange(node.max(initial=-1) + 2))

    def search(self, path: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (query, leaf, state) for the leaves that queries with the given paths and spent budgets reach."""
        n = len(path)
        stack = [(0, a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]
        stack = [(0, np.arange(a, b), np.zeros(b - a, np.int64), state[a:b]) for _, a, b in stack]
        while stack:
            level, query, node, spent = stack.pop()
            if len(query) > 2 * BLOCK:
                half = len(query) // 2
                stack.append((level, query[half:], node[half:], spent[half:]))
                stack.append((level, query[:half], node[:half], spent[:half]))
                continue
            if level == len(self.levels):
                done = (spent != SURPLUS) & (spent != LONGER)
                yield query[done], node[done], spent[done]
                continue
            keys, width = self.levels[level], self.widths[level]
            count = path[query, self.depth + level]
            fits = count < width - 1  # a count beyond the greatest here, or next to it, meets nothing
            query, node, spent, count = query[fits], node[fits], spent[fits], count[fits]
            key = node * width + count
            at = np.searchsorted(keys, key)
            last = len(keys) - 1
            equal = (at <= last) & (keys[np.minimum(at, last)] == key)
            over = at + equal
            more = (over <= last) & (keys[np.minimum(over, last)] == key + 1) & ((spent == SAME) | (spent == LONGER))
            less = (at > 0) & (keys[np.maximum(at - 1, 0)] == key - 1) & (spent == SURPLUS) & (count > 0)
            parts = [
                (query[equal], at[equal], spent[equal]),
                (query[more], over[more], spent[more] + 1),
                (query[less], at[less] - 1, spent[less] + 1),
            ]
            parts = [np.concatenate(x) for x in zip(*parts, strict=True)]
            if len(parts[0]):
                stack.append((level + 1, *parts))


def one_apart(a: np.ndarray, b: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of words, ``b`` as long as ``a`` or one longer, differ by one letter. Word i is ``flat[first[i]:][:size[i]]``."""
    out = np.zeros(len(a), bool)
    order = np.argsort(size[a], kind="stable")
    start = 0
    while start < len(order):
        step = order[start : start + max(1, LETTERS // int(size[a[order[start]]] + 1))]
        # Sizes rise; those far longer than the first wait for a block of their own.
        step = step[: max(1, int(np.searchsorted(size[a[step]], 2 * size[a[step[0]]] + 8)))]
        start += len(step)
        x, y = a[step], b[step]
        width = int(size[x].max(initial=0))
        place = np.arange(width)
        inside = place < size[x][:, None]
        left = flat[np.minimum(first[x][:, None] + place, len(flat) - 1)]
        right = flat[np.minimum(first[y][:, None] + np.arange(width + 1), len(flat) - 1)]
        same = (left == right[:, :-1]) | ~inside
        shifted = (left == right[:, 1:]) | ~inside
        longer = size[y] > size[x]
        # Equal up to somewhere, and from there on equal to the letters one further on.
        head = np.where(same.all(1), width, same.argmin(1))
        tail = np.where(shifted.all(1), 0, width - shifted[:, ::-1].argmin(1))
        out[step] = np.where(longer, tail <= head, (~same).sum(1) == 1)
    return out


def _near_in_shard(rows: pa.Table, order: list[int], depth: int) -> pa.Table:
    """Rows word, n_near, best_n, best of one shard: its own words (state SAME) and its visitors."""
    kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    empty = pa.table({c: pa.array([], t) for c, t in kinds.items()})
    rows = rows.sort_by([("state", "ascending"), ("word", "ascending")])
    text = rows.column("word").combine_chunks()
    words = [w.encode("latin-1") for w in text.to_pylist()]
    counts, state = rows.column("n").to_numpy().astype(np.int64), rows.column("state").to_numpy().astype(np.int64)
    home = int(np.searchsorted(state, SAME, side="right"))
    if not home:
        return empty
    path = paths(words, order)
    trie = Trie(path[:home], depth)
    flat = np.frombuffer(b"".join(words), np.uint8)
    size = path[:, 0]
    first = np.cumsum(size) - size
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for query, leaf, spent in trie.search(path, state):
        many = trie.first[leaf + 1] - trie.first[leaf]
        # Words at a leaf are compared a block at a time.
        cuts = np.flatnonzero(np.diff((np.cumsum(many) - many) // BLOCK, prepend=-1)) if len(many) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(many)], strict=True):
            m = many[lo:hi]
            at = np.arange(m.sum()) + np.repeat(trie.first[leaf[lo:hi]] - (np.cumsum(m) - m), m)
            a, b = np.repeat(query[lo:hi], m), trie.order[at]
            own = np.repeat(spent[lo:hi], m) == SAME  # both at one leaf: each pair once
            a, b = a[~own | (a < b)], b[~own | (a < b)]
            near = one_apart(a, b, flat, first, size)
            links.append((a[near], b[near]))
    if not links:
        return empty
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    word, other = np.concatenate([a, b]), np.concatenate([b, a])
    if not len(word):
        return empty
    # Greatest count first, then the smallest word; visitors and own words are each sorted, so words decide.
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, object), kind="stable")] = np.arange(len(words))
    by = np.lexsort((rank[other], -counts[other], word))
    word, other = word[by], other[by]
    found, begin, many = np.unique(word, return_index=True, return_counts=True)
    best = other[begin]
    columns = [text.take(pa.array(found)), pa.array(many, pa.int64()), pa.array(counts[best]), text.take(pa.array(best))]
    return pa.Table.from_arrays(columns, list(kinds))


def _shards(words: DataFrame, order: list[int], depth: int) -> DataFrame:
    """Columns shard, state, word, n: each word in its own shard and in those that its budget reaches."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text, n = batch.column("word"), batch.column("n")
            top = paths([w.encode("latin-1") for w in text.to_pylist()], order)[:, :depth]
            places = range(1, depth)

            def visits(change: dict[int, int], state: int) -> pa.RecordBatch:
                there = top.copy()
                for place, by in change.items():
                    there[:, place] += by
                keep = (there >= 0).all(1)
                shard = [",".join(map(str, r)) for r in there[keep].tolist()]
                mask = pa.array(keep)
                states = pa.array(np.full(len(shard), state, np.int32))
                return pa.RecordBatch.from_arrays(
                    [pa.array(shard, kinds[0]), states, text.filter(mask), n.filter(mask)], ["shard", "state", "word", "n"]
                )

            yield visits({}, SAME)
            yield visits({0: 1}, LONGER)
            for i in places:
                yield visits({i: 1}, SURPLUS)
                yield visits({0: 1, i: 1}, INSERTED)
                for j in places[i:]:
                    yield visits({i: 1, j: -1}, BOTH)

    return words.mapInArrow(run, "shard string, state int, word string, n long")


def group_order(words: DataFrame) -> list[int]:
    """Letter groups by how many letters of the words they hold, so that the upper levels tell most words apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUPS, np.int64)
        for batch in batches:
            flat = np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), np.uint8)
            total += np.bincount(flat % GROUPS, minlength=GROUPS)
        yield pa.RecordBatch.from_arrays([pa.array(range(GROUPS), pa.int32()), pa.array(total)], ["g", "n"])

    sums = words.mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    return [r["g"] for r in sorted(sums, key=lambda r: (-r["n"], r["g"]))] or list(range(GROUPS))


def shard_depth(words: DataFrame, order: list[int], most: int = SHARD) -> int:
    """Levels of the trie (the length is the first) after which no shard holds more than ``most`` words, or all levels.

    Only the greatest shard's size comes to the driver, a number for each depth that is tried.
    """
    depth = 1
    while True:
        at = depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    top = paths([w.encode("latin-1") for w in batch.column("word").to_pylist()], order)[:, :at]
                    shard, n = np.unique(top, axis=0, return_counts=True)
                    names = [",".join(map(str, r)) for r in shard.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["shard", "n"])

        sizes = words.select("word").mapInArrow(run, "shard string, n long").groupBy("shard").agg(F.sum("n").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= most or depth == GROUPS + 1:
            return depth
        depth += 1


def near_words(words: DataFrame, most: int = SHARD) -> DataFrame:
    """Columns word, n_near, best_n and best for the words that have near words: those one letter apart.

    ``best`` is the near word of largest n, the first in code-point order of equals. ``words`` has columns word (letters
    up to U+00FF, each word once) and n; it is read several times.
    """
    ship_code(words.sparkSession)
    words = words.select("word", "n")
    order = group_order(words)
    depth = shard_depth(words, order, most)
    shards = _shards(words, order, depth)
    parts = shards.groupBy("shard").applyInArrow(
        lambda rows: _near_in_shard(rows, order, depth), "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("best")
    summed = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Columns word and root for rows (word, form): where following forms ends. Each round doubles the steps taken.

    A form's count is a multiple of its word's, so there are no circles and few rounds.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        found = written(moved, "spelling-roots")
        if not found.where("moved").limit(1).count():
            return found.drop("moved")
        found = found.drop("moved")


def variants(words: DataFrame, factor: int = 5, most: int = SHARD) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (of equals the first in code-point order) if that is at least ``factor``
    times the word's n, else null; ``root`` is where following forms ends, the word itself without a form. An empty
    table gives an empty result. Runs jobs while the result is built and writes small tables to the scratch folder.
    """
    words = written(words.select("word", "n"), "spelling-words")
    spread = words.repartition(parallelism(words.sparkSession), "word")
    near = near_words(spread, most)
    enough = F.col("best_n") >= F.lit(factor) * F.col("n")
    linked = written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best")).alias("form"),
            F.when(enough, F.col("best_n")).alias("form_n"),
        ),
        "spelling-linked",
    )
    ends = roots(linked.where(F.col("form").isNotNull()))
    joined = linked.join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
