"""Exact removal of repeated byte strings with a sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting every suffix would move
the text hundreds of times, so only suffixes at anchors are sorted: of the hashes of all GRAM-byte strings within a
window of ``length`` bytes the lowest (of equal ones the last) marks the window's anchor. Equal windows have the same
anchor at the same place, so windows need only be compared where their anchors are.

1. Anchors are range-partitioned by hash. Anchors whose GRAM bytes occur once are done; those whose whole stretch of
   windows occurs again are done too: all their windows repeat. What remains stands at the borders of repeats.
2. The suffixes at the remaining anchors, with the stretch before each, are range-partitioned by sampled splitters over
   their leading bytes, equal ones by document, so that no group of equal suffixes lands in one task. Buckets are
   sorted by multikey quicksort and neighbours compared, across the buckets' boundaries as well. The same is done in the
   order of the stretches before the anchors, read backwards. A neighbour with ``l`` equal bytes before and ``r`` from
   the anchor on confirms the windows that begin ``length - r`` to ``l`` bytes before the anchor; the largest ``l`` and
   ``r`` of the two orders exclude all windows beyond.
3. The few windows between, which one neighbour confirms to the left and another to the right at best, are compared one
   by one by a 128-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, ship_code, steps, written

GRAM = 32
#: Windows whose anchors are found at once; longer texts go piece by piece.
PART = 1 << 22
FULL, SUFFIX = 1, 2
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(raw: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part of a text: anchors, and the first and last start of the windows that each of them marks."""
    windows = len(raw) - length + 1
    for base in range(0, max(0, windows), PART):
        part = np.frombuffer(raw, np.uint8, min(PART, windows - base) + length - 1, base).astype(np.uint64)
        x = part[:-1] | part[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        x = x[:-4] | x[4:] << np.uint64(32)
        n = len(part) - GRAM + 1
        h = x[:n] * MIX[0]
        for j in (8, 16, 24):
            h = (h ^ h >> np.uint64(29)) * MIX[1] + x[j : j + n] * MIX[j // 8]
        h ^= h >> np.uint64(32)
        h *= MIX[2]
        # The hash above, the place below counted from the end, so that the last of equal hashes is lowest.
        h = h & ~np.uint64(0xFFFFFF) | np.uint64(0xFFFFFF) - np.arange(n, dtype=np.uint64)
        chosen = 0xFFFFFF - (_lowest(h, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        change = np.flatnonzero(np.diff(chosen)) + 1
        first, last = np.append(0, change), np.append(change, len(chosen)) - 1
        yield chosen[first] + base, first + base, last + base


def pack(anchor: int, first: int, last: int) -> int:
    """An anchor and the windows it marks in one number: their distances before the anchor are below 256."""
    return anchor << 16 | (anchor - first) << 8 | anchor - last


def unpack(place: int) -> tuple[int, int, int]:
    anchor = place >> 16
    return anchor, anchor - (place >> 8 & 255), anchor - (place & 255)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    signed = lambda v: np.array(v, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in steps(batches):
            ids, keys = batch.column("doc").to_pylist(), batch.column("key").to_pylist()
            out = ([], [], [], [], [])
            for doc, key, text in zip(ids, keys, batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                view = memoryview(raw)
                for part in anchors(raw, length):
                    for a, s, e in zip(*(p.tolist() for p in part), strict=True):
                        out[0].append(digest(view[a : a + GRAM]))
                        out[1].append(digest(view[s : e + length]))
                        out[2].append(doc)
                        out[3].append(key)
                        out[4].append(pack(a, s, e))
            if out[0]:
                columns = [pa.array(signed(out[0])), pa.array(signed(out[1])), *(pa.array(c, pa.int64()) for c in out[2:])]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "stretch", "doc", "key", "place"])

    return docs.mapInArrow(run, "gram long, stretch long, doc long, key long, place long")


def _numbers(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """Columns of a whole partition, whose size the splitters bound."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else names)]


def candidates(rows: DataFrame) -> DataFrame:
    """Columns doc, key, place and use (FULL: all its windows repeat; SUFFIX: to be sorted) of repeated anchors.

    A group of equal GRAM bytes at the edge of a partition may go on in the next one; its anchors are all taken on, the
    suffix order decides them.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, stretch, doc, key, place = _numbers(batches, ["gram", "stretch", "doc", "key", "place"])
        if not len(gram):
            return
        order = np.lexsort((stretch, gram))
        gram, stretch, doc, key, place = (c[order] for c in (gram, stretch, doc, key, place))
        new = np.append(True, gram[1:] != gram[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        edge = np.zeros(len(size), bool)
        edge[[0, -1]] = True
        run_new = new | np.append(True, stretch[1:] != stretch[:-1])
        same = np.cumsum(run_new) - 1
        full = np.bincount(same)[same] > 1
        open_ = np.bincount(group, ~full) > 0
        repeated = (size > 1) | edge
        use = np.where(full, FULL, 0) | np.where(~full | run_new & (open_ | edge)[group], SUFFIX, 0)
        keep = repeated[group]
        columns = [pa.array(c[keep].astype(np.int64)) for c in (doc, key, place)] + [pa.array(use[keep].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "place", "use"])

    dealt = rows.repartitionByRange(parallelism(spark), "gram", "stretch", "doc", "place")
    return dealt.mapInArrow(run, "doc long, key long, place long, use int")


def suffixes(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Columns doc, key, place, ahead (bytes from the anchor to the end of its last window) and behind (those from its
    first window to the anchor, read backwards)."""
    wanted = found.where(F.col("use").bitwiseAND(SUFFIX) > 0).groupBy("doc", "key").agg(
        F.collect_set("place").alias("places")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, packed, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "packed", "places")), strict=True):
                raw = zlib.decompress(packed)
                for p in places:
                    a, s, e = unpack(p)
                    rows.append((doc, key, p, raw[a : e + length], raw[s:a][::-1]))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays(_suffix_arrays(rows), ["doc", "key", "place", "ahead", "behind"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(_suffix_arrays(rows), ["doc", "key", "place", "ahead", "behind"])

    joined = packed_texts(docs).join(wanted, ["doc", "key"])
    return joined.mapInArrow(run, "doc long, key long, place long, ahead binary, behind binary")


def _suffix_arrays(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True))
    return [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)]


def packed_texts(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc, key, ``more`` and packed: the text's bytes, compressed for the way."""
    names = ["doc", "key", *more]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            packed = [zlib.compress(t.encode(), 6) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(packed, pa.binary())], [*names, "packed"]
            )

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", packed binary")


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of big-endian words: each column splits only the rows that are equal so far."""
    order, group = np.arange(len(words)), np.zeros(len(words), np.int64)
    tied = np.arange(len(words))
    for column in words.T:
        if len(tied) < 2:
            break
        value = column[order[tied]]
        by = np.lexsort((value, group[tied]))
        order[tied] = order[tied][by]
        value, old = value[by], group[tied]
        new = np.append(True, (old[1:] != old[:-1]) | (value[1:] != value[:-1]))
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
    return order


def _with_next(flat: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Leading bytes that each string of the order shares with the next one."""
    out = []
    for at in range(0, len(order) - 1, 20_000):
        a, b = order[at : at + 20_000], order[at + 1 : at + 20_001]
        a = a[: len(b)]
        differs = flat[a] != flat[b]
        first = np.where(differs.any(1), differs.argmax(1), flat.shape[1])
        out.append(np.minimum(first, np.minimum(lengths[a], lengths[b])))
    return np.concatenate([np.zeros(0, np.int64), *out])


def neighbours(table: DataFrame, lead: str, then: str) -> DataFrame:
    """Columns doc, key, place and l, r with the suffix before, l2, r2 with the one after, in the order of ``lead``, then
    ``then``; null at a bucket's edge, whose strings are returned as well with the bucket's number."""
    spark = table.sparkSession
    names = ["doc", "key", "place", "l", "r", "l2", "r2", "bucket", "edge", "ahead", "behind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if data is None or not data.num_rows:
            return
        texts = {c: data.column(c).to_pylist() for c in (lead, then)}
        lengths = {c: np.fromiter(map(len, texts[c]), np.int64, data.num_rows) for c in (lead, then)}
        flat, words = {}, []
        for c in (lead, then):
            flat[c] = _padded(texts[c], int(-(-max(8, lengths[c].max()) // 8) * 8))
            words += [flat[c].view(">u8").astype(np.uint64), lengths[c].astype(np.uint64)[:, None]]
        order = multikey_quicksort(np.concatenate(words, 1))
        n = len(order)
        common = {c: _with_next(flat[c], lengths[c], order) for c in (lead, then)}
        l, r = common["behind"], common["ahead"]
        none = np.array([-1])
        take = pa.array(order)
        columns = [data.column(c).take(take).combine_chunks() for c in ("doc", "key", "place")]
        columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in ((none, l), (none, r), (l, none), (r, none))]
        edge = np.zeros(n, np.int32)
        edge[0] |= 1
        edge[-1] |= 2
        columns += [pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(edge)]
        for c in ("ahead", "behind"):
            shown = [None] * n
            for i in (0, n - 1):
                shown[i] = (texts[lead] if c == lead else texts[then])[order[i]]
            columns.append(pa.array(shown, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names)

    dealt = table.repartitionByRange(parallelism(spark), lead, then, "doc", "place")
    schema = "doc long, key long, place long, l int, r int, l2 int, r2 int, bucket int, edge int, ahead binary, behind binary"
    return dealt.mapInArrow(run, schema)


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def evidence(table: DataFrame, lead: str, then: str) -> DataFrame:
    """Columns doc, key, place, l, r, l2, r2 of one order, boundaries between buckets included.

    The driver compares the last suffix of each bucket with the first of the next: two short strings a bucket.
    """
    spark = table.sparkSession
    inner = written(neighbours(table, lead, then), "suffix-order")
    edges = inner.where("edge > 0").orderBy("bucket", F.col("edge") != 1).collect()
    firsts = [x for x in edges if x.edge & 1]
    lasts = [x for x in edges if x.edge & 2]
    rows = []
    for a, b in zip(lasts, firsts[1:], strict=False):
        l, r = _shared(a.behind, b.behind), _shared(a.ahead, b.ahead)
        rows += [(x.doc, x.key, x.place, l, r, -1, -1) for x in (a, b)]
    schema = "doc long, key long, place long, l int, r int, l2 int, r2 int"
    return inner.select("doc", "key", "place", "l", "r", "l2", "r2").unionByName(spark.createDataFrame(rows, schema))


def decide(place: int, pairs: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Confirmed windows of an anchor, as ranges of their starts, and the distances before the anchor of those that may
    repeat yet."""
    anchor, first, last = unpack(place)
    low, high = anchor - last, anchor - first
    ranges = []
    for l, r in pairs:
        near, far = max(low, length - r), min(high, l)
        if near <= far:
            ranges.append((near, far))
    near = max(low, length - max(r for _, r in pairs))
    far = min(high, max(l for l, _ in pairs))
    rest = [d for d in range(near, far + 1) if not any(a <= d <= b for a, b in ranges)] if near <= far else []
    return [(anchor - b, anchor - a) for a, b in ranges], rest


def _decided(grouped: DataFrame, length: int) -> DataFrame:
    """Columns doc, key, spans (starts and ends of bytes, in turn) and open (places and distances left, in turn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, left = [], []
            for full, found in zip(batch.column("full"), batch.column("found"), strict=True):
                places = np.array(full.values, np.int64)
                at = places >> 16
                whole = np.stack([at - (places >> 8 & 255), at - (places & 255) + length], 1)
                by_place: dict[int, list] = {}
                numbers = np.array(found.values, np.int64).reshape(-1, 2)
                shared = (numbers[:, 1:] >> np.array([48, 32, 16, 0]) & 0xFFFF) - 1
                for place, (l, r, l2, r2) in zip(numbers[:, 0].tolist(), shared.tolist(), strict=True):
                    by_place.setdefault(place, []).extend(((l, r), (l2, r2)))
                ranges, rest = whole.ravel().tolist(), []
                for place, pairs in by_place.items():
                    sure, more = decide(place, pairs, length)
                    for a, b in sure:
                        ranges += (a, b + length)
                    for d in more:
                        rest += (place, d)
                spans.append(ranges)
                left.append(rest)
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (spans, left)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), *lists], ["doc", "key", "spans", "open"])

    return grouped.mapInArrow(run, "doc long, key long, spans array<long>, open array<long>")


def _one_by_one(table: DataFrame, left: DataFrame, length: int) -> DataFrame:
    """Columns doc, key, start: repeated windows at the distances that are open (doc, key, place, distance).

    Equal windows have the same GRAM bytes at the same distance, so only those distances of an open anchor's equals are
    looked at.
    """
    gram = F.xxhash64(F.substring("ahead", 1, GRAM))
    grams = table.select("doc", "key", "place", gram.alias("gram")).join(left, ["doc", "key", "place"])
    grams = grams.groupBy("gram").agg(F.collect_set("distance").alias("distances"))
    members = table.withColumn("gram", gram).join(written(grams, "suffix-left"), "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc", "key", "place", "ahead", "behind", "distances")]
            for at in range(0, batch.num_rows, 1000):
                out = ([], [], [], [], [])
                for doc, key, place, ahead, behind, distances in zip(*(c[at : at + 1000] for c in columns), strict=True):
                    whole = memoryview(behind[::-1] + ahead)
                    anchor = place >> 16
                    for d in distances:
                        i = len(behind) - d
                        if 0 <= i <= len(whole) - length:
                            h = xxhash.xxh3_128_intdigest(whole[i : i + length])
                            for c, v in zip(out, (h >> 64, h & (1 << 64) - 1, doc, key, anchor - d), strict=True):
                                c.append(v)
                arrays = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2]] + [pa.array(c, pa.int64()) for c in out[2:]]
                yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "doc", "key", "start"])

    windows = written(members.mapInArrow(run, "h1 long, h2 long, doc long, key long, start long"), "suffix-windows")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return windows.join(written(again, "suffix-again"), ["h1", "h2"], "left_semi").select("doc", "key", "start")


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """Columns doc, key, spans for documents (doc, key, text) with repeated bytes; spans may overlap."""
    found = written(candidates(_anchor_rows(docs, length)), "anchors")
    table = written(suffixes(docs, found, length), "suffixes")
    facts = evidence(table, "ahead", "behind").unionByName(evidence(table, "behind", "ahead"))
    # Four counts below 2^16 in one number, a missing one as zero.
    shared = sum((F.shiftleft((F.col(c) + 1).cast("long"), n) for c, n in (("l", 48), ("r", 32), ("l2", 16))), (F.col("r2") + 1).cast("long"))
    sure = found.where(F.col("use").bitwiseAND(FULL) > 0)
    parts = facts.select("doc", "key", F.lit(None).cast("long").alias("full"), F.array("place", shared).alias("found")).unionByName(
        sure.select("doc", "key", F.col("place").alias("full"), F.lit(None).cast("array<long>").alias("found"))
    )
    grouped = parts.groupBy("doc", "key").agg(
        F.collect_list("full").alias("full"), F.flatten(F.collect_list("found")).alias("found")
    )
    decided = written(_decided(grouped, length), "suffix-spans")
    step = F.transform(F.sequence(F.lit(1), F.size("open"), F.lit(2)), lambda i: F.struct(F.element_at("open", i).alias("place"), F.element_at("open", i + 1).alias("distance")))
    left = decided.where(F.size("open") > 0).select("doc", "key", F.explode(step).alias("x")).select("doc", "key", "x.place", "x.distance")
    spans = decided.select("doc", "key", "spans").where(F.size("spans") > 0)
    more = _one_by_one(table, written(left, "suffix-open"), length).groupBy("doc", "key").agg(
        F.flatten(F.collect_list(F.array(F.col("start"), F.col("start") + length))).alias("spans")
    )
    return spans.unionByName(more).groupBy("doc", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without_repeats(
    docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ("doc_id",), as_text: bool = False
) -> DataFrame:
    """Per document: ``keep``, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, or with ``as_text``
    a string without the rest of a character that a cut went through).

    Bytes are those of UTF-8; null and empty texts have none. Repeated rows repeat each other's strings. ``length`` is
    33 to 280. A removed run may begin or end within a character.
    """
    if not GRAM < length <= 280:
        raise ValueError("length must be 33 to 280")
    ship_code(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A text and its id tell rows apart; rows that agree in both have the same result.
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("key"),
        F.struct(*keep).alias("_keep"),
        text.alias("text"),
    )
    spans = repeated_spans(rows.drop("_keep"), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = zlib.decompress(packed)
                runs = merged(found or [])
                at, parts = 0, []
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                for c, v in zip(out, (len(raw), len(raw) - len(kept), len(runs), kept), strict=True):
                    c.append(v)
            left = [k.decode("utf-8", "ignore") for k in out[3]] if as_text else out[3]
            arrays = [batch.column("_keep"), *(pa.array(c, pa.int64()) for c in out[:3])]
            arrays.append(pa.array(left, pa.string() if as_text else pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, ["_keep", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = packed_texts(rows, ("_keep",)).join(spans, ["doc", "key"], "left").select("_keep", "packed", "spans")
    kind = dict(joined.dtypes)["_keep"]
    last = "string" if as_text else "binary"
    done = joined.mapInArrow(run, f"_keep {kind}, n_bytes long, n_removed long, n_spans long, kept {last}")
    return done.select(*(F.col("_keep")[c].alias(c) for c in keep), "n_bytes", "n_removed", "n_spans", "kept")


def cleaned(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents without repeated strings: column text is what is left, less the rest of a character that a cut
    went through; null stays null, other columns stay as they are."""
    names = docs.columns
    rows = docs.select("doc_id", "text", F.struct(*(c for c in names if c != "text"), F.col("text").isNull().alias("_null")).alias("_doc"))
    done = without_repeats(rows, length, ("_doc",), as_text=True)
    return done.select(
        *((F.when(~F.col("_doc._null"), F.col("kept")) if c == "text" else F.col("_doc")[c]).alias(c) for c in names)
    )
