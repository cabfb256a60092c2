"""Near duplicates by SimHash.

A fingerprint's 64 bits are 32 segments of 2; the bit counts of the segments are a point whose Manhattan distance to
another point is at most the number of differing bits. If the counts of two fingerprints differ by 3 or less in all,
they differ by 1 or less in one half of the segments. So the points are laid out on a grid of each half: a fingerprint
stands in its own cell and looks into those cells where one count is higher by one. What meets there is held against
the bound over all segments, then against the bits themselves.

Equal fingerprints are one before that. Within a cell, only as many links are returned as connect what is connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_text, laid_flat, map_texts, parallelism, ship_code, written
from .components import components

#: Differing bits that link; the grid's geometry holds for this distance.
DISTANCE = 3
LOW_BITS = np.uint64(0x5555555555555555)
#: Rows of a cell that one task compares; a larger cell is split in blocks that are compared pair by pair.
CELL_ROWS = 50_000
#: Cells up to this size are compared for a whole batch at once.
SMALL_CELL = 12
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """SimHash of a text's shingles of lower-case (A-Z) words; 0 without words, null counts as empty."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words_each, len(words))
    bounds = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in bounds), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments, written 00, 01, 11: differing bits are then the Manhattan distance."""
    high = prints >> np.uint64(1)
    return (prints | high) & LOW_BITS | ((prints & high) & LOW_BITS) << np.uint64(1)


def cell_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells in which fingerprints stand or look, and the places of these fingerprints."""
    counts = segment_counts(prints)
    cells, who = [], []
    everyone = np.arange(len(prints))
    for half in (0, 1):
        own = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        side = np.uint64(half << 32)
        cells.append(own | side)
        who.append(everyone)
        for segment in range(16):
            low, high = np.uint64(1 << (2 * segment)), np.uint64(2 << (2 * segment))
            step = np.where(own & low == 0, low, high)
            can = own & high == 0
            cells.append((own[can] | step[can]) | side)
            who.append(everyone[can])
    return np.concatenate(cells).astype(np.int64), np.concatenate(who)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bound first, then the bits."""
    out = np.bitwise_count(segment_counts(a) ^ segment_counts(b)) <= DISTANCE
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(a[at] ^ b[at]) <= DISTANCE
    return out


def _link_large(prints: np.ndarray) -> tuple[list, list]:
    """Links that connect one cell, by breadth-first search: each found fingerprint is compared with those not found."""
    left, right = [], []
    rest = prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= DISTANCE
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), one))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    return left, right


def _links(cells: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole cells; rows come sorted by cell."""
    left, right = [], []
    change = np.flatnonzero(np.diff(cells)) + 1
    starts, ends = np.append(0, change), np.append(change, len(cells))
    large = ends - starts > SMALL_CELL
    for a, b in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        more = _link_large(np.unique(prints[a:b]))
        left += more[0]
        right += more[1]
    small = np.repeat(~large, ends - starts)
    cells, prints = cells[small], prints[small]
    for shift in range(1, SMALL_CELL):
        at = np.flatnonzero(cells[shift:] == cells[:-shift])
        if not len(at):
            break
        a, b = prints[at], prints[at + shift]
        near = _near(a, b) & (a != b)
        left.append(a[near])
        right.append(b[near])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def link(prints: DataFrame, cell_limit: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect the different values of column fp wherever DISTANCE bits or less differ."""
    spark = prints.sparkSession
    ship_code(spark)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 20_000):
                part = values[at : at + 20_000]
                cells, who = cell_rows(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part[who])], ["cell", "fp"])

    cells = prints.mapInArrow(lay_out, "cell long, fp long")
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_limit)
    crowded = written(crowded.select("cell", F.ceil(F.col("n") / cell_limit).cast("int").alias("blocks")), "simhash-crowded")
    cells = cells.withColumn("block", F.lit(0))
    if not crowded.isEmpty():
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j),
        )
        split = cells.drop("block").join(crowded, "cell", "left")
        cells = split.select(
            "cell", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("block")
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        last = False
        batches = iter(batches)
        while not last:
            batch = next(batches, None)
            last = batch is None
            if not last:
                new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "block", "fp")])
                held = np.concatenate([held, new], 1)
            if not held.shape[1]:
                continue
            group = np.append(0, np.cumsum((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)))
            done = held.shape[1] if last else int(np.searchsorted(group, group[-1]))
            a, b = _links(group[:done], held[2, :done].view(np.uint64))
            held = held[:, done:]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = cells.repartition(parallelism(spark), "cell", "block").sortWithinPartitions("cell", "block", "fp")
    return dealt.mapInArrow(compare, "a long, b long")


def groups(prints: DataFrame, cell_limit: int = CELL_ROWS) -> DataFrame:
    """Columns fp and component_id (the lowest doc_id that it reaches) for a table of doc_id and fp."""
    one = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-prints")
    roots = written(components(link(one.select("fp"), cell_limit)), "simhash-roots")
    member = one.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    member = written(member, "simhash-members")
    lowest = written(member.groupBy("root").agg(F.min("first_doc").alias("component_id")), "simhash-lowest")
    return written(member.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id"), "simhash-groups")


def near_duplicates(
    docs: DataFrame, words_each: int = 3, seed: int = 42, cell_limit: int = CELL_ROWS, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Per document: ``keep``, fingerprint (16 hex digits) and component_id, the lowest doc_id that it reaches.

    Null and empty texts have fingerprint zero, which links like any other. Rows that repeat, and all documents of one
    fingerprint, share a component; a null doc_id never names one unless no other is there.
    """
    fields = [("fp", "long")]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    columns = list(dict.fromkeys([*keep, "doc_id"]))
    prints = map_texts(
        docs, columns, fields, lambda texts: [[signed(fingerprint(t, words_each, seed)) for t in texts]]
    )
    prints = written(prints, "simhash")
    found = groups(prints.select("doc_id", "fp"), cell_limit).select("fp", "component_id")
    return prints.join(found, "fp").select(
        *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, words_each: int = 3, seed: int = 42, cell_limit: int = CELL_ROWS) -> DataFrame:
    """One document of each component, with all its columns: that of the lowest doc_id.

    Of several rows with that doc_id and one fingerprint one stays; a component without any doc_id keeps one row.
    """
    names = docs.columns
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = map_texts(
        beside_text(docs),
        ["_doc"],
        [("fp", "long")],
        lambda texts: [[signed(fingerprint(t, words_each, seed)) for t in texts]],
        with_text=True,
    )
    prints = written(prints.withColumn("_row", F.monotonically_increasing_id()), "simhash-documents")
    keys = prints.select(F.col("_doc.doc_id").alias("doc_id"), "fp", "_row")
    found = groups(keys.select("doc_id", "fp"), cell_limit)
    member = written(keys.join(found, "fp").select("root", "doc_id", "_row"), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = member.groupBy("root").agg(F.min(order)["_row"].alias("_first"))
    # Fewer rows go than stay, so these meet the texts.
    goes = written(member.join(first, "root").where("_row != _first").select("_row"), "simhash-goes")
    return laid_flat(prints.join(goes, "_row", "left_anti"), names)
