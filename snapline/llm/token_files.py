"""Token ids in files: Simple-8b words, written in the order of the keys and read back in segments.

A 64-bit word holds a selector in its upper 4 bits and as many equally wide numbers as fit the other 60, the first in the
lowest bits: 60 of 1 bit, 30 of 2, ... 1 of 60; selector 15 stands for 120 zeros. Selector 0 is the escape: two such
words, the upper and the lower half of a number of more than 60 bits. Numbers are cut into blocks that share no word, and
a segment tells the first word of each block, so a block is found and decoded by itself. All numbers that share a
selector are packed and unpacked in one step.

A file is a row of segments. A segment holds whole documents: their keys, their lengths and all their ids. The manifest
names each segment's file and place in it; only files of tasks that succeeded are in it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, scratch_folder, ship_code, steps, written
from .id_batches import batch_encoder

#: Numbers and bits of a word, by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
#: Selectors from the one that takes most numbers to the one that takes any below 2^60.
GREEDY = (15, *range(1, 15))
BLOCK = 1024
#: Ids after which a segment ends with the document; a document lies in one segment.
SEGMENT = 1 << 20
MAGIC = b"S8B1"
#: Magic, block size, documents, ids, words of keys, lengths, and ids, crc32 of all that follows.
HEADER = struct.Struct("<4sIQQQQQI")


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of whole numbers (unsigned 64 bits), and the first word of each block of ``block`` numbers."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    # Bits of each number, a block to a row, and 127 where the last row has none. Rounding to a float may only make a
    # number seem wider.
    width = np.full((-(-n // block), block), 127, np.int8)
    width.reshape(-1)[:n] = np.frexp(values.astype(np.float64))[1]
    # Greatest width of the 1, 2, 4, ... numbers from each place on; two of these cover a word's numbers.
    spans = [width]
    while 2 << len(spans) - 1 <= min(block, COUNTS.max()):
        one, k = spans[-1], 1 << len(spans) - 1
        spans.append(np.maximum(one[:, :-k], one[:, k:]))
    choice = np.zeros(width.shape, np.int8)
    for s in reversed(GREEDY):
        count = int(COUNTS[s])
        if count <= block:
            span = spans[count.bit_length() - 1]
            far = count - (1 << count.bit_length() - 1)
            fits = np.maximum(span[:, : block - count + 1], span[:, far : far + block - count + 1]) <= BITS[s]
            np.copyto(choice[:, : block - count + 1], np.int8(s), where=fits)
    choice = choice.reshape(-1)
    ends = np.minimum(np.arange(block, n + block, block), n)
    # One lane per block walks from word to word.
    at, last = np.arange(0, n, block), ends
    begins = np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + COUNTS[choice[at]]
        live = at < last
        at, last = at[live], last[live]
    starts = np.flatnonzero(begins)
    chosen = choice[starts].astype(np.int64)
    size = np.where(chosen == 0, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen):
        rows = chosen == s
        first, to = starts[rows], where[rows]
        if s == 0:
            words[to], words[to + 1] = values[first] >> np.uint64(32), values[first] & np.uint64(0xFFFFFFFF)
            continue
        word = np.full(len(first), np.uint64(s) << np.uint64(60))
        if BITS[s]:
            for i in range(COUNTS[s]):
                word |= values[first + i] << np.uint64(i * BITS[s])
        words[to] = word
    return words, where[np.searchsorted(starts, np.arange(0, n, block))].astype(np.uint32)


def unpack(words: np.ndarray) -> np.ndarray:
    """The numbers of words; any row of whole blocks will do."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    escape = chosen == 0
    # Escapes come in pairs; the second word of a pair adds no number.
    second = escape & (np.cumsum(escape) % 2 == 0)
    many = np.where(second, 0, COUNTS[chosen])
    to = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for s in np.unique(chosen):
        if s == 0:
            upper = np.flatnonzero(escape & ~second)
            out[to[upper]] = body[upper] << np.uint64(32) | body[upper + 1]
        elif BITS[s]:
            rows = np.flatnonzero(chosen == s)
            mask = np.uint64((1 << int(BITS[s])) - 1)
            first, part = to[rows], body[rows]
            for i in range(COUNTS[s]):
                out[first + i] = part >> np.uint64(i * BITS[s]) & mask
    return out


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1 ^ x >> 63).view(np.uint64)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def write_segment(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of the documents ``keys`` (64-bit, null allowed, as differences) of ``lengths`` ids each."""
    null = np.array([k is None for k in keys], np.uint64)
    known = np.array([0 if k is None else k for k in keys], np.int64)
    head, _ = pack(np.concatenate([null, _zigzag(np.diff(known, prepend=np.int64(0)))]), block)
    sizes, _ = pack(lengths, block)
    words, blocks = pack(ids, block)
    parts = [x.astype("<u8").tobytes() for x in (head, sizes)] + [blocks.astype("<u4").tobytes(), words.astype("<u8").tobytes()]
    rest = b"".join(parts)
    return HEADER.pack(MAGIC, block, len(keys), len(ids), len(head), len(sizes), len(words), zlib.crc32(rest)) + rest


class Segment:
    """A segment as read: ``keys``, ``lengths``, and ids by block or whole."""

    def __init__(self, data: bytes):
        magic, self.block, docs, self.n, head, sizes, words, crc = HEADER.unpack_from(data)
        if magic != MAGIC or zlib.crc32(memoryview(data)[HEADER.size :]) != crc:
            raise ValueError("not a segment of token ids, or a damaged one")
        at, blocks = HEADER.size, -(-self.n // self.block)
        first = unpack(np.frombuffer(data, "<u8", head, at))
        known = np.cumsum(_unzigzag(first[docs:]))
        self.keys = [None if none else k for none, k in zip(first[:docs].tolist(), known.tolist(), strict=True)]
        self.lengths = unpack(np.frombuffer(data, "<u8", sizes, at + 8 * head)).astype(np.int64)
        at += 8 * (head + sizes)
        self.first = np.frombuffer(data, "<u4", blocks, at)
        self.words = np.frombuffer(data, "<u8", words, at + 4 * blocks)

    def of_block(self, k: int) -> np.ndarray:
        """Ids of block ``k`` alone."""
        end = self.first[k + 1] if k + 1 < len(self.first) else len(self.words)
        return unpack(self.words[self.first[k] : end])

    def ids(self) -> np.ndarray:
        return unpack(self.words)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def write(
    docs: DataFrame, path: str, pattern: str, end: int | None = 2, folder: str | None = None, key: str = "doc_id",
    segment: int = SEGMENT, block: int = BLOCK,
) -> DataFrame:
    """Writes the ids of all documents, in ascending order of ``key``, and returns the manifest.

    Each text's ids (null and empty: none) are followed by ``end``. ``key`` is a whole number; null comes first, equal
    keys are ordered by their text's hash, repeated rows are written as often as they come. Columns beside ``key`` and
    ``text`` are not read. A document of any length lies in one segment. An empty table gives an empty manifest.

    Texts are sorted over all tasks, once, and each task writes one file below ``folder`` (default: a new one in the
    scratch folder), whose address pyarrow must know. An attempt writes a file of its own name, so a task that runs
    again harms nothing. The manifest has one row per segment: shard, number (order in the shard), file, place, bytes,
    n_docs, n_ids. Files are written when this function is called.
    """
    spark = docs.sparkSession
    ship_code(spark)
    folder = (folder or f"{scratch_folder(spark).rstrip('/')}/llm-token-files-{uuid.uuid4().hex}").rstrip("/")
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col("text").cast("string").alias("text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order, "text")
    names = ["shard", "number", "file", "place", "bytes", "n_docs", "n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, one = TaskContext.get().partitionId(), batch_encoder(path, pattern)
        store, top = _store(folder)
        name = f"{top}/part-{shard:06d}-{uuid.uuid4().hex}.s8b"
        out, made = None, []
        keys: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def close() -> None:
            nonlocal out
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(name)
            ids = np.concatenate(parts)
            data = write_segment(keys, np.array(lengths, np.uint64), ids, block)
            made.append((shard, len(made), name, out.tell(), len(data), len(keys), len(ids)))
            out.write(data)
            keys.clear(), lengths.clear(), parts.clear()

        for batch in steps(batches):
            ids, places = one.encode(batch.column("text").to_pylist(), end)
            begin, held = 0, sum(lengths)
            for i, k in enumerate(batch.column("_key").to_pylist()):
                keys.append(k)
                lengths.append(places[i + 1] - places[i])
                held += lengths[-1]
                if held >= segment:
                    parts.append(ids[begin : places[i + 1]])
                    begin, held = places[i + 1], 0
                    close()
            parts.append(ids[begin:])
        if keys:
            close()
        if out is not None:
            out.close()
        columns = list(zip(*made, strict=True)) or [()] * len(names)
        types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "shard int, number int, file string, place long, bytes long, n_docs long, n_ids long"
    manifest = ranged.mapInArrow(run, schema)
    return written(manifest.withColumn("folder", F.lit(folder)), "token-manifest")


def read(manifest: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: ``key``, start (ids of all documents before it), n_tokens, ids_crc32.

    The crc is that of the ids as little-endian unsigned 32-bit numbers; ``with_ids`` adds them as such (binary). Tasks
    read a segment at a time. The starts are summed over the manifest, one row per million ids.
    """
    spark = manifest.sparkSession
    ship_code(spark)
    before = Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = based.repartition(parallelism(spark), "shard", "number").select("folder", "file", "place", "bytes", "base")
    names = ["_key", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = _store(row["folder"])
                with store.open_input_file(row["file"]) as f:
                    one = Segment(f.read_at(row["bytes"], row["place"]))
                ids = memoryview(one.ids().astype("<u4")).cast("B")
                ends = np.cumsum(one.lengths)
                starts = ends - one.lengths
                cuts = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array(one.keys, pa.int64()), pa.array(starts + row["base"]), pa.array(one.lengths)]
                arrays.append(pa.array(list(map(zlib.crc32, cuts)), pa.int64()))
                if with_ids:
                    arrays.append(pa.array(list(map(bytes, cuts)), pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "_key long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return spread.mapInArrow(run, schema).withColumnRenamed("_key", key)
