"""Packing of token sequences, online with bounded space.

Each task keeps a fixed number of open windows. A document's whole windows are cut off; what is left goes into the open
window with the least room that still takes it. If none does, the fullest window is emitted and a new one opened. The
windows still open at the end of the tasks are merged in rounds, many tasks' windows at a time; after a round at most
one window of a group is half empty, and only that one takes part in the next round.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code, steps, written
from .id_batches import batch_encoder

#: Windows that a task may write in its number space, as bits of the window's number.
TASK_BITS = 32
#: Tasks whose open windows are merged together in a round.
FAN = 16


class Windows:
    """The open windows of one task: a best-fit store of (room, window number)."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.rooms: list[tuple[int, int]] = []

    def whole(self) -> int:
        """Number of a window that is full at once."""
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece shorter than a window."""
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                self.rooms.pop(0)  # the fullest is emitted
            room, window = self.size, self.whole()
        if room > length:
            insort(self.rooms, (room - length, window))
        return window, self.size - room


def merge_group(units: pd.DataFrame, size: int) -> pd.DataFrame:
    """Best-fit decreasing of whole windows: unit, the unit that begins its bin, its base there, the bin's fill."""
    bins: list[tuple[int, int]] = []
    fills: dict[int, int] = {}
    rows = []
    for unit, fill in sorted(zip(units["unit"].tolist(), units["fill"].tolist(), strict=True), key=lambda x: (-x[1], x[0])):
        at = bisect_left(bins, (fill, -1))
        room, first = bins.pop(at) if at < len(bins) else (size, unit)
        rows.append((unit, first, size - room))
        fills[first] = size - room + fill
        if room > fill:
            insort(bins, (room - fill, first))
    out = pd.DataFrame(rows, columns=["unit", "bin", "base"])
    out["bin_fill"] = out["bin"].map(fills)
    return out


def merge_windows(units: DataFrame, size: int) -> DataFrame:
    """Columns unit, sequence_id and base for windows left open (unit, fill), a unit's task in its upper bits."""
    ship_code(units.sparkSession)
    tasks = (units.agg(F.max(F.shiftright("unit", TASK_BITS))).first()[0] or 0) + 1
    schema = "unit long, bin long, base int, bin_fill int"
    found, span = None, FAN
    while True:
        group = F.floor(F.shiftright("unit", TASK_BITS) / span)
        merged = written(
            units.groupBy(group.alias("_group")).applyInPandas(lambda x: merge_group(x, size), schema), "packing-round"
        )
        if found is None:
            found = merged.select("unit", F.col("bin").alias("sequence_id"), "base")
        else:
            step = merged.select(F.col("unit").alias("sequence_id"), "bin", F.col("base").alias("_more"))
            found = found.join(step, "sequence_id", "left").select(
                "unit",
                F.coalesce("bin", "sequence_id").alias("sequence_id"),
                (F.col("base") + F.coalesce("_more", F.lit(0))).alias("base"),
            )
        if span >= tasks:
            return found
        units = merged.where(F.col("unit") == F.col("bin")).select("unit", F.col("bin_fill").alias("fill"))
        units = units.where(F.col("fill") * 2 <= size)
        span *= FAN


def pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    size: int = 2048,
    end: int | None = 1,
    open_windows: int = 64,
    key: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    A document is its token ids (strings of special tokens count as these, as the tokenizers library has it) and the id
    ``end``; null and empty texts are that id alone. Every id lies in one piece. Pieces fill a sequence from offset 0
    without gaps. Repeated rows are packed as often as they come. Where ``end`` is None, documents without ids give no
    row.
    """
    spark = docs.sparkSession
    ship_code(spark)
    docs = docs.select(F.col(key).alias("_key"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["_key"].dataType.simpleString()
    numbers = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    numbers += [("window", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << TASK_BITS
        windows = Windows(size, open_windows, first)
        one = batch_encoder(path, pattern)
        held: dict[int, list[tuple]] = {}

        def out(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (len(numbers) + 2)
            arrays = [pa.array(columns[0], key_type)]
            arrays += [pa.array(c, t) for c, (_, t) in zip(columns[1:], numbers, strict=False)]
            names = ["_key", *(n for n, _ in numbers)]
            if with_ids:
                arrays.append(pa.array(columns[-1], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        key_type = None
        for batch in steps(batches):
            key_type = batch.column("_key").type
            keys = batch.column("_key").to_pylist()
            rows = []
            ids, places = one.encode(batch.column("text").to_pylist(), end)
            view = memoryview(ids).cast("B")
            for k, first_id, last in zip(keys, places, places[1:]):
                n = last - first_id
                for start in range(0, n, size):
                    length = min(size, n - start)
                    part = view[4 * (first_id + start) : 4 * (first_id + start + length)]
                    crc = zlib.crc32(part)
                    kept = bytes(part) if with_ids else None
                    if length == size:
                        rows.append((k, start, length, crc, n, windows.whole(), 0, False, kept))
                    else:
                        window, offset = windows.place(length)
                        held.setdefault(window, []).append((k, start, length, crc, n, window, offset, False, kept))
            still = {w for _, w in windows.rooms}
            for w in [w for w in held if w not in still]:
                rows += held.pop(w)
            if rows:
                yield out(rows, key_type)
        if held:
            yield out([(*r[:7], True, r[8]) for rows in held.values() for r in rows], key_type)

    schema = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"
    pieces = written(docs.mapInArrow(run, schema + (", ids binary" if with_ids else "")), "packing")
    left = pieces.where("open")
    fills = left.groupBy(F.col("window").alias("unit")).agg(F.sum("length").cast("int").alias("fill"))
    merged = merge_windows(written(fills, "packing-open"), size)
    columns = [F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens"]
    more = ["ids"] if with_ids else []
    done = pieces.where("not open").select(*columns, F.col("window").alias("sequence_id"), "offset", *more)
    rest = left.join(merged, F.col("window") == F.col("unit")).select(
        *columns, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"), *more
    )
    return done.unionByName(rest)
