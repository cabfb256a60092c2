"""Helpers shared by the operators: scratch tables, batches of bounded size, spans as text."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder as scratch_folder

#: Bytes of text that one step of a Python task handles at a time; a longer text is a step of its own.
STEP_BYTES = 4 << 20


#: Where the tables written within ``recorded`` are noted.
_notes: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Notes the folders of all tables that are written to the scratch folder meanwhile."""
    _notes.append([])
    try:
        yield _notes[-1]
    finally:
        _notes.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables that nothing reads any more, and empties the list."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again; the job runs at once.

    Later steps read files instead of repeating the work, and a lost executor costs no more than its own tasks. The
    tables stay until the owner of the folder clears it, as with checkpoints, or ``drop_tables`` is told of them.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    for note in _notes:
        note.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()
BATCH_ROWS, DEFAULT_BATCH_ROWS = 1500, "10000"


def ship_code(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once per application, so that their Python workers import them.

    Where the session leaves the rows of a batch for Python at Spark's default they become fewer, as documents are long.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == DEFAULT_BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, top))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def beside_text(docs: DataFrame) -> DataFrame:
    """Columns _doc, a struct of all columns but text, and text."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_doc"), "text")


def laid_flat(rows: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """The columns ``names`` again, from ``beside_text`` and the text in column ``text``."""
    return rows.select(*((F.col(text) if c == "text" else F.col("_doc")[c]).alias(c) for c in names))


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most STEP_BYTES of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > STEP_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start)


def map_texts(
    docs: DataFrame,
    keep: list[str],
    fields: list[tuple[str, str]],
    work: Callable[[list[str | None]], list[list]],
    with_text: bool = False,
) -> DataFrame:
    """Map-only pass: the columns ``keep`` as they are, and ``fields`` (name, SQL type) computed from column text.

    ``work`` gets the texts of one step and returns a list of values for each field. No other column of ``docs`` is
    read, so extra columns can't clash with the new ones. ``with_text`` returns column text as well.
    """
    ship_code(docs.sparkSession)
    docs = docs.select(*keep, F.col("text").cast("string").alias("text"))
    types = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "string": pa.string(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
        "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()),
    }
    kinds = dict(docs.dtypes)
    carried = [*keep, "text"] if with_text else keep
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carried] + [f"`{c}` {t}" for c, t in fields])
    names = [*carried, *(c for c, _ in fields)]
    arrow = [types[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            values = work(batch.column("text").to_pylist())
            columns = [batch.column(c) for c in carried]
            columns += [pa.array(v, t) for v, t in zip(values, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
