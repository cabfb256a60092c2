"""From documents to training sequences, in stages that each write what they keep.

Quality rules drop documents, of near duplicates one stays, byte strings that occur again go, personal data is replaced,
and what is left is packed. Each stage sees all that the one before kept; all but the last return the columns of
documents, n_chars counted anew where the text changed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapline.llm import packing, pii, quality, simhash, substrings
from snapline.llm.common import drop_tables, recorded, written

SHINGLE_WORDS, REPEAT_BYTES, SEQUENCE = 3, 200, 2048


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, SHINGLE_WORDS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substrings.cleaned(docs, REPEAT_BYTES))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, public_tokenizers.PATTERN, SEQUENCE)


#: Scratch tables of the stages called so far that are still there.
_scratch: list[str] = []


def _tidied(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes the scratch tables of the stages before that ``docs`` doesn't read.

    A stage's result is written before the next stage is called, so these are done with.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _scratch:
            files = docs.inputFiles()
            needed = [path for path in _scratch if any(f"{path.rpartition('/')[2]}/" in f for f in files)]
            drop_tables(docs.sparkSession, [path for path in _scratch if path not in needed])
            _scratch[:] = needed
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _scratch.extend(paths)
        return out

    return run_stage


STAGES = [
    (name, _tidied(stage))
    for name, stage in (
        ("quality", good_quality),
        ("near_duplicates", one_of_near_duplicates),
        ("repeated_passages", without_repeated_passages),
        ("personal_data", without_personal_data),
        ("packing", packed),
    )
]

#: No stage beyond the first is expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``.

    Null and empty texts fail the quality rules, so an empty table, or one of such texts, gives no pieces. Of repeated
    rows one stays. A text of any length is cleaned and packed whole. Columns beside doc_id and text are carried as they
    are to the last stage (n_chars is counted anew), the stratum ``lang`` of the quality rules among them. All stages but
    the last run when this function is called, each over what the one before wrote.
    """
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    _scratch.clear()
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with recorded() as paths:
            docs = written(made, f"pipeline-{name}")
        drop_tables(spark, old)
        old = paths
    return STAGES[-1][1](spark, docs, sf_dir)
