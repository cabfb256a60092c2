"""Secrets, told from widely copied examples by how many owners of the corpus hold the same value.

Candidates of all documents are hashed; for each hash the distinct repositories and owners are counted over the whole
corpus. A value that many owners hold is an example that was copied around; a value that only its owner holds looks
live. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Patterns of the base, fixed by the contract of the scan: kind, pattern, group that holds the value, least length of
#: that group. Runs of hex digits and access keys carry their least length in the pattern, which finds the same spans,
#: as a match always takes its whole run.
BASE = (
    (
        "assign",
        r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that the method adds where the value belongs to few owners.
ADDED = (
    ("prefixed", r"(?<![A-Za-z0-9_])(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_)[A-Za-z0-9_-]{16,}", 0, 20),
    ("keyblock", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", 0, 32),
    ("webtoken", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24),
)
BASE_KINDS = tuple(k for k, *_ in BASE)
KINDS = (*BASE_KINDS, *(k for k, *_ in ADDED))


def _found(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, ord, end, value) of one kind, in code points.

    The text between the matches and the matches alternate, so the running sum of their lengths gives the places.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int,value:string>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + x["gap"]
        end = at + F.length(x["hit"])
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        span = F.struct(at.alias("start"), F.lit(order).alias("ord"), end.alias("end"), value.alias("value"))
        good = F.length(value) >= least
        return F.when(
            x["hit"].isNull(), state
        ).otherwise(
            F.struct(
                end.alias("at"),
                F.when(good, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
            )
        )

    spans = F.aggregate(lengths, start, step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(
        F.array().cast("array<struct<start:int,ord:int,end:int,value:string>>")
    )


def candidates(docs: DataFrame, keep: list[str], repository: str, owner: str) -> DataFrame:
    """Columns _keep (struct of ``keep``), _repo, _owner and _spans: all candidates by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = [_found(F.col("_text"), i, *k) for i, k in enumerate((*BASE, *ADDED))]
    rows = docs.select(
        F.struct(*keep).alias("_keep"),
        F.col(repository).cast("string").alias("_repo"),
        F.col(owner).cast("string").alias("_owner"),
        text.alias("_text"),
    )
    return rows.select("_keep", "_repo", "_owner", F.array_sort(F.concat(*kinds)).alias("_spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: how many rows, distinct repositories and distinct owners hold it.

    Counted in two steps, first once per (value, repository, owner), so that a value with very many copies is
    summed up before it is shuffled and no set is gathered.
    """
    once = found.groupBy("hash", "_repo", "_owner").agg(F.count("*").alias("n"))
    by_repo = once.groupBy("hash", "_repo").agg(F.sum("n").alias("n"))
    by_owner = once.groupBy("hash", "_owner").agg(F.lit(1).alias("one"))
    repos = by_repo.groupBy("hash").agg(F.sum("n").alias("n_copies"), F.count("_repo").alias("n_repositories"))
    owners = by_owner.groupBy("hash").agg(F.count("_owner").alias("n_owners"))
    return repos.join(owners, "hash")


def scan(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    repository: str = "source",
    owner: str = "source",
    max_owners: int = 1,
) -> DataFrame:
    """Per document: ``keep``, counts of the base kinds, base_sha256, spans, n_live and n_example.

    ``spans`` lists all spans of the base and those added spans whose value at most ``max_owners`` owners hold; by
    start, then kind. In how many places they hold it doesn't matter. Of all listed spans, n_live are as rare as that
    and n_example are not. Null and empty texts have none. A null repository or owner is no owner; a value without any
    owner is judged by its repositories.
    """
    keep_list = list(keep)
    per_doc = candidates(docs, keep_list, repository, owner)
    per_doc = written(per_doc.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    found = per_doc.where(F.size("_spans") > 0).select(
        "_row", "_repo", "_owner", F.explode("_spans").alias("span")
    ).withColumn("hash", F.sha2(F.col("span.value"), 256))
    verdict = ownership(found.select("hash", "_repo", "_owner")).select(
        "hash", F.expr(f"if(n_owners > 0, n_owners, n_repositories) <= {max_owners}").alias("live")
    )
    bases = len(BASE_KINDS)
    judged = (
        found.select("_row", "span.start", "span.ord", "span.end", "hash")
        .join(verdict, "hash")
        .where(F.col("live") | (F.col("ord") < bases))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end", "live"))).alias("_judged"))
    )
    kind = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", kind[x["ord"]], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    none = F.array().cast("array<struct<start:int,ord:int,end:int,live:boolean>>")
    has = per_doc.where(F.size("_spans") > 0).select("_row", "_keep").join(judged, "_row", "left")
    without = per_doc.where(F.size("_spans") == 0)
    rows = has.select("_keep", F.coalesce("_judged", none).alias("_judged")).unionByName(
        without.select("_keep", none.alias("_judged"))
    )
    count = lambda test: F.size(F.filter("_judged", test)).cast("long")
    return rows.select(
        *(F.col("_keep")[c].alias(c) for c in keep_list),
        *(count((lambda i: lambda x: x["ord"] == i)(i)).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)),
        F.sha2(listed(F.filter("_judged", lambda x: x["ord"] < bases)), 256).alias("base_sha256"),
        listed(F.col("_judged")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
    )
