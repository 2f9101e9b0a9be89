"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed: its blob is the SHA-256 of its text.  The ledger holds which rule
versions have seen which blob, and what they found.  A scan takes each distinct blob once, leaves out the pairs of blob
and rule version that the ledger already has, runs the remaining rules over the whole text, adds the outcome to the
ledger and joins the findings back to all paths that ever held the blob.  A new rule, or a new version of one, so costs
one pass of that rule alone; a new version of a file costs one pass over its new content.

Distinct blobs are found by a grouping that keeps one text per blob and task before the shuffle, so a text that a third
of all rows share crosses the network once per task.  The findings of a blob are a short array; the join back to paths
is an ordinary equi-join whose hot keys Spark splits.

A finding names the rule and version that made it, and a reader asks for the versions it wants: findings of a replaced
version stay in the ledger and out of the result, and the order of rules is the reader's own.

Defined results: a null text counts as empty; each input row gets one result row, also repeated ones; an empty table
gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

ANY_CASE = re.ASCII | re.IGNORECASE


class Rule(NamedTuple):
    """A kind of secret: a match counts if the given group has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ANY_CASE, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", 1, r"[0-9a-f]+", least=24),
)
FURTHER_RULES = (
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + FURTHER_RULES

FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"
LEDGER = "blob_id string, rules array<string>, findings array<struct<start:int,end:int,rule:string>>"


def found(text: str, rules: Sequence[Rule]) -> list[tuple[int, int, str]]:
    """All matches of the rules in a text as (start, end, name of the rule)."""
    spans = []
    for rule in rules:
        # A long run of a hexadecimal digit can only be found whole, so asking for its least length at once is the same.
        pattern = rule.pattern[:-1] + f"{{{rule.least},}}" if rule.kind == "hex" and rule.pattern.endswith("+") else rule.pattern
        for match in re.compile(pattern, rule.flags).finditer(text):
            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                spans.append((match.start(), match.end(), rule.name))
    return sorted(spans)


def _scan_batches(rules: Sequence[Rule]):
    by_name = {rule.name: rule for rule in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [
                [dict(zip(("start", "end", "rule"), s, strict=True)) for s in found(text, [by_name[n] for n in names])]
                for text, names in zip(batch["text"], batch["rules"], strict=True)
            ]
            yield pd.DataFrame({"blob_id": batch["blob_id"], "rules": batch["rules"], "findings": spans})

    return scan


def content_address(versions: DataFrame, text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """One row per distinct blob with the rules that the ledger lacks for it: blob_id, text, rules."""
    names = F.array(*[F.lit(r.name) for r in rules])
    whole = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(content_address(versions, text).alias("blob_id"), whole.alias("text")).dropDuplicates(["blob_id"])
    if ledger is None:
        return blobs.withColumn("rules", names)
    seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
    left = F.array_except(names, F.coalesce("_seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob_id", "left").withColumn("rules", left).filter(F.size("rules") > 0).drop("_seen")


def scan(versions: DataFrame, *, paths: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES, ledger_path: str | None = None) -> DataFrame:
    """Scans what the ledger at ledger_path (a folder of Parquet, made if missing) has not seen, and adds to it.

    Returns the path columns, `blob_id` and `findings`, one row per version.  Without a path the ledger starts empty
    and lasts as long as the session.
    """
    spark = versions.sparkSession
    known = None
    if ledger_path:
        place = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            known = spark.read.schema(LEDGER).parquet(ledger_path)
    fresh = unseen(versions, known, rules, text).mapInPandas(_scan_batches(rules), LEDGER)
    if ledger_path:
        fresh.write.mode("append").parquet(ledger_path)
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    else:
        ledger, _ = written(fresh, "ledger")
    return findings_of(versions, ledger, paths=paths, text=text, rules=rules)


def findings_of(versions: DataFrame, ledger: DataFrame, *, paths: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """What the given rules, in their given versions, found in each version: struct(start, rank, end, kind), in that order.

    rank is the rule's place among the given ones.
    """
    names, kinds = F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    rank = lambda x: (F.array_position(names, x["rule"]) - 1).cast("int")
    placed = lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), F.get(kinds, rank(x)).alias("kind"))
    kept = ledger.filter(F.size("findings") > 0).groupBy("blob_id").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    wanted = F.filter("findings", lambda x: F.array_contains(names, x["rule"]))
    kept = kept.withColumn("findings", F.array_sort(F.array_distinct(F.transform(wanted, placed))))
    addressed = versions.select(*paths, content_address(versions, text).alias("blob_id"))
    none = F.array().cast(FINDINGS)
    return addressed.join(kept, "blob_id", "left").select(*paths, "blob_id", F.coalesce("findings", none).alias("findings"))


def as_text(findings: Column) -> Column:
    """Findings as kind:start:end, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_rank(rank: int):
    return lambda x: x["rank"] == rank


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = scan(docs, paths=["doc_id"])
    counts = [F.size(F.filter("findings", _of_rank(i))).cast("long").alias(f"n_{rule.kind}") for i, rule in enumerate(BASE_RULES)]
    base = F.filter("findings", lambda x: x["rank"] < len(BASE_RULES))
    return spans.select("doc_id", *counts, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("findings")).alias("spans"), "blob_id")
