"""Secret scan with an incremental ledger of content-addressed blobs.

Every version of every document is addressed by the SHA-256 of its text. A
ledger holds (blob, rule_version, spans) of what was scanned before; only pairs
it lacks are scanned, once each, and findings go back to all documents by blob.
Beside a ledger that is kept stands the table of all versions, (doc_id, blob), so
findings in texts that were replaced since can be told too. Both are read
without repeats: two writers, or a job that ran twice, do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.sources.shared import scratch_folder

# Kind, pattern, flags, group whose length counts, least length.
RULES = (
    (
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 0, 16),  # runs of the class are maximal, so shorter ones never count
)
LEDGER = "blob string, rule_version string, spans string"
VERSIONS = "doc_id string, blob string"
LAST_ID = 2**63 - 1


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr([(k, p, int(f), g, n) for k, p, f, g, n in rules]).encode()).hexdigest()[:16]


def spans_of(text: str, rules=RULES, compiled=None) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in code points, by start, then rule."""
    found = []
    for number, (rule, regex) in enumerate(zip(rules, compiled or [re.compile(r[1], r[2]) for r in rules])):
        for m in regex.finditer(text):
            if m.end(rule[3]) - m.start(rule[3]) >= rule[4]:
                found.append((m.start(), number, m.end()))
    return sorted(found)


def _scanner(rules):
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [re.compile(r[1], r[2]) for r in rules]
        for texts in batches:
            yield pd.Series(
                [
                    ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in spans_of(t, rules, compiled))
                    for t in texts
                ],
                dtype=object,
            )

    return F.pandas_udf(scan, "string")


def scan_new(docs: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Scan the blobs of ``docs`` (doc_id, text) that ``ledger`` lacks under these rules.

    The ledger (a Parquet folder, made if missing) grows by their findings,
    also by empty ones. Returns the ledger's rows for these rules.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    blobs = docs.select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("blob", F.sha2("text", 256))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    known = scanned(spark, ledger, rules)
    # One document stands for a blob; only it sends its text.
    unseen = (
        blobs.groupBy("blob")
        .agg(F.min("doc").alias("doc"))
        .join(known.select("blob"), "blob", "left_anti")
    )
    findings = blobs.join(unseen, ["doc", "blob"], "left_semi").select(
        "blob", _scanner(rules)(F.col("text")).alias("spans")
    )
    (
        findings.groupBy("blob")  # repeated rows share id and blob
        .agg(F.max("spans").alias("spans"))
        .select("blob", F.lit(version).alias("rule_version"), "spans")
        .write.mode("append")
        .parquet(ledger)
    )
    return scanned(spark, ledger, rules)


def scanned(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """The ledger's rows for these rules, one for each blob."""
    version = rule_version(rules)
    rows = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == version)
    once = rows.groupBy("blob").agg(F.max("spans").alias("spans"))
    return once.select("blob", F.lit(version).alias("rule_version"), "spans")


def _findings(ledger_rows: DataFrame) -> DataFrame:
    return ledger_rows.where("spans <> ''").select("blob", "spans")


def _record_versions(paths: DataFrame, ledger: str) -> None:
    """Add the (doc_id, blob) pairs of ``paths`` that the table of versions lacks."""
    spark, folder = paths.sparkSession, f"{ledger}-versions"
    spark.createDataFrame([], VERSIONS).write.mode("append").parquet(folder)
    known = spark.read.schema(VERSIONS).parquet(folder)
    pairs = paths.select(F.col("doc_id").cast("string").alias("doc_id"), "blob").distinct()
    same = (pairs["doc_id"].eqNullSafe(known["doc_id"])) & (pairs["blob"] == known["blob"])
    pairs.join(known, same, "left_anti").write.mode("append").parquet(folder)


def history(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """(doc_id: string, blob, spans) of every version of a document that was scanned with ``ledger``."""
    versions = spark.read.schema(VERSIONS).parquet(f"{ledger}-versions").distinct()
    found = _findings(scanned(spark, ledger, rules))
    return versions.join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.lit("")).alias("spans")
    )


def scan_documents(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``: ``kind:start:end`` joined by commas, or empty.

    Null and empty texts have no spans. Repeated rows are returned as often; no
    rows give no rows. A ``ledger`` that is named is kept, with all versions.
    """
    paths = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    if ledger is not None:
        _record_versions(paths, ledger)
    ledger = ledger or scratch_folder(docs.sparkSession, "ledger")
    found = _findings(scan_new(docs, ledger, rules))
    return paths.join(found, "blob", "left").select(
        "doc_id", F.coalesce("spans", F.lit("")).alias("spans")
    )


def cut(text: str, spans: str, mark: str) -> str:
    """``text`` with each span replaced; overlapping spans are one."""
    parts, done = [], 0
    for a, b in sorted(tuple(map(int, s.rsplit(":", 2)[1:])) for s in spans.split(",")):
        if a >= done:
            parts += [text[done:a], mark]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, ledger: str | None = None, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping ones by one); n_chars follows."""
    ledger = ledger or scratch_folder(docs.sparkSession, "ledger")
    found = _findings(scan_new(docs, ledger, rules))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut(t, s, mark) for t, s in zip(texts, spans)], dtype=object)

    rows = docs.select(F.struct("*").alias("row"), F.sha2("text", 256).alias("blob"))
    rows = rows.join(found, "blob", "left").withColumn("clean", cleaned("row.text", "spans"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("clean"))
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
