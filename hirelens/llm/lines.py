"""Line dedup over levelled sorted runs of line keys.

A batch of documents is anti-joined with the runs of earlier batches; keys that
no run holds become a new run. Runs are tables bucketed and sorted by key, so a
later anti-join moves only the batch. ``fanout`` runs of a level are merged into
one of the next. DataFrame functions only.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.sources.shared import scratch_folder

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1
KEY = ["h1", "h2"]


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _document():
    """A null id is the largest; rows that share an id but not the text keep their own lines."""
    return F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("version")


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per line whose key is long enough: doc, version, pos, h1, h2 (128 bits)."""
    lines = docs.select(*_document(), F.posexplode(_lines()).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER)
    return (
        lines.select("doc", "version", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            "doc",
            "version",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
        )
    )


class LineRuns:
    """Runs of (h1, h2, owner): each key seen so far in exactly one run, with its document."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 3, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = defaultdict(list)

    @property
    def runs(self) -> list[str]:
        return [name for level in sorted(self.levels) for name in self.levels[level]]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{self.folder}/{name}")
            .saveAsTable(name)
        )
        return name

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch whose documents all come after the earlier ones.

        Returns (doc, version, pos) of the lines that lose.
        """
        fresh = keys.groupBy(*KEY).agg(F.min("doc").alias("owner"))
        for run in self.runs:
            fresh = fresh.join(self.spark.table(run).select(*KEY), KEY, "left_anti")
        own = self._write(fresh)
        self.levels[0].append(own)
        # Read as plain files, the run is shuffled like the batch, so a join skewed by a very
        # common line can be split.
        first = self.spark.read.schema(fresh.schema).parquet(f"{self.folder}/{own}")
        lost = keys.join(first, KEY, "left").where(
            F.col("owner").isNull() | (F.col("owner") < F.col("doc"))
        )
        return lost.select("doc", "version", "pos")

    def compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for run in old[1:]:
                merged = merged.unionAll(self.spark.table(run))
            self.levels[level + 1].append(self._write(merged))
            self.levels[level] = []
            for run in old:
                self.spark.sql(f"DROP TABLE {run}")
            level += 1

    def close(self) -> None:
        """Forget the runs in the session's catalog; their files stay."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE {run}")
        self.levels.clear()


def lost_lines(docs: DataFrame, *, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc, version, pos) of all lines to drop: documents go in as batches by ascending id."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "lines")
    shares = [i / batches for i in range(1, batches)]
    ids = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"))
    bounds = ids.agg(F.percentile_approx("doc", shares)).first()[0] if shares else []
    batch = sum(((F.col("doc") > b).cast("int") for b in bounds or []), F.lit(0))
    keys = line_keys(docs, min_chars).withColumn("batch", batch)
    keys.write.partitionBy("batch").parquet(f"{folder}/keys")
    written = spark.read.schema(keys.schema).parquet(f"{folder}/keys")
    runs = LineRuns(spark, f"{folder}/runs", fanout)
    out = f"{folder}/lost"
    lost = None
    for number in range(len(bounds or []) + 1):
        lost = runs.add(written.where(F.col("batch") == number).drop("batch"))
        lost.write.mode("append").parquet(out)
        runs.compact()
    found = spark.read.schema(lost.schema).parquet(out)
    runs.close()
    return found


def kept_lines(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of ``docs`` and its other lines, joined.

    A document whose lines are all dropped has an empty text; a null text is
    one empty line and comes out as the empty text.
    """
    gone = lost.groupBy("doc", "version").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), "text", *_document())
    rows = rows.join(gone, ["doc", "version"], "left").withColumn("lines", _lines())
    # What stays between two dropped lines is a slice; so the work is linear in the lines.
    ends = F.concat("gone", F.array(F.size("lines")))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    spans = F.zip_with(starts, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a))
    none = F.col("gone").isNull()
    return rows.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(none, F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(F.flatten(spans), "\n"))
        .alias("kept"),
    )


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines left only in their smallest document.

    n_chars, if there, follows the new text.
    """
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept_lines(docs, lost_lines(docs, **how)).select(
        *(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns)
    )
