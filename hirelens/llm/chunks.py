"""Document fingerprints from content-defined chunks.

A gear hash of the last 16 bytes is normalised: before the normal size a cut
needs seven zero bits, after it five. Chunks between cuts depend on content
alone, so text that moves keeps its chunks. A fingerprint is the set of chunk
digests with their lengths; likeness is the share of bytes of the first that
the second contains.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLEST, NORMAL, LARGEST = 16, 48, 255
STRICT, LOOSE = 1 << (16 - 7), 1 << (16 - 5)
DIGEST_DIGITS = 10
BLOCK = 1 << 22
LAST_ID = 2**63 - 1
LIKENESS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def gear_table() -> np.ndarray:
    """16 random bits for each byte, by rule."""
    return np.array(
        [int.from_bytes(hashlib.sha256(b"gear%d" % b).digest()[:2], "little") for b in range(256)],
        np.uint16,
    )


GEAR = gear_table()


def _candidates(data: bytes) -> tuple[list[int], list[int]]:
    """Ends of chunks that the strict and the loose rule allow, in blocks of bounded memory."""
    strict, loose = [], []
    for at in range(0, len(data), BLOCK):
        back = min(at, 15)
        h = GEAR[np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at) + back, at - back)]
        for s in (1, 2, 4, 8):
            h[s:] += h[:-s] << s
        ends = np.flatnonzero(h[back:] < LOOSE)
        loose += (ends + (at + 1)).tolist()
        strict += (ends[h[back:][ends] < STRICT] + (at + 1)).tolist()
    return strict, loose


def cut_points(data: bytes) -> list[int]:
    """The ends of all chunks."""
    strict, loose = _candidates(data)
    ends, start, n = [], 0, len(data)
    i = j = 0
    n_strict, n_loose = len(strict), len(loose)
    while n - start > SMALLEST:
        i = bisect_left(strict, start + SMALLEST, i)
        if i < n_strict and strict[i] < start + NORMAL:
            end = strict[i]
        else:
            j = bisect_left(loose, start + NORMAL, j)
            end = loose[j] if j < n_loose and loose[j] <= start + LARGEST else start + LARGEST
        if end >= n:
            break
        ends.append(end)
        start = end
    if n > start:
        ends.append(n)
    return ends


def chunk_set(text: str) -> dict[str, int]:
    """Digest and length in bytes of each distinct chunk."""
    from xxhash import xxh64_hexdigest as digest

    data, start, found = text.encode(), 0, {}
    for end in cut_points(data):
        found[digest(data[start:end])[:DIGEST_DIGITS]] = end - start
        start = end
    return found


def fingerprint(chunks: dict[str, int]) -> str:
    """Digests in order, each followed by the chunk's length as two hex digits."""
    return "".join(sorted(f"{d}{n:02x}" for d, n in chunks.items()))


def parse(fingerprint: str) -> dict[str, int]:
    step = DIGEST_DIGITS + 2
    return {
        fingerprint[i : i + DIGEST_DIGITS]: int(fingerprint[i + DIGEST_DIGITS : i + step], 16)
        for i in range(0, len(fingerprint), step)
    }


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of the bytes of ``a`` that ``b`` contains. Nothing is like nothing, 1.0."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / total


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; the empty and the null text have the empty one."""

    @F.pandas_udf("string")
    def marked(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(chunk_set(t)) for t in texts], dtype=object)

    return docs.select("doc_id", marked(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def with_successors(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(range, extra, doc, doc_id, text), in partitions sorted by the first three and text.

    Ids are split into ranges; the first document of each range is repeated at
    the end of the range before (``extra``), the very first at the end of the
    last. So every document is followed by its successor in its own partition
    and each text is shuffled once.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    shares = [i / ranges for i in range(1, ranges)]
    ids = rows.select("doc")
    bounds = sorted(set(ids.agg(F.percentile_approx("doc", shares)).first()[0] or [])) if shares else []
    # The number of bounds below an id, found in an array that is a constant.
    if bounds:
        table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        number = F.size(F.filter(table, lambda b: b < F.col("doc")))
    else:
        number = F.lit(0)
    firsts = sorted(ids.groupBy(number.alias("range")).agg(F.min("doc").alias("doc")).collect())
    before = [(f.doc, firsts[i - 1].range) for i, f in enumerate(firsts)]  # a row per range
    heads = F.broadcast(spark.createDataFrame(before, "doc long, before int"))
    places = F.array(
        F.struct(F.col("range"), F.lit(False).alias("extra")),
        F.struct(F.col("before").alias("range"), F.lit(True).alias("extra")),
    )
    return (
        rows.withColumn("range", number)
        .join(heads, "doc", "left")
        .withColumn("place", F.explode(F.when(F.col("before").isNull(), F.slice(places, 1, 1)).otherwise(places)))
        .select("place.range", "place.extra", "doc", "doc_id", "text")
        .repartition(ranges, "range")
        .sortWithinPartitions("range", "extra", "doc", "text")
    )


def edit(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None  # the document that waits for its successor
    names = [c.split()[0] for c in LIKENESS.split(", ")]
    for batch in batches:
        out = []
        for group, extra, doc_id, text in zip(batch["range"], batch["extra"], batch["doc_id"], batch["text"]):
            chunks = None
            if held is not None and held[0] == group:
                chunks = chunk_set(text)
                _, id_before, before, own = held
                edited = edit(before, text)
                new = chunk_set(edited)
                out.append(
                    (
                        id_before,
                        len(before),
                        hashlib.sha256(edited.encode()).hexdigest(),
                        fingerprint(own),
                        fingerprint(new),
                        likeness(own, new),
                        likeness(own, chunks),
                    )
                )
            held = None if extra else (group, doc_id, text, chunks if chunks is not None else chunk_set(text))
        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) against its edited text and the next document.

    The next document is the one with the next larger doc_id; after the last
    comes the first (a single document follows itself). Rows that share an id
    follow each other by text; a null id is the largest. No rows give no rows.
    """
    return with_successors(docs).select("range", "extra", "doc_id", "text").mapInPandas(_compared, LIKENESS)
