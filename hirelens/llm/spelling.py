"""Spelling variants: words one edit apart, each with the frequent form it stands for.

The vocabulary is dealt into groups of words in which the edit can only lie in
one window: two words one edit apart share all letters before the window's half
or all after it. Groups that are too large are halved again; a window of one
letter bounds a group by the alphabet, so no group is unbounded and no word is
left out. Inside a group the words are sorted, and each of them is compared by
one scan of that list: the rows of a banded edit matrix are kept by depth, those
of the prefix shared with the word before are reused, and once every cell of a
row exceeds one edit all words with that prefix are skipped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.sources.shared import scratch_folder, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]+"
AFTER_ALL = "\U0010ffff"
FOUND = "word string, near long, best_n long, best string"
# Words per group beyond which it is halved, and rows of a scanning task.
GROUP, TASK = 128, 200_000


def occurrences(docs: DataFrame) -> DataFrame:
    """(word) for every run of letters in (doc_id, text), A-Z lower-cased.

    One (document, run) in 97, by CRC-32 of ``<doc_id>:<run>``, loses a letter.
    A null text has no runs; a null doc_id counts as an empty string.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"),
    ).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, *, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""
    counted = words.where(F.length("word") >= min_length).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def windows(words: DataFrame, min_length: int = 5) -> DataFrame:
    """(word, n, m, a, b): the edit lies between the first ``a`` and the last ``b`` letters.

    m is the length of the shorter word of a pair; a word is the shorter or the
    longer one, so it is there with its own length and, if that is in the
    vocabulary at all, the length before it.
    """
    size = F.length("word")
    both = F.when(size > min_length, F.array(size - 1, size)).otherwise(F.array(size))
    return words.select("word", "n", F.explode(both).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))


def halved(rows: DataFrame) -> DataFrame:
    """Every row twice: for an edit in the second half of its window, and in the first."""
    free = F.col("m") - F.col("a") - F.col("b")
    half = F.floor(free / 2).cast("int")
    late = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    early = F.struct(F.col("a").alias("a"), (F.col("b") + free - half).alias("b"))
    return rows.select("word", "n", "m", F.explode(F.array(late, early)).alias("x")).select("word", "n", "m", "x.*")


def group_key() -> Column:
    """The exact letters outside the window, with its place."""
    word = F.col("word")
    tail = word.substr(F.length(word) - F.col("b") + 1, F.col("b"))
    return F.concat_ws(":", "m", "a", "b", word.substr(F.lit(1), F.col("a")), tail)


def scan(query: str, rests: list[str], shared: list[int]) -> list[int]:
    """Places in the sorted ``rests`` of those one edit from ``query``, as long or one longer.

    ``shared[j]`` is the length of the common prefix of rests j - 1 and j. A row
    holds three cells of the matrix: the prefix of a rest against that of the
    query one shorter, as long, and one longer; 2 stands for all above one.
    """
    k = len(query)
    rows = [(2, 0, 1 if k else 2)]
    found, j, n = [], 0, len(rests)
    while j < n:
        rest = rests[j]
        i = min(len(rows) - 1, shared[j])
        del rows[i + 1 :]
        x, y, z = rows[i]
        alive = True
        while i < len(rest):
            c = rest[i]
            left = x if i and c == query[i - 1] else x + 1
            x2 = min(y + 1, left)
            if i < k:
                y2 = min(z + 1, x2 + 1, y if c == query[i] else y + 1)
                z2 = min(y2 + 1, z if c == query[i + 1] else z + 1) if i + 1 < k else 2
            else:
                y2 = z2 = 2
            x, y, z = min(x2, 2), min(y2, 2), min(z2, 2)
            i += 1
            rows.append((x, y, z))
            if x > 1 and y > 1 and z > 1:
                alive = False
                break
        if alive:
            if (y if i == k else x) == 1:
                found.append(j)
            j += 1
        else:
            j = bisect_right(rests, rest[:i] + AFTER_ALL, j + 1)
    return found


def common(u: str, v: str) -> int:
    """Length of the common prefix."""
    n = min(len(u), len(v))
    if u[:n] == v[:n]:
        return n
    i = 0
    while u[i] == v[i]:
        i += 1
    return i


def near_in_group(words: list[str], counts: list[int], m: int, a: int, b: int) -> list[tuple[str, int, int, str]]:
    """(word, near, best_n, best) of one group, counting each pair in one group only.

    A pair belongs to the window that holds its first difference; the last
    window also holds the end of the shorter word.
    """
    k = m - a - b
    order = sorted((w[a : len(w) - b], w, n) for w, n in zip(words, counts))
    rests = [r for r, _, _ in order]
    shared = [0, *(common(u, v) for u, v in zip(rests, rests[1:]))]
    near: dict[int, int] = {}
    best: dict[int, tuple[int, str]] = {}

    def link(i: int, j: int) -> None:
        near[i] = near.get(i, 0) + 1
        other = (-order[j][2], order[j][1])
        if i not in best or other < best[i]:
            best[i] = other

    for i, query in enumerate(rests):
        if len(query) != k:
            continue
        for j in scan(query, rests, shared):
            if b and common(query, rests[j]) >= k:
                continue
            link(i, j)
            if len(rests[j]) > k:
                link(j, i)
    return [(order[i][1], n, -best[i][0], best[i][1]) for i, n in near.items()]


def groups_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(words, counts, m, a, b) of one group after the other, from rows sorted by key."""
    now, words, counts, where = None, [], [], ()
    for batch in batches:
        columns = (batch[c].tolist() for c in ("key", "word", "n", "m", "a", "b"))
        for key, word, n, *place in zip(*columns):
            if key != now:
                if len(words) > 1:
                    yield words, counts, *where
                now, words, counts, where = key, [], [], place
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield words, counts, *where


def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, rows = [c.split()[0] for c in FOUND.split(", ")], []
    for group in groups_of(batches):
        rows += near_in_group(*group)
        if len(rows) >= 20_000:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    yield pd.DataFrame(rows, columns=names).astype({"near": "int64", "best_n": "int64"})


def near_words(words: DataFrame, *, min_length: int = 5, group: int = GROUP) -> DataFrame:
    """(word, near, best_n, best): how many words are one edit away, and the most frequent of them.

    ``words`` is (word, n), each word once, none shorter than ``min_length``.
    Words with nothing near are left out. Ties go to the smallest word in
    code-point order. Groups above ``group`` words are halved until their
    window is one letter wide: what is left differs by one or two letters.
    """
    spark = words.sparkSession
    folder = scratch_folder(spark, "spelling")
    rows, settled = halved(windows(words, min_length)), None
    for number in count():
        keyed = stored(rows.withColumn("key", group_key()), f"{folder}/{number}")
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sizes = stored(sizes, f"{folder}/{number}-sizes")
        large = (F.col("size") > group) & (F.expr("m - a - b") > 1)
        small = keyed.join(sizes, "key").where(~large).drop("size")
        settled = small if settled is None else settled.unionAll(small)
        hot = sizes.where(F.col("size") > group)
        if hot.isEmpty():
            break
        rows = halved(keyed.join(hot, "key").where(large))
    settled = stored(settled, f"{folder}/settled")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-settled.count() // TASK))
    pairs = settled.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(scanned, FOUND)
    order = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("top")
    return (
        pairs.groupBy("word")
        .agg(F.sum("near").alias("near"), order)
        .select("word", "near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain word, form, form of that, ... ends, for (word, form).

    Every round doubles the steps taken, so the rounds grow with the logarithm
    of the longest chain. Chains without an end are not allowed.
    """
    folder = scratch_folder(forms.sparkSession, "roots")
    now = stored(forms.select("word", F.col("form").alias("root")), f"{folder}/0")
    for number in count(1):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(
            now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"),
            f"{folder}/{number}",
        )
        if now.where("next is not null").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, *, min_length: int = 5, min_count: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (doc_id, text).

    A word's form is its near word with the largest n, if that is at least
    ``times`` its own. ``times`` must be 2 or more, which makes chains end.
    Repeated rows count as often as they occur; no rows give no words.
    """
    spark = docs.sparkSession
    words = vocabulary(occurrences(docs), min_length=min_length, min_count=min_count)
    words = stored(words, scratch_folder(spark, "vocabulary"))
    near = near_words(words, min_length=min_length)
    frequent = F.col("best_n") >= times * F.col("n")
    known = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("near", F.lit(0).cast("long")).alias("n_near"),
            F.when(frequent, F.col("best")).alias("form"),
            F.when(frequent, F.col("best_n")).alias("form_n"),
        ),
        scratch_folder(spark, "forms"),
    )
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
