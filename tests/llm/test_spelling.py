"""Spelling variants against brute force on small tables with odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hirelens.llm import spelling


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def ours(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    base += ["Zürich", "zürich", "straße", "abcde" * 30, "ab×cd", "résumé", "RÉSUMÉ"]
    rows = []
    for doc in range(80):
        words = []
        for _ in range(60):
            w = rng.choice(base[: rng.choice([5, 20, len(base)])])
            spot = rng.randrange(len(w))
            words.append(rng.choice([w, w, w.title(), w[:spot] + w[spot + 1 :], w[:spot] + "b" + w[spot:], w[:spot] + "é" + w[spot + 1 :]]))
        rows.append((doc, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return [*rows, *rows[:5], (None, "Word words words words"), (None, "Word words"), (90, None), (91, ""), (92, "1234 ЖЖЖЖЖ")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("word", "n", "run", "h", "key", "size", "root", "form", "near"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_against_brute_force(spark, texts):
    expected = brute(brute_words(texts))
    assert any(r[1] for r in expected) and any(r[1] and r[2] != r[1] for r in expected)
    assert ours(spelling.variants(frame(spark, texts))) == expected


@pytest.mark.parametrize("group", [2, 7, 100_000])
def test_halving_loses_and_repeats_nothing(spark, group):
    """Whatever the size at which groups are halved, each pair is counted once."""
    rng = random.Random(group)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(300)} | {"aaaaa", "aaaaaa", "aaaaaaa", "baaaaa"}
    counts = {w: rng.randint(3, 9) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: (r.near, r.best_n, r.best) for r in spelling.near_words(df, group=group).collect()}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        assert found.get(w) == (None if best is None else (len(near), counts[best], best))


def test_scan_skips_and_reuses():
    rests = sorted(["abcd", "abce", "abcde", "zzzz", "abcdd", "bbcd", "aabcd", "xbcx"])
    shared = [0, *(spelling.common(u, v) for u, v in zip(rests, rests[1:]))]
    hits = {rests[j] for j in spelling.scan("abcd", rests, shared)}
    assert hits == {"abce", "abcde", "bbcd", "abcdd", "aabcd"}


def test_long_chain_of_forms(spark):
    chain = [("a" * 5 + "bcdefghijk"[:i], 3 * 2**i) for i in range(10)]
    forms = [(w, chain[i + 1][0]) for i, (w, _) in enumerate(chain[:-1])]
    found = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r.root for r in found} == {chain[-1][0]} and len(found) == 9


def test_no_rows(spark):
    assert ours(spelling.variants(frame(spark, []))) == []
    assert ours(spelling.variants(frame(spark, [(1, None), (2, "too few words")]))) == []
