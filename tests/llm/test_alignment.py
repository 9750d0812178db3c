"""Alignment of two tokenizers against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hirelens.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True  # their strings are plain text here
    from hirelens.llm.packing import byte_alphabet

    letters = byte_alphabet()
    a_bytes = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        whole = (" " + text).encode()
        ok = b"".join(map(a_bytes, x)) == whole == b"".join(map(b_bytes, y))
        return ([(i, a_bytes(i)) for i in x], [(i, b_bytes(i)) for i in y]) if ok else ([], [])

    return both


def brute(encoders, rows):
    held, per_doc = Counter(), []
    for _, text in rows:
        x, y = encoders(text)
        ends = [np.cumsum([len(w) for _, w in side]).tolist() for side in (x, y)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for cut in cuts:
            groups.append([[i for (i, _), e in zip(side, own) if start < e <= cut] for side, own in zip((x, y), ends)])
            start = cut
        links = Counter(p for a, b in groups for p in product(a, b))
        held.update(links.keys())
        per_doc.append((len(x), len(y), groups, links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for (doc, _), (n_a, n_b, groups, links) in zip(rows, per_doc):
        form = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        n_best = sum(n for (a, b), n in links.items() if held[a, b] == top[a])
        total = sum(n * held[p] for p, n in links.items())
        sha = hashlib.sha256(form.encode()).hexdigest() if form else ""
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), n_best, total, sha))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("doc", "block", "pair", "place", "docs", "a", "n_a", "total"):
        df = df.withColumn(name, F.lit(-1))
    return df


def ours(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


ODD = [
    "plain words, and more words.",
    "plain words, and more words.",
    "",
    None,
    "a <|endoftext|> b <s> </s> <unk> <0x41>",
    "mark ▁ inside",
    "  two  blanks   and three \n new \t tab \r\n end  ",
    " ",
    "\n",
    "x\x00y \x7f é̈ ﬁ ℌ ½ 汉字 漢字 Ж 🏳️‍🌈    ​",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 3,
    "日本語のテキスト" * 40,
    "=" * 500 + "\n" * 30 + "-" * 77,
]


def test_against_brute_force(spark, encoders):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "repeated id"), (2**62 + 1, "large id words")]
    expected = brute(encoders, rows)
    assert sum(r[3] for r in expected) > 100
    for block in (1, 200, 1 << 23):  # however documents are put in blocks
        assert ours(alignment.align(frame(spark, rows), A, B, block=block)) == expected


def test_given_documents(spark, encoders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert ours(alignment.align(docs, A, B)) == brute(encoders, rows)


def test_cuts_are_all_common_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000):
        for _ in range(30):
            last = int(rng.integers(n, 4 * n + 1))
            ends = [np.unique(np.append(rng.integers(1, last + 1, n), last)) for _ in "ab"]
            common = np.intersect1d(*ends)
            a, b = alignment.groups(*ends, *(np.array([0, len(e)]) for e in ends))
            assert (ends[0][a - 1] == common).all() and (ends[1][b - 1] == common).all()


def test_large_group_by_distinct_ids(monkeypatch):
    """Links of a group beyond the bound are counted from its distinct ids."""
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 5, 60).astype(np.uint32) for _ in "ab"]
    starts, sizes = np.array([0, 50, 55]), np.array([50, 5, 5])
    args = (*ids, starts, sizes, starts, sizes, np.array([0, 0, 1]), (7, 9))
    whole = alignment.linked(*args)
    for bound in (1, 10, 100, 2499):
        monkeypatch.setattr(alignment, "LINKS", bound)
        assert all((x == y).all() for x, y in zip(alignment.linked(*args), whole))


def test_no_rows(spark):
    assert ours(alignment.align(frame(spark, []), A, B)) == []
    assert ours(alignment.align(frame(spark, [(1, None)]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]
