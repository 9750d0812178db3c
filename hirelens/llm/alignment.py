"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both token sequences of a text cover the same bytes. A byte offset where tokens
of both end cuts the text in two: one near the middle is looked for by bisecting
the ends of the other sequence, and both halves are cut on in the same way. An
interval without such an offset is a leaf, a group whose tokens are all linked.

How many documents hold a pair of ids linked is counted without sending a row
per document and pair: documents are taken in blocks, each block names its
distinct pairs once, and the sums over all blocks return to it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.batches import Strings
from hirelens.llm.packing import WordIds, byte_alphabet
from hirelens.sources.shared import scratch_folder, stored

SPACE_MARK = "▁"
# Characters of a block; links and tokens that are looked at together.
BLOCK, LINKS, PART = 1 << 22, 1 << 21, 1 << 16
NONE = np.zeros(0, np.uint32)

FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
BLOCKS = (
    "block long, doc string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " places binary, times binary, place int, pair long, docs long"
)
ALIGNED = "doc string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_side(path: str) -> tuple[Callable, list[bytes]]:
    """How a byte-level vocabulary encodes a text, and the bytes of each id."""
    words = WordIds(path)
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    letters, vocab = byte_alphabet(), described["model"]["vocab"]
    special = {t["content"] for t in described["added_tokens"]}
    known = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        known[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    return words.ids, known


def piece_side(path: str) -> tuple[Callable, list[bytes]]:
    """The same of a sentencepiece model, which adds a blank to the text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = ((model.is_byte(i), model.id_to_piece(i)) for i in range(model.get_piece_size()))
    known = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE_MARK, " ").encode() for byte, p in pieces]
    return model.encode_as_numpy, known


class Pair:
    """Two tokenizers with what is looked up by id."""

    def __init__(self, vocabulary: str, model: str):
        (self.a, bytes_a), (self.b, bytes_b) = byte_side(vocabulary), piece_side(model)
        self.sizes = len(bytes_a), len(bytes_b)
        self.sides = Strings(bytes_a), Strings(bytes_b)
        texts = [[str(i).encode() for i in range(n)] for n in self.sizes]
        # The decimal id with the mark after it: in a group, at its end, for both sides.
        marked = ((texts[0], b","), (texts[0], b"|"), (texts[1], b","), (texts[1], b";"))
        self.written = Strings([t + mark for ids, mark in marked for t in ids])

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text with a blank before it, none if one side does not give back its bytes."""
        if text and SPACE_MARK not in text:
            spaced = " " + text
            both = np.array(self.a(spaced), np.uint32), np.asarray(self.b(text)).astype(np.uint32)
            whole = np.frombuffer(spaced.encode(), np.uint8)
            if all(np.array_equal(side.joined(ids), whole) for side, ids in zip(self.sides, both)):
                return both
        return NONE, NONE


@lru_cache(maxsize=1)
def tokenizers(vocabulary: str, model: str) -> Pair:
    return Pair(vocabulary, model)


def near_middle(ea: np.ndarray, eb: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every interval of A tokens lo to hi - 1: the token nearest to the middle that ends where a B token ends.

    The last token's end is not asked for. Also the B token's index; both are
    -1 where there is none. Rings around the middle are tried, each twice as
    wide as the one before.
    """
    middle = (lo + hi - 1) // 2
    cut, partner = np.full(len(lo), -1, np.int32), np.full(len(lo), -1, np.int32)
    where = np.searchsorted(eb, ea[middle])
    hit = eb[where] == ea[middle]
    cut[hit], partner[hit] = middle[hit], where[hit]
    left = np.flatnonzero(~hit & (hi - lo > 2))
    reach = 1
    while len(left):
        far = 2 * reach
        low, high, m = lo[left], hi[left] - 2, middle[left]
        starts = np.stack([np.maximum(low, m - far + 1), m + reach])
        sizes = np.maximum(np.stack([m - reach, np.minimum(high, m + far - 1)]) - starts + 1, 0).ravel()
        owner = np.repeat(np.tile(left, 2), sizes)
        begin = np.repeat(starts.ravel() - (np.cumsum(sizes) - sizes), sizes)
        tried = begin + np.arange(len(owner))
        where = np.searchsorted(eb, ea[tried])
        hit = eb[where] == ea[tried]
        owner, tried, where = owner[hit], tried[hit], where[hit]
        order = np.lexsort((tried, np.abs(tried - middle[owner]), owner))
        owner, tried, where = owner[order], tried[order], where[order]
        first = np.ones(len(owner), bool)
        first[1:] = owner[1:] != owner[:-1]
        cut[owner[first]], partner[owner[first]] = tried[first], where[first]
        left = left[(cut[left] < 0) & ((m - far >= low) | (m + far <= high))]
        reach = far
    return cut, partner


def groups(ea: np.ndarray, eb: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end, as numbers of A and of B tokens, in order.

    ``ea`` and ``eb`` are the ends of all tokens, ``a`` and ``b`` how many of
    them come before each text and in all; a text's last tokens end together.
    """
    lo, hi, lb, hb = a[:-1], a[1:], b[:-1], b[1:]
    some = hi > lo
    lo, hi, lb, hb = lo[some], hi[some], lb[some], hb[some]
    ends_a, ends_b = [], []
    while len(lo):
        cut, partner = np.full(len(lo), -1, np.int32), np.full(len(lo), -1, np.int32)
        large = np.flatnonzero((hi - lo > 1) & (hb - lb > 1))
        cut[large], partner[large] = near_middle(ea, eb, lo[large], hi[large])
        leaf = cut < 0
        ends_a.append(hi[leaf])
        ends_b.append(hb[leaf])
        more = ~leaf
        c, d = cut[more] + 1, partner[more] + 1
        lo, hi = np.concatenate([lo[more], c]), np.concatenate([c, hi[more]])
        lb, hb = np.concatenate([lb[more], d]), np.concatenate([d, hb[more]])
    if not ends_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(ends_a)), np.sort(np.concatenate(ends_b))


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts, as from and to, of at most ``most`` tokens or one text."""
    upto = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right"))
        yield start, max(stop, start + 1)
        start = max(stop, start + 1)


def all_groups(pair: Pair, ids_a: np.ndarray, ids_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of a block end; texts go together in parts that fit a processor's cache."""
    ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in runs(np.diff(a), PART):
        ea = np.cumsum(pair.sides[0].length[ids_a[a[i] : a[j]]], dtype=np.int32)
        eb = np.cumsum(pair.sides[1].length[ids_b[b[i] : b[j]]], dtype=np.int32)
        before = ((n[i : j + 1] - n[i]).astype(np.int32) for n in (a, b))
        end_a, end_b = groups(ea, eb, *before)
        ends_a.append(end_a + a[i])
        ends_b.append(end_b + b[i])
    return np.concatenate(ends_a), np.concatenate(ends_b)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(weights, start)


def linked(ids_a, ids_b, start_a, na, start_b, nb, doc, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, A id, B id) as one number each, and how often they are linked.

    A group of very many links is reduced to its distinct ids first.
    """
    keys, weights = [], []
    links = na * nb
    for g in np.flatnonzero(links > LINKS):
        a, times_a = np.unique(ids_a[start_a[g] : start_a[g] + na[g]], return_counts=True)
        b, times_b = np.unique(ids_b[start_b[g] : start_b[g] + nb[g]], return_counts=True)
        for one, n in zip(a.astype(np.int64), times_a):
            keys.append((doc[g] * sizes[0] + one) * sizes[1] + b)
            weights.append(n * times_b)
    rest = np.flatnonzero(links <= LINKS)
    upto = np.cumsum(links[rest])
    parts = np.searchsorted(upto, np.arange(LINKS, (upto[-1] if len(upto) else 0) + LINKS, LINKS), side="right")
    done = 0
    for stop in parts.tolist():
        chosen = rest[done : max(stop, done + 1)]
        done = max(stop, done + 1)
        if not len(chosen):
            continue
        n = links[chosen]
        group = np.repeat(chosen, n)
        at = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        a = ids_a[start_a[group] + at // nb[group]].astype(np.int64)
        b = ids_b[start_b[group] + at % nb[group]]
        found = summed((doc[group] * sizes[0] + a) * sizes[1] + b, np.ones(len(group), np.int64))
        keys.append(found[0])
        weights.append(found[1])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return summed(np.concatenate(keys), np.concatenate(weights))


def small(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as they need; the first byte tells how many."""
    top = int(numbers.max()) if len(numbers) else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def block_rows(pair: Pair, number: int, docs: list[str], texts: list[str | None]) -> Iterator[pd.DataFrame]:
    """A block's documents and its distinct pairs, see ``BLOCKS``."""
    ids = [pair.ids(t) for t in texts]
    ids_a, ids_b = (np.concatenate([x[side] for x in ids]) for side in (0, 1))
    a, b = (np.cumsum([0, *(len(x[side]) for x in ids)]) for side in (0, 1))
    end_a, end_b = all_groups(pair, ids_a, ids_b, a, b)
    na, nb = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
    start_a, start_b = end_a - na, end_b - nb
    doc = np.searchsorted(a, start_a, side="right") - 1
    of_a, of_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)

    # The written form of all groups: ids of both sides in order, each with the mark that follows it.
    va, vb = pair.sizes
    written = np.empty(len(ids_a) + len(ids_b), np.int64)
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[end_a - 1], last_b[end_b - 1] = True, True
    written[np.arange(len(ids_a)) + start_b[of_a]] = ids_a + va * last_a
    written[np.arange(len(ids_b)) + end_a[of_b]] = ids_b + 2 * va + vb * last_b
    marks = (a + b).tolist()
    hashes = []
    for start, stop in zip(marks, marks[1:]):
        form = pair.written.joined(written[start:stop])
        hashes.append(hashlib.sha256(form[:-1]).hexdigest() if len(form) else "")

    keys, times = linked(ids_a, ids_b, start_a, na, start_b, nb, doc, pair.sizes)
    owner, codes = np.divmod(keys, va * vb)
    distinct, place = np.unique(codes, return_inverse=True)
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
    spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    n = len(docs)
    yield pd.DataFrame(
        {
            "block": number,
            "doc": docs,
            "n_a": np.diff(a),
            "n_b": np.diff(b),
            "n_groups": np.bincount(doc, minlength=n),
            "n_links": np.bincount(doc, na * nb, minlength=n).astype(np.int64),
            "groups_sha256": hashes,
            "places": [small(np.diff(place[i:j], prepend=0)) for i, j in spans],
            "times": [small(times[i:j]) for i, j in spans],
            "place": pd.array([None] * n, "Int32"),
            "pair": pd.array([None] * n, "Int64"),
            "docs": pd.array([None] * n, "Int64"),
        }
    )
    held = np.bincount(place, minlength=len(distinct))
    for i in range(0, len(distinct), 1 << 17):
        part = slice(i, i + (1 << 17))
        m = len(distinct[part])
        none = pd.array([None] * m, "Int64")
        yield pd.DataFrame(
            {"block": number, "doc": None}
            | dict.fromkeys(FIGURES, none)
            | {"groups_sha256": None, "places": None, "times": None}
            | {"place": np.arange(i, i + m, dtype=np.int32), "pair": distinct[part], "docs": held[part]}
        )


def blocks(docs: DataFrame, vocabulary: str, model: str, characters: int = BLOCK) -> DataFrame:
    """Documents (doc, text) in blocks of about so many characters, see ``BLOCKS``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = tokenizers(vocabulary, model)
        number = TaskContext.get().partitionId() << 32
        names, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                names.append(doc)
                texts.append(text)
                size += len(text or "")
                if size >= characters:
                    yield from block_rows(pair, number, names, texts)
                    number, names, texts, size = number + 1, [], [], 0
        if names:
            yield from block_rows(pair, number, names, texts)

    return docs.mapInPandas(cut, BLOCKS)


def rated(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block with the corpus-wide counts of their pairs."""
    order = pairs["place"].to_numpy().argsort()
    total = pairs["total"].to_numpy()[order].astype(np.int64)
    best = pairs["best"].to_numpy()[order].astype(bool)
    n_best, count_sum = [], []
    for places, times in zip(docs["places"], docs["times"]):
        at, n = np.cumsum(unpacked(places)), unpacked(times)
        n_best.append(int(n[best[at]].sum()))
        count_sum.append(int((total[at] * n).sum()))
    return docs.assign(n_best=n_best, count_sum=count_sum)[[c.split()[0] for c in ALIGNED.split(", ")]]


def align(docs: DataFrame, vocabulary: str, model: str, *, block: int = BLOCK) -> DataFrame:
    """Per row of (doc_id, text): tokens, groups and links of two tokenizers, see ``ALIGNED``.

    ``vocabulary`` is a byte-level vocabulary (A), ``model`` a sentencepiece
    model (B). A text that is null or empty, or whose bytes one side does not
    give back, has no tokens. ``n_best`` counts the links whose pair is in as
    many documents as any pair of the same A id, ties included. Repeated rows
    are documents of their own; a null doc_id stays null; no rows give no rows.
    """
    folder = scratch_folder(docs.sparkSession, "alignment")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), "text")
    cut = stored(blocks(rows, vocabulary, model, block), f"{folder}/blocks")
    pairs = cut.where("pair is not null").select("block", "place", "pair", "docs")
    totals = stored(pairs.groupBy("pair").agg(F.sum("docs").alias("total")), f"{folder}/totals")
    a_id = F.floor(F.col("pair") / F.lit(tokenizers(vocabulary, model).sizes[1])).alias("a")
    # At most one row per id of the vocabulary.
    top = totals.groupBy(a_id).agg(F.max("total").alias("top"))
    known = totals.withColumn("a", a_id).join(F.broadcast(top), "a")
    known = known.select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    answers = pairs.join(known, "pair").select(F.col("block").alias("asked_by"), "place", "total", "best")
    texts = cut.where("pair is null").select(
        "block", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times"
    )
    found = texts.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInPandas(rated, ALIGNED)
    return found.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *found.columns[1:])
