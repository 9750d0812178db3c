"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text's encoding is the segmentation into pieces with the highest sum of the
model's piece scores. Short texts are solved at once. Giant ones are split into
chunks of equal length: the state at a border is how far the piece over it
reaches into the next chunk, and each chunk yields a matrix of best scores from
state to state. Matrices are multiplied (max, plus) in groups, the chain of
products gives the best states at all borders, and every chunk is backtraced on
its own between its two states.

Among paths of equal score the one with the longest last piece wins, then the
longest piece before it, and so on. A matrix carries that order too: for every
state it ends in, the rank of the states it may start from. So ids do not depend
on how a text is split.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.batches import Strings, by_group
from hirelens.sources.shared import scratch_folder, stored

SPACE_MARK = "▁"
WORD = re.compile(r" +[^ ]*|[^ ]+")
START = re.compile(r"(?<! ) ")
CHUNK = 1 << 14
GROUP = 256
NEVER = -np.inf
MOST_WORDS = 150_000
KEY = "doc long, version long"
CHUNKS = f"{KEY}, k long, part string, length int, final boolean"
TRANSFERS = f"{KEY}, k long, m binary, ranks binary, middle binary, length int, first int, last int, rim string"
DIGESTS = "n_tokens long, ids_crc32 long, score double, decoded_sha256 string"


class Pieces:
    """The model's pieces with blanks for the space mark, best paths, and decoding."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = {i: model.id_to_piece(i).replace(SPACE_MARK, " ") for i in plain}
        self.id = {t: i for i, t in texts.items()}
        self.score = {t: model.get_score(i) for i, t in texts.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = {i: t.encode() for i, t in texts.items()}
        self.text |= {i: bytes([b]) for b, i in enumerate(self.bytes)}
        # If only runs of blanks hold a blank after their first character, no piece reaches over
        # the start of such a run: from one run to the next a text can be solved on its own.
        over = [p for p in self.score if " " in p[1:] and p.strip(" ")]
        if over:
            raise ValueError(f"piece {over[0]!r} reaches over the start of a word")
        self.longest = max(map(len, self.score), default=1)
        self.fallback = min(self.score.values(), default=0.0) - 10
        # Pieces and all their beginnings; a beginning that is no piece can't be taken.
        self.table = {p[:n]: NEVER for p in self.score for n in range(1, len(p))} | self.score
        # Score by id; a character in bytes pays once, at its first byte.
        self.scores = np.zeros(len(ids))
        self.scores[list(texts)] = [self.score[t] for t in texts.values()]
        self.scores[[i for b, i in enumerate(self.bytes) if not 0x80 <= b < 0xC0]] = self.fallback
        self.strings = Strings([self.text.get(i, b"") for i in ids])
        self.known = Words(self, path)

    def forward(self, s: str, start: int, stop: int, last: int) -> tuple[list[float], list[int]]:
        """Best scores of segmenting s[start:end] for every end up to ``stop``, and the last starts.

        Pieces start at ``last`` or before. Among equal scores the longest last
        piece wins. A character without a piece falls back to its bytes.
        """
        n = stop - start
        best, back = [NEVER] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        get = self.table.get
        for b in range(min(n, last - start + 1)):
            so_far = best[b]
            if so_far == NEVER:
                continue
            at = start + b
            for end in range(b + 1, n + 1):
                v = get(s[at : start + end])
                if v is None:
                    break
                v += so_far
                if v > best[end]:
                    best[end], back[end] = v, b
            if s[at] not in self.score and so_far + self.fallback > best[b + 1]:
                best[b + 1], back[b + 1] = so_far + self.fallback, b
        return best, back

    def between(self, s: str, start: int, stop: int, last: int | None = None) -> bytes:
        """Ids of the best path through s[start:stop]."""
        _, back = self.forward(s, start, stop, stop if last is None else last)
        ids, end = [], stop - start
        while end > 0:
            piece = s[start + back[end] : start + end]
            if piece in self.id:
                ids.append(self.id[piece])
            else:
                ids += [self.bytes[b] for b in reversed(piece.encode())]
            end = back[end]
        return array("I", ids[::-1]).tobytes()

    def decoded(self, ids: bytes) -> bytes:
        """What ids stand for, without the first blank."""
        return self.strings.joined(np.frombuffer(ids, "<u4")).tobytes()[1:]

    def total(self, ids: bytes) -> float:
        return float(self.scores[np.frombuffer(ids, "<u4")].sum())

    def words(self, s: str) -> bytes:
        """The same for a text that is empty or starts with a run of blanks, by spans of words."""
        return self.known.whole(s)

    def syncs(self, s: str, length: int) -> tuple[int, int] | None:
        """The first and the last start of a run of blanks in a chunk, both on every path.

        The first comes after any piece that reaches in from the chunk before.
        """
        first = START.search(s, self.longest, length)
        if not first:
            return None
        last = s.rfind(" ", first.start(), length)
        while last > first.start() and s[last - 1] == " ":
            last -= 1
        return first.start(), last

    def matrix(self, s: str, length: int, final: bool) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Best scores from state to state for a chunk of ``length`` characters and what follows.

        Also the ranks of the entry states among paths of equal score, and the
        ids between the first and the last sync, which no state changes.
        """
        size = self.longest
        out, order = np.full((size, size), NEVER), np.full((size, size), size, np.int16)
        top = 0 if final else min(size - 1, len(s) - length)
        sync = self.syncs(s, length)
        if sync:
            first, last = sync
            middle = self.words(s[first:last])
            tail, _ = self.forward(s, last, length + top, length - 1)
            ends = np.array(tail[length - last :]) + self.total(middle)
            heads = [self.forward(s, i, first, first) for i in range(size)]
            for i, (best, _) in enumerate(heads):
                out[i, : top + 1] = best[-1] + ends
            order[:, : top + 1] = ranked([cuts(back, i, first) for i, (_, back) in enumerate(heads)], size)[:, None]
            return out, order, middle
        entries = range(min(size, length + 1))
        found = [self.forward(s, i, length + top, length - 1) for i in entries if i < length]
        for i, (best, _) in enumerate(found):
            out[i, : top + 1] = best[length - i :]
        if length < size:  # the piece that reaches in ends where the chunk does
            out[length, 0] = 0.0
        for j in range(top + 1):
            paths = [cuts(back, i, length + j) if best[length + j - i] > NEVER else None for i, (best, back) in enumerate(found)]
            order[:, j] = ranked([*paths, *([[-1] if not j else None] * (length < size))], size)
        return out, order, b""

    def ends(self, rim: str, length: int, first: int, last: int, entry: int, leave: int) -> tuple[bytes, bytes]:
        """Ids of a chunk before and after its middle, between two states.

        ``rim`` is the chunk and what follows without the middle, which lies
        from ``first`` to ``last``; without syncs (-1) it is all of it.
        """
        if entry == length + leave:
            return b"", b""
        if first < 0:
            return self.between(rim, entry, length + leave, length - 1), b""
        cut = last - first
        return self.between(rim, entry, first), self.between(rim, first, length + leave - cut, length - 1 - cut)


def exact_model(path: str, scores: dict[str, float], first_blank: bool) -> tuple[bytes, int] | None:
    """The model for the library's own best-path search, and the longest text it solves exactly.

    That search adds in single precision, relative to the lowest score: exact
    for whole scores while sums stay below 2**23. A lowest score that only runs
    of blanks have is raised to the next one, so an answer for words parted by
    single blanks holds if no word starts with the blank alone, or if no piece
    has that blank and the word's first character. None if a
    score is not whole or not negative (such a piece may be user-defined, for
    which the library has rules of its own).
    """
    if not all(v < 0 and v.is_integer() for v in scores.values()):
        return None
    with open(path, "rb") as file:
        model = file.read()
    lowest = min(scores.values(), default=-1.0)
    written = [v for p, v in scores.items() if p.strip(" ")]
    if written and lowest not in written:
        model = model.replace(_score(lowest), _score(min(written)))
        lowest = min(written)
    # Fields given again replace the former: best path by score, no normalisation, a first blank or none.
    model += b"\x12\x02\x18\x01" + b"\x1a\x08\x12\x00\x18%c\x20\x00\x28\x01" % first_blank
    return model, int(2**23 // -lowest)


def _score(value: float) -> bytes:
    """A piece's score as the model file holds it."""
    return b"\x15" + struct.pack("<f", value)


class Words(dict):
    """Ids of words without their first blank; of two generations, the older one is dropped.

    Texts are cut into spans of words made of characters that are all pieces
    themselves, as long as the library's search is exact, and it solves all of
    a text's spans together. The table is for the rest: words it may have
    started with the blank alone wrongly, runs of blanks, longer words. New ones
    go to the library together if they can; the others are solved here one by
    one. A character that no piece holds, like a line break, parts a word: what
    comes after it has a table of its own.
    """

    def __init__(self, solver: Pieces, path: str):
        super().__init__()
        self.solver, self.older = solver, {}
        letters = "".join(p for p in solver.score if len(p) == 1 and p != " ")
        held = "".join(sorted({c for p in solver.score for c in p}))
        self.part = re.compile(f"([^{re.escape(held)}])").split if held else lambda word: [word]
        self.quick = quick_search(path, solver.score, True) if letters and " " in solver.score else None
        self.after = Tails(solver, None)
        if self.quick:
            self.letters = set(letters)
            self.plain = re.compile(f"[{re.escape(letters)}]{{1,{self.quick[1]}}}").fullmatch
            self.search = quick_search(path, solver.score, False)[0]
            self.after = Tails(solver, (self.search, self.plain))
            # Spans end before a blank that starts a run, or a character that no piece holds;
            # what is no span is such a character, a word, or a run of blanks without a word.
            ends = f"\\Z|(?=[^{re.escape(held)}])|(?<! )(?= )"
            rest = f"[^{re.escape(held)}]| *[{re.escape(held.replace(' ', ''))}]+| +"
            self.spans = re.compile(f"([{re.escape(letters)} ]{{1,{self.quick[1]}}}(?:{ends}))|({rest})").findall
            self.blank = solver.id[" "]
            self.opening = {i for p, i in solver.id.items() if p[0] == " "}
            starts = {p[1] for p in solver.score if len(p) > 1 and p[0] == " "}
            self.doubtful = {i for p, i in solver.id.items() if p[0] in starts}

    def turn(self) -> None:
        if len(self) > MOST_WORDS:
            self.older = dict(self)
            self.clear()

    def whole(self, s: str) -> bytes:
        """Ids of a text that is empty or starts with a run of blanks."""
        self.turn()
        if not self.quick:
            return self.each(s)
        found = self.spans(s)
        solved = iter(self.search([span for span, _ in found if span], out_type=int, num_threads=1))
        return b"".join([self.checked(span, next(solved)) if span else self.one(rest) for span, rest in found])

    def checked(self, span: str, ids: list[int]) -> bytes:
        """The library's ids of a span, with words by the table that a blank alone may wrongly start."""
        if "  " in span:
            return self.each(span)
        held, blank = array("I", ids).tobytes(), self.blank
        if blank not in ids or not any(a == blank and b in self.doubtful for a, b in pairwise(ids)):
            return held
        starts = [i for i, x in enumerate(ids) if x in self.opening]  # one for each word with its blank
        out = [held[: 4 * starts[0]]]
        for word, i, end in zip(span.split(" ")[1:], starts, [*starts[1:], len(ids)]):
            doubt = ids[i] == blank and i + 1 < end and ids[i + 1] in self.doubtful
            out.append(self[word] if doubt else held[4 * i : 4 * end])
        return b"".join(out)

    def each(self, span: str) -> bytes:
        """Ids of a span by the table of words."""
        found = WORD.findall(span)
        self.learn([w[1:] for w in found if w[0] == " "])
        return b"".join(map(self.one, found))

    def one(self, word: str) -> bytes:
        """Ids of a word with its blanks, or of what comes after a character that no piece holds, or that itself."""
        return self[word[1:]] if word[0] == " " else self.after[word]

    def learn(self, words: list[str]) -> None:
        if self.quick:
            new = [w for w in set(words) if w not in self]
            if self.older:
                new = [w for w in new if w not in self.older]
            if not (set("".join(new)) <= self.letters and max(map(len, new), default=1) <= self.quick[1]):
                new = filter(self.plain, new)
            new = [w for w in new if w]
            if new:
                blank = self.solver.id[" "]
                for word, ids in zip(new, self.quick[0](new, out_type=int, num_threads=1)):
                    if ids[0] != blank:
                        self[word] = array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            first, *rest = self.part(word)
            if rest:
                return self[first] + b"".join(map(self.after.__getitem__, rest))
            ids = self.solver.between(" " + word, 0, len(word) + 1)
        self[word] = ids
        return ids


class Tails(dict):
    """Ids of parts of words, after a character that no piece holds or such a character itself."""

    def __init__(self, solver: Pieces, quick: tuple | None):
        super().__init__()
        self.solver, self.quick = solver, quick

    def __missing__(self, part: str) -> bytes:
        if len(self) > MOST_WORDS // 4:
            self.clear()
        if self.quick and self.quick[1](part):
            ids = array("I", self.quick[0](part, out_type=int)).tobytes()
        else:
            ids = self.solver.between(part, 0, len(part))
        self[part] = ids
        return ids


def quick_search(path: str, scores: dict[str, float], first_blank: bool) -> tuple | None:
    """The library's search in the exact model, and its longest word."""
    from sentencepiece import SentencePieceProcessor

    exact = exact_model(path, scores, first_blank)
    return exact and (SentencePieceProcessor(model_proto=exact[0]).encode, exact[1])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def cuts(back: list[int], start: int, end: int) -> list[int]:
    """Where the pieces of a path start, from its last one to ``start``; before that, over the border, is -1."""
    places, at = [], end - start
    while at > 0:
        at = back[at]
        places.append(start + at)
    return [*places, -1]


def ranked(paths: list[list[int] | None], size: int) -> np.ndarray:
    """Rank of each path; the first piece from the right that starts earlier wins. None comes last."""
    ranks = np.full(size, size, np.int16)
    there = sorted((p, i) for i, p in enumerate(paths) if p is not None)
    for rank, (_, i) in enumerate(there):
        ranks[i] = rank
    return ranks


def times(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Max-plus product of two pairs of scores and ranks."""
    size = len(a[0])
    total = a[0][:, :, None] + b[0][None, :, :]
    best = total.max(axis=1)
    via = np.where((total == best[:, None, :]) & (total > NEVER), b[1][None, :, :], size + 1).argmin(axis=1)
    columns, rows = np.arange(size)[None, :], np.arange(size)[:, None]
    # First the state in between, by the right matrix; then the left one's rank for that state.
    key = np.where(best > NEVER, b[1][via, columns].astype(np.int64) * (size + 1) + a[1][rows, via], 1 << 40)
    ranks = np.where(best > NEVER, key.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable"), size)
    return best, ranks.astype(np.int16)


def best_states(matrices: list[tuple[np.ndarray, np.ndarray]], entry: int, leave: int) -> list[int]:
    """The states at all borders of a chain between two given ones, both included."""
    size = len(matrices[0][0])
    scores = [np.where(np.arange(size) == entry, 0.0, NEVER)]
    for m, _ in matrices:
        scores.append((scores[-1][:, None] + m).max(axis=0))
    states = [leave]
    for (m, ranks), before in zip(reversed(matrices), reversed(scores[:-1])):
        total = before + m[:, states[-1]]
        possible = (total == total.max()) & (total > NEVER)
        states.append(int(np.where(possible, ranks[:, states[-1]], size + 1).argmin()))
    return states[::-1]


def _square(scores: bytes, ranks: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(scores)
    size = int(len(m) ** 0.5)
    return m.reshape(size, -1), np.frombuffer(ranks, np.int16).reshape(size, -1)


def _giants(giants: DataFrame, model: str, chunk: int) -> DataFrame:
    """(doc, version, ids, score, n_chunks) of giant texts (doc, version, text), each once.

    Every chunk is a row of its own before any work is done on it, and the rows
    are dealt to a stated number of tasks, since they are small for their cost.
    """
    spark = giants.sparkSession
    folder = scratch_folder(spark, "transfers")
    reach = pieces(model).longest - 1
    key = ["doc", "version"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            for doc, version, text in zip(batch["doc"], batch["version"], batch["text"]):
                s = " " + text
                rows = ((doc, version, p // chunk, s[p : p + chunk + reach], min(chunk, len(s) - p), p + chunk >= len(s)) for p in range(0, len(s), chunk))
                while part := list(islice(rows, 64)):  # bounded batches of a giant text
                    yield pd.DataFrame(part, columns=names)

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solver = pieces(model)
        names = [c.split()[0] for c in TRANSFERS.split(", ")]
        for batch in batches:
            rows = zip(*(batch[c].tolist() for c in ("doc", "version", "k", "part", "length", "final")))
            while part := list(islice(rows, 256)):
                yield pd.DataFrame([(doc, version, k, *_transfer(solver, *x)) for doc, version, k, *x in part], columns=names)

    chunks = giants.mapInPandas(cut, CHUNKS).repartition(parts, *key, "k").dropDuplicates([*key, "k"])
    transfer = stored(
        chunks.mapInPandas(transfers, TRANSFERS).withColumn("g", F.floor(F.col("k") / GROUP)), f"{folder}/chunks"
    )
    matrix = transfer.select(*key, "k", "g", "m", "ranks")

    def product(rows: list[tuple]) -> Iterator[tuple]:
        total = None
        for _, scores, ranks in rows:
            one = _square(scores, ranks)
            total = one if total is None else times(total, one)
        yield total[0].tobytes(), total[1].tobytes()

    def chained(rows: list[tuple]) -> Iterator[tuple]:
        states = best_states([_square(*m) for _, *m in rows], 0, 0)
        return ((g, entry, leave) for (g, *_), entry, leave in zip(rows, states, states[1:]))

    def inner(rows: list[tuple]) -> Iterator[tuple]:
        states = best_states([_square(m, r) for _, m, r, *_ in rows], rows[0][3], rows[0][4])
        return ((k, entry, leave) for (k, *_), entry, leave in zip(rows, states, states[1:]))

    products = by_group(matrix, [*key, "g"], ["k"], product, f"{KEY}, g long, m binary, ranks binary", parts)
    chain = by_group(products, key, ["g"], chained, f"{KEY}, g long, entry int, leave int", parts)
    known = matrix.join(chain, [*key, "g"]).select(*key, "g", "k", "m", "ranks", "entry", "leave")
    borders = by_group(known, [*key, "g"], ["k"], inner, f"{KEY}, g long, k long, entry int, leave int", parts)

    def whole(rows: list[tuple]) -> Iterator[tuple]:
        solver, ids = pieces(model), []
        for _, middle, *state in rows:
            head, tail = solver.ends(*state)
            ids += [head, middle, tail]
        ids = b"".join(ids)
        yield ids, solver.total(ids), len(rows)

    traced = transfer.select(*key, "k", "middle", "rim", "length", "first", "last").join(borders.drop("g"), [*key, "k"])
    return by_group(traced, key, ["k"], whole, f"{KEY}, ids binary, score double, n_chunks int", parts)


def _transfer(solver: Pieces, part: str, length: int, final: bool) -> tuple:
    """Matrix, ranks and middle ids of a chunk, and the text around the middle."""
    m, ranks, middle = solver.matrix(part, length, final)
    first, last = solver.syncs(part, length) or (-1, -1)
    return m.tobytes(), ranks.tobytes(), middle, length, first, last, part if first < 0 else part[:first] + part[last:]


def _rows(docs: DataFrame, model: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text) of short texts, and (doc_id, ids, score, n_chunks) of giant ones."""
    if chunk <= pieces(model).longest:
        raise ValueError("a chunk must be longer than any piece")
    rows = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"),
        F.xxhash64("text").alias("version"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    giant = F.length("text") >= chunk
    large = rows.where(giant)
    found = _giants(large.select("doc", "version", "text"), model, chunk)
    large = large.select("doc_id", "doc", "version").join(found, ["doc", "version"])
    return rows.where(~giant).select("doc_id", "text"), large.select("doc_id", "ids", "score", "n_chunks")


def encode(docs: DataFrame, model: str, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, score, n_chunks) for every row of ``docs`` (doc_id, text).

    ids are 32-bit little-endian numbers. Texts get the leading blank that the
    model expects; no other normalisation is done, and characters without a
    piece, the space mark itself included, become byte pieces. Null and empty
    texts are that blank alone. Texts of ``chunk`` characters or more go
    through the scan; if the scores are whole numbers, their ids and scores are
    those of the direct way. Repeated rows are encoded as often as they occur;
    no rows give no rows.
    """

    @F.pandas_udf("ids binary, score double")
    def solved(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        solver = pieces(model)
        for texts in batches:
            ids = [solver.words(" " + t) for t in texts]
            yield pd.DataFrame({"ids": ids, "score": [solver.total(x) for x in ids]})

    small, large = _rows(docs, model, chunk)
    small = small.select("doc_id", solved("text").alias("x"))
    return small.select("doc_id", "x.ids", "x.score", F.lit(1).alias("n_chunks")).unionAll(large)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        solver = pieces(model)
        for batch in batches:
            yield pd.Series([None if x is None else solver.decoded(x).decode() for x in batch], dtype=object)

    return encoded.withColumn("text", decoded("ids"))


def round_trip(docs: DataFrame, model: str, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chunks, DIGESTS) of every row encoded and its ids decoded again.

    The digests are the number of ids, their CRC-32, the score, and the SHA-256
    of the decoded text. Both ways are done in one call, so ids and texts stay
    where they are. Texts are treated as by ``encode``.
    """

    def digest(solver: Pieces, ids: bytes) -> tuple:
        return len(ids) // 4, zlib.crc32(ids), solver.total(ids), hashlib.sha256(solver.decoded(ids)).hexdigest()

    names = [c.split()[0] for c in DIGESTS.split(", ")]

    @F.pandas_udf(DIGESTS)
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        solver = pieces(model)
        for texts in batches:
            yield pd.DataFrame([digest(solver, solver.words(" " + t)) for t in texts], columns=names)

    @F.pandas_udf(DIGESTS)
    def of_ids(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        solver = pieces(model)
        for batch in batches:
            yield pd.DataFrame([digest(solver, x) for x in batch], columns=names)

    small, large = _rows(docs, model, chunk)
    small = small.select("doc_id", F.lit(1).alias("n_chunks"), of_texts("text").alias("x"))
    large = large.select("doc_id", "n_chunks", of_ids("ids").alias("x"))
    return small.unionAll(large).select("doc_id", "x.n_tokens", "x.ids_crc32", "x.score", "n_chunks", "x.decoded_sha256")
