"""Cost-balanced packing of tokenized documents into sequences.

Documents are cut at multiples of the sequence length; the pieces are dealt by
hash into groups of a bounded number of tokens. Within a group pieces go, by
descending cost, to the sequence with the lowest estimated cost (linear plus
quadratic in the length of each piece) that has room for them. A piece for which
no sequence has room is cut: the cheapest sequence with any room left takes what
it can. So all the padding of a group is less than one sequence.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.sources.shared import scratch_folder, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
END_ID = 0
# Fixed value: the pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space between two white-space characters (or before the end) belongs to their run.
JOINED = re.compile(r"\s (?:\s|\Z)")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordIds(dict):
    """Ids of texts as bytes, by a table of the words met so far.

    The strings of the vocabulary's added tokens, like the end of a text, are
    found in a text first and give their own ids, as in ``tokenizers``.

    The vocabulary's pattern never lets a piece reach over a space that starts
    a word, so a text's ids are those of its words one after the other. A text
    with a longer run of white space is encoded as a whole. The vocabulary is
    read from its tokenizers file; tiktoken, which gives the same ids, encodes.
    """

    def __init__(self, path: str, most: int = 200_000):
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        added = described["added_tokens"]
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("an added token that looks at what is around it is not supported")
        special = {t["content"]: t["id"] for t in added}
        self.special = {text: number.to_bytes(4, "little") for text, number in special.items()}
        longest_first = sorted(map(re.escape, special), key=len, reverse=True)
        self.part = re.compile(f"({'|'.join(longest_first)})").split if special else lambda text: [text]
        letters = byte_alphabet()
        ranks = {
            bytes(letters[c] for c in token): number
            for token, number in described["model"]["vocab"].items()
            if token not in special
        }
        coding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ids, self.most = coding.encode_ordinary, most

    def encoded(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.encoded(" " + word)
        return found

    def __call__(self, text: str) -> bytes:
        first, *rest = self.part(text)
        if rest:
            return b"".join(self.special.get(part) or self.plain(part) for part in (first, *rest))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if JOINED.search(text):
            return self.encoded(text)
        if len(self) > self.most:
            self.clear()
        first, *words = text.split(" ")
        return self.encoded(first) + b"".join(map(self.__getitem__, words))


def pieces(docs: DataFrame, vocabulary: str, length: int = 1024) -> DataFrame:
    """Tokenize (doc_id, text) and cut: one row per piece of at most ``length`` ids.

    A document's ids end with id 0, so a null or empty text has that one id.
    Pieces that may be cut again carry their ids, 32-bit little-endian.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = WordIds(vocabulary)
        frame = lambda rows: pd.DataFrame(rows, columns=[*NAMES, "ids"]).astype({"doc_id": "Int64"})
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = memoryview(encode(text) + END_ID.to_bytes(4, "little"))
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rest = bytes(piece) if n - start < length else None
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, rest))
                    if len(rows) == 4096:
                        yield frame(rows)
                        rows = []
            yield frame(rows)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, f"{PIECES}, ids binary")


def assign(lengths: list[int], room: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) for pieces in descending order of length."""
    n = max(1, math.ceil(sum(lengths) / room))
    used, cost = np.zeros(n, np.int64), np.zeros(n)
    out = []
    for i, size in enumerate(lengths):
        at = 0
        while at < size:
            rest = size - at
            fits = used <= room - rest
            if not fits.any():
                fits = used < room
            k = int(np.where(fits, cost, np.inf).argmin())
            part = min(rest, room - int(used[k]))
            out.append((i, at, part, k, int(used[k])))
            used[k] += part
            cost[k] += linear * part + quadratic * part * part
            at += part
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    length: int = 1024,
    group_tokens: int = 1 << 21,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
) -> DataFrame:
    """Pack (doc_id, text); returns one row per piece, see ``PACKED``.

    Cost per token pair and per token are ``quadratic`` and ``linear``.
    Repeated rows are packed as often as they occur; no rows give no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, length), scratch_folder(spark, "pieces"))
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = math.ceil(total / group_tokens) or 1

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]
        ).reset_index(drop=True)
        first, ids = int(group["dealt"].iloc[0]) << 32, group["ids"]
        whole = group[NAMES].itertuples(index=False, name=None)
        whole = [(None if pd.isna(r[0]) else r[0], *r[1:]) for r in whole]
        rows = []
        for i, at, part, k, offset in assign(group["length"].tolist(), length, linear, quadratic):
            doc, start, size, crc, tokens = whole[i]
            if part < size:
                crc = zlib.crc32(memoryview(ids[i])[4 * at : 4 * (at + part)])
            rows.append((doc, start + at, part, crc, tokens, first + k, offset))
        out = pd.DataFrame(rows, columns=[*NAMES, "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})

    dealt = F.pmod(
        F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)
    ).alias("dealt")
    return (
        cut.select("*", dealt)
        .groupBy("dealt")
        .applyInPandas(packed, PACKED)
    )
