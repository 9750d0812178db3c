"""Work on sorted groups of rows and on many short byte strings, in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Strings:
    """Many short byte strings in one buffer, to be joined by their numbers."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(x) for x in strings], np.int32)
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        n = self.length[numbers]
        upto = np.cumsum(n, dtype=np.int32)
        at = np.repeat(self.start[numbers] - upto + n, n)
        at += np.arange(len(at), dtype=np.int32)
        return self.buffer[at]


def by_group(
    df: DataFrame, keys: list[str], order: list[str], solve: Callable[[list[tuple]], Iterator[tuple]], schema: str, parts: int
) -> DataFrame:
    """``solve`` on the rows of each group, in order; its rows follow the group's keys.

    Many small groups go through one Python call each, without a data frame of
    their own. ``parts`` tasks share the groups, however small they are.
    """
    names = [*keys, *(c for c in df.columns if c not in keys)]
    head = len(keys)
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch[c].tolist() for c in names))

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for key, group in groupby(rows(batches), key=itemgetter(*range(head))):
            for row in solve([r[head:] for r in group]):
                out.append((*key, *row))
                size += 100 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
            if size > 1 << 22:
                yield pd.DataFrame(out, columns=columns)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    dealt = df.select(*names).repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(solved, schema)
