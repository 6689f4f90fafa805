"""The adaptive threshold of one-class distances as a stateful stream, restarted anywhere."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Trailing:
    """The last values of a stream, and any of them by rank: sorted blocks with their counts, so that a value comes, goes and is found in logarithmic time and one short move."""

    BLOCK = 256

    def __init__(self, most: int, values: Iterable[float] = ()):
        self.most, self.recent, self.blocks = most, deque(), []
        for v in values:
            self.add(v)

    def __len__(self) -> int:
        return len(self.recent)

    def _of(self, v: float) -> int:
        """The first block that may hold v."""
        return min(bisect_left(self.blocks, v, key=lambda b: b[-1]), len(self.blocks) - 1)

    def add(self, v: float) -> None:
        self.recent.append(v)
        if not self.blocks:
            self.blocks.append([v])
        else:
            k = self._of(v)
            insort(self.blocks[k], v)
            if len(self.blocks[k]) > self.BLOCK:
                half = self.BLOCK // 2
                self.blocks[k : k + 1] = [self.blocks[k][:half], self.blocks[k][half:]]
        if len(self.recent) > self.most:
            gone = self.recent.popleft()
            k = self._of(gone)
            self.blocks[k].pop(bisect_left(self.blocks[k], gone))
            if not self.blocks[k]:
                del self.blocks[k]

    def ranked(self, k: int) -> float:
        """The k-th smallest value, from 0."""
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)

    def quantile(self, q: float) -> float:
        """Linearly interpolated; equal neighbours give their value, infinite ones too."""
        at = q * (len(self) - 1)
        low = int(at)
        a, b = self.ranked(low), self.ranked(min(low + 1, len(self) - 1))
        return a if a == b else a + (b - a) * (at - low)


def adaptive_stream(df: DataFrame, distance: str, *by: str, order: str = "seq", contamination: float = 0.025, most: int = 4000, least: int = 200, fallback: float = math.inf, reset: str | None = None) -> DataFrame:
    """Rows (by, order, distance) of a stream with threshold and flag (the distance is above it).

    The threshold is the quantile of the last distances of the session, this one included, and the fallback until there are
    enough. Rows of a session are taken in order within a trigger; those of later triggers follow. A null or NaN distance
    isn't counted, has the threshold of those before it, and no flag. Where reset names a boolean column, a row where it is true
    begins anew. The state of a session is its last distances, at most so many, so a stream may stop and go on anywhere.
    """
    if not 0 < contamination < 1 or not 1 <= least <= most:
        raise ValueError("0 < contamination < 1 and 1 <= least <= most are required")
    columns = [*by, order, distance]
    out = T.StructType([*df.select(*columns).schema.fields, T.StructField("threshold", T.DoubleType()), T.StructField("flag", T.BooleanType())])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trailing = Trailing(most, state.get[0] if state.exists else ())
        rows = pd.concat(frames).sort_values(order, kind="stable")
        begins = rows[reset].fillna(False) if reset else [False] * len(rows)
        thresholds, flags = [], []
        for d, begin in zip(rows[distance], begins):
            if begin:
                trailing = Trailing(most)
            known = d is not None and not math.isnan(d)
            if known:
                trailing.add(float(d))
            thresholds.append(trailing.quantile(1 - contamination) if len(trailing) >= least else fallback)
            flags.append(bool(known and d > thresholds[-1]))
        state.update((list(trailing.recent),))
        yield rows[columns].assign(threshold=thresholds, flag=flags)

    return df.groupBy(*by).applyInPandasWithState(update, out, "recent array<double>", "append", GroupStateTimeout.NoTimeout)
