"""Results of serving queries that are kept for a while."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

# How long, in seconds, pages of articles and results of a search are kept.
PAGE_SECONDS, SEARCH_SECONDS = 180, 90


class TimedResults:
    """Results by key, each kept for its seconds and then built anew.

    Results are persisted in the executors (spilling to disk) and released when they expire or when
    more than ``most`` are held, the one used longest ago first.  A result whose building fails isn't
    kept, and a lost executor's part is computed again from its lineage.
    """

    def __init__(self, most: int = 64, clock: Callable[[], float] = time.monotonic):
        if most < 1:
            raise ValueError("most must be 1 or more")
        self.most, self.clock = most, clock
        self._held: OrderedDict[Hashable, tuple[float, DataFrame]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def drop(self, key: Hashable) -> None:
        _, df = self._held.pop(key, (0.0, None))
        if df is not None:
            df.unpersist()

    def get(self, key: Hashable, seconds: float, build: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        for old in [k for k, (until, _) in self._held.items() if until <= now]:
            self.drop(old)
        if key not in self._held:
            self._held[key] = (now + seconds, build().persist(StorageLevel.MEMORY_AND_DISK))
            while len(self._held) > self.most:
                self.drop(next(iter(self._held)))
        self._held.move_to_end(key)
        return self._held[key][1]
