"""Calls to a service paced per key.

All batches of one service key go through one task, one after the other, so a key's
calls keep their distance without any shared clock. That is a limit of the service,
not of the data: with more keys, more tasks work.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.operators.reconcile import Mapper, OversizeError, map_batches

_RETRY_IN, _RETRY_FIELD = re.compile(K.RETRY_IN), re.compile(K.RETRY_FIELD)


def named_delay(message: str) -> float | None:
    """Seconds that an error message asks to wait, with a margin; None if it is no rate limit."""
    low = message.lower()
    if not any(word in low for word in K.RATE_LIMIT_WORDS):
        return None
    for pattern in (_RETRY_IN, _RETRY_FIELD):
        found = pattern.search(message)
        if found:
            try:
                return float(found[1]) + K.RETRY_MARGIN
            except ValueError:  # such as "1.2.3"
                continue
    return K.RETRY_DEFAULT


class PacedMapper:
    """A mapper that starts no call within ``interval`` seconds of the last one, and waits where the service says so.

    A call that fails on a rate limit is made again after the delay the message names
    (at most ``longest`` seconds). Other failures are made again after 1, 2, 4 ... seconds,
    up to the cap of ``BACKOFF_CAP``. After ``attempts`` calls the last failure stands.
    """

    def __init__(self, mapper: Mapper, interval: float, attempts: int = 3, longest: float = K.LONGEST_WAIT_SECONDS,
                 clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.mapper, self.interval, self.attempts, self.longest = mapper, interval, attempts, longest
        self.clock, self.sleep = clock, sleep
        self.next_at: float | None = None

    def _wait_until(self, at: float) -> None:
        while (rest := at - self.clock()) > 0:
            self.sleep(rest)

    def __call__(self, segments: Sequence[dict]) -> str:
        for attempt in range(self.attempts):
            if self.next_at is not None:
                self._wait_until(self.next_at)
            self.next_at = self.clock() + self.interval
            try:
                return self.mapper(segments)
            except OversizeError:
                raise  # halving is not waiting
            except Exception as failure:
                if attempt + 1 == self.attempts:
                    raise
                delay = named_delay(str(failure))
                wait = min(2.0 ** attempt, float(K.BACKOFF_CAP)) if delay is None else min(delay, self.longest)
                self.next_at = max(self.next_at, self.clock() + wait)
        raise AssertionError("attempts has to be positive")


def map_paced(batches: DataFrame, make_mapper: Callable[[str], Mapper], keys: Sequence[str], service_keys: Sequence[str],
              interval: float, attempts: int = 3, make_clock: Callable[[], tuple] | None = None) -> DataFrame:
    """``map_batches`` with the batches dealt evenly to service keys, each paced on its own.

    ``make_mapper`` gets the service key. ``make_clock`` may give (clock, sleep) for each
    key. Adds ``service_key`` to the result.
    """
    names = list(service_keys)
    dealt = batches.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(len(names))).cast("int"))
    parts = []
    for slot, name in enumerate(names):  # one partition per key: its calls follow each other in one task
        def make(name=name):
            clock = make_clock() if make_clock else (time.monotonic, time.sleep)
            return PacedMapper(make_mapper(name), interval, attempts, clock=clock[0], sleep=clock[1])

        own = dealt.where(F.col("_slot") == slot).drop("_slot").repartition(1)
        parts.append(map_batches(own, make, keys).withColumn("service_key", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
