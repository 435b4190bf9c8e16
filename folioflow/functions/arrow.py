"""Arrow-batched helpers that need no session at import time."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_batched(result_type: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF whose DDL result type is parsed when a plan uses it."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        @functools.wraps(fn)
        def column(*cols) -> Column:
            return F.pandas_udf(fn, result_type)(*cols)

        return column

    return wrap
