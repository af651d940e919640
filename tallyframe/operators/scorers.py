"""Calls to an outside scorer, in batches with retries; the scorer itself is given by the caller."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

# Answers after which a call is made again.
RETRIED = (408, 425, 429, 500, 502, 503, 504)
# Seconds before the second and the third call, by what is called.
PAUSES = {"recognition": (0.9, 1.8), "review": (1.2, 2.4), "images": (15.0, 30.0)}


class Refused(Exception):
    def __init__(self, status: int):
        super().__init__(status)
        self.status = status


def with_retries(call: Callable[[], pd.DataFrame], attempts: int = 3, pause: float | Sequence[float] = 0.9, sleep: Callable[[float], None] = time.sleep) -> pd.DataFrame:
    """The call's result; after a passing failure again, after pauses that grow by `pause`, or are those given (the last one again)."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Refused as e:
            if e.status not in RETRIED or n == attempts:
                raise
        except ConnectionError:
            if n == attempts:
                raise
        sleep(pause * n if isinstance(pause, (int, float)) else pause[min(n, len(pause)) - 1])
    raise AssertionError


def scored(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], out: str, rows: int = 16, attempts: int = 3, pause: float | Sequence[float] = 0.9) -> DataFrame:
    """df's rows through the scorer, at most `rows` at a time. Filters belong before this: they are not moved through it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                yield with_retries(lambda part=part: scorer(part), attempts, pause)

    return df.mapInPandas(run, out)
